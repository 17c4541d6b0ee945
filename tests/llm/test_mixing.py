import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.llm import mixing


def table(documents, prose):
    rows = [(i, prose(i, 5 + i % 40), "en", f"s{i % 5}" if i % 7 else None) for i in range(400)]
    return documents([*rows, (400, None, None, "s1"), (401, "", None, "empty"), (402, " \n ", None, "empty"), (7, prose(7, 12), "en", None), (7, prose(7, 12), "en", None)])


def test_words_taken_meet_the_targets(documents, prose):
    docs = table(documents, prose)
    rows = mixing.mix(docs, block_words=50, shard_words=900).collect()
    assert len(rows) == docs.count()
    sizes = {(r.doc_id, r.text): len((r.text or "").encode().split()) for r in docs.collect()}
    assert sum(r.size for r in rows) == sum(len((r.text or "").encode().split()) for r in docs.collect()) and sizes
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = sum(r.size for r in rows)
    want = mixing.targets([sum(r.size for r in rows if r.source == s) for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * total, 2)
    for s, target in zip(names, want):
        own = [r for r in rows if r.source == s]
        assert {r.target for r in own} == {target} and {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - target) <= 0.5
        assert all(r.taken <= 2 * r.size for r in own)
    for r in rows:
        assert r.taken == sum(d.words for d in r.draws) and all(d.shard is not None for d in r.draws)
    assert len({d.shard for r in rows for d in r.draws}) > 1


def test_reruns_and_other_partitions_agree(documents, prose):
    docs = table(documents, prose)
    one, two = (sorted(map(str, mixing.mix(d, block_words=50).drop("draws").collect())) for d in (docs, docs.orderBy(F.rand()).repartition(7)))
    assert one == two


def test_excess_goes_to_the_others():
    assert mixing.targets([10, 100, 100], [3, 1, 2], 300, 2) == pytest.approx([20, 280 / 3, 560 / 3])
    assert mixing.targets([0, 0], [3, 1], 0, 2) == [0, 0]
    assert mixing.targets([5], [3], 7.5, 2) == [7.5]
    got = mixing.targets([1, 50, 7, 30], [3, 1, 2, 3], 132, 2)
    assert sum(got) == pytest.approx(132) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [1, 50, 7, 30]))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 99)) == list(range(n))


def test_tree_deals_every_block_once(spark):
    quotas = [40, 0, 7, 13]
    rows = mixing.block_shards(spark, quotas, 9, 7).collect()
    assert sorted((r.source_no, r.block) for r in rows) == [(s, b) for s, q in enumerate(quotas) for b in range(q)]
    loads = np.bincount([r.shard for r in rows])
    assert loads.max() - loads.min() <= 1


def test_drawn_documents_are_cut_to_their_words(documents, prose):
    docs = table(documents, prose)
    rows = mixing.mix(docs).collect()
    drawn = mixing.draw_documents(docs).collect()
    assert sum(len(r.text.split()) for r in drawn) == sum(r.taken for r in rows)
    texts = {r.text for r in docs.collect()}
    cut = [r for r in drawn if r.text not in texts]
    assert len(cut) <= 2 * 7 and all(any(t and t.startswith(r.text) for t in texts) for r in cut)
    assert all(r.n_chars == len(r.text) for r in drawn)


def test_empty_table(documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.draw_documents(documents([])).collect() == []
