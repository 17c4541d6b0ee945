import zlib
from collections import defaultdict

from demandgrid.llm import sharding


def check(docs, most):
    """``most``: the largest share of a shard, in even shares, and the spread of the shards without a row larger than that."""
    rows, texts = sharding.shard(docs).collect(), docs.collect()
    assert len(rows) == len(texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in texts)
    slots, load = defaultdict(list), [0] * 8
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) <= most * sum(load) / 8
    return rows


def test_sizes_are_nearly_equal(documents, prose):
    check(documents([(i, prose(i, i % 50)) for i in range(3000)]), 1.02)


def test_a_group_that_fits_stays_together(documents, prose):
    same = prose(0, 30)
    rows = check(documents([*((i, prose(i, 30)) for i in range(2000)), *((2000 + i, same) for i in range(150))]), 1.02)
    assert len({r.shard for r in rows if r.doc_id >= 2000}) == 1


def test_an_overfull_group_is_divided(documents, prose):
    same = prose(0, 30)
    rows = check(documents([*((i, prose(i, 30)) for i in range(1000)), *((1000 + i, same) for i in range(800))]), 1.05)
    assert len({r.shard for r in rows if r.doc_id >= 1000}) > 2


def test_one_row_of_half_of_all_bytes(documents, prose):
    """It fills a shard; the seven others share the rest evenly, none stays empty."""
    small = [(i, prose(i, 25)) for i in range(3000)]
    half = sum(len(t) + 1 for _, t in small)
    rows = check(documents([*small, (9999, "x" * half)]), 4.1)
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r.size
    alone = next(r.shard for r in rows if r.doc_id == 9999)
    assert load[alone] == half + 1
    others = [load[s] for s in range(8) if s != alone]
    assert max(others) <= 1.02 * min(others)


def test_hard_texts(documents, hard_texts):
    """The largest row sets the largest load; the rest lies beside it."""
    sizes = [len((t or "").encode()) + 1 for t in hard_texts]
    check(documents(list(enumerate(hard_texts))), 8 * max(sizes) / sum(sizes) + 0.01)
    assert sharding.shard(documents([])).collect() == []
    check(documents([(1, None)] * 50), 2)


def test_ranges_are_split_until_none_is_overfull(monkeypatch, documents, prose):
    """With far too few draws the first splitters are poor; the result still is balanced."""
    monkeypatch.setattr(sharding, "DRAWS_PER_RANGE", 0.05)
    check(documents([(i, prose(i, 20)) for i in range(3000)]), 1.1)


def test_written_shards(spark, documents, prose, tmp_path):
    docs = documents([(i, prose(i, 20)) for i in range(100)])
    sharding.write_shards(docs.select("doc_id", "text"), sharding.shard(docs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
