import itertools
import zlib

import numpy as np
import pytest

from demandgrid.llm import quality


def test_sums_equal_all_paths():
    """Marginals of short chains against the sum over all label sequences."""
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 1, 6, 3])
    odds, moves = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2))
    chains = quality.Chains(lengths)
    good, pairs = quality._sums(odds, moves, chains)
    for start, n in zip(chains.starts, lengths):
        total, marginal, linked = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(odds[start + t] * s for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            marginal += w * np.array(path)
            for t, (a, b) in enumerate(zip(path, path[1:])):
                linked[t + 1, a, b] += w
        assert good[start : start + n] == pytest.approx(marginal / total)
        assert pairs[start : start + n] == pytest.approx(linked / total)


def test_neighbours_stay_in_their_chain():
    chains = quality.Chains(np.array([2, 0, 1, 3]))
    before, after = chains.neighbours(np.array([1, 2, 3, 4, 5, 6]), 9)
    assert before.tolist() == [9, 1, 9, 9, 4, 5] and after.tolist() == [2, 9, 9, 5, 6, 9]


def table(documents, spark, prose):
    rows, labels = [], []
    for i in range(160):
        lines = [prose(100 * i + j, 12).capitalize() + "." for j in range(4)]
        if i % 4 == 0:
            lines[1:3] = [line.upper().replace(" ", "!! ") for line in lines[1:3]]
        if i % 4 == 1 and i % 8 == 1:
            lines = ["click | here | now |"] * 6
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 4 != 0 and i % 8 != 1)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_documents(documents, spark, prose):
    docs, labels, known = table(documents, spark, prose)
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 20
    assert np.mean([(scores[i] >= 0.7) == (known[i] == 1) for i in held]) >= 0.95


def test_lines_are_told_apart(documents, spark, prose):
    docs, labels, _ = table(documents, spark, prose)
    field = quality.train(docs, labels)
    lines = quality.label_lines(docs.where("doc_id % 8 in (1, 3)"), field).collect()
    assert {r["line_no"] for r in lines} == set(range(6))
    junk = [r["good"] for r in lines if "|" in r["line"]]
    clean = [r["good"] for r in lines if "|" not in r["line"]]
    assert np.mean(junk) < 0.3 < 0.7 < np.mean(clean)


def test_held_out_labels_teach_nothing(documents, spark, prose):
    docs, labels, _ = table(documents, spark, prose)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality")
    first, second = (sorted(map(tuple, quality.score_documents(docs, x).collect())) for x in (labels, turned))
    assert first == second


def test_hard_texts(documents, spark, prose, hard_texts):
    docs, labels, known = table(documents, spark, prose)
    hard = documents([(1000 + i, t) for i, t in enumerate(hard_texts)] + [(None, "x"), (None, "x"), (1000, "again")])
    more = spark.createDataFrame([(None, 1), (1003, None), (5, 7), (1, 1)], "doc_id long, quality int")
    out = quality.score_documents(docs.unionByName(hard), labels.unionByName(more)).collect()
    assert len(out) == len(known) + len(hard_texts) + 3
    assert all(0 <= r["score"] <= 1 for r in out)
    blank = {r["score"] for r in out if r["doc_id"] in (1001, 1002)}
    assert len(blank) == 1
    x = [r["score"] for r in out if r["doc_id"] is None]
    assert x[0] == x[1]


def test_nothing_to_learn_from(documents, spark):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in quality.score_documents(docs, ones).collect())
    assert quality.score_documents(docs.limit(0), none).collect() == []
