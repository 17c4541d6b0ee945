import numpy as np
import pytest

from demandgrid.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, leaf int, v string, block int")


def exact(rows, k=20):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(float)
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            s = (v * np.asarray(q, np.float32).astype(float)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.5 * rng.normal(size=16)).tolist()) for i in range(4000)]
    got, want = found(neighbours.search(table(spark, [(*r, 0, 1, "a", 2) for r in rows]))), exact(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.93
    lookup = {i: np.asarray(x, np.float32).astype(float) for i, x in rows}
    for q, own in got.items():
        assert len(own) == 20 and q not in [i for i, _ in own]
        assert all(s == pytest.approx(lookup[i] @ lookup[q], abs=1e-12) for i, s in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_copies_tie_by_id(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(900)]
    got, want = found(neighbours.search(table(spark, [(*r, 0, 1, "a", 2) for r in rows]))), exact(rows)
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_small_clusters_get_k_rows(spark, monkeypatch):
    """The nearest leaf of an outlier holds fewer than k vectors; the walk goes on."""
    monkeypatch.setattr(neighbours, "ROWS_PER_LEAF", 10)
    axes = np.eye(41)
    rows = [(i, axes[i % 40].tolist()) for i in range(1200)] + [(5000 + i, (10 * axes[40]).tolist()) for i in range(4)]
    got = found(neighbours.search(table(spark, [(*r, 0, 1, "a", 2) for r in rows])))
    assert got.keys() == {i for i, _ in rows if i % 20 == 0}
    assert all(len(own) == 20 and q not in [i for i, _ in own] for q, own in got.items())


def test_walks_pass_the_rows_asked_for():
    tree = neighbours.Tree(np.repeat(np.eye(6), 30, axis=0), 10)
    held = np.full(tree.leaves, 15)
    first = tree.visits(np.eye(6)[2], 1, held, 0)
    assert len(first) == 1 and tree.visits(np.eye(6)[2], 1, held, 15) == first
    assert len(tree.visits(np.eye(6)[2], 1, held, 31)) == 3
    assert len(tree.visits(np.eye(6)[2], 1, held, 10**6)) == tree.leaves


def test_rows_of_one_id_find_each_other(spark):
    """Each row of a repeated id asks for itself; only that row is no candidate."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(table(spark, [(*r, 0, 1, "a", 2) for r in rows])).collect())
    assert got == sorted([(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 0, 0.0), (0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 0, 0.0)])


def test_unusable_vectors_take_no_part(spark):
    bad = [(20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [None, 1.0]), (120, [1.0]), (None, [1.0, 1.0]), (140, [])]
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [0.5, 0.5]), (2, [0.1, 0.0])]
    got = found(neighbours.search(table(spark, [(*r, 0, 1, "a", 2) for r in bad + rows])))
    assert {q: [i for i, _ in own] for q, own in got.items()} == {0: [1, 3, 2]}
    assert neighbours.search(table(spark, [])).collect() == []
    assert neighbours.search(table(spark, [(1, [1.0], 0, 1, "a", 2)])).collect() == []
