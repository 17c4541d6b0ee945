import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from demandgrid.llm import jaccard
from demandgrid.llm.common import marked
from demandgrid.llm.shingling import shingle_set, word_hashes


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((d, min(groups[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def corpus(prose, copies=60):
    r, rows = random.Random(3), []
    for base in range(12):
        words = prose(base, 100 + base * 20).split()
        for _ in range(1 + base % 4):
            own = list(words)
            for _ in range(r.randint(0, 12)):
                own[r.randrange(len(own))] = f"edit{r.random()}"
            rows.append(" ".join(own))
    hot = prose(99, 150).split()
    for i in range(copies):
        own = list(hot)
        own[(7 * i) % 150] = f"new{i}"
        rows.append(" ".join(own))
    return [(10 + i, t) for i, t in enumerate(rows)]


def check(documents, rows):
    out = jaccard.join_documents(documents(rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in out) == brute_force(rows)
    return out


def test_links_and_classes(documents, prose):
    rows = corpus(prose)
    out = check(documents, [*rows, *((500 + i, t) for i, (_, t) in enumerate(rows[:9])), (600, "one two"), (601, "one  two"), (602, "one two three")])
    firsts = Counter(r.class_id for r in out if r.is_first)
    assert set(firsts.values()) == {1} and set(firsts) == {r.class_id for r in out}


def test_a_group_over_many_cells(documents, prose, monkeypatch):
    """Every pair of a large group meets in exactly one cell."""
    monkeypatch.setattr(jaccard, "CHUNK_TEXTS", 7)
    check(documents, corpus(prose, 50))


def test_chunks_without_texts(documents, prose, monkeypatch):
    """Two very long near copies make two chunks and may share one; their pair counts once."""
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 500)
    rows = []
    for pair in range(8):
        words = prose(pair, 500).split()
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join([*words[:-1], "end"]))]
    check(documents, rows)


def test_hard_texts(documents, hard_texts):
    rows = [(i, t) for i, t in enumerate(hard_texts)]
    check(documents, rows)
    assert jaccard.join_documents(documents([])).collect() == []
    out = jaccard.join_documents(documents([(None, "a b c"), (None, "a b c"), (3, "a b c"), (None, None)])).collect()
    assert Counter((r.doc_id, r.class_id, r.links) for r in out) == Counter([(None, 3, 2), (None, 3, 2), (3, 3, 2), (None, None, 0)])


def test_one_of_each_class_stays(documents, prose):
    rows = corpus(prose, 20)
    table = documents([*rows, rows[0], rows[0], (900, None), (901, "")])
    kept = jaccard.first_of_classes(table)
    want = {c for _, c, _ in brute_force(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want | {900, 901})
    assert kept.columns == table.columns


def test_posterior_limits():
    limits = jaccard.least_matches(0.8, 1e-6, 240, 40)
    assert [n for n, _ in limits] == [40, 80, 120, 160, 200, 240]
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        match = np.cumsum(rng.random(240) < 0.8)
        lost += any(match[n - 1] < least for n, least in limits)
    assert lost == 0
    match = np.cumsum(rng.random((500, 240)) < 0.3, axis=1)
    assert (match[:, 39] < limits[0][1]).mean() > 0.9


def test_signatures_estimate_similarity():
    rng, found = np.random.default_rng(1), []
    for _ in range(100):
        u = rng.integers(0, 2**63, 1125, np.uint64)
        found.append((jaccard.signature(np.unique(u[:1000])) == jaccard.signature(np.unique(u[125:]))).mean())
    assert abs(np.mean(found) - 7 / 9) < 0.01 and np.std(found) < 0.04


def test_word_hashes_depend_on_the_word_alone(prose):
    words = [*prose(5, 3000).split(), "é", "a", "ab", "ba", "\0", "a\0"]
    text = " \n".join(words)
    hashes = word_hashes(text.encode())
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert len(shingle_set(text.encode())) == len(shingles(text))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.tid): bytes(r.root) for r in jaccard.components(edges).collect()}
    assert got == {bytes([i]): b"\0" for i in range(1, 61)} | {b"\xf1": b"\xf0"}


def test_texts_without_candidates_do_not_move(spark, documents, prose):
    """Neither where bodies are fetched nor where copies are dropped, also when nothing is small enough to broadcast."""
    rows = [*corpus(prose, 20), *((1000 + i, prose(200 + i, 40)) for i in range(50))]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.first_of_classes(documents([*rows, rows[0]]))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        stays, moves = plan[plan.index("Union") :].split("Scan", 1)
        assert "BroadcastHashJoin" in stays and "hashpartitioning" not in stays.split("BroadcastExchange")[0]
        assert "hashpartitioning" in moves
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_force(rows)})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_marks_miss_nothing(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("h"), "id")
    some = rows.where("id % 4 = 0").select("h")
    found = marked(rows, F.col("h"), some, "hit").groupBy(F.expr("id % 4 = 0").alias("own")).agg(F.sum(F.col("hit").cast("int")).alias("hits")).collect()
    hits = {r.own: r.hits for r in found}
    assert hits[True] == 5000 and hits[False] < 1500
    assert marked(rows, F.col("h"), some.limit(0), "hit").where("hit").isEmpty()


def test_repeated_rows_without_text(documents):
    """One stays, whether or not other rows repeat."""
    for more in ([], [(2, "a b c"), (2, "a b c")]):
        kept = jaccard.first_of_classes(documents([(1, None), (1, None), (3, "d e f"), *more]))
        assert sorted(r.doc_id for r in kept.collect()) == sorted({1, 3, *(d for d, _ in more)})
