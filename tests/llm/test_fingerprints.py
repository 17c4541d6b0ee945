import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.llm import fingerprints as fp


def shingles(text):
    w = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs):
    rows = sorted(fp.edited_fingerprints(docs).collect(), key=lambda r: -r.doc_id)
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    errors = []
    for i, ((doc_id, text), r) in enumerate(zip(texts, rows)):
        after = texts[(i + 1) % len(texts)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, n = map(shingles, (text, edited, after))
        for estimate, own, other in ((r.near_edited, a, b), (r.near_next, a, n)):
            exact = likeness(own, other)
            assert len(own | other) > fp.K or estimate == pytest.approx(exact)
            errors.append(estimate - exact)
    assert np.abs(errors).max() < 0.25 and np.abs(errors).mean() < 0.04
    same = {}
    for (_, text), r in zip(texts, rows):
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(same.values())) >= len({frozenset(shingles(t)) for t in same})
    return rows


def test_hard_texts(documents, hard_texts):
    check(documents(list(enumerate(hard_texts))))


def test_many_documents_with_gaps_in_their_ids(documents, prose):
    """Ids over several blocks, clustered at both ends."""
    ids = [*range(1500), *(10**15 + 977 * i for i in range(1500))]
    check(documents([(i, prose(i % 700, 3 + i % 30)) for i in ids]))


def test_blocks_of_blocks(documents, prose, monkeypatch):
    monkeypatch.setattr(fp, "IDS_PER_BLOCK", 4)
    check(documents([(3 * i, prose(i, 8)) for i in range(200)]))


def test_one_none_and_repeated(documents, prose):
    assert fp.edited_fingerprints(documents([])).collect() == []
    check(documents([(5, prose(5, 50))]))
    assert fp.edited_fingerprints(documents([(5, "a b"), (5, "a b"), (None, "c")])).count() == 3


def test_sketches_merge(spark, prose):
    a, b = prose(1, 900), prose(2, 900)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    sa, sb = fp.shingles(F.col("a")), fp.shingles(F.col("b"))
    both = df.select(fp.merge(fp.sketch(sa), fp.sketch(sb)).alias("m"), fp.sketch(F.concat(sa, sb)).alias("w"), fp.distinct_count(fp.sketch(sa)).alias("n"), fp.containment(fp.sketch(sa), fp.sketch(F.concat(sa, sb))).alias("c"), fp.containment(fp.sketch(sa), fp.sketch(sb)).alias("none")).first()
    assert both.m == both.w and abs(both.n - 896) < 250 and both.c > 0.8 and both.none < 0.1
    parts = df.select(F.explode(F.array("a", "b")).alias("t")).select(F.lit(1).alias("g"), fp.sketch(fp.shingles(F.col("t"))).alias("s"))
    assert fp.merge_groups(parts, ["g"], "s").first().s == both.m


def test_no_python_in_the_plan(documents, prose):
    plan = fp.edited_fingerprints(documents([(i, prose(i, 9)) for i in range(20)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
