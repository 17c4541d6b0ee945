import random
import re
from collections import Counter

import numpy as np
import pytest

from demandgrid.llm import collocations


def brute(rows, least, covered=100, first=2000, longest=5):
    out, by = [], {}
    for lang, text in rows:
        by.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, texts in by.items():
        f, n = Counter(), 0
        for text in texts:
            low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                w = re.findall("[^\x20\x09]+", piece)
                n += len(w)
                for size in range(1, longest + 1):
                    f.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        f = {p: c for p, c in f.items() if c >= least}
        around = Counter()
        for p, c in f.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], c)
        scored = []
        for p, a in f.items():
            if len(p) > 1 and 100 * around[p] < covered * a:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(scored)[:first]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(docs, **settings):
    return sorted(tuple(r) for r in collocations.collocations(docs, **settings).collect())


def corpus(seed, texts):
    """Few words, so that long phrases are frequent; all kinds of separators."""
    r = random.Random(seed)
    words = ["a", "B", "ça", "d'e", "f", "G-h", "Ä", "x\x0by", "\x1c", "0"]
    passage = "one two, THREE four five six seven"
    out = []
    for i in range(texts):
        own = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(r.randint(0, 40)))
        out.append((i, own + (passage if i % 3 else ""), r.choice([None, "en", "de", "a b"])))
    return out


@pytest.mark.parametrize("shards", [1, 4])
def test_equals_counting_everything(documents, shards):
    """Also with one shard, so that a cycle is one scan."""
    docs = documents(corpus(shards, 60))
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], 4)
    assert len(want) > 40 and any(len(p[2].split()) == 5 for p in want)
    assert found(docs, least=4, shards=shards) == want


def test_full_bit_arrays_change_nothing(documents, monkeypatch):
    """And nothing is broadcast or collected, as with very many phrases."""
    monkeypatch.setattr(collocations, "bits_for", lambda rows: collocations.BITMAP)
    monkeypatch.setattr(collocations, "holds", lambda bits, hashes: np.ones(len(hashes), bool))
    monkeypatch.setattr(collocations, "SMALL", -1)
    docs = documents(corpus(7, 40))
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], 3)
    assert found(docs, least=3, first=9, covered=60) == brute([(r["lang"], r["text"]) for r in docs.collect()], 3, covered=60, first=9)
    assert found(docs, least=3) == want


def test_hard_texts(documents, hard_texts):
    docs = documents([(i, t) for i, t in enumerate(hard_texts * 3)] + [(None, None)] * 3)
    assert found(docs, least=6) == brute([(None, t) for t in hard_texts * 3], 6)
    assert found(docs.limit(0)) == []


def test_products_beyond_64_bits():
    """The score of 10**12 of 10**15 words, as the query computes it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    exact = "cast(1000 * cast(a as decimal(18, 0)) * cast(n as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    a, n, left, right = 10**12 - 1, 10**15 + 7, 10**12 + 39, 10**12 + 61
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(f"cast({exact} as long) as s").first()
    assert row["s"] == 1000 * a * n // (left * right)


def test_a_head_is_written_once_for_its_last_words():
    """And, if hot, once per part: a key is in the same part in every block."""
    full = np.full(collocations.BITMAP // 8, 255, np.uint8)
    want = Counter()
    text = " ".join(f"the w{i % 40} of w{i % 7}" for i in range(200)).split()
    for size in (1, 2):
        want.update("en\n" + " ".join(text[i : i + size]) for i in range(len(text) - size + 1))
    for hot, most in (((), 1), (("the",), 40)):
        rows, got = Counter(), Counter()
        for heads, part, lasts, counts in collocations.count_block(b"en", " ".join(text).encode(), True, full, full, 2, hot):
            for head, p, words, each in zip(heads.to_pylist(), part, lasts.to_pylist(), counts.to_pylist()):
                rows[head] += 1
                assert (p > 0) == (head == "en\nthe " and bool(hot)) or head == "en\n"
                got.update(dict(zip((head + w for w in words.split(" ")), each, strict=True)))
        assert got == want and rows["en\nof "] == 1 and (rows["en\nthe "] == 1 if most == 1 else 1 < rows["en\nthe "] <= most)
