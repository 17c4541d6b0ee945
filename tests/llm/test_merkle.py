import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from demandgrid.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) per row, straight from the definition."""

    def leaf(r, text):
        return sha(*(told(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), told(text))

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: levels([leaf(r, r["text"]) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for i, s in enumerate(sources):
        for j, r in enumerate(by[s]):
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            own, proof = leaf(r, text), []
            for tree, at in ((trees[s], j), (top, i)):
                for digests in tree[:-1]:
                    run, k = digests[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    proof += run[:k] + run[k + 1 :]
                    own, at = sha(*run[:k], own, *run[k + 1 :]), at // 3
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], top[-1][0], sha(*proof), own, own == top[-1][0]))
    return sorted(out, key=str)


def without_lines():
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def got(docs):
    return sorted((tuple(r) for r in merkle.verified(docs, without_lines()).collect()), key=str)


@pytest.mark.parametrize("per_round", [1, 2, 7])
def test_every_proof(documents, prose, monkeypatch, per_round):
    """Sources of 1 to 31 rows and a hot one, over several rounds of levels."""
    monkeypatch.setattr(merkle, "LEVELS", per_round)
    sizes = {None: 4, "": 1, "a": 3, "b": 10, "é": 9, "z": 28, "Z": 31, "hot": 90}
    rows = [(100 * i + j, prose(j, 5) + "\n" * (j % 2), "en", s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    docs = documents(rows)
    assert got(docs) == brute(docs.collect())


def test_hard_texts(documents, hard_texts):
    """Nulls in every column, repeated ids and wholly repeated rows, long and odd texts."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}") for i, t in enumerate(hard_texts)]
    rows += [(None, None)] * 7 + [(3, "a\nb"), (3, "a\nb"), (3, "c"), (None, "x", None, "s1")]
    docs = documents(rows)
    assert got(docs) == brute(docs.collect())


def test_one_row_and_none(documents):
    one = documents([(1, "only")])
    (row,) = got(one)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha() and row[6]
    assert got(one.limit(0)) == []


def test_many_repeated_rows_spread_over_ranges(documents):
    docs = documents([(None, None)] * 300)
    assert got(docs) == brute(docs.collect())
