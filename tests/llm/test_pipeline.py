import importlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from demandgrid.llm import pii
from test_jaccard import brute_force
from test_language import STEMS, text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All columns of documents; copies, near copies, personal data, texts without letters, nulls."""
    r, rows = random.Random(5), []
    for i in range(150):
        lang = sorted(STEMS)[i % 3]
        rows.append((i, text(lang, i, 60 + i % 50), lang, f"s{i % 4}" if i % 9 else None))
    for i in range(150, 180):
        words = rows[i - 150][1].split()
        words[r.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words) if i % 2 else rows[i - 150][1], "xx", "s0"))
    rows += [(200, None, "xx", "s1"), (201, "12 34 !!", "yy", "s1"), (202, f"{text('xx', 900)} mail a.b.1@x.example.org at 17.252.227.210", "xx", "s2")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages_follow_a_brute_force_version(spark, folder):
    path, rows = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], docs.schema)
    for stage in seen[:-1]:
        assert list(stage[0].asDict()) == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in seen[0]} == {i for i, *_ in rows} - {200, 201}
    kept = [(r.doc_id, r.text) for r in seen[0]]
    assert sorted(r.doc_id for r in seen[1]) == sorted({c for _, c, _ in brute_force(kept)})
    assert {r.doc_id: r.text for r in seen[2]} == {r.doc_id: pii.replace(r.text, {}, pii.KEY)[0] for r in seen[1]}
    assert all("17.252.227.210" not in r.text and r.n_chars == len(r.text) for r in seen[2])
    words = {r.doc_id: len(r.text.split()) for r in seen[2]}
    taken = sum(len(r.text.split()) for r in seen[3])
    assert abs(taken - 1.5 * sum(words.values())) <= 3
    assert all(sum(len(r.text.split()) for r in seen[3] if r.doc_id == d) <= 2 * n for d, n in words.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[3])
    assert sum(r.length for r in seen[4]) == want
    assert corpus_pipeline.run(spark, path).count() == len(seen[4])


def test_every_operator_has_a_query():
    contract = importlib.import_module("__spark_entry__")
    names = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in contract.queries()
