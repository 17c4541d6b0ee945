import random

import numpy as np
import zlib

from pyspark.sql import functions as F

from demandgrid.llm import language

STEMS = {"xx": "the and ing tion with for".split(), "yy": "que les ment eau oux des".split(), "zz": "und sch keit ung der ver".split()}


def text(lang, seed, words=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(words))


def table(documents):
    rows = [(i, text(lang, i), lang) for i in range(240) for lang in [sorted(STEMS)[i % 3]]]
    odd = [(240, None, "xx"), (241, "", "xx"), (242, "123 ?!", "yy"), (243, text("zz", 0, 20_000), None), (0, rows[0][1], "xx"), (244, "²", "zz")]
    return documents([*rows, *odd])


def test_held_out_accuracy_and_hard_cases(documents):
    rows = language.identify(table(documents)).collect()
    assert len(rows) == 246
    own = [r for r in rows if r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == sorted(STEMS)[r.doc_id % 3] for r in own]) > 0.95
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (240, 241, 242, 244))
    assert by[243].lang_pred == "zz" and all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn(documents):
    assert [r.lang_pred for r in language.identify(documents([(1, "words", None)])).collect()] == ["und"]
    assert language.identify(documents([])).collect() == []


def test_labels_of_held_out_rows_are_not_used(documents):
    docs = table(documents)
    spoilt = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "wrong").otherwise(F.col("lang")))
    assert sorted(map(str, language.identify(docs).collect())) == sorted(map(str, language.identify(spoilt).collect()))


def test_without_labels_texts_with_letters_stay(documents):
    docs = documents([(1, "words here", None), (2, None, None), (3, "", None), (4, "12 ?!", None), (5, "Привет", None)])
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_rejected_documents_go(documents):
    kept = language.keep_identified(table(documents))
    assert {r.doc_id for r in kept.collect()} == set(range(240)) | {243}
    assert kept.columns == table(documents).columns


def test_slopes_of_the_network():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    net = language.ByteNet(2)
    h, where = net.pooled(x, places=True)
    for i, (table, at) in enumerate(zip(net.filters, where)):
        direct = np.stack([[sum(table[k, row[p + k]] for k in range(len(table))) for p in range(language.WINDOW - len(table) + 1)] for row in x])
        assert np.allclose(direct.max(axis=1).clip(0), h[:, i * language.FILTERS : (i + 1) * language.FILTERS], atol=1e-5)
        assert (direct.argmax(axis=1) == at).all()
    before = -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    net.fit(x, y, rounds=30)
    assert -np.log(net.probabilities(x)[np.arange(5), y]).mean() < before / 2
