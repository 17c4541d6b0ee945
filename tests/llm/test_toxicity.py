import random
import zlib

import numpy as np
import pytest

from demandgrid.llm import toxicity

BAD = "idiot moron clown loser pathetic".split()
FORMS = {"idiot": "1d1ot i.d.i.o.t idioooot".split(), "moron": ["m0r0n", "m o r o n"], "clown": ["cl0wn"], "loser": ["l0$er", "l-o-s-e-r"], "pathetic": ["p4th3tic"]}


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(1), []
    words = "the and of thing inner oration lesson river stone matter winter paper little common".split()
    for i in range(400):
        own = [r.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                word = r.choice(BAD)
                # Noisy forms stand in documents that no model has learned from, too.
                own[r.randrange(40)] = r.choice([word, *FORMS[word]]) if i % 2 else word
        out.append((i, " ".join(own), int(toxic)))
    return out


@pytest.fixture(scope="module")
def restorer(rows):
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    for _, text, _ in rows:
        c = np.concatenate([[0], toxicity.letter_codes(text), [0]])
        np.add.at(counts, (c[:-2] * toxicity.SIZE + c[1:-1]) * toxicity.SIZE + c[2:], 1)
    return toxicity.Restorer(counts)


def test_counts_cover_all_texts(documents, rows, restorer):
    counts = toxicity.trigram_counts(documents([*((i, t) for i, t, _ in rows), (-1, None), (-2, "")]).repartition(5))
    again = np.zeros_like(counts)
    for _, text, _ in [*rows, (0, "", 0), (0, "", 0)]:
        c = np.concatenate([[0], toxicity.letter_codes(text), [0]])
        np.add.at(again, (c[:-2] * toxicity.SIZE + c[1:-1]) * toxicity.SIZE + c[2:], 1)
    assert (counts == again).all()


@pytest.mark.parametrize(("word", "form"), [(w, f) for w, fs in FORMS.items() for f in fs])
def test_noisy_forms_are_restored(restorer, word, form):
    assert word in restorer.words(f"the {form} and {form}, of")


def test_ordinary_words_stay(restorer):
    text = "River stone!! Heit$$$ ###, 3,000 v2.0 winter's a - b"
    assert restorer.words(text) == {"river", "stone", "heit", "v", "winter", "s", "a", "b"}


@pytest.mark.parametrize(
    ("form", "found"),
    [
        ("i d 1 o t", {"idiot"}),
        ("l 0 s 3 r", {"loser"}),
        ("t h e", {"the"}),
        ("idi0+", {"idiot"}),
        ("th3", {"the"}),
        ("cl0wn5", {"clown"}),
        ("m o r o n i d i o t", {"moron", "idiot"}),
        ("m o r o n i d i o t c l o w n m o r o n i d i o t", {"moron", "idiot", "clown"}),
        ("idi" + "o" * 60 + "t", {"idiot"}),
        ("lo5" + "e" * 50 + "r", {"loser"}),
    ],
)
def test_forms_of_several_words_and_any_length(restorer, form, found):
    assert found <= restorer.words(f"river {form}, stone")


def test_the_search_finds_the_best_reading(restorer):
    """Against every reading of short forms."""
    from itertools import product

    for form in ("l0", "1d1", "s7on3", "$t0n", "r1v3r"):
        best = None
        for letters in product(*(toxicity.READINGS.get(c, c) for c in form)):
            x, y, score = 0, 0, 0.0
            for c, letter in zip(form, letters):
                z = toxicity.CODE[letter]
                score += restorer.logp[x, y, z] - toxicity.SIGN * (c != letter)
                x, y = y, z
            score += restorer.logp[x, y, 0]
            best = max(best or (score, ""), (score, "".join(letters)))
        found = restorer.restore(form)
        assert found == best[1]


def test_held_out_rows_are_told_apart(spark, documents, rows):
    docs = documents([*((i, t) for i, t, _ in rows), (1000, None), (1001, ""), (1002, "the river " * 5000 + "idiot moron"), (1, rows[1][1])])
    labels = spark.createDataFrame([(i, y, y, "a") for i, _, y in rows] + [(1001, None, None, None)], "doc_id long, toxic int, score int, text string")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    own = [(by[i] >= 0.3, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == y for p, y in own]) > 0.95 and sum(y for _, y in own) > 10
    assert by[1000] == by[1001] < 0.3 and by[1002] > 0.3


def test_nothing_to_learn(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(documents([(1, "word")]), labels).collect()] == [pytest.approx(0.1)]
    assert toxicity.score_documents(documents([]), labels).collect() == []


def test_long_words_take_linear_time(restorer):
    assert restorer.words("a" * 300_000 + " " + "a$" * 100_000 + " ok") >= {"ok"}
