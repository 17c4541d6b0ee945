import random

import pytest

#: Names that the operators use inside, in a table of their input.
CLASHES = "size long, Text_ string, block long, tid string, _h long, before long, kinds string, score double"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang[, source]]) rows, with columns whose names clash."""

    def build(rows):
        full = [(*r, *(None, None)[len(r) - 2 :]) for r in rows]
        full = [(*r, None if r[1] is None else len(r[1]), 1, "x", 2, "y", 3, 4, "z", 0.5) for r in full]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")

    return build


@pytest.fixture
def prose():
    """Texts of invented words, by seed and number of words."""

    def build(seed, words):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bdfklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(words))

    return build


@pytest.fixture
def hard_texts(prose):
    """Null, empty, blank, long, repeated, signs only, other scripts."""
    same = prose(1, 60)
    return [None, "", " \n\t ", prose(2, 6000), same, same, same, "?!", "Привет, мир! 你好 世界 🎉", "x" * 5000, "<|endoftext|> is text", "a b\x1cc d"]
