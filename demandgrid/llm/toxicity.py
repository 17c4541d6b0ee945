"""Toxicity of restored texts: a noisy channel undone by a Viterbi search, then a linear model.

Words written with look-alike signs, single letters with separators between them, or
repeated letters are taken as noisy forms of words. Each sign has a few readings with a cost, which makes
a lattice; the search keeps the best path per last two letters under a character trigram model
counted over all texts. The restored words of a text give features (the word and its
beginnings), which a logistic model weighs that was fitted on a bounded sample of labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import bounded_sample, held_out, pick

# Readings of look-alike signs; the letters of the model ("" stands for all others and the word's edge).
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SIZE = len(LETTERS) + 2
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = SIZE - 1

#: Costs in nats: reading a sign as a letter, dropping a separator, ending a word at one, dropping a repetition beyond the second.
SIGN, GAP, END, REPEAT = 1.0, 0.2, 1.0, 0.3
_SIGNS = re.escape("".join(READINGS))
_SEP = r"[ .\-_*]"
_UNIT = rf"(?:[^\W\d_]|[{_SIGNS}])"
#: Words that may be noisy forms: single letters or signs apart, signs beside letters, three equal letters.
NOISY = re.compile(
    rf"(?<![^\W_]){_UNIT}(?:{_SEP}{_UNIT}){{2,}}(?![^\W_])"
    rf"|(?<![\w{_SIGNS}])(?:[\w{_SIGNS}]*[^\W\d_][{_SIGNS}]+|[{_SIGNS}](?=[^\W\d_]))[\w{_SIGNS}]*"
    r"|(?<!\w)\w*([^\W\d_])\1\1\w*"
)
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Labelled rows to learn from; features need so many toxic rows.
FIT_ROWS, LEAST_ROWS, LEAST_EVIDENCE = 8000, 4, 6.0
CACHED = 300_000


TABLE = np.array([CODE.get(chr(c).lower(), OTHER if chr(c).isalpha() else 0) for c in range(0x180)])


def letter_codes(text: str) -> np.ndarray:
    """A code per character: letters of the model, others, and 0 for what is no letter."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(raw < 0x180, TABLE[np.minimum(raw, 0x17F)], OTHER)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three characters follow each other, over all texts; each task sends its own sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SIZE**3, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                c = np.concatenate([[0], letter_codes(text.as_py() or ""), [0]])
                held.append((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:])
                size += len(c)
                if size > SIZE**3:
                    total += np.bincount(np.concatenate(held), minlength=SIZE**3)
                    held, size = [], 0
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    sums = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE**3, np.int64)
    for r in sums.collect():  # at most SIZE**3 rows, whatever the data
        out[r["gram"]] = r["n"]
    return out


class Restorer:
    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        one = c.sum(axis=(0, 1)) + 1
        two = c.sum(axis=0)
        one /= one.sum()
        two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
        self.logp = np.log((c + 20 * two) / (c.sum(axis=2, keepdims=True) + 20))
        self.known: dict[str, str] = {}
        self.cost: list[float] | None = None

    def restore(self, noisy: str) -> str:
        """The likeliest words behind a noisy form; separators and signs that read as no letter end a word.

        Takes time and memory in proportion to the length: paths share their beginnings.
        """
        if self.cost is None:
            self.cost = self.logp.ravel().tolist()
        cost = self.cost
        # state: last two codes, as one number -> (score, letters so far as (path before, letter), last letter, its run)
        beam: dict[int, tuple] = {0: (0.0, None, "", 0)}
        for c in noisy.lower():
            after: dict[int, tuple] = {}
            if c in CODE or c.isalpha():
                read = ((CODE.get(c, OTHER), c, 0.0),)
            else:
                read = tuple((CODE[letter], letter, SIGN) for letter in READINGS.get(c, ""))
            gap, plain = c in " .-_*", not read or read[0][2] > 0
            for state, (score, path, last, run) in beam.items():
                at, y = state * SIZE, state % SIZE * SIZE
                for z, letter, price in read:
                    value, to = score - price + cost[at + z], y + z
                    if to not in after or value > after[to][0]:
                        after[to] = value, (path, letter), letter, 1
                if not plain:
                    if c == last:
                        value = score - (REPEAT if run > 1 else 2.0)
                        if state not in after or value > after[state][0]:
                            after[state] = value, path, last, run + 1
                    continue
                if gap and (state not in after or score - GAP > after[state][0]):
                    after[state] = score - GAP, path, last, run
                if gap and not state:
                    continue
                # Marks after the end of a word are part of that end.
                value = score - (0.5 if c in "!|(+" and not state and path else (END if gap else 3.0) - cost[at])
                if 0 not in after or value > after[0][0]:
                    after[0] = value, (path, " "), "", 0
            beam = after
        _, path = max(((score + cost[state * SIZE], path) for state, (score, path, _, _) in beam.items()), key=lambda x: x[0])
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out))

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text; a noisy form also gives the words it shows as written."""
        low = text.lower()
        out = set(WORDS.findall(low))
        for m in NOISY.finditer(low):
            form = m.group()
            if not WORDS.search(form):
                continue
            if form not in self.known:
                if len(self.known) > CACHED:
                    self.known.clear()
                self.known[form] = self.restore(form)
            out.update(WORDS.findall(self.known[form]))
        return out


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:n]}~".encode()) for n in PREFIXES if len(word) > n)]


def fit(flat: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, rounds: int = 300) -> tuple[dict[int, float], float]:
    """Weights by feature and the intercept of a logistic model over features seen mostly in toxic rows.

    ``flat`` holds the distinct features of the rows, ``lengths`` of them for each row. Without rows of both labels
    there are no weights, and the intercept is the smoothed share of toxic rows.
    """
    rows, positive = len(toxic), int(toxic.sum())
    clean = rows - positive
    base = math.log((positive + 1) / (clean + 9))
    names, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(rows, dtype=np.int32), lengths)
    with_ = np.bincount(column, toxic[row], len(names))
    without = np.bincount(column, minlength=len(names)) - with_
    odds = np.log((with_ + 0.5) / (positive + 1)) - np.log((without + 0.5) / (clean + 1))
    evidence = odds * np.sqrt(with_)
    strong = np.flatnonzero((with_ >= LEAST_ROWS) & (evidence > LEAST_EVIDENCE))
    if not len(strong) or not clean:
        return {}, base
    strong = strong[np.lexsort((names[strong], -evidence[strong]))]
    at = np.full(len(names), -1, np.int32)
    at[strong] = np.arange(len(strong))
    kept = at[column] >= 0
    r, c = row[kept], at[column[kept]]
    w, b = np.zeros(len(strong)), base
    seen_w, seen_b = np.full(len(strong), 1e-6), 1e-6
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-(np.bincount(r, w[c], rows) + b))) - toxic
        g, h = np.bincount(c, d[r], len(strong)) + 0.5 * w, d.sum()
        seen_w += g * g
        seen_b += h * h
        w -= 0.5 * g / np.sqrt(seen_w)
        b -= 0.5 * h / math.sqrt(seen_b)
    return dict(zip(names[strong].tolist(), w.tolist())), float(b)


def train(labelled: DataFrame, restorer: Restorer, fit_rows: int = FIT_ROWS) -> tuple[dict[int, float], float]:
    """Fits on about ``fit_rows`` rows (doc_id, text, toxic), chosen by hash; null labels teach nothing.

    The driver gets the feature hashes of those rows: a few MB for a thousand of them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({f for w in restorer.words(t.as_py() or "") for f in features(w)}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64())), batch.column(2)], names=["k", "f", "toxic"])

    chosen = bounded_sample(labelled.where(F.col("toxic").isin(0, 1)), fit_rows, "doc_id", "text")
    found = chosen.select("k", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(read, "k long, f array<long>, toxic int").toArrow()
    order = np.lexsort((found["toxic"].to_numpy(), found["k"].to_numpy()))
    found = found.take(pa.array(order)).combine_chunks()
    lists = found["f"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int64()))
    lengths = np.diff(lists.offsets.to_numpy()) if found.num_rows else np.zeros(0, np.int64)
    return fit(lists.flatten().to_numpy().astype(np.uint32), lengths, found["toxic"].to_numpy().astype(float))


def scorer(restorer: Restorer, weights: dict[int, float], base: float):
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, ...]] = {}
        for array in texts:
            out = np.zeros(len(array))
            for i, text in enumerate(array):
                found: set[int] = set()
                for word in restorer.words(text.as_py() or ""):
                    hit = known.get(word)
                    if hit is None:
                        if len(known) > CACHED:
                            known.clear()
                        hit = known[word] = tuple(f for f in features(word) if f in weights)
                    found.update(hit)
                out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, base + sum(weights[f] for f in sorted(found))))))
            yield pa.array(out)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, score (probability that the label is toxic).

    Learns from labelled rows where ``learn`` holds (default: those not ``held_out``); with no such row every score is
    the prior. Null and empty texts score the intercept. Whole texts are read, however long. Repeated rows are scored each; a repeated
    label row counts again. An empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text")
    restorer = Restorer(trigram_counts(rows))
    marked = pick(labels, "doc_id", "toxic")
    known = rows.where(~held_out(F.col("doc_id")) if learn is None else learn).join(marked, "doc_id").select("doc_id", "text", "toxic")
    weights, base = train(known, restorer, fit_rows)
    return rows.select("doc_id", scorer(restorer, weights, base)("text").alias("score"))
