"""Language identification with a byte convolutional network, trained in numpy.

Filters of several widths slide over the bytes of a window; each filter keeps its largest
value, and a softmax layer turns those into language probabilities. A filter is a table of
weights per place and byte value, so a convolution is a sum of table rows. Texts are cut
into windows of fixed length; a text's probabilities are the mean over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import bounded_sample, held_out, pick

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
#: Labelled rows to learn from, and windows taken of each.
FIT_ROWS, FIT_WINDOWS = 6000, 3
#: Windows that are scored together.
BATCH = 128
UNKNOWN = "und"


class ByteNet:
    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def pooled(self, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest value of each filter over each window, and where it is."""
        most, where = [], []
        for table in self.filters:
            width = len(table)
            length = windows.shape[1] - width + 1
            total = table[0].take(windows[:, :length], axis=0)
            for k in range(1, width):
                total += table[k].take(windows[:, k : k + length], axis=0)
            if places:
                where.append(total.argmax(axis=1))
            most.append(total.max(axis=1))
        return np.maximum(np.concatenate(most, axis=1) + self.bias, 0), where

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(windows)[0] @ self.out + self.out_bias)

    def fit(self, windows: np.ndarray, labels: np.ndarray, rounds: int = 6, rate: float = 0.05, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        parts = [*self.filters, self.bias, self.out, self.out_bias]
        seen = [np.full(p.shape, 1e-4, np.float32) for p in parts]
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(len(windows)), -(-len(windows) // BATCH)):
                x, y = windows[rows], labels[rows]
                h, where = self.pooled(x, places=True)
                d = _softmax(h @ self.out + self.out_bias)
                d[np.arange(len(y)), y] -= 1
                d /= len(y)
                dh = (d @ self.out.T) * (h > 0)
                slopes = [self._filter_slope(x, at, dh[:, i * FILTERS : (i + 1) * FILTERS], WIDTHS[i]) for i, at in enumerate(where)]
                for p, g, s in zip(parts, [*slopes, dh.sum(0), h.T @ d, d.sum(0)], seen):
                    s += g * g
                    p -= rate * g / np.sqrt(s)
        return self

    @staticmethod
    def _filter_slope(x: np.ndarray, at: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
        """Only the bytes under the largest value of a filter move its weights."""
        rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)
        return np.stack([np.bincount((x[rows, at + k].astype(np.int64) * FILTERS + f).ravel(), d.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(width)]).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """The whole text in rows of WINDOW bytes; the last is filled with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], ByteNet | None]:
    """The languages in order and the network, from about ``fit_rows`` rows (doc_id, text, lang), chosen by hash.

    The driver gets FIT_WINDOWS windows of each. Null or empty texts and null languages teach nothing; with
    no row there is no network.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                own = windows_of(text.encode()) if text else ()
                for i in np.random.default_rng(k & (2**63 - 1)).choice(len(own), min(FIT_WINDOWS, len(own)), replace=False) if text else ():
                    out.append((k, int(i), lang, own[i].tobytes()))
            columns = zip(*out) if out else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "i", "lang", "window"])

    rows = bounded_sample(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), fit_rows, "doc_id", "text")
    found = rows.select("k", "text", "lang").mapInArrow(cut, "k long, i int, lang string, window binary").toArrow()
    found = sorted(zip(*(found[c].to_pylist() for c in ("k", "i", "lang", "window"))))
    languages = sorted({lang for _, _, lang, _ in found})
    if not found:
        return [], None
    windows = np.stack([np.frombuffer(w, np.uint8) for *_, w in found])
    return languages, ByteNet(len(languages)).fit(windows, np.array([languages.index(lang) for _, _, lang, _ in found]))


def predictor(languages: list[str], net: ByteNet | None):
    """Column function text -> struct(lang_pred, score)."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter = regex.compile(r"\p{L}").search
        for array in texts:
            out: list = [{"lang_pred": UNKNOWN, "score": 0.0}] * len(array)
            waiting: list[tuple[int, np.ndarray]] = []
            held = 0

            def score() -> None:
                if not waiting:
                    return
                windows = np.concatenate([w for _, w in waiting])
                p = np.concatenate([net.probabilities(windows[i : i + BATCH]) for i in range(0, len(windows), BATCH)])
                ends = np.cumsum([len(w) for _, w in waiting])
                for (i, w), end in zip(waiting, ends):
                    mean = p[end - len(w) : end].mean(axis=0)
                    best = int(mean.argmax())
                    out[i] = {"lang_pred": languages[best], "score": float(min(1.0, mean[best]))}
                waiting.clear()

            for i, text in enumerate(array):
                t = text.as_py()
                if t is None or net is None or not letter(t):
                    continue
                waiting.append((i, windows_of(t.encode())))
                held += len(waiting[-1][1])
                if held >= 16 * BATCH:
                    score()
                    held = 0
            score()
            yield pa.array(out, kind)

    return predict


def identify(docs: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (probability of that language).

    Learns from the rows where ``learn`` holds (default: those not ``held_out``). A null text, or one without a letter, is
    ``und`` with score 0, as is every text where there is nothing to learn from. Whole texts
    are read, however long; repeated rows are predicted each; of equal scores the first language by code point
    wins.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    known = rows.where(~held_out(F.col("doc_id")) if learn is None else learn).select("doc_id", "text", "lang")
    predict = predictor(*train(known, fit_rows))
    return rows.select("doc_id", predict("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents with a language: not ``und``, and scored ``least`` or more; their columns stay as they are.

    Where there is nothing to learn from, every document whose text has a letter stays.
    """
    known = pick(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    languages, net = train(known)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predict = predictor(languages, net)
    judged = docs.withColumn("_p", predict("text"))
    return judged.where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= least)).drop("_p")
