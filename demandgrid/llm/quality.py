"""Document quality from line labels of a linear-chain conditional random field.

Every line with words is labelled good or bad. A line's features are shares and counts of its own
bytes and words and those of the lines before and after it, each cut into bins; a weight per feature and
bin, and weights for neighbouring labels, are fitted in numpy on documents with a known label, which all
their lines take. Forward and backward sums give each line's probability of being good; a document's
score is their mean, weighted by the lines' lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.llm.common import bounded_batches, bounded_sample, held_out, pick

#: Labelled rows to learn from, half of them of each label; all lines of these rows are used.
FIT_ROWS = 4000
BINS, ROUNDS, RATE, DECAY = 16, 120, 0.3, 1e-5
#: Lines of a chain that is fitted; longer documents are fitted in several chains.
FIT_CHAIN = 64
#: Characters whose lines are labelled together; of a longer text, all of them.
CHUNK_CHARS = 1 << 21
FEATURES = ("length", "words", "word length", "capitals", "signs", "calls", "digits", "capital words", "repeats", "other words", "same lines", "ends open")
#: Bytes by kind, fixed values.
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
CALLS = b"!?"
SIGNS = bytes(c for c in range(33, 127) if chr(c) not in ".,;:!?'\"()-" and not chr(c).isalnum())


def lines_of(text: str) -> list[bytes]:
    """The lines that have words, in order."""
    return [line for line in text.encode("utf-8", "replace").split(b"\n") if line.strip()]


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row per line of a document, a column per feature."""
    times: dict[bytes, int] = {}
    for line in lines:
        times[line] = times.get(line, 0) + 1
    out = np.empty((len(lines), len(FEATURES)), np.float32)
    for i, line in enumerate(lines):
        size, words = len(line), line.split()
        n = len(words)
        letters = size - len(line.translate(None, LETTERS))
        capitals = size - len(line.translate(None, CAPITALS))
        solid = sum(map(len, words))
        out[i] = (
            math.log2(size),
            math.log2(n),
            solid / n,
            capitals / max(1, letters),
            (size - len(line.translate(None, SIGNS))) / solid,
            (size - len(line.translate(None, CALLS))) / n,
            (size - len(line.translate(None, DIGITS))) / solid,
            sum(w[0] in CAPITALS for w in words) / n,
            sum(map(eq, words, words[1:])) / n,
            len(set(words)) / n,
            math.log2(times[line]),
            line.rstrip()[-1:] not in (b".", b"!", b"?", b":", b'"'),
        )
    return out


class Chains:
    """Lines of many chains in a row, and the order in which their places are worked through."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.size = int(self.starts[-1])
        long_first = np.argsort(-self.lengths, kind="stable")
        first, left = self.starts[:-1][long_first], self.lengths[long_first]
        at_least = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
        #: The lines that stand at place 0, 1, ... of their chains.
        self.places = [first[:m] + t for t, m in enumerate(at_least)]

    def neighbours(self, rows: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """``rows`` of the line before and of the line after; ``none`` at the ends of a chain."""
        before, after = np.full_like(rows, none), np.full_like(rows, none)
        before[1:], after[:-1] = rows[:-1], rows[1:]
        before[self.starts[:-1][self.lengths > 0]] = none
        after[self.starts[1:][self.lengths > 0] - 1] = none
        return before, after


class LineField:
    """States are 0 (bad) and 1 (good); ``weights`` are log odds of good."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, moves: np.ndarray, prior: float):
        self.edges, self.weights, self.moves, self.prior = edges, weights, moves, prior

    def codes(self, features: np.ndarray, chains: Chains) -> np.ndarray:
        return codes(self.edges, features, chains)

    def marginals(self, code: np.ndarray, chains: Chains) -> np.ndarray:
        """Probability of good, per line."""
        return _sums(self.weights[code].sum(axis=1), self.moves, chains)[0]

    def document_scores(self, documents: list[list[bytes]]) -> np.ndarray:
        """Length-weighted mean per document; the share of good rows learned from, where a document has no line."""
        chains = Chains(np.array([len(d) for d in documents], np.int64))
        out = np.full(len(documents), self.prior)
        if chains.size:
            features = np.concatenate([line_features(d) for d in documents if d])
            good = self.marginals(self.codes(features, chains), chains)
            length = np.array([len(line) for d in documents for line in d], float)
            some = chains.lengths > 0
            at = chains.starts[:-1][some]
            out[some] = np.add.reduceat(good * length, at) / np.add.reduceat(length, at)
        return np.clip(out, 0.0, 1.0)


def codes(edges: list[np.ndarray], features: np.ndarray, chains: Chains) -> np.ndarray:
    """Per line the numbers of its own bins, of those of the line before, and of those of the line after."""
    width = BINS + 1
    parts = []
    for f, cut in enumerate(edges):
        own = np.searchsorted(cut, features[:, f], side="left")
        for where, rows in enumerate((own, *chains.neighbours(own, BINS))):
            parts.append((f * 3 + where) * width + rows)
    return np.stack(parts, axis=1)


def _edges(values: np.ndarray) -> np.ndarray:
    """Upper ends of bins: half by the lines, half by the distinct values, as rare ones tell most."""
    parts = np.arange(1, BINS // 2) / (BINS // 2)
    return np.unique(np.concatenate([np.quantile(v, parts, method="lower") for v in (values, np.unique(values))]))


def _sums(odds: np.ndarray, moves: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good per line, expected moves [line, from, to] from the line before) by forward and backward sums."""
    own = np.empty((len(odds), 2))
    own[:, 1] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    own[:, 0] = 1 - own[:, 1]
    m = np.exp(moves)
    ahead, back = np.empty_like(own), np.ones_like(own)
    for t, at in enumerate(chains.places):
        value = own[at] if t == 0 else own[at] * (ahead[at - 1] @ m)
        ahead[at] = value / value.sum(axis=1, keepdims=True)
    for at in reversed(chains.places[1:]):
        value = (own[at] * back[at]) @ m.T
        back[at - 1] = value / value.sum(axis=1, keepdims=True)
    both = ahead * back
    pairs = np.zeros((len(odds), 2, 2))
    later = np.ones(len(odds), bool)
    later[chains.starts[:-1][chains.lengths > 0]] = False
    at = np.flatnonzero(later)
    pairs[at] = ahead[at - 1][:, :, None] * m * (own[at] * back[at])[:, None, :]
    pairs[at] /= pairs[at].sum(axis=(1, 2), keepdims=True)
    return both[:, 1] / both.sum(axis=1), pairs


def fit(documents: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None) -> LineField:
    """The field of documents (features per line) with label 0 or 1; ``weights`` per document."""
    weights = np.ones(len(labels)) if weights is None else weights
    prior = float((labels * weights).sum() / max(1e-9, weights.sum())) if len(labels) else 0.5
    cut = [(d[i : i + FIT_CHAIN], y, w) for d, y, w in zip(documents, labels, weights) for i in range(0, len(d), FIT_CHAIN)]
    slope = np.zeros(len(FEATURES) * 3 * (BINS + 1))
    moves = np.zeros((2, 2))
    if not cut or len(set(labels.tolist())) < 2:
        edges = [np.zeros(0)] * len(FEATURES)
        known = LineField(edges, slope, moves, prior)
        if cut:
            # All rows have one label: every line, being in the one bin of the first feature, takes it.
            known.weights[0] = 12.0 if labels[0] else -12.0
        return known
    features = np.concatenate([d for d, _, _ in cut])
    chains = Chains(np.array([len(d) for d, _, _ in cut]))
    edges = [_edges(features[:, f]) for f in range(len(FEATURES))]
    code = codes(edges, features, chains)
    good = np.repeat([float(y) for _, y, _ in cut], chains.lengths)
    # A document weighs the same however many lines it has, in the square root of their number.
    weight = np.repeat([w / math.sqrt(len(d)) for d, _, w in cut], chains.lengths)
    true = np.zeros((len(good), 2, 2))
    true[np.arange(len(good)), good.astype(int), good.astype(int)] = 1
    seen, seen_moves, total = np.full_like(slope, 1e-8), np.full_like(moves, 1e-8), weight.sum()
    for _ in range(ROUNDS):
        odds = slope[code].sum(axis=1)
        p, pairs = _sums(odds, moves, chains)
        g = np.bincount(code.ravel(), np.repeat((good - p) * weight, code.shape[1]), len(slope)) / total - DECAY * slope
        linked = pairs.any(axis=(1, 2))
        gm = ((true - pairs)[linked] * weight[linked, None, None]).sum(axis=0) / total - DECAY * moves
        seen += g * g
        seen_moves += gm * gm
        slope += RATE * g / np.sqrt(seen)
        moves += RATE * gm / np.sqrt(seen_moves)
    return LineField(edges, slope, moves, prior)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS) -> LineField:
    """The field of about ``fit_rows`` labelled documents, half of each label (all, of the rarer), chosen by a hash of doc_id.

    Features of their lines go to the driver, no texts. Sampled documents are weighted, so that each label has the weight of
    all its rows. Rows whose label is not 0 or 1 teach nothing; of several labels of a document the least counts.
    """
    known = pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id")) if learn is None else learn)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    parts = [bounded_sample(known.where(F.col("y") == y), fit_rows // 2, "doc_id") for y in (0, 1)]
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # A sample of bounded size: it goes to the documents.
    wanted = F.broadcast(parts[0].unionByName(parts[1]))
    rows = pick(docs, "doc_id", "text").join(wanted, "doc_id").select("k", "y", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(lines_of(t or "")).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["k", "y", "features"])

    found = sorted((r["k"], r["y"], bytes(r["features"])) for r in rows.mapInArrow(read, "k long, y int, features binary").collect())
    labels_ = np.array([y for _, y, _ in found], int)
    share = np.bincount(labels_, minlength=2)
    weights = np.array([totals[y] / share[y] for y in labels_]) if len(found) else np.zeros(0)
    documents = [np.frombuffer(f, np.float32).reshape(-1, len(FEATURES)) for _, _, f in found]
    return fit(documents, labels_, weights / max(1e-9, weights.mean()) if len(found) else weights)


def scorer(field: LineField):
    """Column function text -> score."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            out, waiting, held = [], [], 0
            for value in array:
                text = value.as_py() or ""
                waiting.append(lines_of(text))
                held += len(text)
                if held >= CHUNK_CHARS:
                    out.append(field.document_scores(waiting))
                    waiting, held = [], 0
            out.append(field.document_scores(waiting))
            yield pa.array(np.concatenate(out))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and score of every document: the likelihood, from 0 to 1, that its quality is good.

    Learns from ``labels`` (doc_id, quality) of the documents where ``learn`` holds (default: those not ``held_out``); without a
    label the score is 0.5. Null, empty and blank texts score the share of good rows among those learned from. Whole texts are
    read, however long; repeated rows score alike; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    score = scorer(train(docs, labels, learn, fit_rows))
    return pick(docs, "doc_id", "text").select("doc_id", score("text").alias("score"))


def label_lines(docs: DataFrame, field: LineField) -> DataFrame:
    """(doc_id, line_no, line, good) of every line with words; ``good`` is its probability."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                lines = lines_of(text.as_py() or "")
                if not lines:
                    continue
                chains = Chains(np.array([len(lines)]))
                good = field.marginals(field.codes(line_features(lines), chains), chains)
                columns = [pa.repeat(doc_id, len(lines)), pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.binary()).cast(pa.string()), pa.array(good)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line_no", "line", "good"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(label, f"doc_id {dict(rows.dtypes)['doc_id']}, line_no int, line string, good double")
