"""N-gram Jaccard join with Bayesian candidate pruning.

1. One pass over the texts makes a MinHash signature per text; equal texts become one.
2. Texts that agree on a band of the signature meet under the smallest text key of that
   bucket, their leader. Candidates that share any bucket share a leader, and a text has few
   leaders, so texts move a few times, not once per band.
3. The texts of a leader are dealt to chunks of bounded size; two chunks make a cell. In a
   cell, signatures are compared a few values at a time: a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold, given the matches so far
   and a uniform prior, is below the tolerance. The others are verified exactly on shingles.
   A cell returns one row per text: its links, and one neighbour for the classes.
4. Classes are the connected components of those neighbours.

The bands miss a pair of similarity 0.8 with a probability of 5e-6, nearer ones less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import marked, pick, stored
from demandgrid.llm.shingling import WORDS, mixed, shingle_set

THRESHOLD, TOLERANCE = 0.8, 1e-6
BANDS, BAND_VALUES = 40, 6
#: Signature values compared before each look at the posterior.
STEP_VALUES = 40
#: Texts and shingles of a chunk, on average.
CHUNK_TEXTS, CHUNK_SHINGLES = 128, 200_000
#: Shingles of a slice of the exact verification.
SLICE = 4096


_FACTORS: dict = {}


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _FACTORS:
        rng = np.random.default_rng(20240229)
        _FACTORS[n] = rng.integers(0, 2**32, n, np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint32)
    return _FACTORS[n]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of many hash functions over the shingles, as 32-bit values."""
    a, b = _multipliers(BANDS * BAND_VALUES)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(out, (short[at : at + 512, None] * a ^ b).min(axis=0), out=out)
    return out


def least_matches(threshold: float, tolerance: float, values: int, step: int) -> list[tuple[int, int]]:
    """(values compared, fewest matches not dropped).

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    A compared value is one byte, so unequal minima agree with probability 1/256 besides.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(step, values, step), values]:
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def features(docs: DataFrame) -> DataFrame:
    """One row per distinct text with words: tid, doc_id (its least), copies, n (shingles), sig, bands."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, bands = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"")
                values = signature(s)
                grouped = values.reshape(BANDS, BAND_VALUES).astype(np.uint64)
                key = np.arange(BANDS, dtype=np.uint64)
                for j in range(BAND_VALUES):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, j])
                n.append(len(s))
                sig.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(key.view(np.int64).tolist() if len(s) else [])
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tid", "n", "sig", "bands"])

    rows = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tid"), F.col("text").cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    made = rows.mapInArrow(make, f"doc_id {kind}, tid binary, n int, sig binary, bands array<long>").where("n > 0")
    same = F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    return made.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *same)


def leaders(texts: DataFrame) -> DataFrame:
    """(tid, doc_id, copies, n, sig, leaders) of the texts that share a bucket: the least text keys of these buckets, as 64-bit hashes.

    Of equal hashes, two buckets share a leader: more pairs meet, none is missed.
    """
    bands = texts.select(F.xxhash64("tid").alias("t"), F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("t").alias("leader"), F.count("*").alias("m")).where("m > 1")
    shared = stored(shared.select("key", "leader"), "buckets")
    # Most buckets hold one text; those do not move again.
    again = marked(bands, F.col("key"), shared.select("key"), "_hit").where("_hit").drop("_hit")
    own = again.join(shared, "key").groupBy("t").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    return texts.drop("bands").withColumn("t", F.xxhash64("tid")).join(own, "t").drop("t")


def cells(led: DataFrame, bodies: DataFrame) -> DataFrame:
    """The texts of each cell (leader, i, j), i <= j: chunk, tid, copies, sig, text, leaders."""
    member = led.drop("doc_id").withColumn("leader", F.explode("leaders"))
    size = member.groupBy("leader").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK_TEXTS, F.col("total") / CHUNK_SHINGLES)).cast("int")
    dealt = member.join(size.select("leader", chunks.alias("chunks")), "leader")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("tid", "leader"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.join(bodies, "tid")
    i, j = F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    return dealt.select("leader", i, j, "chunk", "tid", "copies", "sig", "text", "leaders")


def _counted_before(leader: int, lists: list[list[int]]) -> np.ndarray | None:
    """Which of the texts have which leaders less than this one: two texts that share one met there."""
    columns: dict[int, int] = {}
    places = [(r, columns.setdefault(x, len(columns))) for r, own in enumerate(lists) for x in own if x < leader]
    if not columns:
        return None
    out = np.zeros((len(lists), len(columns)), np.float32)
    out[tuple(np.array(places).T)] = 1
    return out


def candidate_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of left[i], right[i] that the posterior does not drop."""
    done, matches = 0, np.zeros(len(left), np.int32)
    for n, least in limits:
        matches += (sig[left, done:n] == sig[right, done:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        left, right, matches, done = left[keep], right[keep], matches[keep], n
    return left, right


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left[i]] and sets[right[i]].

    Few pairs are merged one by one; many share a product of 0/1 rows over slices of the
    shingles that more than one set has.
    """
    if len(left) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    kept = times[column] > 1
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        low, high = np.searchsorted(column, [at, at + SLICE])
        part = np.zeros((len(sets), SLICE), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        common += part @ part.T
    return common[left, right].astype(np.int64)


def cell_links(cell: pd.DataFrame, threshold: float, limits: list[tuple[int, int]]) -> pd.DataFrame:
    """(tid, links, near): per linked text of a cell the copies it links to here, and a linked text."""
    cell = cell.drop_duplicates("tid").reset_index(drop=True)
    own, chunk = len(cell), cell["chunk"].to_numpy()
    sets = [shingle_set(t.encode()) for t in cell["text"]]
    sizes = np.array([len(s) for s in sets])
    sig = np.stack([np.frombuffer(x, np.uint8) for x in cell["sig"]])
    left, right = np.triu_indices(own, 1)
    # Pairs of one chunk belong to its own cell, also where the other chunk got no text.
    if cell["i"].iloc[0] != cell["j"].iloc[0]:
        across = chunk[left] != chunk[right]
        left, right = left[across], right[across]
    fits = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right])
    left, right = left[fits], right[fits]
    before = _counted_before(cell["leader"].iloc[0], list(cell["leaders"]))
    if before is not None:
        new = (before @ before.T)[left, right] == 0
        left, right = left[new], right[new]
    left, right = candidate_pairs(sig, left, right, limits)
    common = common_counts(sets, left, right)
    linked = common >= threshold * (sizes[left] + sizes[right] - common)
    left, right = left[linked], right[linked]
    copies = cell["copies"].to_numpy()
    links = np.bincount(left, copies[right], own) + np.bincount(right, copies[left], own)
    parent = np.arange(own)
    if len(left):
        while True:
            least = parent.copy()
            np.minimum.at(least, left, parent[right])
            np.minimum.at(least, right, parent[left])
            least = least[least]
            if (least == parent).all():
                break
            parent = least
    some = links > 0
    return pd.DataFrame({"tid": cell["tid"][some], "links": links[some].astype(np.int64), "near": cell["tid"].to_numpy()[parent[some]]})


def components(edges: DataFrame) -> DataFrame:
    """(tid, root) of the texts in edges (a, b): the least text of each component.

    Each round, every text points its larger neighbours, and then its smaller ones, to the
    least it knows of; rounds are written down, and end when nothing changes.
    """
    least = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = least.unionAll(least.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        rest = least.join(low, "a").select("a", "b", "low")
        small = rest.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
        own = low.where("low < a").select("a", F.col("low").alias("b"))
        after = stored(large.unionAll(small).unionAll(own).where("a > b").distinct(), "edges")
        if after.count() == least.count() and after.join(least, ["a", "b"], "left_anti").isEmpty():
            return after.select(F.col("a").alias("tid"), F.col("b").alias("root"))
        least = after


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, text key ``tid``, class_id, links, is_first.

    Similarity: Jaccard of the sets of five-word runs (of all words, where there are fewer),
    words separated by ASCII white space; links have at least ``threshold``. ``links`` counts the other
    documents linked to this one, copies included. ``class_id`` is the least doc_id of the
    connected component; ``is_first`` marks one document of each class. Texts that are null or have no words
    link to nothing and are classes of their own. Repeated rows are copies of each other, but all
    of a repeated id and text are marked alike. Null ids come after all others.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text")
    texts = stored(features(rows), "texts")
    led = stored(leaders(texts), "leaders")
    wanted = led.select("tid", "doc_id")
    keyed = rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tid"), "text")
    # Only texts that may be wanted move to the join; most have no candidates.
    hit = marked(keyed, F.xxhash64("tid", "doc_id"), wanted.select(F.xxhash64("tid", "doc_id")), "_hit").where("_hit").drop("_hit")
    first = hit.join(wanted, (hit["tid"] == wanted["tid"]) & hit["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    bodies = first.groupBy("tid").agg(F.first("text").alias("text"))
    limits = least_matches(threshold, tolerance, BANDS * BAND_VALUES, STEP_VALUES)

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        return cell_links(cell, threshold, limits)

    found = cells(led, bodies).groupBy("leader", "i", "j").applyInPandas(link, "tid binary, links long, near binary")
    found = stored(found, "links")
    roots = components(found.select(F.col("tid").alias("a"), F.col("near").alias("b")))
    links = found.groupBy("tid").agg(F.sum("links").alias("others"))
    known = texts.select("tid", "doc_id", "copies").join(links, "tid", "left").join(roots, "tid", "left")
    known = known.select("tid", "doc_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("root", "tid").alias("root"))
    known = stored(known, "known")
    classes = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("tid", F.struct(F.col("doc_id").isNull(), "doc_id", "tid")).alias("kept"))
    member = known.join(classes, "root").select("tid", F.col("doc_id").alias("_least"), "links", "class_id", (F.col("kept") == F.col("tid")).alias("_kept"))
    out = keyed.select("doc_id", "tid").join(member, "tid", "left")
    alone = F.col("links").isNull()
    return out.select(
        "doc_id", "tid",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        (alone | (F.col("_kept") & F.col("doc_id").eqNullSafe(F.col("_least")))).alias("is_first"),
    )


def first_of_classes(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each class; all columns stay. Of repeated rows one stays, too."""
    judged = join_documents(docs).select("doc_id", "tid", "is_first")
    judged = judged.groupBy("doc_id", "tid").agg(F.first("is_first").alias("is_first"), F.count("*").alias("rows"))
    judged = stored(judged.where("not is_first or rows > 1"), "dropped")
    keyed = docs.withColumn("_tid", F.unhex(F.md5(F.col("text").cast("binary"))))
    # Documents that are surely neither dropped nor repeated stay where they are; only the others move.
    keyed = marked(keyed, F.xxhash64("doc_id", "_tid"), judged.select(F.xxhash64("doc_id", "tid")), "_hit")
    gone = judged.where("not is_first").withColumnsRenamed({"doc_id": "_d", "tid": "_t"})
    hit = keyed.where("_hit")
    same = hit["doc_id"].eqNullSafe(gone["_d"]) & hit["_tid"].eqNullSafe(gone["_t"])
    kept = hit.join(gone, same, "left_anti")
    if not judged.where("is_first").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_tid"])
    return keyed.where("not _hit").unionByName(kept).drop("_tid", "_hit")
