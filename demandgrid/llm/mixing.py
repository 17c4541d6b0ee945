"""Mixing sources to target weights.

A source's documents are put in a keyed random order, a line of words. A mix that takes T
words of a source of W words takes the first T words of that line, repeated as often as
needed, so only the last document is cut. The line is divided into blocks. The exact block
quotas of all sources are split among the output shards by a tree: at each node a
multivariate hypergeometric draw decides how many blocks of each source go left. A shard
then draws its blocks, disjoint from all others, at keyed permuted places of the line, and
orders its documents by a keyed hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.llm.common import pick, running_totals, stored

#: Word separators of the size measure, fixed values: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_WORDS = 1 << 16, 1 << 24
BROADCAST_SOURCES = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, repeats: int) -> list[float]:
    """Shares of ``total`` by weight, at most ``repeats`` times the size; the excess goes to the others."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level >= repeats * sizes[i]}
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else weights[i] * level
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(key & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds, repeated while the result is too large."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64(2 ** int(half) - 1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (_mixed(right, key * 4 + turn) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_draws(quotas: np.ndarray, capacities: np.ndarray, shard: int, seed: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source in a shard, and in all shards before it: the path from the root to that leaf."""
    low, high = 0, len(capacities)
    own, before = quotas, np.zeros_like(quotas)
    while high - low > 1:
        middle = (low + high) // 2
        if (low, high) not in known:
            known[low, high] = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, int(capacities[low:middle].sum()))
        left = known[low, high]
        if shard < middle:
            own, high = left, middle
        else:
            own, before, low = own - left, before + left, middle
    return own, before


def block_shards(spark, quotas: list[int], shards: int, seed: int) -> DataFrame:
    """(source_no, block, shard) for every drawn block; each task replays the tree for its own shards."""
    quota = np.asarray(quotas, np.int64)
    total = int(quota.sum())
    capacities = np.full(shards, total // shards) + (np.arange(shards) < total % shards)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            for shard in frame["id"]:
                own, before = shard_draws(quota, capacities, int(shard), seed, known)
                for s in np.flatnonzero(own):
                    at = permute(np.arange(before[s], before[s] + own[s]), int(quota[s]), seed * 1009 + int(s))
                    yield pd.DataFrame({"source_no": int(s), "block": at, "shard": int(shard)})

    return spark.range(shards).mapInPandas(draw, "source_no int, block long, shard int")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = 7,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, draws, and ``payload``.

    ``draws``: for each repeat that takes the document, its epoch, words (its first ones),
    shard and order in the shard. Sources by code point (null is a source of its own, last)
    weigh ``weights`` in turn. A null text has 0 words. Repeated rows count each; a table
    without rows gives none. Reruns give the same mix, in whatever order rows are read.
    One row per source goes to the driver: sources are a catalogue, not a value per document.
    """
    spark = docs.sparkSession
    columns = dict.fromkeys(("doc_id", "source", "text", *payload))
    sized = pick(docs, *columns).withColumn("size", word_count("text"))
    sized = sized.withColumns({"_h": F.xxhash64(F.lit(seed), "doc_id", "text"), "_crc": F.xxhash64("text")})
    sized = sized.select("doc_id", "source", "size", "_h", "_crc", *[c for c in columns if c in payload and c != "source"])
    # Sizes are kept; texts that go along are read and counted again rather than written once more.
    sized = sized if payload else stored(sized, "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    weighs = [weights[i % len(weights)] for i in range(len(found))]
    target = targets(sizes, weighs, share * sum(sizes), repeats)
    cuts = [round(t) for t in target]
    quotas = [-(-c // block_words) for c in cuts]
    shards = max(1, -(-sum(cuts) // shard_words))
    catalogue = spark.createDataFrame(
        [(r["source"], i, sizes[i], target[i], cuts[i]) for i, r in enumerate(found)],
        "source string, source_no int, source_size long, target double, cut long",
    )
    named = catalogue.withColumnRenamed("source", "_source")
    # Few sources go to every task; with very many, rows are shuffled by source.
    named = F.broadcast(named) if len(found) <= BROADCAST_SOURCES else named
    line = sized.join(named, sized["source"].eqNullSafe(named["_source"])).drop("_source")
    line = running_totals(line, "source_no", "size", "_h", sum(r["rows"] for r in found), ("doc_id", "_crc"))
    blocks = block_shards(spark, quotas, shards, seed)
    for epoch in range(repeats):
        at = F.col("source_size") * epoch + F.col("before")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - at)).cast("long")
        line = line.withColumns({"_words": words, "block": F.floor(at / block_words).cast("long")})
        line = line.join(blocks, ["source_no", "block"], "left").drop("block")
        draw = F.struct(F.lit(epoch).alias("epoch"), F.col("_words").alias("words"), "shard", F.xxhash64(F.lit(seed + 1 + epoch), "_h").alias("order"))
        line = line.withColumn(f"_draw{epoch}", F.when(F.col("_words") > 0, draw)).drop("_words", "shard")
    draws = F.filter(F.array(*(f"_draw{e}" for e in range(repeats))), lambda d: d.isNotNull())
    line = line.withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    keep = [c for c in columns if c in payload and c != "source"]
    return line.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *keep)


@F.arrow_udf(T.StringType())
def first_words(text: pa.Array, words: pa.Array) -> pa.Array:
    """The text up to the end of its nth word."""
    import re

    out = []
    for t, n in zip(text, words.to_pylist()):
        t = t.as_py() or ""
        end = 0
        for k, m in enumerate(re.finditer(WORD, t), 1):
            end = m.end()
            if k == n:
                break
        out.append(t if end and not re.search(WORD, t[end:]) else t[:end])
    return pa.array(out, pa.string())


def draw_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them: a row per draw, cut to its words, in shards and shuffled there.

    Columns of documents (doc_id, text, lang, source, n_chars); a document drawn twice stands twice.
    """
    drawn = mix(docs, payload=("text", "lang"), **settings).withColumn("d", F.explode("draws"))
    text = F.when(F.col("d.words") < F.col("size"), first_words("text", "d.words")).otherwise(F.col("text"))
    drawn = drawn.select("doc_id", text.alias("text"), "lang", "source", "d.shard", "d.order")
    drawn = drawn.withColumn("n_chars", F.char_length("text").cast("long"))
    # A shard is dealt to several tasks, by the leading bits of the order; each sorts its own.
    dealt = drawn.repartition("shard", F.shiftrightunsigned("order", 60)).sortWithinPartitions("shard", "order")
    return dealt.select("doc_id", "text", "lang", "source", "n_chars")
