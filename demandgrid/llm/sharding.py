"""Sharding by sampled splitters.

Rows are ordered by a hash of their text. A size-weighted sample of that order, bounded in
number, gives quantile splitters of many small ranges per shard. A key that fills a range
by itself becomes a range of its own. Exact sizes of the ranges are then counted (combined
per task, so a few thousand rows move); an overfull range is sampled and split again, a
single key by a hash of its rows. Whole keys and ranges are dealt to shards: single keys
first, largest first, then the ranges in order into the room that is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import pick, running_totals, stored

SHARDS, RANGES_PER_SHARD, DRAWS_PER_RANGE = 8, 256, 16
#: A range is overfull beyond so many times its share, while it can be split.
OVERFULL = 2.0


class Ranges:
    """Ranges of (key, sub): splitters of the keys, and splitters of ``sub`` for single keys."""

    def __init__(self, splitters: np.ndarray, single: dict[int, np.ndarray]):
        keys = np.array(sorted(single), np.int64)
        self.splitters, self.keys = np.unique(splitters.astype(np.int64)), keys
        self.subs = [np.unique(single[int(k)]) for k in keys]
        first = len(self.splitters) + 1
        self.first = first + np.concatenate([[0], np.cumsum([len(s) + 1 for s in self.subs])]).astype(np.int64)
        self.count = int(self.first[-1])

    def of(self, key: np.ndarray, sub: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.splitters, key, side="right").astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            for i in np.unique(at[self.keys[at] == key]):
                own = key == self.keys[i]
                out[own] = self.first[i] + np.searchsorted(self.subs[i], sub[own], side="right")
        return out

    def owner(self, number: int) -> int:
        """Index of the single key a range belongs to, or -1."""
        return int(np.searchsorted(self.first, number, side="right")) - 1


def quantiles(values: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Boundaries that cut the weighted values into parts of equal weight."""
    order = np.argsort(values, kind="stable")
    line = np.cumsum(weights[order])
    if not len(line) or parts < 2:
        return np.zeros(0, np.int64)
    at = np.searchsorted(line, line[-1] * np.arange(1, parts) / parts)
    return values[order][np.minimum(at, len(line) - 1)]


def _sample(rows: DataFrame, total: int, draws: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About ``draws`` rows (at most twice that expected), each with chance proportional to its size."""
    chance = F.col("size") * (draws / max(1, total))
    u = F.shiftrightunsigned(F.xxhash64("key", "sub", F.lit(turn)), 11) / float(2**53)
    found = rows.where(u < chance).select("key", "sub", F.greatest("size", F.lit(total / draws)).alias("w")).toPandas()
    return found["key"].to_numpy(np.int64), found["sub"].to_numpy(np.int64), found["w"].to_numpy(float)


def _split(key: np.ndarray, sub: np.ndarray, w: np.ndarray, share: float) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Splitters of a sample: keys heavier than ``share`` stand alone, the others are cut by weight."""
    names, which = np.unique(key, return_inverse=True)
    weight = np.bincount(which, w, len(names)) if len(names) else np.zeros(0)
    heavy = weight >= share
    single = {int(k): quantiles(sub[key == k], w[key == k], int(x // share)) for k, x in zip(names[heavy], weight[heavy])}
    light = ~heavy[which] if len(names) else np.zeros(0, bool)
    return quantiles(key[light], w[light], max(1, int(round(w[light].sum() / share)))), single


def _fill(totals: dict[int, tuple[int, int]], ranges: Ranges, shards: int) -> list[int]:
    """The shard of each range."""
    load, out = np.zeros(shards), [0] * ranges.count
    capacity = sum(t for t, _ in totals.values()) / shards
    units = []
    for i in range(len(ranges.keys)):
        own = list(range(ranges.first[i], ranges.first[i + 1]))
        size = sum(totals.get(r, (0, 0))[0] for r in own)
        units += [(size, own)] if size <= capacity else [(totals.get(r, (0, 0))[0], [r]) for r in own]
    # A range that is still overfull holds one row or key that nothing divides: it is placed like a single key.
    light = range(len(ranges.splitters) + 1)
    whole = {r for r in light if totals.get(r, (0, 0))[0] > OVERFULL * capacity / RANGES_PER_SHARD}
    units += [(totals[r][0], [r]) for r in whole]
    for size, own in sorted(units, key=lambda u: (-u[0], u[1])):
        s = int(np.argmin(load))
        load[s] += size
        for r in own:
            out[r] = s
    # The rest raises the shards to one level, beside those that a single row lifts above it.
    rest = sum(totals.get(r, (0, 0))[0] for r in light if r not in whole)
    low = np.sort(load)
    level = next((x for n in range(1, shards + 1) if (x := (rest + low[:n].sum()) / n) <= (low[n] if n < shards else np.inf)), capacity)
    room = np.cumsum(np.maximum(0, level - load))
    line = 0
    for r in light:
        if r in whole:
            continue
        size = totals.get(r, (0, 0))[0]
        middle = (line + size / 2) * (room[-1] / max(1e-9, rest))
        out[r] = min(int(np.searchsorted(room, middle, side="right")), shards - 1)
        line += size
    return out


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Sizes (bytes of the text plus 1) of the shards are nearly equal. Equal texts share a shard
    unless together they outgrow one. A null text has no bytes. Slots run from 0 without gaps
    in each shard. Repeated rows get a slot each; which of them gets which is left open. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        # Rows alike in id and text differ in the low bits only, so that many of them can be divided, too.
        F.xxhash64(F.lit("row"), "doc_id", text).bitwiseAND(~(2**20 - 1)).bitwiseOR(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**20))).alias("sub"),
    )
    rows = stored(rows, "rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = shards * ranges_per_shard
    share = max(1.0, total / parts)
    splitters, single = _split(*_sample(rows, total, parts * DRAWS_PER_RANGE, 0), share)
    for turn in range(1, 64):
        ranges = Ranges(splitters, single)
        number = _number(ranges)
        sums = rows.groupBy(number("key", "sub").alias("range")).agg(
            F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("sub") != F.max("sub")
        )
        totals = {r[0]: (r[1], r[2], r[3], r[4], r[5]) for r in sums.collect()}
        over = [n for n, (size, _, low, high, many) in totals.items() if size > OVERFULL * share and (low != high or many)]
        if not over:
            break
        inside = rows.where(number("key", "sub").isin(over))
        weight = sum(totals[n][0] for n in over)
        key, sub, w = _sample(inside, weight, max(64, int(DRAWS_PER_RANGE * weight / share)), turn)
        before = (len(splitters), sum(len(s) + 1 for s in single.values()))
        more, alone = _split(key, sub, w, share)
        splitters = np.unique(np.concatenate([splitters, more]))
        single |= {k: np.union1d(single.get(k, np.zeros(0, np.int64)), s) for k, s in alone.items()}
        if before == (len(splitters), sum(len(s) + 1 for s in single.values())):
            break
    shard_of = np.array(_fill({n: t[:2] for n, t in totals.items()}, ranges, shards), np.int32)

    @F.arrow_udf("int")
    def place(key: pa.Array, sub: pa.Array) -> pa.Array:
        return pa.array(shard_of[ranges.of(key.to_numpy(), sub.to_numpy())])

    placed = rows.withColumns({"shard": place("key", "sub"), "_one": F.lit(1)})
    placed = running_totals(placed, "shard", "_one", "sub", count, ("doc_id", "key"))
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("before").alias("slot"))


def _number(ranges: Ranges):
    @F.arrow_udf("long")
    def number(key: pa.Array, sub: pa.Array) -> pa.Array:
        return pa.array(ranges.of(key.to_numpy(), sub.to_numpy()))

    return number


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents (doc_id unique) in one folder per shard, ordered by slot within each file."""
    joined = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    joined.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
