"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted list of the k smallest distinct shingle hashes of a text. Sketches of
parts merge to the sketch of the whole, and give resemblance, containment and the number
of distinct shingles.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.common import pick, stored

K, WORDS = 128, 5
#: Documents whose neighbours in id order are found by one window.
IDS_PER_BLOCK = 500


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of ``words`` words, in order; of all words, where there are fewer.

    Words are separated by white space. A null text, or one without words, has no shingles.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    hashes = F.transform(F.array_remove(F.split(spaced, " "), ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - words)
        full = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= words, full).otherwise(short)

    return _let(hashes, runs)


def _let(value: Column, use) -> Column:
    """``use(value)`` with value computed once."""
    return F.transform(F.array(value), use)[0]


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what a and b are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], column: str, k: int = K, parts: int = 64) -> DataFrame:
    """Sketch per group of rows: distinct hashes, then the k smallest in ``parts`` parts of each group, then of those."""
    one = df.select(*by, F.explode(column).alias("_x")).distinct()
    for keys in ([*by, "_part"], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_x"))
        one = one.withColumn("_part", F.pmod(F.hash("_x"), F.lit(parts))).withColumn("_r", rank).where(F.col("_r") <= k)
    return one.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common hashes among the k smallest of the union (exact for small sets); 1 for two empty sets."""

    def share(both: Column) -> Column:
        common = F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(both, -1))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(common) / F.size(both))

    return _let(merge(a, b, k), share).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, then from the place of the kth hash."""
    last = (F.element_at(a, -1).cast("double") + float(2**63)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of a that b has; 1 where a has none."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def printed(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")))


def _blocks(ids: DataFrame, column: str, rows: int) -> Column:
    """A block number by id, such that blocks hold about IDS_PER_BLOCK of evenly spread ids; -1 for null."""
    low, high = ids.agg(F.min(column), F.max(column)).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, math.ceil((high - low + 1) / max(1, rows / IDS_PER_BLOCK)))
    # As decimals: the span of longs may be no long.
    above = F.col(column).cast("decimal(20,0)") - F.lit(Decimal(low))
    return F.coalesce(F.floor(above / F.lit(Decimal(width))).cast("long"), F.lit(-1))


def heads_after(heads: DataFrame, rows: int) -> DataFrame:
    """(block, next_head) from rows (block, head): the head of the next lower block; of the last, the first's."""
    if rows <= 4 * IDS_PER_BLOCK:
        down = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc())
        first = heads.agg(F.max_by("head", "block").alias("first")).scalar()
        return heads.select("block", F.coalesce(F.lead("head").over(down), first).alias("next_head"))
    upper = stored(heads.withColumn("upper", _blocks(heads, "block", rows)), "heads")
    tops = upper.groupBy("upper").agg(F.max_by("head", "block").alias("head")).withColumnRenamed("upper", "block")
    after = heads_after(tops, tops.count()).withColumnsRenamed({"block": "upper", "next_head": "_after"})
    down = Window.partitionBy("upper").orderBy(F.col("block").desc())
    out = upper.withColumn("next_head", F.lead("head").over(down)).join(after, "upper")
    return out.select("block", F.coalesce("next_head", "_after").alias("next_head"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next document has the next lower doc_id.

    After the last comes the first. Null ids come last, in one block; equal ids in order of their text's hash.
    Text moves once, by block of ids; the first row of a block also visits the block before it.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    rows = rows.withColumn("block", _blocks(rows, "doc_id", count))
    # In a struct, so that the head of the block of null ids is not null itself.
    heads = stored(rows.groupBy("block").agg(F.struct(F.max("doc_id").alias("id")).alias("head")), "blocks")
    after = heads_after(heads, heads.count()).select(F.col("block").alias("at"), F.col("next_head.id").alias("_id"))
    first = Window.partitionBy("at").orderBy("_h", "text")
    guests = rows.join(after, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_h", F.xxhash64("text"))
    guests = guests.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    own = rows.select("block", "doc_id", "text", F.lit(False).alias("guest"))
    met = own.unionAll(guests.select("at", "doc_id", "text", F.lit(True)))
    met = met.repartition("block").withColumns({"_h": F.xxhash64("text"), "sketch": sketch(shingles(F.col("text")))})
    down = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "_h", "text")
    met = met.withColumns({"next_text": F.lead("text").over(down), "next_sketch": F.lead("sketch").over(down)})
    return met.where("not guest").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are found.

    Edited: the last third (floor) of the characters replaced by the first as many (or all) of
    the next document. Null texts are empty; an empty text has an empty fingerprint, and two
    empty ones are alike (1). A single document is its own next. Repeated rows stay.
    """
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 3) as int))"))
    rows = with_next(docs).withColumn("edited", F.when(cut == 0, F.col("text")).otherwise(edited))
    rows = rows.withColumn("edited_sketch", sketch(shingles(F.col("edited"))))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained"),
    )
