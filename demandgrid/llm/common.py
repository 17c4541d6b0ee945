"""Helpers shared by the operators: column choice, stored tables, splits and prefix sums."""

from __future__ import annotations

import atexit
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandgrid.session import scratch_path

#: Rows that one window of ``running_totals`` sees, on average.
ROWS_PER_BUCKET = 1000

#: Bytes of the rows that a Python worker gets at once, unless a single row is larger.
BATCH_BYTES = 2 << 20

#: Bits of a bit array per entry, and the fewest and most bits: beyond that, more is hit in vain.
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32768

_written: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes: texts differ in length, so a number of rows bounds nothing.

    The setting stays, since results are computed when they are read. A smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name (of equal names the first), whatever else the table holds.

    Columns that differ only in case, or repeat, do not clash. A missing one raises ``ValueError``.
    """
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_c{df.columns.index(n)}").alias(n) for n in names))


def _remove_written() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written:
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors.

    The table is deleted when the program ends.
    """
    if not _written:
        atexit.register(_remove_written)
    path = scratch_path(df.sparkSession, f"llm-{name}")
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bits_for(rows: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << math.ceil(math.log2(max(1, rows * BITS_EACH)))))


def marked(rows: DataFrame, hash_: Column, among: DataFrame, name: str) -> DataFrame:
    """Adds the boolean ``name``: false only where ``hash_`` is not in the one column of hashes of ``among``.

    A wrong hit is possible, so an exact join has to follow; it then moves the rows that hit, not all. Every
    task gets a bit array of at most ``MOST_BITS`` bits. ``among`` is read twice: a stored table.
    """
    bits = bits_for(among.count())
    at = among.select(F.col(among.columns[0]).bitwiseAND(bits - 1).alias("p"))
    maps = at.groupBy(F.expr(f"p div {BITMAP}").alias("_block")).agg(F.expr(f"bitmap_construct_agg(p % {BITMAP})").alias("_map"))
    placed = rows.withColumn("_p", hash_.bitwiseAND(bits - 1)).withColumn("_block", F.expr(f"_p div {BITMAP}"))
    byte = F.conv(F.hex(F.expr(f"substring(_map, cast(_p % {BITMAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_p % 8 as int))").bitwiseAND(1) == 1, F.lit(False))
    found = placed.join(F.broadcast(maps), "_block", "left").withColumn("_byte", byte).withColumn(name, hit)
    return found.drop("_p", "_block", "_map", "_byte")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def running_totals(df: DataFrame, key: str, value: str, order: str, rows: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same ``key`` with a smaller ``order``.

    ``order`` is a 64-bit hash. Its leading bits deal the rows into buckets of about
    ``ROWS_PER_BUCKET``; bucket sums are added up in two levels, so no window holds a whole
    key however many rows that has. Equal hashes are ordered by ``ties``. ``key`` is never null.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_BUCKET))))
    low = bits // 2
    bucket = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")
    dealt = df.withColumn("_b", bucket)
    dealt = dealt.withColumns({"_b1": F.shiftright("_b", low), "_b2": F.col("_b").bitwiseAND(2**low - 1)}).drop("_b")
    sums = dealt.groupBy(key, "_b1", "_b2").agg(F.sum(value).alias("_v"))
    earlier = (Window.unboundedPreceding, -1)
    in_block = Window.partitionBy(key, "_b1").orderBy("_b2").rowsBetween(*earlier)
    in_key = Window.partitionBy(key).orderBy("_b1").rowsBetween(*earlier)
    blocks = sums.groupBy(key, "_b1").agg(F.sum("_v").alias("_v"))
    blocks = blocks.select(key, "_b1", F.coalesce(F.sum("_v").over(in_key), F.lit(0)).alias("_block"))
    base = sums.select(key, "_b1", "_b2", F.coalesce(F.sum("_v").over(in_block), F.lit(0)).alias("_in"))
    base = base.join(blocks, [key, "_b1"]).select(key, "_b1", "_b2", (F.col("_in") + F.col("_block")).alias("_base"))
    # The window comes before the join: rows then move once, whichever join is taken.
    in_bucket = Window.partitionBy(key, "_b1", "_b2").orderBy(order, *ties).rowsBetween(*earlier)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(in_bucket), F.lit(0)))
    out = local.join(base, [key, "_b1", "_b2"]).withColumn("before", (F.col("_base") + F.col("_local")).cast("long"))
    return out.drop("_b1", "_b2", "_base", "_local")


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has fewer), chosen by a hash of the columns ``by``, which is added as ``k``.

    The rows stay where they are: no task or driver gathers candidates for the sample.
    """
    share = min(1.0, rows / max(1, df.count()))
    keyed = df.withColumn("k", F.xxhash64(F.lit(7), *by))
    return keyed.where(F.shiftrightunsigned("k", 11) < F.lit(int(share * 2**53)))
