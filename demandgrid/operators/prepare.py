"""From order lines to entity-day series."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from demandgrid.functions.numeric import count_where, nan_to_null, share_pct, with_scalars
from demandgrid.operators.ranking import top_n
from demandgrid.schema import BUSINESS, DATE, HOUSEHOLD, KEY, SEGMENT, VALUE

HOUSEHOLD_PREFIX = "A"


# --- checks, projections and filters -----------------------------------------


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def add_usage_type(df: DataFrame, col: str, prefix: str = HOUSEHOLD_PREFIX, out: str = SEGMENT) -> DataFrame:
    """Keys with the prefix are household, all others business."""
    return df.withColumn(out, F.when(F.col(col).startswith(prefix), HOUSEHOLD).otherwise(BUSINESS))


def segment(df: DataFrame, usage_type: str, col: str = SEGMENT) -> DataFrame:
    return df.filter(F.col(col) == usage_type)


def drop_matching(df: DataFrame, pattern: str = "category_lvl") -> DataFrame:
    """Drops category columns and every feature named after them."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def crop_years(df: DataFrame, first: int, last: int, date: str = DATE) -> DataFrame:
    """Keeps whole years; written as a date range so it reaches the parquet scan."""
    return df.filter(F.col(date).between(F.lit(dt.date(first, 1, 1)), F.lit(dt.date(last, 12, 31))))


def since(df: DataFrame, day: str | dt.date, date: str = DATE) -> DataFrame:
    return df.filter(F.col(date) >= F.lit(str(day)).cast("date"))


def with_date(df: DataFrame, out: str = "date", candidates: Sequence[str] = ("date", DATE)) -> DataFrame:
    """``out`` from the first candidate column that exists."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        raise ValueError(f"none of {list(candidates)} present")
    return df.withColumn(out, F.coalesce(*[F.to_date(c) for c in present]))


def narrow_floats(df: DataFrame) -> DataFrame:
    """DOUBLE to FLOAT, for use right before a write."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles})


# --- aggregation ---------------------------------------------------------------


def aggregate_level(
    df: DataFrame,
    level: str,
    date: str = DATE,
    value: str = VALUE,
    key: str = KEY,
) -> DataFrame:
    """Entity x day totals; ``level`` becomes the key and is kept as a column.

    Sums are combined on the map side, so a level value that holds a large part of
    the rows still reaches the reducer as one row per input task and day.
    """
    require_columns(df, [level, date, value])
    daily = (
        nan_to_null(df.select(level, date, value))
        .filter(F.col(level).isNotNull() & F.col(date).isNotNull())
        .groupBy(level, date)
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    )
    if level == key:
        return daily
    return daily.select(F.col(level).alias(key), level, date, value)


def first_attr(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-null value of each column per group, first by ``order``."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols])


# --- dense grid ------------------------------------------------------------------


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def _fill_days(
    df: DataFrame,
    key: str | Sequence[str],
    date: str,
    value: str,
    lo: Column | None,
    hi: Column | None,
    carry: Sequence[str],
    partitions: int | None,
) -> DataFrame:
    """One row per key and day.

    Each row generates the empty days up to the next row of its key, so only the
    sparse rows are shuffled (once, by key); the grid itself never is, and stays
    partitioned by key for the windows that follow. Generated days hold 0, the
    ``carry`` columns of the row they come from, and NULL elsewhere. ``partitions``
    sets the number of tasks that hold the grid, by default ``spark.sql.shuffle.partitions``:
    AQE would merge tasks by the size of the sparse rows, many times smaller than the grid.
    """
    keys = _keys(key)
    df = df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    series = Window.partitionBy(*keys).orderBy(date)
    others = [c for c in df.columns if c not in (*keys, date, value, "_lo", "_hi")]
    own = F.col("_day") == F.col(date)
    previous, following = F.lag(date).over(series), F.lead(date).over(series)
    begin = F.col(date) if lo is None else F.when(previous.isNull(), lo).otherwise(F.col(date))
    last_row_end = F.col(date) if hi is None else hi
    end = F.when(following.isNull(), last_row_end).otherwise(F.greatest(F.date_sub(following, 1), F.col(date)))
    return (
        df.withColumns({"_begin": begin, "_end": end})
        .withColumn("_day", F.explode(F.sequence("_begin", "_end")))
        .select(
            *keys,
            F.col("_day").alias(date),
            F.when(own, F.coalesce(F.col(value), F.lit(0.0))).otherwise(F.lit(0.0)).alias(value),
            *[F.col(c) if c in carry else F.when(own, F.col(c)).alias(c) for c in others],
        )
    )


def fill_zero_global(
    df: DataFrame,
    key: str | Sequence[str] = KEY,
    date: str = DATE,
    value: str = VALUE,
    carry: Sequence[str] = (),
    partitions: int | None = None,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Every key on every day between the first and the last date of the table.

    A list of columns, such as segment and key, makes a series of each combination.

    ``dates`` may name a cheaper table with the same first and last date, such as the
    raw lines, to read the bounds from.

    ``carry`` columns take the latest earlier value of the key, else its first one;
    for columns without NULL that equals ``fill_attributes`` without its window.
    """
    rows = _known(df, [*_keys(key), date])
    bounds = (rows if dates is None else dates).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return _fill_days(with_scalars(rows, bounds), key, date, value, F.col("_lo"), F.col("_hi"), carry, partitions)


def fill_zero_per_key(
    df: DataFrame,
    key: str | Sequence[str] = KEY,
    date: str = DATE,
    value: str = VALUE,
    carry: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Every day between the first and the last date of each key."""
    rows = _known(df, [*_keys(key), date])
    return _fill_days(rows, key, date, value, None, None, carry, partitions)


def fill_attributes(df: DataFrame, cols: Sequence[str], key: str = KEY, date: str = DATE) -> DataFrame:
    """Latest earlier value within the key, else the first later one.

    A row without an earlier value needs the first value of the whole key, so one
    ordered window serves both directions.
    """
    series = Window.partitionBy(key).orderBy(date)
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.first(c, ignorenulls=True).over(whole)) for c in cols
    }
    return df.withColumns(filled)


# --- summaries -------------------------------------------------------------------


def prep_summary(df: DataFrame, key: str = KEY, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Rows, keys, date range, zero share and the mean of the keys' daily means."""
    per_key = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(date).alias("lo"),
            F.max(date).alias("hi"),
            count_where(F.col(value) == 0).alias("zeros"),
            F.avg(value).alias("mean"),
            F.sum(value).alias("total"),
        )
    )
    return per_key.agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("key_count"),
        F.min("lo").alias("date_min"),
        F.max("hi").alias("date_max"),
        share_pct(F.sum("zeros"), F.sum("n")).alias("zero_pct"),
        F.avg("mean").alias("mean_daily_value"),
        F.sum("total").alias("total_value"),
    )


def top_share(df: DataFrame, n: int = 10, key: str = KEY, value: str = VALUE) -> DataFrame:
    """Percentage of the volume held by the ``n`` largest keys."""
    totals = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    top = top_n(totals, n, "total", key).agg(F.sum("total").alias("top_total"))
    whole = totals.agg(F.sum("total").alias("all_total"))
    return with_scalars(top, whole).withColumn("top_pct", share_pct(F.col("top_total"), F.col("all_total")))


def year_stats(df: DataFrame, key: str = KEY, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Distinct keys, sum and mean per year, by way of (year, key) partial totals."""
    per_key = df.groupBy(F.year(date).alias("year"), key).agg(
        F.sum(value).alias("total"), F.count(value).alias("n")
    )
    return per_key.groupBy("year").agg(
        F.count(key).alias("key_count"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total_value"),
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_value"),
    )


def reduction(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows and keys before and after keeping ``keys``, from per-key counts."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    kept = keys.select(key).distinct().withColumn("_kept", F.lit(True))
    marked = sizes.join(kept, key, "left")
    is_kept = F.col("_kept").isNotNull()
    return marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.when(is_kept, F.col("n"))), F.lit(0)).alias("rows_after"),
        F.count(F.lit(1)).alias("keys_before"),
        count_where(is_kept).alias("keys_after"),
    ).withColumn("reduction_pct", F.lit(100.0) - share_pct(F.col("rows_after"), F.col("rows_before")))
