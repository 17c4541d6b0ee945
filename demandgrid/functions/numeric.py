"""Null-safe arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares greater than every number in Spark; NULL never matches."""
    floating = [f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in floating})


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row result (a global aggregate) to every row.

    They enter as a scalar subquery: evaluated once, no join.
    """
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumns({c: packed.getField(c) for c in one_row.columns})


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero or missing."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def share_pct(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100.0), whole)


def round_half_even(value: Column, digits: int) -> Column:
    """Decimal rounding with ties to the even digit.

    The bits that depend on the order of a distributed sum are dropped first, so a
    tie is decided the same way on every run.
    """
    scale = F.lit(float(10**digits))
    return F.rint(F.round(value, digits + 6) * scale) / scale


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over rows with both values; NULL when one is constant.

    ``corr`` raises on a constant column under ANSI arithmetic.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
