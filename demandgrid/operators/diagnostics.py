"""Column profiles and correlations of a feature table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from demandgrid.functions.numeric import numeric_columns
from demandgrid.functions.quantiles import quantiles_by_column
from demandgrid.session import materialise

# Fixed values of the data model.
SKEW_LIMIT = 3.0
KURTOSIS_LIMIT = 10.0
ZERO_LIMIT = 0.9
MISSING_LIMIT = 0.1
VARIANCE_LIMIT = 0.01
CORRELATION_LIMIT = 0.95


def sample_skewness(col: str) -> Column:
    """Bias-corrected skewness, NULL below three values."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)))


def sample_kurtosis(col: str) -> Column:
    """Bias-corrected excess kurtosis, NULL below four values."""
    n = F.count(col).cast("double")
    scale = (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1.0) * F.kurtosis(col) + 6.0))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, _x) rows: an Expand inside the generated code, combined per feature
    before the shuffle. One wide aggregate over many columns would exceed the field
    limit of code generation."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot([], list(cols), "feature", "_x")


def _missing_rate() -> Column:
    return F.avg(F.col("_x").isNull().cast("double"))


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Moments, extremes, exact median and missing / zero rates per column."""
    names = list(cols or numeric_columns(df))
    # Written once, column by column; the passes unpivot what they read.
    wide = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in names]), "profiled")
    long = _long(wide, names)
    profile = long.groupBy("feature").agg(
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        sample_skewness("_x").alias("skew"),
        sample_kurtosis("_x").alias("kurtosis"),
        _missing_rate().alias("missing_rate"),
        F.avg(F.when(F.col("_x") == 0, 1.0).otherwise(0.0)).alias("zero_rate"),
    )
    return profile.join(quantiles_by_column(wide, {"median": 0.5}), "feature", "left")


def profile_flags(profile: DataFrame) -> DataFrame:
    """One row per column and exceeded limit."""
    checks = {
        "high_skew": (F.abs("skew") > SKEW_LIMIT, F.col("skew")),
        "high_kurtosis": (F.col("kurtosis") > KURTOSIS_LIMIT, F.col("kurtosis")),
        "high_zero_rate": (F.col("zero_rate") > ZERO_LIMIT, F.col("zero_rate")),
    }
    found = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(n).alias("flag"), v.alias("measured"))) for n, (c, v) in checks.items()])
    )
    return profile.select("feature", F.explode(found).alias("_f")).select("feature", "_f.*")


def high_missing(df: DataFrame, limit: float = MISSING_LIMIT, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns missing in more than the given share of rows."""
    rates = _long(df, cols or numeric_columns(df)).groupBy("feature").agg(_missing_rate().alias("missing_rate"))
    return rates.filter(F.col("missing_rate") > limit)


def low_variance(df: DataFrame, limit: float = VARIANCE_LIMIT, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns whose sample variance is below the limit."""
    spread = _long(df, cols or numeric_columns(df)).groupBy("feature").agg(F.var_samp("_x").alias("variance"))
    return spread.filter(F.col("variance") < limit)


def correlated_pairs(
    df: DataFrame, limit: float = CORRELATION_LIMIT, cols: Sequence[str] | None = None
) -> DataFrame:
    """Column pairs with |r| above the limit over rows where both are present.

    Each task sums products of whole batches of columns (matrix products over the rows it
    reads), so rows are not multiplied by pairs and one row per pair leaves a task. Values are taken from the
    column's mean, so that large means cost no digits. A constant column has no correlation.
    """
    names = list(cols or numeric_columns(df))
    doubles = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    # One row of means and extremes, as many numbers as there are columns.
    about = doubles.agg(*[f(c).alias(f"{n}{c}") for c in doubles.columns for n, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    centres = [about[f"m{c}"] or 0.0 for c in doubles.columns]
    varying = [i for i, c in enumerate(doubles.columns) if about[f"lo{c}"] is not None and about[f"lo{c}"] < about[f"hi{c}"]]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(varying)
        total = np.zeros((6, size, size))
        for batch in batches:
            if not batch.num_rows or not size:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) - centres[i] for i in varying])
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            square = x * x
            total += (there.T @ there, x.T @ there, there.T @ x, square.T @ there, there.T @ square, x.T @ x)
        a, b = np.triu_indices(size, 1)
        number = np.array(varying, np.int32)
        arrays = [pa.array(number[a]), pa.array(number[b]), *(pa.array(t[a, b]) for t in total)]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    sums = doubles.mapInArrow(moments, "a int, b int, n double, x double, y double, xx double, yy double, xy double")
    pair = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.nullif(F.col("n"), F.lit(0.0))

    def spread(product: str, one: str, other: str) -> Column:
        return F.col(product) - F.col(one) * F.col(other) / n

    # What rounding leaves of the spread of a constant column is no spread.
    def scale(square: str, one: str) -> Column:
        own = spread(square, one, one)
        return F.when(own > F.col(square) * 1e-13, F.sqrt(own))

    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), spread("xy", "x", "y") / scale("xx", "x") / scale("yy", "y")))
    by_pair = pair.withColumn("r", F.when(spread("xy", "x", "y").isNotNull() & scale("xx", "x").isNotNull() & scale("yy", "y").isNotNull(), r))
    labels = F.array(*[F.lit(c) for c in names])
    return by_pair.filter(F.abs("r") > limit).select(F.get(labels, F.col("a")).alias("feature_a"), F.get(labels, F.col("b")).alias("feature_b"), "r")
