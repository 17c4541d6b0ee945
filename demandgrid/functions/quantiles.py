"""Exact quantiles of large groups without gathering or shuffling a group.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
That is fine for the days of one key, not for a whole table or a segment. Here the values are
written once and read twice. The first pass makes a mergeable KLL sketch per group, a few ten
kilobytes per task whatever the group's size, and takes from it a bracket around each wanted rank.
The second counts the values between the brackets and shuffles those inside, per distinct value.
The counts say exactly whether a bracket holds its rank; if one does not, which its width makes
unlikely, all values take its place. What is inside a bracket is split by the leading bits of the
value, so that values that lie close together (ratios near 1, prices around one level) are sorted in many parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from demandgrid.schema import ALL
from demandgrid.session import materialise

# Bits of the code that a coarse and a fine bin leave out: coarse bins are 0.05 % wide,
# fine ones 4e-9, and a group has at most some million coarse bins if its values cover all doubles.
_COARSE, _FINE = 40, 24
# Size of the sketches, and the half width of a bracket as a share of the ranks: three times their error
# of 2.296 / k^0.9021 at 99 % confidence.
_SKETCH = 4096
_MARGIN = 3 * 2.296 / _SKETCH**0.9021
# Rows of brackets or wanted bins that are broadcast; with more groups than that the passes are plain joins.
_BROADCAST_ROWS = 100_000


def _code(value: Column) -> Column:
    """Long that never decreases as the value grows: exponent and 51 bits of the mantissa."""
    size = F.least(F.abs(value), F.lit(1.7976931348623157e308))
    exponent = F.floor(F.log2(size))
    # log2 may round up just below a power of two; the code stays in order there.
    mantissa = size / F.pow(F.lit(2.0), exponent) - 1.0
    code = (exponent + 1075).cast("long") * 2**51 + F.floor(mantissa * float(2**51)).cast("long")
    return F.when(value == 0, F.lit(0)).when(value > 0, code).otherwise(-code).cast("long")


def _ranks(p: float, total: Column) -> tuple[Column, Column, Column]:
    """0-based ranks around (n - 1) * p and the weight of the upper one."""
    position = (total - 1) * F.lit(float(p))
    low = F.floor(position)
    return low, F.ceil(position), position - low


def _wanted(bins: DataFrame, by: Sequence[str], bin_: str, named: Mapping[str, float], total: Column | None = None) -> DataFrame:
    """The bins (with counts ``_n``) that hold a wanted rank, with ``_before`` (ranks below) and ``_total``.

    Bins inside a bin start at its own ``_before``.
    """
    ordered = Window.partitionBy(*(by or [F.lit(0)])).orderBy(bin_)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.lit(0) if total is None else F.col("_start")
    counted = bins.withColumn("_upto", start + F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumns(
        {"_total": F.sum("_n").over(whole) if total is None else total, "_before": F.col("_upto") - F.col("_n")}
    )
    holds = F.lit(False)
    for p in set(named.values()):
        low, high, _ = _ranks(p, F.col("_total"))
        holds = holds | ((low < F.col("_upto")) & (high >= F.col("_before")))
    return counted.filter(holds)


def _few(rows: DataFrame) -> DataFrame:
    """For a join: broadcast where the number of rows allows it."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST_ROWS else rows


def _brackets(sketches: DataFrame, by: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """Per group the bounds _lo0, _hi0, ... of the values around each wanted rank, NULL where there is no bound."""
    bounds = {}
    # As few values as a sketch holds are all kept: a margin may be less than the step to the next rank.
    many = F.kll_sketch_get_n_double("_s") > _SKETCH
    for i, p in enumerate(ps):
        low, high = p - _MARGIN, p + _MARGIN
        for name, at, inside in ((f"_lo{i}", low, low > 0), (f"_hi{i}", high, high < 1)):
            bounds[name] = F.when(many, F.kll_sketch_get_quantile_double("_s", F.lit(at))) if inside else F.lit(None).cast("double")
    return sketches.select(*by, *[c.alias(n) for n, c in bounds.items()])


def _counted(rows: DataFrame, brackets: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Counts of the distinct values inside the brackets, and of all others between them: (by, _region, _v, _n).

    Regions ascend with the values; ``_v`` is NULL in those between the brackets.
    """
    joined = rows.join(brackets, list(by)) if by else rows.crossJoin(brackets)
    v = F.col("_v")
    region, inside = F.lit(0), F.lit(False)
    for i in range(n):
        low = F.coalesce(v >= F.col(f"_lo{i}"), F.lit(True))
        high = F.coalesce(v <= F.col(f"_hi{i}"), F.lit(True))
        region = region + low.cast("int") + (~high).cast("int")
        inside = inside | (low & high)
    kept = joined.select(*by, region.alias("_region"), F.when(inside, v).alias("_v"))
    return kept.groupBy(*by, "_region", "_v").agg(F.count(F.lit(1)).alias("_n"))


def _counted_by_column(wide: DataFrame, brackets: DataFrame, feature: str, n: int) -> DataFrame:
    """``_counted`` for the columns of a wide table, named in ``feature``.

    Each task counts whole batches, column by column, so that a row per region and distinct value inside a
    bracket leaves a batch, instead of a row per value being joined and hashed.
    """
    names = wide.columns
    # As many rows as there are columns.
    bounds = {r[feature]: [(r[f"_lo{i}"], r[f"_hi{i}"]) for i in range(n)] for r in brackets.collect()}
    limits = [
        [(-np.inf if lo is None else lo, np.inf if hi is None else hi, hi is None) for lo, hi in bounds.get(c, ())] for c in names
    ]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for c, around in enumerate(limits):
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                if not len(x) or not around:
                    continue
                # Spark takes NaN for the largest value: inside a bracket only where that has no upper bound.
                nan = np.isnan(x)
                x = x + 0.0
                region, inside = np.zeros(len(x), np.int32), np.zeros(len(x), bool)
                for lo, hi, open_ in around:
                    low, high = (x >= lo) | nan, (x <= hi) | (nan & open_)
                    region += low.astype(np.int32) + ~high
                    inside |= low & high
                for r, k in zip(*np.unique(region[~inside], return_counts=True)):
                    parts.append((c, np.array([r]), np.array([0.0]), np.array([k]), np.array([True])))
                for r in np.unique(region[inside]):
                    v, k = np.unique(x[inside & (region == r)], return_counts=True)
                    parts.append((c, np.full(len(v), r), v, k, np.zeros(len(v), bool)))
            if parts:
                number = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
                r, v, k, outside = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
                arrays = [pa.array(number, pa.int32()), pa.array(r, pa.int32()), pa.array(v, pa.float64(), mask=outside), pa.array(k, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["c", "_region", "_v", "_n"])

    labels = F.array(*[F.lit(c) for c in names])
    counts = wide.mapInArrow(count, "c int, _region int, _v double, _n long").groupBy("c", "_region", "_v").agg(F.sum("_n").alias("_n"))
    return counts.select(F.get(labels, F.col("c")).alias(feature), "_region", "_v", "_n")


def quantiles_by_column(wide: DataFrame, named: Mapping[str, float], feature: str = "feature") -> DataFrame:
    """``quantile_columns`` of each column of a written table of doubles: one row per column that has a value."""
    long = wide.unpivot([], wide.columns, feature, "_x")
    return quantile_columns(long, "_x", named, [feature], written=True, count=lambda brackets, n: _counted_by_column(wide, brackets, feature, n))


def quantile_columns(
    df: DataFrame,
    value: str,
    named: Mapping[str, float],
    by: Sequence[str] = (),
    overall_of: str | None = None,
    written: bool = False,
    count: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """One row per group with a column per wanted quantile, exact and linearly interpolated.

    Rows with a NULL group or value do not count. ``overall_of`` names one of ``by``; groups with that
    column set to ``all`` are added. The table is evaluated once, unless it is ``written`` already and cheap to
    read. ``count`` may count what ``_counted`` does in a way that suits the table. Runs its jobs when called; only
    the last one is left to the reader of the result.
    """
    by = list(by)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, value]])
    rows = df.filter(known).select(*by, F.col(value).cast("double").alias("_v"))
    rows = rows if written else materialise(rows, "quantile-rows")
    sketches = rows.groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(_SKETCH)).alias("_s"))
    if overall_of:
        rest = [c for c in by if c != overall_of]
        sketches = materialise(sketches, "quantile-sketches")
        whole = sketches.groupBy(*rest).agg(F.kll_merge_agg_double("_s", F.lit(_SKETCH)).alias("_s"))
        sketches = sketches.unionByName(whole.withColumn(overall_of, F.lit(ALL)))
        rows = rows.withColumn(overall_of, F.explode(F.array(overall_of, F.lit(ALL))))
    ps = sorted(set(named.values()))
    brackets = materialise(_brackets(sketches, by, ps), "quantile-brackets")
    coarse = counts = None
    for bounds in (brackets, brackets.select(*by, *[F.lit(None).cast("double").alias(c) for c in brackets.columns if c not in by])):
        counted = count(bounds, len(ps)) if count else _counted(rows, _few(bounds), by, len(ps))
        counts = counted.withColumn("_c", F.when(F.col("_v").isNotNull(), _code(F.col("_v"))))
        bin_ = F.struct("_region", F.shiftright("_c", _COARSE).alias("bits"))
        counts = materialise(counts.withColumn("_bin", bin_), "quantile-counts")
        bins = counts.groupBy(*by, "_bin").agg(F.sum("_n").alias("_n"))
        wanted = _wanted(bins, by, "_bin", named).select(*by, "_bin", F.col("_before").alias("_start"), "_total")
        coarse = materialise(wanted, "quantile-bins")
        if coarse.filter(F.col("_bin.bits").isNull()).isEmpty():
            break
    counts = counts.filter(F.col("_v").isNotNull()).drop("_region").join(_few(coarse), [*by, "_bin"])
    counts = materialise(counts.withColumn("_part", F.shiftright("_c", _FINE)), "quantile-values")
    parts = counts.groupBy(*by, "_bin", "_part").agg(F.sum("_n").alias("_n"), F.max("_start").alias("_start"), F.max("_total").alias("_all"))
    fine = _wanted(parts, [*by, "_bin"], "_part", named, F.col("_all")).select(*by, "_bin", "_part", "_before")
    inside = Window.partitionBy(*by, "_bin", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(fine, [*by, "_bin", "_part"]).withColumn("_last", F.col("_before") + F.sum("_n").over(inside) - 1)
    ranked = ranked.withColumn("_first", F.col("_last") - F.col("_n") + 1)

    def quantile(p: float) -> Column:
        low, high, _ = _ranks(p, F.col("_total"))
        _, _, weight = _ranks(p, F.max("_total"))

        def at(rank: Column) -> Column:
            return F.max(F.when(rank.between(F.col("_first"), F.col("_last")), F.col("_v")))

        # Two equal neighbours, or a rank that is met exactly, need no arithmetic.
        return F.when((at(low) == at(high)) | (weight == 0), at(low)).otherwise(at(low) * (F.lit(1.0) - weight) + at(high) * weight)

    return ranked.groupBy(*by).agg(*[quantile(p).alias(n) for n, p in named.items()])
