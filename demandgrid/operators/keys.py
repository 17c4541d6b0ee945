"""Choosing the keys worth modelling.

Every operator first reduces the rows to one row per key with a map-side combined
aggregate, then ranks, compares or joins those key rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.functions.numeric import count_where, share_pct, with_scalars
from demandgrid.functions.quantiles import quantile_columns
from demandgrid.operators.ranking import ranked_top, top_n, top_per_group
from demandgrid.schema import ALL, BUSINESS, DATE, HOUSEHOLD, KEY, SEGMENT, VALUE

Day = str | dt.date


@dataclass(frozen=True)
class Preset:
    """Keys to train on: the ``top`` most active; and the monthly test minimum."""

    top: int
    min_test_per_step: int


# Fixed values of the data model.
PRESETS = {BUSINESS: Preset(3000, 2), HOUSEHOLD: Preset(3500, 4), ALL: Preset(7000, 4)}
PRODUCT_PRESET = Preset(50, 10)
TRAIN_COUNT = "actual_value_count_in_train_period"
TEST_THRESHOLDS = (4, 8, 48, 96)


def _day(day: Day) -> Column:
    return F.lit(str(day)).cast("date")


def _between(date: str, lo: Day | None, hi: Day | None) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(date) >= _day(lo))
    if hi is not None:
        cond = cond & (F.col(date) <= _day(hi))
    return cond


def test_period(train_end: Day, step: int = 1) -> tuple[dt.date, dt.date]:
    """First and last day of the ``step`` months after ``train_end``."""
    end = cal.to_day(train_end)
    return end + dt.timedelta(days=1), cal.add_months(end, step)


# --- counts and simple selections ------------------------------------------------


def active_counts(
    df: DataFrame, lo: Day | None = None, hi: Day | None = None, key: str = KEY, date: str = DATE, value: str = VALUE
) -> DataFrame:
    """Rows with a positive value per key within [lo, hi]."""
    active = df.filter((F.col(value) > 0) & F.col(key).isNotNull() & _between(date, lo, hi))
    return active.groupBy(key).agg(F.count(F.lit(1)).alias("active_count"))


def top_active(df: DataFrame, n: int, hi: Day | None = None, key: str = KEY, **names: str) -> DataFrame:
    """The ``n`` keys with most active rows up to ``hi``."""
    return top_n(active_counts(df, hi=hi, key=key, **names), n, "active_count", key)


def active_in_test(
    df: DataFrame, min_count: int, lo: Day, hi: Day | None = None, key: str = KEY, **names: str
) -> DataFrame:
    """Keys with at least ``min_count`` active rows in the test period."""
    counts = active_counts(df, lo, hi, key=key, **names)
    return counts.filter(F.col("active_count") >= min_count)


def _selection(df: DataFrame, preset: Preset, train_end: Day, step: int, key: str) -> tuple[DataFrame, DataFrame]:
    test_start = cal.to_day(train_end) + dt.timedelta(days=1)
    targets = active_in_test(df, preset.min_test_per_step * step, test_start, key=key).select(key)
    chosen = top_active(df, preset.top, train_end, key).select(key).union(targets).distinct()
    return chosen, targets


def select_keys(
    df: DataFrame, train_end: Day, step: int = 1, preset: Preset = PRESETS[ALL], key: str = KEY
) -> DataFrame:
    """All rows of keys that are among the most active in train or active in test."""
    chosen, _ = _selection(df, preset, train_end, step, key)
    return df.join(chosen, key, "left_semi")


def select_keys_by_segment(
    df: DataFrame,
    train_end: Day,
    step: int = 1,
    presets: Mapping[str, Preset] = PRESETS,
    key: str = KEY,
    date: str = DATE,
    value: str = VALUE,
    by: str = SEGMENT,
) -> DataFrame:
    """``select_keys`` for every segment at once, each with its own preset.

    Segments that ``presets`` does not name, and rows without one, get the general preset (``all``).
    """
    in_train = F.col(date) <= _day(train_end)
    counts = (
        df.filter((F.col(value) > 0) & F.col(key).isNotNull())
        .groupBy(by, key)
        .agg(
            count_where(in_train).alias("_train"),
            count_where(F.col(date) > _day(train_end)).alias("_test"),
        )
    )
    general = presets.get(ALL, PRESETS[ALL])
    top_of, min_of = F.lit(general.top), F.lit(general.min_test_per_step * step)
    for name, preset in presets.items():
        top_of = F.when(F.col(by) == name, preset.top).otherwise(top_of)
        min_of = F.when(F.col(by) == name, preset.min_test_per_step * step).otherwise(min_of)
    most = max(p.top for p in (general, *presets.values()))
    top = top_per_group(counts.filter(F.col("_train") > 0), most, "_train", key, [by], out="_rank")
    chosen = (
        top.filter(F.col("_rank") <= top_of)
        .select(by, key)
        .union(counts.filter(F.col("_test") >= min_of).select(by, key))
        .distinct()
        .toDF("_by", "_key")
    )
    return df.join(chosen, F.col(by).eqNullSafe(F.col("_by")) & (F.col(key) == F.col("_key")), "left_semi")


def select_products(
    df: DataFrame, train_end: Day, step: int = 1, preset: Preset = PRODUCT_PRESET, key: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """Product-level selection and the list of keys to predict."""
    chosen, targets = _selection(df, preset, train_end, step, key)
    return df.join(chosen, key, "left_semi"), targets


def threshold_stats(
    df: DataFrame,
    min_count: int,
    train_end: Day,
    period: tuple[Day, Day],
    test: tuple[Day, Day] | None = None,
    key: str = KEY,
    date: str = DATE,
    value: str = VALUE,
) -> DataFrame:
    """Per key: active rows in the period, in train and in test, and the two rules."""
    test = test or test_period(train_end)
    counts = (
        df.filter((F.col(value) > 0) & F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            count_where(_between(date, *period)).alias("actual_value_count"),
            count_where(_between(date, period[0], train_end)).alias("train_count"),
            count_where(_between(date, *test)).alias("test_count"),
        )
    )
    over = F.col("actual_value_count") >= min_count
    return counts.withColumn("is_over_threshold", over.cast("int")).withColumn(
        "selected", over | (F.col("test_count") > 0)
    )


def select_threshold(df: DataFrame, min_count: int, train_end: Day, period: tuple[Day, Day], **names) -> DataFrame:
    """Rows of keys with enough activity in the period or any in the test month."""
    key, date = names.get("key", KEY), names.get("date", DATE)
    test = names.get("test") or test_period(train_end)
    # Only two ranges of dates count; their hull reaches the scan.
    days = [cal.to_day(d) for d in (*period, *test)]
    counted = df.filter(_between(date, min(days), max(days)))
    stats = threshold_stats(counted, min_count, train_end, period, **names)
    return df.join(stats.filter("selected").select(key), key, "left_semi")


def attach_key_stats(pred: DataFrame, stats: DataFrame, key: str = KEY) -> DataFrame:
    """Threshold flag, active count and train-period count on every prediction, 0 for unknown keys."""
    named = {"is_over_threshold": "is_over_threshold", "actual_value_count": "actual_value_count", "train_count": TRAIN_COUNT}
    few = stats.select(key, *[F.col(c).alias(n) for c, n in named.items()])
    return pred.join(few, key, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in named.values()})


def restrict(pred: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    return pred.join(keys.select(key), key, "left_semi")


def volume_totals(df: DataFrame, hi: Day | None = None, key: str = KEY, date: str = DATE, value: str = VALUE) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull() & _between(date, None, hi))
    return rows.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total_value"))


def select_by_volume(df: DataFrame, n: int, train_end: Day, min_test: int, step: int = 1, key: str = KEY) -> DataFrame:
    """Rows of the ``n`` largest keys in train or of keys active in the test months."""
    lo, hi = test_period(train_end, step)
    top = top_n(volume_totals(df, train_end, key), n, "total_value", key).select(key)
    chosen = top.union(active_in_test(df, min_test, lo, hi, key).select(key)).distinct()
    return df.join(chosen, key, "left_semi")


def set_overlap(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """Each key with the side it is on: ``both``, ``only_a`` or ``only_b``."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    return left.join(right, key, "full").select(key, side.alias("side"))


# --- coverage ----------------------------------------------------------------------


def _measure(df: DataFrame, measure: str, key: str) -> DataFrame:
    """Per-key totals under the name ``m``: by volume or by active rows."""
    if measure == "sum":
        return volume_totals(df, key=key).select(key, F.col("total_value").alias("m"))
    if measure == "active":
        return active_counts(df, key=key).select(key, F.col("active_count").alias("m"))
    raise ValueError(f"unknown measure {measure!r}")


def coverage(df: DataFrame, measure: str, ns: Sequence[int], key: str = KEY) -> DataFrame:
    """For each N: total of the N largest keys, its share, and the cut in keys.

    Only the largest ``max(ns)`` keys are ranked. An N above the number of keys has
    no row.
    """
    totals = _measure(df, measure, key)
    whole = totals.agg(F.sum("m").alias("_all"), F.count(F.lit(1)).alias("_keys"))
    top = ranked_top(totals, max(ns), "m", key)
    cuts = [F.sum(F.when(F.col("rank") <= n, F.col("m"))).alias(f"n{n}") for n in ns]
    by_n = with_scalars(top.agg(*cuts), whole).unpivot(["_all", "_keys"], [f"n{n}" for n in ns], "_name", "top_total")
    n_keys = F.substring("_name", 2, 10).cast("int")
    return (
        by_n.withColumn("n", n_keys)
        .filter(F.col("n") <= F.col("_keys"))
        .select(
            "n",
            "top_total",
            share_pct(F.col("top_total"), F.col("_all")).alias("coverage_pct"),
            ((F.lit(1.0) - F.col("n") / F.col("_keys")) * 100.0).alias("key_reduction_pct"),
        )
    )


def top_detail(df: DataFrame, n: int, measure: str = "active", key: str = KEY) -> DataFrame:
    """Sum, mean, max, min, median and share of the ``n`` largest keys."""
    totals = _measure(df, measure, key)
    whole = totals.agg(F.sum("m").alias("all_total"))
    top = top_n(totals, n, "m", key).agg(
        F.count(F.lit(1)).alias("key_count"),
        F.sum("m").alias("top_total"),
        F.avg("m").alias("mean"),
        F.max("m").alias("max"),
        F.min("m").alias("min"),
        F.percentile("m", F.lit(0.5)).alias("median"),  # over at most n keys
    )
    return with_scalars(top, whole).withColumn("coverage_pct", share_pct(F.col("top_total"), F.col("all_total")))


def coverage_delta(
    df: DataFrame, n1: int, n2: int, test: tuple[Day, Day], min_test: int = 4, key: str = KEY
) -> DataFrame:
    """Gain of ranking ``n2`` instead of ``n1`` keys, also for keys active in test."""
    totals = _measure(df, "active", key)
    whole = totals.agg(F.sum("m").alias("_all"))
    ranked = ranked_top(totals, max(n1, n2), "m", key)
    tested = active_in_test(df, min_test, *test, key=key).select(key, F.lit(True).alias("_tested"))
    marked = ranked.join(tested, key, "left")
    first, second = F.col("rank") <= n1, F.col("rank") <= n2
    in_test = F.col("_tested").isNotNull()
    sums = marked.agg(
        F.sum(F.when(first, F.col("m"))).alias("total_n1"),
        F.sum(F.when(second, F.col("m"))).alias("total_n2"),
        count_where(first & in_test).alias("tested_n1"),
        count_where(second & in_test).alias("tested_n2"),
        count_where(second & ~first & in_test).alias("tested_added"),
    )
    pct1, pct2 = share_pct(F.col("total_n1"), F.col("_all")), share_pct(F.col("total_n2"), F.col("_all"))
    return with_scalars(sums, whole).select(
        "total_n1",
        "total_n2",
        pct1.alias("coverage_n1_pct"),
        pct2.alias("coverage_n2_pct"),
        (pct2 - pct1).alias("gain_points"),
        (F.col("total_n2") - F.col("total_n1")).alias("added_total"),
        "tested_n1",
        "tested_n2",
        "tested_added",
    )


def rank_overlap(df: DataFrame, n: int, key: str = KEY) -> DataFrame:
    """Keys shared by the top ``n`` by activity and the top ``n`` by volume."""
    by_count = top_n(_measure(df, "active", key), n, "m", key)
    by_volume = top_n(_measure(df, "sum", key), n, "m", key)
    sides = set_overlap(by_count, by_volume, key)
    return sides.agg(
        count_where(F.col("side") == "both").alias("overlap"),
        count_where(F.col("side") == "only_a").alias("only_active"),
        count_where(F.col("side") == "only_b").alias("only_volume"),
    ).withColumn("overlap_pct", share_pct(F.col("overlap"), F.lit(n)))


# --- distributions -----------------------------------------------------------------


def threshold_counts(counts: DataFrame, thresholds: Sequence[int], count: str = "active_count") -> DataFrame:
    """Keys with at least t rows for every t, in one pass over the key counts."""
    names = {f"t{t}": t for t in thresholds}
    one = counts.agg(
        F.count(F.lit(1)).alias("_keys"), *[count_where(F.col(count) >= t).alias(n) for n, t in names.items()]
    )
    rows = one.unpivot(["_keys"], list(names), "_name", "key_count")
    return rows.select(
        F.substring("_name", 2, 10).cast("int").alias("threshold"),
        "key_count",
        share_pct(F.col("key_count"), F.col("_keys")).alias("key_pct"),
    )


def threshold_sweep(
    df: DataFrame, lo: Day, hi: Day | None = None, thresholds: Sequence[int] = TEST_THRESHOLDS, key: str = KEY
) -> DataFrame:
    """Keys active in the test period under each threshold."""
    return threshold_counts(active_counts(df, lo, hi, key), thresholds)


def count_stats(counts: DataFrame, count: str = "active_count") -> DataFrame:
    """Keys, mean, extremes and quartiles of the per-key counts."""
    basic = counts.agg(
        F.count(F.lit(1)).alias("key_count"),
        F.avg(count).alias("mean"),
        F.max(count).alias("max"),
        F.min(count).alias("min"),
    )
    quartiles = quantile_columns(counts, count, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return with_scalars(basic, quartiles)


def nonzero_ratio(df: DataFrame, above: float | None = None, key: str = KEY, value: str = VALUE) -> DataFrame:
    """Share of positive rows per key; with ``above``, only keys beyond it."""
    positive = F.when(F.col(value) > 0, 1.0).otherwise(0.0)
    rates = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(positive).alias("nonzero_ratio"))
    return rates if above is None else rates.filter(F.col("nonzero_ratio") > above)


def recent_keys(df: DataFrame, day: Day, key: str = KEY, date: str = DATE) -> DataFrame:
    """Number of keys with a row on or after ``day``."""
    return df.filter(_between(date, day, None)).select(key).distinct().agg(F.count(key).alias("key_count"))


def key_stats(df: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(value).alias("count"),
            F.coalesce(F.sum(value), F.lit(0.0)).alias("total_value"),
            F.avg(value).alias("mean_value"),
            F.stddev_samp(value).alias("std_value"),
        )
    )

