"""Time-series and profile features.

Series operators expect an entity-day table (``aggregate_level`` or a grid): one
row per key and day, so a key's window holds as many rows as there are days,
whatever share of the raw lines the key had. All windows over one key share a
single exchange and sort; (key, weekday) windows reuse that exchange when they
follow a key window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.functions.numeric import count_where, numeric_columns, ratio, share_pct
from demandgrid.functions.quantiles import quantiles_by_column
from demandgrid.schema import DATE, KEY, SEGMENT, SPLIT, STORE, TEST, TRAIN, VALUE
from demandgrid.session import materialise

# Fixed values of the data model.
LAGS = (1, 2, 3, 7, 14, 21, 28)
WINDOWS = (7, 14, 28)
TRENDS = (7, 28)
# Built from the current target, or (the profile) from later ones.
LEAKING = ("trend_7d_f", "trend_28d_f") + tuple(f"product_{x}_f" for x in ("mean", "std", "median", "min", "max"))
# Rows of one entity and day, on average, for each sampled cut between its buckets; and the most cuts.
ROWS_PER_CUT, MOST_CUTS = 50_000, 256
DEFAULT_CONFIG = {
    KEY: {
        "lag": [1, 2, 3],
        "rolling_mean": [2, 3, 6],
        "rolling_std": [2, 3, 6],
        "cumulative_mean": [2, 3, 6, 12],
    }
}

_ROLLING = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}


def _series(key: str | Sequence[str], date: str):
    """Window of one series; a list of columns names a series by several keys."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(date)


# --- column builders -------------------------------------------------------------


def lag_columns(
    ns: Sequence[int] = LAGS, key: str | Sequence[str] = KEY, date: str = DATE, value: str = VALUE
) -> dict[str, Column]:
    series = _series(key, date)
    return {f"lag_{n}_f": F.lag(value, n).over(series) for n in ns}


def rolling_columns(
    stat: str,
    ns: Sequence[int] = WINDOWS,
    key: str | Sequence[str] = KEY,
    date: str = DATE,
    value: str = VALUE,
) -> dict[str, Column]:
    """Statistic over the ``n`` rows before the current one; fewer at the start."""
    series = _series(key, date)
    return {f"rolling_{stat}_{n}_f": _ROLLING[stat](value).over(series.rowsBetween(-n, -1)) for n in ns}


def trend_columns(
    ns: Sequence[int] = TRENDS, key: str | Sequence[str] = KEY, date: str = DATE, value: str = VALUE
) -> dict[str, Column]:
    """Change against ``n`` rows ago. Uses the current value, so it leaks the target."""
    series = _series(key, date)
    past = {n: F.lag(value, n).over(series) for n in ns}
    return {f"trend_{n}d_f": ratio(F.col(value) - p, p + F.lit(1.0)) for n, p in past.items()}


# --- operators -------------------------------------------------------------------


def lags(df: DataFrame, ns: Sequence[int] = LAGS, **names: str) -> DataFrame:
    return df.withColumns(lag_columns(ns, **names))


def rolling(df: DataFrame, stat: str, ns: Sequence[int] = WINDOWS, **names: str) -> DataFrame:
    return df.withColumns(rolling_columns(stat, ns, **names))


def trend(df: DataFrame, ns: Sequence[int] = TRENDS, **names: str) -> DataFrame:
    return df.withColumns(trend_columns(ns, **names))


def change_rate(df: DataFrame, key: str | Sequence[str] = KEY, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Relative change between the two rows before the current one."""
    series = _series(key, date)
    one, two = F.lag(value, 1).over(series), F.lag(value, 2).over(series)
    return df.withColumn("change_rate_f", ratio(one - two, two))


def cumulative_mean(
    df: DataFrame, ns: Sequence[int] = (2, 3, 6, 12), key: str = KEY, date: str = "period", value: str = "period_mean"
) -> DataFrame:
    """Mean of the ``n`` earlier periods; feed it ``period_mean(..., 'month')``."""
    series = _series(key, date)
    return df.withColumns({f"cumulative_mean_{n}_f": F.avg(value).over(series.rowsBetween(-n, -1)) for n in ns})


def dow_mean(df: DataFrame, key: str = KEY, date: str = DATE, value: str = VALUE, out: str | None = None) -> DataFrame:
    """Mean of the key's earlier values on the same business weekday."""
    weekday = cal.day_of_week_f(date)
    same_day = Window.partitionBy(key, weekday).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out or "material_dow_mean_f", F.when(weekday.isNotNull(), F.avg(value).over(same_day)))


def entity_dow_mean(
    df: DataFrame,
    entity: str = STORE,
    tie: str = KEY,
    date: str = DATE,
    value: str = VALUE,
    out: str | None = None,
) -> DataFrame:
    """``dow_mean`` for an entity with many rows per day, in (date, tie) order.

    A store may hold a large part of the table, so its rows are never put into one
    (entity, weekday) window. Earlier days enter as day totals. The rows of one entity and day share a window, unless
    they are many: then they are cut at sampled values of ``tie`` into buckets, whose totals are added up
    first. Rows of equal ``tie`` stay together. Day totals are written when this is called.
    """
    if entity not in df.columns:
        return df
    out = out or f"{entity}_dow_mean_f"
    weekday = cal.day_of_week_f(date)
    sampled = F.when(F.pmod(F.xxhash64(tie), F.lit(ROWS_PER_CUT)) == 0, F.col(tie))
    days = (
        df.filter(F.col(entity).isNotNull() & weekday.isNotNull())
        .groupBy(entity, date)
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"), F.count(value).alias("_n"), F.array_sort(F.collect_set(sampled)).alias("_sample"))
    )
    days = materialise(days, "entity-days")
    before = Window.partitionBy(entity, weekday).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    past = days.select(
        entity,
        date,
        F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_past_sum"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_past_n"),
    )
    today = [entity, date]
    every = F.ceil(F.size("_sample") / MOST_CUTS)
    cuts = days.filter(F.size("_sample") > 0).select(entity, date, F.filter("_sample", lambda x, i: i % every == 0).alias("_cuts"))
    divided = not cuts.isEmpty()
    rows = df
    if divided:
        placed = df.join(cuts, [entity, date], "left")
        bucket = F.size(F.filter("_cuts", lambda cut: cut <= F.col(tie)))
        rows = placed.withColumn("_bucket", F.when(F.col("_cuts").isNull() | F.col(tie).isNull(), 0).otherwise(bucket)).drop("_cuts")
        today.append("_bucket")
    so_far = Window.partitionBy(*today).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    with_today = rows.withColumns(
        {
            "_today_sum": F.coalesce(F.sum(value).over(so_far), F.lit(0.0)),
            "_today_n": F.count(value).over(so_far),
        }
    )
    if divided:
        earlier = Window.partitionBy(entity, date).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy(*today).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"), F.count(value).alias("_c"))
        base = totals.select(*today, F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c"))
        with_today = with_today.join(base, today, "left").withColumns(
            {"_today_sum": F.col("_today_sum") + F.col("_s"), "_today_n": F.col("_today_n") + F.col("_c")}
        )
    mean = ratio(F.col("_past_sum") + F.col("_today_sum"), F.col("_past_n") + F.col("_today_n"))
    return (
        with_today.join(past, [entity, date], "left")
        .withColumn(out, F.when(weekday.isNotNull(), mean))
        .select(*df.columns, out)
    )


def key_profile(
    df: DataFrame,
    train_end: str | None = None,
    key: str = KEY,
    date: str = DATE,
    value: str = VALUE,
    prefix: str = "product",
) -> DataFrame:
    """Mean, std, median, min and max of the key on each of its rows.

    All rows count unless ``train_end`` is given. A window instead of an aggregate
    and a join: the series exchange is reused and nothing is read twice.
    """
    of_key = Window.partitionBy(key)
    v = F.col(value) if train_end is None else F.when(F.col(date) <= F.lit(train_end).cast("date"), F.col(value))
    return df.withColumns(
        {
            f"{prefix}_mean_f": F.avg(v).over(of_key),
            f"{prefix}_std_f": F.stddev_samp(v).over(of_key),
            f"{prefix}_median_f": F.percentile(v, F.lit(0.5)).over(of_key),
            f"{prefix}_min_f": F.min(v).over(of_key),
            f"{prefix}_max_f": F.max(v).over(of_key),
        }
    )


def period_mean(df: DataFrame, entity: str, unit: str, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Mean per entity and week (from Monday) or month."""
    period = F.trunc(date, unit)
    return (
        df.filter(F.col(entity).isNotNull())
        .groupBy(entity, period.alias("period"))
        .agg(F.avg(value).alias("period_mean"))
    )


def mask_after(df: DataFrame, train_end: str, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Target NULL after ``train_end``, so no feature sees it."""
    return df.withColumn(value, F.when(F.col(date) <= F.lit(train_end).cast("date"), F.col(value)))


def label_split(df: DataFrame, train_end: str | dt.date, date: str = DATE, out: str = SPLIT) -> DataFrame:
    """Rows up to ``train_end`` are train; later or undated rows are test."""
    return df.withColumn(out, F.when(F.col(date) <= F.lit(str(train_end)).cast("date"), TRAIN).otherwise(TEST))


def split_sizes(df: DataFrame, split: str = SPLIT) -> DataFrame:
    """Rows and share of train and test in one pass."""
    sizes = df.agg(
        count_where(F.col(split) == TRAIN).alias(TRAIN),
        count_where(F.col(split) == TEST).alias(TEST),
        F.count(F.lit(1)).alias("total"),
    )
    return sizes.unpivot(["total"], [TRAIN, TEST], split, "row_count").select(
        split, "row_count", share_pct(F.col("row_count"), F.col("total")).alias("pct")
    )


def feature_columns(df: DataFrame, suffix: str = "_f", block: Sequence[str] | None = None) -> list[str]:
    """Names by suffix; with ``block``, every numeric column not listed there."""
    if block is not None:
        return [c for c in numeric_columns(df) if c not in set(block)]
    return [c for c in df.columns if c.endswith(suffix)]


def null_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of NULL per column: one count per column in one aggregate."""
    cols = list(cols or feature_columns(df))
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols])
    known = one.unpivot(["_rows"], cols, "feature", "_known")
    return known.select("feature", (F.lit(1.0) - ratio(F.col("_known"), F.col("_rows"))).alias("null_rate"))


def describe_features(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max per feature."""
    cols = list(cols or feature_columns(df))
    wide = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "described")
    long = wide.unpivot([], cols, "feature", "_x")
    basic = long.groupBy("feature").agg(
        F.count("_x").alias("count"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    quartiles = quantiles_by_column(wide, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, "feature", "left")


# --- feature sets ------------------------------------------------------------------


def calendar_features(df: DataFrame, date: str = DATE, segment: str = SEGMENT) -> DataFrame:
    """Calendar, container and one-hot columns of the segment feature set."""
    cols = {
        "day_of_week_f": cal.dow(date),
        "is_weekend_f": cal.is_weekend(date),
        "is_business_day_f": cal.is_business_day_simple(date),
        **cal.month_parts(date),
        **cal.day_parts(date),
        **cal.onehot_dow(date),
    }
    if segment in df.columns:
        cols["container_f"] = cal.container_f(segment)
    return df.withColumns(cols)


def product_calendar(df: DataFrame, holidays: DataFrame, date: str = DATE) -> DataFrame:
    """Calendar columns of the product feature set."""
    parts = cal.month_parts(date)
    flags = df.withColumns(
        {
            "dow": cal.dow(date),
            "is_weekend": cal.is_weekend(date),
            "day_of_week_f": cal.day_of_week_f(date),
            "month": parts["month_f"],
            "quarter": parts["quarter_f"],
            "year": parts["year_f"],
            **cal.month_edges(date),
        }
    )
    return cal.is_business_day_f(flags, holidays, date)


def config_columns(
    sizes: Mapping[str, Sequence[int]], series: str | Sequence[str] = KEY, date: str = DATE, value: str = VALUE
) -> dict[str, Column]:
    """Feature columns of one entity from its window sizes."""
    names = {"key": series, "date": date, "value": value}
    built = {
        **lag_columns(sizes.get("lag", ()), **names),
        **rolling_columns("mean", sizes.get("rolling_mean", ()), **names),
        **rolling_columns("std", sizes.get("rolling_std", ()), **names),
    }
    # The mean of the n calendar months before the row's own.
    months = Window.partitionBy(*([series] if isinstance(series, str) else series)).orderBy(F.year(date) * 12 + F.month(date))
    for n in sizes.get("cumulative_mean", ()):
        built[f"cumulative_mean_{n}_f"] = F.avg(value).over(months.rangeBetween(-n, -1))
    return built


def features_from_config(
    df: DataFrame,
    config: Mapping[str, Mapping[str, Sequence[int]]] = DEFAULT_CONFIG,
    key: str = KEY,
    series: Sequence[str] | None = None,
    date: str = DATE,
    value: str = VALUE,
) -> DataFrame:
    """Window features per entity from a size table.

    Features of the key are windows on the table itself. A coarser entity gets its
    windows on its own entity-day totals, joined back by (entity, date).
    """
    out = df
    if key in config:
        built = config_columns(config[key], series or key, date, value)
        # Windows over months come first, so that those over days, here and in what follows, share one sort.
        months = {n: c for n, c in built.items() if n.startswith("cumulative_")}
        days = {n: c for n, c in built.items() if n not in months}
        out = df.withColumns(months).withColumns(days).select(*[c for c in df.columns if c not in built], *built)
    for entity in [e for e in config if e != key and e in df.columns]:
        daily = df.filter(F.col(entity).isNotNull()).groupBy(entity, date).agg(F.sum(value).alias(value))
        built = config_columns(config[entity], entity, date, value)
        wide = daily.select(entity, date, *[c.alias(f"{entity}_{n}") for n, c in built.items()])
        out = out.join(wide, [entity, date], "left")
    return out


def series_features(df: DataFrame, lag_ns: Sequence[int] = LAGS, window_ns: Sequence[int] = WINDOWS, **names: str) -> DataFrame:
    """All lag, rolling and trend columns in one window operator."""
    cols = {**lag_columns(lag_ns, **names)}
    for stat in _ROLLING:
        cols.update(rolling_columns(stat, window_ns, **names))
    cols.update(trend_columns(**names))
    return df.withColumns(cols)


def feature_job(
    df: DataFrame,
    mode: str,
    train_end: str,
    holidays: DataFrame | None = None,
    config: Mapping[str, Mapping[str, Sequence[int]]] = DEFAULT_CONFIG,
    key: str = KEY,
    mask: bool = True,
) -> DataFrame:
    """Complete feature table from a dense entity-day table.

    ``by_usage_type`` treats (segment, key) as the series in one plan instead of a
    loop over segments, ``all`` ignores the segment, and ``product`` builds the
    product feature set. ``mask`` hides the values after ``train_end`` from the windows of
    the first two; ``forecast_table`` has features fit for a forecast.
    """
    if mode == "product":
        if holidays is None:
            raise ValueError("the product feature set needs a holiday table")
        series = key_profile(series_features(df, key=key), key=key)
        with_dow = dow_mean(series, key)
        if STORE in df.columns and STORE != key:
            with_dow = entity_dow_mean(with_dow, STORE)
        return label_split(product_calendar(with_dow, holidays), train_end)
    if mode not in ("by_usage_type", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    by_segment = mode == "by_usage_type"
    series = [SEGMENT, key] if by_segment else [key]
    table = df if by_segment or SEGMENT not in df.columns else df.drop(SEGMENT)
    masked = table.withColumn("_target", F.col(VALUE))
    masked = mask_after(masked, train_end) if mask else masked
    built = change_rate(features_from_config(masked, config, key, series), series)
    restored = built.withColumn(VALUE, F.col("_target")).drop("_target")
    return label_split(calendar_features(restored), train_end)


def known_at_month_start(
    df: DataFrame, cols: Sequence[str], train_end: str | dt.date, series: str | Sequence[str] = KEY, date: str = DATE
) -> DataFrame:
    """The columns as they stand on the first row of the series' month.

    They must not use the row's own value. All rows after ``train_end`` count as one month that
    begins the day after, so training and test rows know the past equally well: up to the
    day before the first one to forecast.
    """
    after = F.date_add(F.lit(str(train_end)).cast("date"), 1)
    block = F.when(F.col(date) >= after, after).otherwise(F.trunc(date, "month"))
    # In the order the columns were made in: a window per month would sort all rows once more.
    order = _series(series, date)
    begins = (F.row_number().over(order) == 1) | ~F.col("_block").eqNullSafe(F.lag("_block").over(order))
    started = df.withColumn("_block", block).withColumn("_begins", begins)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(F.col("_begins"), F.struct(*cols)), ignorenulls=True).over(so_far)
    return started.withColumn("_first", first).withColumns({c: F.col("_first")[c] for c in cols}).drop("_block", "_begins", "_first")


def forecast_table(
    df: DataFrame,
    mode: str,
    train_end: str | dt.date,
    config: Mapping[str, Mapping[str, Sequence[int]]] = DEFAULT_CONFIG,
    key: str = KEY,
) -> DataFrame:
    """``feature_job`` (``by_usage_type`` or ``all``) with window features as known at the start of each row's month.

    No row, of training or test, has a feature that uses a value of its own month or a later one.
    """
    if mode not in ("by_usage_type", "all"):
        raise ValueError(f"no forecast features for mode {mode!r}")
    table = feature_job(df, mode, str(train_end), config=config, key=key, mask=False)
    windows = [c for c in feature_columns(table) if c.removeprefix(f"{STORE}_").startswith(("lag_", "rolling_", "cumulative_", "change_rate"))]
    return known_at_month_start(table, windows, train_end, [SEGMENT, key] if mode == "by_usage_type" else [key])
