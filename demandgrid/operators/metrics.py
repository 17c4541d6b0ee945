"""Evaluation of predictions.

``by`` lists grouping columns (none for the whole table). Sums and counts are
combined on the map side, so a segment or key holding most rows costs no more than
others. Medians and percentiles use ``functions.quantiles``, which splits such a
group over tasks.

"Within X" exists in four meanings with distinct names: per key by mean error rate
(``within_rate``), per record by error rate (``within_record``), per record in units
(``within_units``) and per key with every record in units (``within_units_keys``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.functions.numeric import correlation as pearson
from demandgrid.functions.numeric import count_where, ratio, round_half_even, share_pct, with_scalars
from demandgrid.functions.quantiles import quantile_columns
from demandgrid.operators.ranking import ranked_top
from demandgrid.schema import ACTUAL, ALL, DATE, KEY, PRED_DATE, PREDICTED, SEGMENT, SPLIT, TEST, VALUE
from demandgrid.session import materialise

# Fixed values of the data model.
UNIT_LIMITS = (5, 10, 20, 30, 50)
RATE_LIMITS = (20, 30, 50, 100)
RECORD_LIMITS = (20, 30, 50)
PERCENTILES = (10, 25, 50, 75, 90)
MAPE_CAP = 1000.0
R2_NO_VARIANCE = -999.0
R2_EPSILON = 1e-10
TRAIN_PER_PREDICT = 12
DAYS_IF_UNKNOWN = 31
EXPORT_METRICS = ("RMSE", "MAE", "MAPE", "Error_Rate_10", "Error_Rate_20")
GRADES = ((10, "excellent"), (20, "good"), (30, "acceptable"))
SUMMARY_COLUMNS = (
    "material_key",
    "predict_year_month",
    "usage_type",
    "actual_value_count",
    "actual_value_count_in_train_period",
    "actual_value_count_in_predict_period",
    "actual_value_mean",
    "predict_value_mean",
    "error_value_mean",
)

Keys = Sequence[str]


# --- record expressions (built per call: columns need a live session) ---------------


def act() -> Column:
    return F.col(ACTUAL)


def prd() -> Column:
    return F.col(PREDICTED)


def err() -> Column:
    return prd() - act()


def abs_err() -> Column:
    return F.abs(err())


def positive() -> Column:
    return act() > 0


def err_rate() -> Column:
    """Relative miss of a record with a positive actual, else NULL."""
    return F.when(positive(), abs_err() / F.nullif(act(), F.lit(0.0)))


def canonical(pred: DataFrame, test_only: bool = True) -> DataFrame:
    """Either prediction layout with the columns ``actual``, ``predicted``, ``date``."""
    renames = {VALUE: ACTUAL, "predicted_value": PREDICTED, "prediction": PREDICTED, DATE: PRED_DATE}
    for old, new in renames.items():
        if old in pred.columns and new not in pred.columns:
            pred = pred.withColumnRenamed(old, new)
    if test_only and SPLIT in pred.columns:
        pred = pred.filter(F.col(SPLIT) == TEST)
    return pred


def record_errors(pred: DataFrame) -> DataFrame:
    """Signed, absolute and relative error; the last is NULL for a zero actual."""
    return pred.withColumns({"error": err(), "abs_error": abs_err(), "relative_error": ratio(err(), act())})


# --- aggregate expressions ---------------------------------------------------------


def _rmse(where: Column | None = None) -> Column:
    squared = err() * err()
    return F.sqrt(F.avg(squared if where is None else F.when(where, squared)))


def _mae(where: Column | None = None) -> Column:
    return F.avg(abs_err() if where is None else F.when(where, abs_err()))


def r2_expr(on_zero: str = "zero") -> Column:
    """1 - SS_res / SS_tot with a chosen treatment of SS_tot = 0.

    ``zero`` gives 0, ``sentinel`` gives -999, and ``epsilon`` adds 1e-10 to a
    positive SS_tot and gives 0 otherwise.
    """
    both = act().isNotNull() & prd().isNotNull()
    residual = F.sum(err() * err())
    return _r2_of(residual, F.var_pop(F.when(both, act())) * F.count(F.when(both, act())), on_zero)


def _r2_of(residual: Column, total: Column, on_zero: str) -> Column:
    if on_zero == "epsilon":
        return F.when(total > 0, 1.0 - residual / (total + F.lit(R2_EPSILON))).otherwise(0.0)
    fallback = {"zero": 0.0, "sentinel": R2_NO_VARIANCE}[on_zero]
    return F.when(total > 0, 1.0 - residual / F.nullif(total, F.lit(0.0))).otherwise(fallback)


def _agg(df: DataFrame, by: Keys, named: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in named.items()])


def _beside(left: DataFrame, right: DataFrame, by: Keys) -> DataFrame:
    """Two results with one row per group, or one row each, as one."""
    return left.join(right, list(by), "left") if by else with_scalars(left, right)


# --- record-level metrics ------------------------------------------------------------


def rmse_mae(pred: DataFrame, by: Keys = ()) -> DataFrame:
    return _agg(pred, by, {"n": F.count(F.lit(1)), "rmse": _rmse(), "mae": _mae()})


def positive_metrics(pred: DataFrame, by: Keys = ()) -> DataFrame:
    """RMSE, MAE and MAPE (a ratio) over records with a positive actual; 0 if none."""
    none = F.lit(0.0)
    return _agg(
        pred,
        by,
        {
            "n_positive": count_where(positive()),
            "rmse_positive": F.coalesce(_rmse(positive()), none),
            "mae_positive": F.coalesce(_mae(positive()), none),
            "mape": F.coalesce(F.avg(err_rate()), none),
        },
    )


def mape_capped(pred: DataFrame, by: Keys = (), cap: float = MAPE_CAP) -> DataFrame:
    """MAPE in percent, each record capped."""
    capped = F.avg(F.when(positive(), F.least(err_rate() * 100.0, F.lit(cap))))
    return _agg(pred, by, {"mape_capped_pct": F.coalesce(capped, F.lit(0.0))})


def mape_pct(pred: DataFrame, by: Keys = ()) -> DataFrame:
    return _agg(pred, by, {"mape_pct": F.coalesce(F.avg(err_rate() * 100.0), F.lit(0.0))})


def correlation(pred: DataFrame, by: Keys = ()) -> DataFrame:
    return _agg(pred, by, {"correlation": pearson(PREDICTED, ACTUAL)})


def r2(pred: DataFrame, on_zero: str = "zero", by: Keys = ()) -> DataFrame:
    return _agg(pred, by, {"r2": r2_expr(on_zero)})


def within_record(pred: DataFrame, by: Keys = (), limits: Sequence[int] = RECORD_LIMITS) -> DataFrame:
    """Percentage of positive records whose error rate is at most X percent."""
    shares = {
        f"within_{x}_record_pct": share_pct(count_where(err_rate() * 100.0 <= x), count_where(positive())) for x in limits
    }
    return _agg(pred, by, {"n_positive": count_where(positive()), **shares})


def within_units(pred: DataFrame, by: Keys = (), limits: Sequence[int] = UNIT_LIMITS) -> DataFrame:
    """Percentage of records whose absolute error is at most X units."""
    shares = {f"within_{x}_units_pct": share_pct(count_where(abs_err() <= x), F.count(abs_err())) for x in limits}
    return _agg(pred, by, shares)


def abs_error_stats(pred: DataFrame, by: Keys = ()) -> DataFrame:
    """Mean and exact median of the absolute error; groups with a NULL in their name are left out."""
    errors = pred.select(*by, abs_err().alias("_e")).filter(F.col("_e").isNotNull())
    errors = materialise(reduce(lambda df, c: df.filter(F.col(c).isNotNull()), by, errors), "errors")
    median = quantile_columns(errors, "_e", {"error_median": 0.5}, by, written=True)
    return _beside(_agg(errors, by, {"error_mean": F.avg("_e")}), median, by)


def pred_distribution(pred: DataFrame, by: Keys = ()) -> DataFrame:
    values = materialise(pred.select(*by, PREDICTED), "predicted")
    spread = _agg(values, by, {"pred_mean": F.avg(prd()), "pred_std": F.stddev_samp(prd())})
    median = quantile_columns(values, PREDICTED, {"pred_median": 0.5}, by, written=True)
    return _beside(spread, median, by)


# --- per-key metrics -----------------------------------------------------------------


def key_error_rate(pred: DataFrame, key: str = KEY, by: Keys = ()) -> DataFrame:
    """Mean error rate of each key over its positive records."""
    return _agg(
        pred.filter(positive() & F.col(key).isNotNull()),
        [*by, key],
        {
            "error_rate_mean": F.avg(err_rate()),
            "n_records": F.count(F.lit(1)),
            "total_actual": F.sum(act()),
            "total_predicted": F.sum(prd()),
        },
    )


def error_rate_stats(rates: DataFrame, by: Keys = (), rate: str = "error_rate_mean") -> DataFrame:
    """Mean, median and population std over the keys' error rates."""
    rates = materialise(rates.select(*by, rate), "rates")
    spread = _agg(
        rates,
        by,
        {"key_count": F.count(rate), "error_rate_mean": F.avg(rate), "error_rate_std": F.stddev_pop(rate)},
    )
    median = quantile_columns(rates, rate, {"error_rate_median": 0.5}, by, written=True)
    return _beside(spread, median, by)


def within_rate(rates: DataFrame, by: Keys = (), limits: Sequence[int] = RATE_LIMITS) -> DataFrame:
    """Keys whose mean error rate is at most X percent, and their share."""
    rate = F.col("error_rate_mean")
    named = {"key_count": F.count(rate)}
    for x in limits:
        named[f"within_{x}_percent"] = count_where(rate <= x / 100.0)
        named[f"within_{x}_percent_ratio"] = F.coalesce(
            ratio(count_where(rate <= x / 100.0), F.count(rate)), F.lit(0.0)
        )
    return _agg(rates, by, named)


def error_rate_percentiles(rates: DataFrame, by: Keys = (), percents: Sequence[int] = PERCENTILES) -> DataFrame:
    return quantile_columns(rates, "error_rate_mean", {f"p{p}": p / 100.0 for p in percents}, by)


def key_unit_error(pred: DataFrame, key: str = KEY, by: Keys = (), limits: Sequence[int] = UNIT_LIMITS) -> DataFrame:
    """Percentage of a key's records that miss by more than X units."""
    misses = {f"Error_Rate_{x}": F.avg(F.when(abs_err() > x, 100.0).otherwise(0.0)) for x in limits}
    return _agg(
        pred.filter(F.col(key).isNotNull()),
        [*by, key],
        {"count": F.count(F.lit(1)), **misses, "RMSE": _rmse(), "MAE": _mae()},
    )


def within_units_keys(unit_errors: DataFrame, by: Keys = (), limits: Sequence[int] = (20, 30, 50)) -> DataFrame:
    """Keys with no record beyond X units, and their percentage."""
    named = {"material_key_count": F.count(F.lit(1))}
    for x in limits:
        clean = count_where(F.col(f"Error_Rate_{x}") == 0)
        named[f"within_{x}_units_keys"] = clean
        named[f"within_{x}_units_keys_pct"] = F.coalesce(share_pct(clean, F.count(F.lit(1))), F.lit(0.0))
    return _agg(unit_errors, by, named)


def key_detail(pred: DataFrame, key: str = KEY) -> DataFrame:
    """Totals and error-rate statistics (percent) of keys with a non-zero actual sum."""
    rows = pred.filter(F.col(key).isNotNull()).select(key, ACTUAL, PREDICTED, (err_rate() * 100.0).alias("_pct"))
    detail = _agg(
        rows,
        [key],
        {
            "record_count": count_where(positive()),
            "actual_sum": F.sum(act()),
            "predicted_sum": F.sum(prd()),
            "mean_error_rate": F.avg("_pct"),
            "max_error_rate": F.max("_pct"),
            "min_error_rate": F.min("_pct"),
            # A key has a row per day: its values fit the aggregation that runs anyway.
            "median_error_rate": F.percentile("_pct", F.lit(0.5)),
        },
    )
    return detail.filter((F.col("actual_sum") != 0) & (F.col("record_count") > 0))


def key_metrics(pred: DataFrame, key: str = KEY) -> DataFrame:
    """The per-key table written next to the predictions."""
    misses = {f"Error_Rate_{x}": F.avg(F.when(abs_err() > x, 100.0).otherwise(0.0)) for x in UNIT_LIMITS}
    return _agg(
        pred.filter(F.col(key).isNotNull()),
        [key],
        {
            "RMSE": _rmse(),
            "MAE": _mae(),
            "MAPE": F.avg(err_rate()) * 100.0,
            "Mean_Actual": F.avg(act()),
            "Mean_Predicted": F.avg(prd()),
            "count": F.count(F.lit(1)),
            **misses,
        },
    )


def rank_keys(detail: DataFrame, metric: str, n: int, best_low: bool = True, key: str = KEY) -> DataFrame:
    """The ``n`` best and the ``n`` worst keys by a metric."""
    known = detail.filter(F.col(metric).isNotNull())
    best = ranked_top(known, n, metric, key, ascending=best_low).withColumn("end", F.lit("best"))
    worst = ranked_top(known, n, metric, key, ascending=not best_low).withColumn("end", F.lit("worst"))
    return best.unionByName(worst)


def scale_quartiles(detail: DataFrame, volume: str = "actual_sum", rate: str = "mean_error_rate") -> DataFrame:
    """Mean error rate of the keys in each quartile of volume."""
    cuts = quantile_columns(detail, volume, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    v = F.col(volume)
    band = (
        F.when(v <= F.col("q1"), "small")
        .when(v <= F.col("q2"), "medium_low")
        .when(v <= F.col("q3"), "medium_high")
        .otherwise("large")
    )
    banded = with_scalars(detail, cuts).withColumn("band", band)
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("key_count"), F.avg(rate).alias("mean_error_rate"))


# --- segments ------------------------------------------------------------------------


def combine(parts: Mapping[str, DataFrame], segment: str = SEGMENT) -> DataFrame:
    """Union of per-segment predictions, each labelled."""
    labelled = [df.withColumn(segment, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def _with_overall(df: DataFrame, segment: str, named: Mapping[str, Column], more: Keys = ()) -> DataFrame:
    """Aggregates per segment and for the whole table in one pass."""
    rolled = df.rollup(segment).agg(F.grouping(segment).alias("_g"), *[c.alias(n) for n, c in named.items()])
    label = F.when(F.col("_g") == 1, ALL).otherwise(F.col(segment))
    return rolled.withColumn(segment, label).drop("_g")


def _partials(pred: DataFrame, by: Keys) -> DataFrame:
    """Mergeable record statistics per group: sums, counts and central moments."""
    both = act().isNotNull() & prd().isNotNull()
    a, p, one = F.when(both, act()), F.when(both, prd()), F.when(both, 1)
    n = F.count(one)
    within = {f"_w{x}": count_where(err_rate() * 100.0 <= x) for x in RECORD_LIMITS}
    within |= {f"_u{x}": count_where(abs_err() <= x) for x in UNIT_LIMITS}
    return _agg(
        pred,
        by,
        {
            "_rows": F.count(F.lit(1)),
            "_n": n,
            "_e2": F.sum(err() * err()),
            "_ae": F.sum(abs_err()),
            "_rate": F.sum(err_rate()),
            "_n_rate": F.count(err_rate()),
            "_n_positive": count_where(positive()),
            "_a": F.avg(a),
            "_p": F.avg(p),
            "_m2a": F.var_pop(a) * n,
            "_m2p": F.var_pop(p) * n,
            "_cap": F.covar_pop(a, p) * n,
            "_min_a": F.min(a),
            "_max_a": F.max(a),
            "_min_p": F.min(p),
            "_max_p": F.max(p),
            **within,
        },
    )


def _merged(on_zero: str, centre_a: Column, centre_p: Column) -> dict[str, Column]:
    """Record metrics from partials; the parts' own moments stay exact, so only the
    spread between the parts is formed from squares of means. Those are taken from a
    common centre, so that a large mean costs no digits."""
    n = F.sum("_n")
    centre = {"_a": centre_a, "_p": centre_p}

    def total(within: str, x: str, y: str) -> Column:
        dx, dy = F.col(x) - centre[x], F.col(y) - centre[y]
        sum_x, sum_y = F.sum(F.col("_n") * dx), F.sum(F.col("_n") * dy)
        between = F.sum(F.col("_n") * dx * dy) - sum_x * sum_y / F.nullif(n, F.lit(0))
        return F.sum(within) + between

    def spread(within: str, x: str) -> Column:
        varies = F.min(f"_min{x}") < F.max(f"_max{x}")
        return F.when(varies, total(within, x, x)).otherwise(F.lit(0.0))

    ss_a, ss_p = spread("_m2a", "_a"), spread("_m2p", "_p")
    return {
        "n": F.sum("_rows"),
        "rmse": F.sqrt(F.sum("_e2") / F.nullif(n, F.lit(0))),
        "mae": F.sum("_ae") / F.nullif(n, F.lit(0)),
        "mape_pct": F.coalesce(F.sum("_rate") * 100.0 / F.nullif(F.sum("_n_rate"), F.lit(0)), F.lit(0.0)),
        "correlation": total("_cap", "_a", "_p") / F.nullif(F.sqrt(ss_a) * F.sqrt(ss_p), F.lit(0.0)),
        "r2": _r2_of(F.sum("_e2"), ss_a, on_zero),
        **{f"within_{x}_record_pct": share_pct(F.sum(f"_w{x}"), F.sum("_n_positive")) for x in RECORD_LIMITS},
        **{f"within_{x}_units_pct": share_pct(F.sum(f"_u{x}"), n) for x in UNIT_LIMITS},
    }


def _record_metrics(parts: DataFrame, segment: str, on_zero: str) -> DataFrame:
    """Record metrics of the named segments and of the whole table, rows without a segment included."""
    centred = with_scalars(parts, parts.agg(F.avg("_a").alias("_ca"), F.avg("_p").alias("_cp")))
    out = _with_overall(centred, segment, _merged(on_zero, F.col("_ca"), F.col("_cp")))
    return out.filter(F.col(segment).isNotNull())


def metrics_by_segment(pred: DataFrame, segment: str = SEGMENT, on_zero: str = "zero") -> DataFrame:
    """Record metrics per segment and overall; ``all`` covers every row, also those without a segment."""
    return _record_metrics(materialise(_partials(pred, [segment]), "segment-parts"), segment, on_zero)


def evaluation(pred: DataFrame, run: str, segment: str = SEGMENT, key: str = KEY) -> DataFrame:
    """Long metrics table (run, segment, metric, value) of a run.

    The predictions are reduced to one row per segment and key, written once; record and
    key metrics are merged from those rows. In ``all`` every row counts, also those without a
    segment or key, and a key of several segments counts once, with the mean over all its rows.
    """
    parts = materialise(_partials(pred, [segment, key]), "evaluation-parts")
    rates = parts.filter(F.col(key).isNotNull()).select(segment, key, "_rate", "_n_rate")
    whole = rates.groupBy(key).agg(F.sum("_rate").alias("_rate"), F.sum("_n_rate").alias("_n_rate"))
    named = rates.filter(F.col(segment).isNotNull()).unionByName(whole.withColumn(segment, F.lit(ALL)))
    named = named.withColumn("_key_rate", ratio(F.col("_rate"), F.col("_n_rate")))
    rated = F.count("_key_rate")
    by_key = {"key_count": rated, "error_rate_mean": F.avg("_key_rate")}
    for x in RECORD_LIMITS:
        by_key[f"within_{x}_percent_ratio"] = ratio(count_where(F.col("_key_rate") <= x / 100.0), rated)
    keys = named.groupBy(segment).agg(*[c.alias(n) for n, c in by_key.items()])
    median = quantile_columns(named, "_key_rate", {"error_rate_median": 0.5}, [segment])
    tables = (_record_metrics(parts, segment, "zero"), keys, median)
    return reduce(DataFrame.unionByName, [to_long(t, run, segment) for t in tables])


def to_long(wide: DataFrame, run: str, segment: str = SEGMENT) -> DataFrame:
    """One row per metric of a wide metrics table."""
    names = [c for c in wide.columns if c != segment]
    doubles = wide.select(F.col(segment).alias("segment"), *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot(["segment"], names, "metric", "value").select(
        F.lit(run).alias("run"), "segment", "metric", "value"
    )


# --- material summary ----------------------------------------------------------------


def material_summary(pred: DataFrame, key: str = KEY, date: str = PRED_DATE, segment: str = SEGMENT) -> DataFrame:
    """Key x month x segment: active days, means and mean error rate, rounded 2/2/4."""
    return (
        pred.filter(F.col(key).isNotNull() & F.col(segment).isNotNull())
        .groupBy(key, cal.year_month(date).alias("predict_year_month"), segment)
        .agg(
            count_where(positive()).alias("actual_value_count"),
            round_half_even(F.avg(act()), 2).alias("actual_value_mean"),
            round_half_even(F.avg(prd()), 2).alias("predict_value_mean"),
            round_half_even(F.avg(err_rate()), 4).alias("error_value_mean"),
        )
    )


def enrich_summary(
    summary: DataFrame, train: DataFrame, pred: DataFrame, train_end: str, key: str = KEY, date: str = DATE
) -> DataFrame:
    """Adds each key's active days in the train and in the predict period."""
    in_train = (
        train.filter((F.col(date) <= F.lit(train_end).cast("date")) & (F.col(VALUE) > 0))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("actual_value_count_in_train_period"))
    )
    in_predict = (
        pred.filter(positive()).groupBy(key).agg(F.count(F.lit(1)).alias("actual_value_count_in_predict_period"))
    )
    added = ("actual_value_count_in_train_period", "actual_value_count_in_predict_period")
    return (
        summary.join(in_train, key, "left")
        .join(in_predict, key, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in added})
    )


def enrich_fallback(summary: DataFrame) -> DataFrame:
    """Train count estimated from the predict count when no train table exists."""
    estimate = F.col("actual_value_count_in_predict_period") * TRAIN_PER_PREDICT
    return summary.withColumn("actual_value_count_in_train_period", estimate)


def order_columns(df: DataFrame, cols: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def summary_counts(summary: DataFrame, segment: str = SEGMENT) -> DataFrame:
    """Summary rows with train or predict activity, per segment and in total."""
    return _with_overall(
        summary,
        segment,
        {
            "summary_rows": F.count(F.lit(1)),
            "with_train_activity": count_where(F.col("actual_value_count_in_train_period") > 0),
            "with_predict_activity": count_where(F.col("actual_value_count_in_predict_period") > 0),
        },
    )


def month_accuracy(pred: DataFrame, key: str = KEY, date: str = PRED_DATE) -> DataFrame:
    """Month totals per key, rounded, and the accuracy in percent."""
    totals = pred.groupBy(key, cal.year_month(date).alias("year_month")).agg(
        F.rint(F.sum(prd())).alias("predicted"), F.rint(F.sum(act())).alias("actual")
    )
    return totals.withColumn("accuracy", (F.lit(1.0) - ratio(abs_err(), act())) * 100.0)


def grade(mape: Column | str) -> Column:
    """Grade of a MAPE in percent by the bands 10, 20 and 30."""
    m = F.col(mape) if isinstance(mape, str) else mape
    band = reduce(lambda c, g: c.when(m < g[0], g[1]), GRADES[1:], F.when(m < GRADES[0][0], GRADES[0][1]))
    return band.otherwise("needs_work")


def export_totals(by_key: DataFrame, key: str = KEY) -> DataFrame:
    """Key totals rebuilt from means and counts; absent columns count as 0."""
    have = set(by_key.columns)
    days = F.col("count") if "count" in have else F.lit(DAYS_IF_UNKNOWN)

    def total(mean: str) -> Column:
        return F.col(mean) * days if mean in have else F.lit(0.0)

    return by_key.select(
        key,
        total("Mean_Actual").alias("actual_sum"),
        total("Mean_Predicted").alias("predicted_sum"),
        *[(F.col(c) if c in have else F.lit(0.0)).alias(c) for c in EXPORT_METRICS],
    )
