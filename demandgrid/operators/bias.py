"""Where predictions are systematically high or low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.functions.numeric import count_where, ratio, share_pct, with_scalars
from demandgrid.functions.quantiles import quantile_columns
from demandgrid.operators.metrics import abs_err, act, err, prd
from demandgrid.operators.ranking import ranked_top
from demandgrid.schema import ACTUAL, KEY, PRED_DATE, PREDICTED
from demandgrid.session import materialise

# Fixed values of the data model.
RULE_LIMITS = {"mean_ratio": 1.2, "band_spread": 0.5, "keys_over_2": 0.0}
RATIO_HIGH = 2.0
SCALE_BANDS = ((10.0, "0-10"), (50.0, "10-50"), (100.0, "50-100"), (500.0, "100-500"))
TOP_BAND = "500+"
SMALL_ACTUAL = 10
BINS = 50


def pred_ratio() -> Column:
    return ratio(prd(), act())


def rel_err() -> Column:
    return ratio(err(), act())


def scale_band(value: Column | str = ACTUAL) -> Column:
    """Right-closed bands; zero and negative values have none."""
    v = F.col(value) if isinstance(value, str) else value
    band = F.when(v <= 0, None)
    for upper, label in SCALE_BANDS:
        band = band.when(v <= upper, label)
    return band.when(v.isNotNull(), TOP_BAND)


def prediction_ratio(pred: DataFrame) -> DataFrame:
    """Mean and exact median of predicted / actual over non-zero actuals."""
    ratios = materialise(pred.select(pred_ratio().alias("_r")), "ratios")
    mean = ratios.agg(F.avg("_r").alias("ratio_mean"), F.count("_r").alias("ratio_count"))
    return with_scalars(mean, quantile_columns(ratios, "_r", {"ratio_median": 0.5}, written=True))


def direction_counts(pred: DataFrame) -> DataFrame:
    """Records predicted too high, too low and exactly."""
    counts = pred.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(prd() > act()).alias("over"),
        count_where(prd() < act()).alias("under"),
        count_where(prd() == act()).alias("exact"),
    )
    return counts.withColumns({f"{c}_pct": share_pct(F.col(c), F.col("total")) for c in ("over", "under", "exact")})


def bias_by_scale(pred: DataFrame) -> DataFrame:
    """Ratio and errors per band of the actual value."""
    banded = pred.select(
        scale_band().alias("actual_scale"),
        pred_ratio().alias("_r"),
        err().alias("_e"),
        rel_err().alias("_rel"),
    ).filter(F.col("actual_scale").isNotNull())
    banded = materialise(banded, "banded")
    means = banded.groupBy("actual_scale").agg(
        F.avg("_r").alias("ratio_mean"),
        F.count("_r").alias("ratio_count"),
        F.avg("_e").alias("error_mean"),
        F.avg("_rel").alias("relative_error_mean"),
    )
    return means.join(quantile_columns(banded, "_r", {"ratio_median": 0.5}, ["actual_scale"], written=True), "actual_scale", "left")


def bias_by_key(pred: DataFrame, key: str = KEY) -> DataFrame:
    """Sums, means, spreads and ratios per key, and predicted / actual of the sums."""
    rows = pred.filter(F.col(key).isNotNull()).select(key, ACTUAL, PREDICTED, pred_ratio().alias("_r"))
    stats = rows.groupBy(key).agg(
        F.sum(act()).alias("actual_value_sum"),
        F.avg(act()).alias("actual_value_mean"),
        F.stddev_samp(act()).alias("actual_value_std"),
        F.sum(prd()).alias("predicted_value_sum"),
        F.avg(prd()).alias("predicted_value_mean"),
        F.stddev_samp(prd()).alias("predicted_value_std"),
        F.avg("_r").alias("prediction_ratio_mean"),
        F.avg(err()).alias("absolute_error_mean"),
        # A key has a row per day: its values fit the aggregation that runs anyway.
        F.percentile("_r", F.lit(0.5)).alias("prediction_ratio_median"),
    )
    return stats.withColumn("overprediction_score", ratio(F.col("predicted_value_sum"), F.col("actual_value_sum")))


def bias_rank(by_key: DataFrame, n: int = 10, key: str = KEY) -> DataFrame:
    """The keys predicted too high and the keys predicted best."""
    score = F.col("overprediction_score")
    scored = by_key.filter(score.isNotNull()).select(
        key,
        "actual_value_sum",
        "predicted_value_sum",
        "overprediction_score",
        (F.lit(1.0) / (F.lit(1.0) + F.abs(score - 1.0))).alias("accuracy_score"),
    )
    over = ranked_top(scored, n, "overprediction_score", key).withColumn("list", F.lit("overpredicted"))
    good = ranked_top(scored, n, "accuracy_score", key).withColumn("list", F.lit("accurate"))
    return over.unionByName(good)


def bias_by_day(pred: DataFrame, date: str = PRED_DATE) -> DataFrame:
    days = pred.groupBy(date).agg(
        F.sum(act()).alias("actual_value"),
        F.sum(prd()).alias("predicted_value"),
        F.avg(pred_ratio()).alias("prediction_ratio"),
    )
    return days.withColumn("overprediction_rate", ratio(F.col("predicted_value"), F.col("actual_value")))


def bias_by_weekday(pred: DataFrame, date: str = PRED_DATE) -> DataFrame:
    return pred.groupBy(cal.dow(date).alias("weekday")).agg(
        F.avg(pred_ratio()).alias("prediction_ratio"), F.avg(err()).alias("absolute_error")
    )


def _key_ratios(pred: DataFrame, key: str) -> DataFrame:
    """Per-key means with a zero actual counted as 1 in the denominator."""
    base = F.when(act() == 0, F.lit(1.0)).otherwise(act())
    return pred.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(abs_err()).alias("abs_error"),
        F.avg(abs_err() / base).alias("rel_error"),
        F.avg(prd() / base).alias("overprediction"),
        F.avg(act()).alias("actual_value"),
        F.avg(prd()).alias("predicted_value"),
    )


def high_overprediction(pred: DataFrame, above: float = 5.0, key: str = KEY) -> DataFrame:
    """Profile of the keys whose mean ratio is above the limit."""
    high = _key_ratios(pred, key).filter(F.col("overprediction") > above)
    profile = high.agg(
        F.count(F.lit(1)).alias("key_count"),
        F.avg("actual_value").alias("mean_actual"),
        F.avg("predicted_value").alias("mean_predicted"),
        count_where(F.col("actual_value") < SMALL_ACTUAL).alias("small_keys"),
    ).withColumn("small_pct", share_pct(F.col("small_keys"), F.col("key_count")))
    return with_scalars(profile, quantile_columns(high, "actual_value", {"median_actual": 0.5}))


def error_histogram(pred: DataFrame, bins: int = BINS, tail: float = 0.95, ratio_below: float = 10.0) -> DataFrame:
    """Counts behind the two error charts: trimmed absolute error and ratio.

    Equal-width bins between the smallest and the largest value of each measure. The two measures are
    written once: predictions are evaluated once, however many passes read them.
    """
    values = materialise(pred.select(abs_err().alias("_e"), pred_ratio().alias("_r")), "errors")
    cut = quantile_columns(values, "_e", {"_cut": tail}, written=True).scalar()
    error = F.when(F.col("_e") < cut, F.col("_e"))
    share = F.when(F.col("_r") < ratio_below, F.col("_r"))
    measures = {"abs_error": error, "prediction_ratio": share}
    limits = values.agg(*[f(c).alias(f"{p}{n}") for n, c in measures.items() for f, p in ((F.min, "_lo_"), (F.max, "_hi_"))])
    rows = with_scalars(values, limits)

    def placed(name: str, value: Column) -> Column:
        low = F.col(f"_lo_{name}")
        width = (F.col(f"_hi_{name}") - low) / bins
        position = F.coalesce(F.floor((value - low) / F.nullif(width, F.lit(0.0))), F.lit(0))
        # The largest value belongs to the last bin.
        at = F.least(position, F.lit(bins - 1)).cast("int")
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("measure"), at.alias("bin"), low.alias("_lo"), width.alias("_w")))

    both = F.array_compact(F.array(*[placed(n, c) for n, c in measures.items()]))
    counted = rows.select(F.explode(both).alias("_b")).select("_b.*").groupBy("measure", "bin", "_lo", "_w")
    counts = counted.agg(F.count(F.lit(1)).alias("n"))
    return counts.select("measure", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "n")


def bias_overall(pred: DataFrame) -> DataFrame:
    return pred.agg(
        F.avg(act()).alias("mean_actual"),
        F.avg(prd()).alias("mean_predicted"),
        F.avg(pred_ratio()).alias("mean_prediction_ratio"),
        share_pct(count_where(prd() > act()), F.count(F.lit(1))).alias("overprediction_percentage"),
    )


def test_rows(pred: DataFrame, year: int | None = None, step: int | None = None, date: str = PRED_DATE) -> DataFrame:
    """Predictions of a year, or of a step when the table has no date."""
    if year is not None and date in pred.columns:
        first, last = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))
        return pred.filter(F.col(date).between(first, last))
    if step is not None and "step" in pred.columns:
        return pred.filter(F.col("step") == step)
    return pred


def bias_rules(pred: DataFrame, key: str = KEY) -> DataFrame:
    """Measured value, limit and outcome of the three bias rules."""
    overall = pred.agg(F.avg(pred_ratio()).alias("mean_ratio"))
    bands = (
        pred.select(scale_band().alias("_band"), pred_ratio().alias("_r"))
        .filter(F.col("_band").isNotNull())
        .groupBy("_band")
        .agg(F.avg("_r").alias("_m"))
        .agg((F.max("_m") - F.min("_m")).alias("band_spread"))
    )
    sums = pred.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(prd()).alias("_p"), F.sum(act()).alias("_a"))
    high = sums.agg(count_where(ratio(F.col("_p"), F.col("_a")) > RATIO_HIGH).cast("double").alias("keys_over_2"))
    one = with_scalars(with_scalars(overall, bands), high)
    rules = one.unpivot([], list(RULE_LIMITS), "rule", "measured")
    limit = F.lit(None).cast("double")
    for name, at in RULE_LIMITS.items():
        limit = F.when(F.col("rule") == name, at).otherwise(limit)
    return rules.withColumn("limit", limit).withColumn("applies", (F.col("measured") > F.col("limit")).cast("int"))
