"""Comparison of runs on the long metrics table (run, segment, metric, value)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from demandgrid.functions.numeric import count_where, ratio
from demandgrid.operators.metrics import UNIT_LIMITS, err
from demandgrid.operators.ranking import top_per_group
from demandgrid.schema import ACTUAL, ALL, KEY, SEGMENT

LOWER, HIGHER = "lower", "higher"

# Fixed values of the data model: which way each metric improves.
DIRECTIONS = {
    "rmse": LOWER,
    "mae": LOWER,
    "mape_pct": LOWER,
    "error_rate_mean": LOWER,
    "error_rate_median": LOWER,
    "within_20_percent_ratio": HIGHER,
    "within_30_percent_ratio": HIGHER,
    "within_50_percent_ratio": HIGHER,
    "within_20_record_pct": HIGHER,
    "within_30_record_pct": HIGHER,
    "within_50_record_pct": HIGHER,
    **{f"within_{x}_units_pct": HIGHER for x in UNIT_LIMITS},
    "correlation": HIGHER,
    "r2": HIGHER,
}
# Changes of RMSE and MAE, and cuts of the key count in percent, that decide between thresholds.
RMSE_CLEAR, MAE_CLEAR, RMSE_SAME = 5, 3, 2
CUT_CLEAR, CUT_LARGE = 20, 50
NO_CHANGE_BELOW = 0.1
SCORE_BANDS = (5.0, 0.0, -5.0)


def _value_of(run: str) -> Column:
    return F.max(F.when(F.col("run") == run, F.col("value")))


def compare_runs(metrics: DataFrame, a: str, b: str, directions: Mapping[str, str] = DIRECTIONS) -> DataFrame:
    """Before (a), after (b), difference and improvement percent per segment and metric.

    Both runs are put side by side by one aggregate instead of a self join. The
    improvement is relative to |before| and NULL when that is 0.
    """
    sides = (
        metrics.filter(F.col("run").isin(a, b) & F.col("metric").isin(*directions))
        .groupBy("segment", "metric")
        .agg(_value_of(a).alias("before"), _value_of(b).alias("after"))
        .filter(F.col("before").isNotNull() & F.col("after").isNotNull())
    )
    higher = F.col("metric").isin(*[m for m, d in directions.items() if d == HIGHER])
    diff = F.col("after") - F.col("before")
    gain = F.when(higher, diff).otherwise(-diff)
    return sides.select(
        "segment",
        "metric",
        "before",
        "after",
        diff.alias("diff"),
        (ratio(gain, F.abs("before")) * 100.0).alias("improvement_pct"),
    )


def verdict(cmp: DataFrame, tolerance: float = NO_CHANGE_BELOW) -> DataFrame:
    gain = F.col("improvement_pct")
    word = (
        F.when(gain.isNull() | (F.abs(gain) < tolerance), "no_change")
        .when(gain > 0, "improved")
        .otherwise("worsened")
    )
    return cmp.withColumn("verdict", word)


def overall_verdict(cmp: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Improved against worsened metrics per segment.

    With the default tolerance of 0 every change counts; 0.1 ignores small ones.
    """
    counts = cmp.groupBy("segment").agg(
        count_where(F.col("improvement_pct") > tolerance).alias("improved"),
        count_where(F.col("improvement_pct") < -tolerance).alias("worsened"),
    )
    word = (
        F.when(F.col("improved") > F.col("worsened"), "improved")
        .when(F.col("improved") < F.col("worsened"), "worsened")
        .otherwise("mixed")
    )
    return counts.withColumn("overall", word)


def _wide(cmp: DataFrame, named: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Chosen comparison values of a segment as columns."""
    cols = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(name) for name, (m, c) in named.items()]
    return cmp.groupBy("segment").agg(*cols)


def score(cmp: DataFrame) -> DataFrame:
    """Mean of the RMSE and MAE improvements and the change of the 20 % share."""
    wide = _wide(
        cmp,
        {
            "rmse_pct": ("rmse", "improvement_pct"),
            "mae_pct": ("mae", "improvement_pct"),
            "within_20_points": ("within_20_record_pct", "diff"),
        },
    )
    total = (F.col("rmse_pct") + F.col("mae_pct") + F.col("within_20_points")) / 3.0
    much, some, same = SCORE_BANDS
    s = F.col("score")
    judgement = (
        F.when(s > much, "much_better").when(s > some, "better").when(s > same, "similar").otherwise("worse")
    )
    return wide.withColumn("score", total).withColumn("judgement", F.when(s.isNotNull(), judgement))


def recommend_threshold(metrics: DataFrame, low: str, high: str) -> DataFrame:
    """Which of two selection thresholds to use, from error change and key cut."""
    m = metrics.filter(F.col("segment") == ALL)

    def pick(run: str, metric: str) -> Column:
        return F.max(F.when((F.col("run") == run) & (F.col("metric") == metric), F.col("value")))

    wide = m.agg(
        (pick(high, "rmse") - pick(low, "rmse")).alias("rmse_diff"),
        (pick(high, "mae") - pick(low, "mae")).alias("mae_diff"),
        (pick(high, "r2") - pick(low, "r2")).alias("r2_diff"),
        pick(low, "key_count").alias("keys_low"),
        pick(high, "key_count").alias("keys_high"),
    )
    cut = F.coalesce(ratio(F.col("keys_low") - F.col("keys_high"), F.col("keys_low")) * 100.0, F.lit(0.0))
    rmse, mae = F.col("rmse_diff"), F.col("mae_diff")
    return wide.withColumn("key_reduction_pct", cut).withColumns(
        {
            "accuracy": F.when((rmse < 0) & (mae < 0), "high_better")
            .when((rmse > 0) & (mae > 0), "low_better")
            .otherwise("mixed"),
            "recommendation": F.when(
                (rmse < -RMSE_CLEAR) & (mae < -MAE_CLEAR) & (F.col("key_reduction_pct") > CUT_CLEAR), "high_strong"
            )
            .when((rmse > RMSE_CLEAR) & (mae > MAE_CLEAR), "low_strong")
            .when((F.col("key_reduction_pct") > CUT_LARGE) & (F.abs(rmse) < RMSE_SAME), "high")
            .otherwise("depends"),
        }
    )


def best_run(metrics: DataFrame, metric: str = "error_rate_mean", segment: str = ALL) -> DataFrame:
    """Run with the lowest value; equal values go to the smaller name."""
    rows = metrics.filter((F.col("metric") == metric) & (F.col("segment") == segment) & F.col("value").isNotNull())
    return rows.agg(F.min(F.struct("value", "run")).alias("_b")).select("_b.run", "_b.value")


def top_volume_rmse(pred: DataFrame, n: int = 5, key: str = KEY, segment: str = SEGMENT) -> DataFrame:
    """Largest keys of each segment by actual volume, with their RMSE."""
    by_key = (
        pred.filter(F.col(key).isNotNull() & F.col(segment).isNotNull())
        .groupBy(segment, key)
        .agg(F.sum(ACTUAL).alias("actual_sum"), F.sqrt(F.avg(err() * err())).alias("rmse"))
    )
    return top_per_group(by_key, n, "actual_sum", key, [segment])


def within_change(cmp: DataFrame) -> DataFrame:
    """Change of the within-X shares in percentage points."""
    shares = cmp.filter(F.col("metric").rlike("^within_[0-9]+_record_pct$"))
    return shares.select("segment", "metric", "before", "after", F.col("diff").alias("change_points"))
