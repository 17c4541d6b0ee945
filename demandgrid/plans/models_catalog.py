"""F: training and prediction."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.functions.numeric import with_scalars
from demandgrid.operators import features as ft
from demandgrid.operators import keys as ks
from demandgrid.operators import models as md
from demandgrid.plans.catalog import Catalog
from demandgrid.plans.driver_tables import TRAIN_END, DriverTables
from demandgrid.plans.features_catalog import CONFIG_NAMES
from demandgrid.schema import DATE, KEY, PREDICTED, SEGMENT, VALUE
from demandgrid.session import materialise

SCOPE = ("2001-01-01", "2001-03-31")
STEPS = 2
TRIALS = 7
# The quantities of the test tables are drawn at random: no model can do better than the mean there, but a useful one is within 5 %.
NEAR = 1.05
GRID = {"maxDepth": [3, 5], "stepSize": [0.05, 0.1]}
# A feature that no row misses, for the fit that SQL can repeat.
LINE = "day_of_month_f"


def _build(grid: DataFrame, cutoff: str) -> DataFrame:
    return ft.forecast_table(grid, "by_usage_type", cutoff)


def _table(t: DriverTables) -> DataFrame:
    return _build(t.store_dense_segment, TRAIN_END)


def _checked(predictions: DataFrame) -> DataFrame:
    """Which rows are predicted, with what actual, has an exact answer; of the trees' values only that they are finite numbers."""
    finite = F.col(PREDICTED).isNotNull() & ~F.isnan(PREDICTED) & (F.abs(PREDICTED) < float("inf"))
    return predictions.withColumn(PREDICTED, finite).withColumnRenamed(PREDICTED, "is_finite")


def _line(t: DriverTables) -> DataFrame:
    return md.fit_predict(_table(t), TRAIN_END, 1, features=[LINE], regressor="linear").predictions


def _tuned(t: DriverTables) -> DataFrame:
    return md.tune(_table(t), TRAIN_END, GRID).withColumn("rmse", F.col("rmse") > 0).withColumnRenamed("rmse", "is_positive")


def _searched(t: DriverTables) -> DataFrame:
    """All trials made; the best one comes near the error of each key's mean on the month held out (see ``NEAR``)."""
    table = _table(t)
    cutoff = cal.add_months(cal.to_day(TRAIN_END), -1)
    told = md.search(table, TRAIN_END, trials=TRIALS, max_iter=8)
    held_out = table.filter((F.col(DATE) > F.lit(str(cutoff)).cast("date")) & (F.col(DATE) <= F.lit(TRAIN_END).cast("date")) & (F.col(VALUE) > 0))
    mean = md.against_mean(table, held_out.select(KEY, F.col(VALUE).alias("actual"), F.col(VALUE).alias(PREDICTED)), cutoff)
    best = told.agg(F.count(F.lit(1)).alias("trials"), F.min("rmse").alias("_best"), (F.max("trees") == 8).alias("some_in_full"))
    return with_scalars(best, mean.select("n", "mean_rmse")).select(
        "trials", "n", "mean_rmse", (F.col("_best") < F.col("mean_rmse") * NEAR).alias("best_is_near"), "some_in_full"
    )


def _compared(t: DriverTables) -> DataFrame:
    """Errors of the models of F01, F02 and F03 beside the error of each key's mean, on the rows they predict."""
    # Written once: two models and three means read it.
    table = materialise(_table(t), "compared")
    tried = {
        "one": md.fit_predict(table, TRAIN_END, 1).predictions,
        "by segment": md.fit_by_segment(table, TRAIN_END)[0],
        "walk": md.walk_forward(t.store_dense_segment, TRAIN_END, 1, _build),
    }
    parts = [md.against_mean(table, p, TRAIN_END).withColumn("model", F.lit(n)) for n, p in tried.items()]
    return reduce(DataFrame.unionByName, parts).select("model", "n", "mean_rmse", (F.col("rmse") < F.col("mean_rmse") * NEAR).alias("is_near"))


def _importance(t: DriverTables) -> DataFrame:
    """Shares of each segment sum up to 1; which input they belong to has an exact answer, too."""
    _, fits = md.fit_by_segment(_table(t), TRAIN_END)
    whole = md.importance(fits)
    inside = (F.col("importance") >= 0) & (F.col("importance") <= 1)
    total = F.round(F.sum("importance").over(Window.partitionBy(SEGMENT)), 6)
    return whole.select("feature", SEGMENT, inside.alias("is_share"), total.alias("total"))


def _scope(t: DriverTables) -> DataFrame:
    parts = [
        md.predict_scope(t.predictions, "future", agg, *SCOPE).withColumn("scope", F.lit(f"future-{agg}"))
        for agg in ("sum", "mean", "median")
    ]
    parts.append(
        md.predict_scope(t.predictions, "single-date", "sum", SCOPE[0]).withColumn("scope", F.lit("single-date"))
    )
    listed = ks.top_active(t.store_daily, 10)
    parts.append(
        md.predict_scope(t.predictions, "material-key", "mean", keys=listed).withColumn("scope", F.lit("keys"))
    )
    parts.append(
        md.predict_scope(t.predictions, "walk-forward", "mean", *SCOPE).withColumn("scope", F.lit("walk-forward"))
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _feature_counts(t: DriverTables) -> DataFrame:
    table = ft.calendar_features(t.material_store_daily)
    names = ft.feature_columns(table)
    return table.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "n")


CALENDAR_NAMES = (
    ["day_of_week_f", "is_weekend_f", "is_business_day_f", "month_f", "quarter_f", "year_f"]
    + ["day_of_month_f", "week_of_year_f"]
    + [f"day_of_week_{i}_f" for i in range(7)]
    + ["container_f"]
)

FORECAST_NAMES = CONFIG_NAMES + ["change_rate_f"] + CALENDAR_NAMES

HAMPEL = """WITH near AS (
  SELECT *, list(actual_value) OVER (PARTITION BY material_key ORDER BY file_date
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM dense),
med AS (SELECT *, list_aggregate(v, 'quantile_cont', 0.5) AS m FROM near),
mad AS (SELECT *, list_aggregate(list_transform(v, lambda x: abs(x - m)), 'quantile_cont', 0.5) AS s FROM med)
SELECT material_key, file_date,
  CASE WHEN s > 0 AND abs(actual_value - m) > s * 3 * CAST(1.4826 AS DOUBLE) THEN m ELSE actual_value END AS actual_value
FROM mad"""

BASELINE = """WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY material_key ORDER BY file_date DESC) AS rk,
    count(*) OVER (PARTITION BY material_key) AS n FROM sd),
k AS (
  SELECT material_key, max(file_date) AS last_day, least(max(n), 60) AS n,
    avg(actual_value) FILTER (rk <= 30) AS recent,
    avg(actual_value) FILTER (rk > least(n, 60) - 30 AND rk <= least(n, 60)) AS older
  FROM ranked GROUP BY 1),
d AS (
  SELECT *, CASE WHEN n >= 30 THEN (recent - older) / 30 ELSE 0 END AS trend, unnest(range(31)) AS i FROM k)
SELECT material_key, CAST(last_day + CAST(i AS INTEGER) + 1 AS DATE) AS date,
  greatest(0, recent + trend * i
    + 200 * sin(2 * pi() * dayofyear(CAST(last_day + CAST(i AS INTEGER) + 1 AS DATE)) / 365)) AS predicted
FROM d"""


def register(c: Catalog) -> None:
    due = """SELECT material_key, file_date AS date, actual_value AS actual, usage_type, true AS is_finite{}
        FROM densu WHERE actual_value > 0 AND file_date > DATE '{}' AND file_date <= DATE '{}'"""
    first = due.format("", TRAIN_END, "2001-01-31")
    c.add("F01_fit_predict", lambda t: _checked(md.fit_predict(_table(t), TRAIN_END, 1).predictions), first, "actual")
    c.add(
        "F01_fit_predict_linear",
        _line,
        f"""WITH line AS (SELECT regr_slope(actual_value, day(file_date)) AS a, regr_intercept(actual_value, day(file_date)) AS b
          FROM densu WHERE file_date <= DATE '{TRAIN_END}')
        SELECT material_key, date, actual, a * day(date) + b AS predicted, usage_type FROM ({first}), line""",
        "actual predicted",
    )
    c.add(
        "F02_walk_forward",
        lambda t: _checked(md.walk_forward(t.store_dense_segment, TRAIN_END, STEPS, _build)),
        due.format(", 1 AS step", TRAIN_END, "2001-01-31") + " UNION ALL " + due.format(", 2 AS step", "2001-01-31", "2001-02-28"),
        "actual",
    )
    mean = """SELECT count(*) AS n, sqrt(avg(power(m - actual_value, 2))) AS mean_rmse FROM densu JOIN (
          SELECT material_key, avg(actual_value) AS m FROM densu WHERE file_date <= DATE '{0}' GROUP BY 1) k
          ON k.material_key = densu.material_key
        WHERE actual_value > 0 AND file_date > DATE '{0}' AND file_date <= DATE '{1}'"""
    c.add(
        "F01_models_against_mean",
        _compared,
        f"SELECT model, n, mean_rmse, true AS is_near FROM ({mean.format(TRAIN_END, '2001-01-31')}), (VALUES ('one'), ('by segment'), ('walk')) v(model)",
        "mean_rmse",
    )
    c.add(
        "F06_search",
        _searched,
        f"SELECT CAST({TRIALS} AS BIGINT) AS trials, n, mean_rmse, true AS best_is_near, true AS some_in_full FROM ({mean.format('2000-11-30', TRAIN_END)})",
        "mean_rmse",
    )
    c.add("F03_fit_by_segment", lambda t: _checked(md.fit_by_segment(_table(t), TRAIN_END)[0]), first, "actual")
    c.add(
        "F04_winsorize",
        lambda t: md.winsorize(t.store_daily),
        """SELECT sd.material_key, file_date, least(greatest(actual_value, lo), hi) AS actual_value
        FROM sd JOIN (SELECT material_key, quantile_cont(actual_value, 0.05) AS lo,
          quantile_cont(actual_value, 0.95) AS hi FROM sd GROUP BY 1) q ON q.material_key = sd.material_key""",
        "actual_value",
    )
    c.add("F05_hampel", lambda t: md.hampel(t.store_dense), HAMPEL, "actual_value")
    trials = [f"({i}, 'maxDepth={d},stepSize={w}', true)" for i, (d, w) in enumerate(product(*GRID.values()))]
    c.add("F06_tune", _tuned, f"SELECT * FROM (VALUES {', '.join(trials)}) AS v(trial, params, is_positive)")
    # Only window features can be missing: the grid has every date.
    inputs = FORECAST_NAMES + [f"{n}{md.MISSING_FLAG}" for n in (*CONFIG_NAMES, "change_rate_f")]
    c.add(
        "F07_importance",
        _importance,
        f"""SELECT unnest({inputs}) AS feature, usage_type, true AS is_share, CAST(1 AS DOUBLE) AS total
        FROM (SELECT DISTINCT usage_type FROM store_dim)""",
    )
    c.add("F08_baseline_forecast", lambda t: md.baseline_forecast(t.store_daily, 31), BASELINE, "predicted")
    scoped = f"FROM pred WHERE date BETWEEN DATE '{SCOPE[0]}' AND DATE '{SCOPE[1]}' GROUP BY 1"
    c.add(
        "F09_predict_scope",
        _scope,
        f"""SELECT material_key, sum(predicted) AS predicted, count(*) AS day_count, 'future-sum' AS scope {scoped}
        UNION ALL SELECT material_key, avg(predicted), count(*), 'future-mean' {scoped}
        UNION ALL SELECT material_key, quantile_cont(predicted, 0.5), count(*), 'future-median' {scoped}
        UNION ALL SELECT material_key, avg(predicted), count(*), 'walk-forward' {scoped}
        UNION ALL SELECT material_key, sum(predicted), count(*), 'single-date' FROM pred
          WHERE date = DATE '{SCOPE[0]}' GROUP BY 1
        UNION ALL SELECT material_key, avg(predicted), count(*), 'keys' FROM pred WHERE material_key IN (
          SELECT material_key FROM (SELECT material_key, count(*) AS n FROM sd WHERE actual_value > 0 GROUP BY 1)
          ORDER BY n DESC, material_key LIMIT 10) GROUP BY 1""",
        "predicted",
    )
    c.add(
        "F10_feature_columns",
        _feature_counts,
        f"SELECT unnest({CALENDAR_NAMES}) AS feature, n FROM (SELECT count(*) AS n FROM msd)",
    )
