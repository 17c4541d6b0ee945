"""G: evaluation; H: bias."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgrid.operators import bias as bs
from demandgrid.operators import metrics as mt
from demandgrid.operators import prepare as pp
from demandgrid.plans.catalog import Catalog
from demandgrid.plans.driver_tables import TRAIN_END, DriverTables
from demandgrid.plans.sql_tables import RECORD_METRICS, UNIT_SQL
from demandgrid.schema import ACTUAL, BUSINESS, HOUSEHOLD, KEY, PREDICTED, SEGMENT

ALL_SEGMENTS = "SELECT * FROM pe UNION ALL SELECT * REPLACE ('all' AS usage_type) FROM pe"


def _style_b(t: DriverTables) -> DataFrame:
    """Predictions in the other layout: value names and a split column."""
    p = t.predictions.withColumnsRenamed({ACTUAL: "actual_value", PREDICTED: "predicted_value", "date": "file_date"})
    split = F.when(F.col("file_date") <= F.lit(TRAIN_END).cast("date"), "train").otherwise("test")
    return mt.canonical(p.withColumn("data_type", split))


def _rates(t: DriverTables) -> DataFrame:
    return mt.key_error_rate(t.predictions)


def _detail(t: DriverTables) -> DataFrame:
    return mt.key_detail(t.predictions)


def _enriched(t: DriverTables) -> DataFrame:
    return mt.enrich_summary(mt.material_summary(t.predictions), t.store_daily, t.predictions, TRAIN_END)


def _combined(t: DriverTables) -> DataFrame:
    parts = {s: pp.segment(t.predictions, s).drop(SEGMENT) for s in (BUSINESS, HOUSEHOLD)}
    return mt.combine(parts)


def _r2(t: DriverTables) -> DataFrame:
    parts = [mt.r2(t.predictions, z).withColumn("on_zero", F.lit(z)) for z in ("zero", "sentinel", "epsilon")]
    # A single-row-per-key table has no variance inside a key and a day.
    flat = [
        mt.r2(t.predictions, z, [KEY, "date"]).groupBy("r2").count().select("r2", F.lit(f"{z}-flat").alias("on_zero"))
        for z in ("zero", "sentinel", "epsilon")
    ]
    out = parts[0]
    for part in parts[1:] + flat:
        out = out.unionByName(part)
    return out


def _graded(t: DriverTables) -> DataFrame:
    return mt.mape_pct(t.predictions, [KEY]).withColumn("grade", mt.grade("mape_pct"))


def register(c: Catalog) -> None:
    c.add(
        "G01_canonical",
        _style_b,
        f"SELECT *, 'test' AS data_type FROM pred WHERE date > DATE '{TRAIN_END}'",
        "actual predicted",
    )
    c.add(
        "G02_record_errors",
        lambda t: mt.record_errors(t.predictions),
        "SELECT *, predicted - actual AS error, abs(predicted - actual) AS abs_error, "
        "(predicted - actual) / nullif(actual, 0) AS relative_error FROM pred",
        "actual predicted error abs_error relative_error",
    )
    c.add(
        "G03_rmse_mae",
        lambda t: mt.rmse_mae(t.predictions),
        "SELECT count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM pe",
        "rmse mae",
    )
    c.add(
        "G04_positive_metrics",
        lambda t: mt.positive_metrics(t.predictions),
        """SELECT count(*) AS n_positive, sqrt(avg(e * e)) AS rmse_positive, avg(abs(e)) AS mae_positive,
        avg(rate) AS mape FROM pe WHERE actual > 0""",
        "rmse_positive mae_positive mape",
    )
    c.add(
        "G05_mape_capped",
        lambda t: mt.mape_capped(t.predictions, [KEY]),
        "SELECT material_key, coalesce(avg(least(100 * rate, 1000)) FILTER (rate IS NOT NULL), 0) AS mape_capped_pct FROM pe GROUP BY 1",
        "mape_capped_pct",
    )
    c.add(
        "G06_mape_pct",
        lambda t: mt.mape_pct(t.predictions, [KEY]),
        "SELECT material_key, coalesce(avg(100 * rate), 0) AS mape_pct FROM pe GROUP BY 1",
        "mape_pct",
    )
    c.add(
        "G07_correlation",
        lambda t: mt.correlation(t.predictions, [SEGMENT]),
        "SELECT usage_type, corr(predicted, actual) AS correlation FROM pe GROUP BY 1",
        "correlation",
    )
    main = "1 - sum(e * e) / (var_pop(actual) * count(*))"
    c.add(
        "G08_r2",
        _r2,
        f"""SELECT {main} AS r2, 'zero' AS on_zero FROM pe UNION ALL SELECT {main}, 'sentinel' FROM pe
        UNION ALL SELECT 1 - sum(e * e) / (var_pop(actual) * count(*) + 1e-10), 'epsilon' FROM pe
        UNION ALL SELECT DISTINCT CAST(0 AS DOUBLE), 'zero-flat' FROM pe
        UNION ALL SELECT DISTINCT CAST(-999 AS DOUBLE), 'sentinel-flat' FROM pe
        UNION ALL SELECT DISTINCT CAST(0 AS DOUBLE), 'epsilon-flat' FROM pe""",
        "r2",
    )
    c.add(
        "G09_key_error_rate",
        _rates,
        "SELECT * FROM key_rates",
        "error_rate_mean total_actual total_predicted",
    )
    c.add(
        "G10_error_rate_stats",
        lambda t: mt.error_rate_stats(_rates(t)),
        """SELECT count(*) AS key_count, avg(error_rate_mean) AS error_rate_mean,
        stddev_pop(error_rate_mean) AS error_rate_std, quantile_cont(error_rate_mean, 0.5) AS error_rate_median
        FROM key_rates""",
        "error_rate_mean error_rate_std error_rate_median",
    )
    within = ", ".join(
        f"count(*) FILTER (error_rate_mean <= {x} / CAST(100 AS DOUBLE)) AS within_{x}_percent, "
        f"1.0 * count(*) FILTER (error_rate_mean <= {x} / CAST(100 AS DOUBLE)) / count(*) "
        f"AS within_{x}_percent_ratio"
        for x in mt.RATE_LIMITS
    )
    c.add(
        "G11_within_rate_keys",
        lambda t: mt.within_rate(_rates(t)),
        f"SELECT count(*) AS key_count, {within} FROM key_rates",
        " ".join(f"within_{x}_percent_ratio" for x in mt.RATE_LIMITS),
    )
    c.add(
        "G12_error_rate_percentiles",
        lambda t: mt.error_rate_percentiles(_rates(t)),
        "SELECT "
        + ", ".join(f"quantile_cont(error_rate_mean, {p / 100}) AS p{p}" for p in mt.PERCENTILES)
        + " FROM key_rates",
        " ".join(f"p{p}" for p in mt.PERCENTILES),
    )
    c.add(
        "G13_within_record",
        lambda t: mt.within_record(t.predictions, [SEGMENT]),
        "SELECT usage_type, count(rate) AS n_positive, "
        + ", ".join(
            f"100.0 * count(*) FILTER (100 * rate <= {x}) / count(rate) AS within_{x}_record_pct"
            for x in mt.RECORD_LIMITS
        )
        + " FROM pe GROUP BY 1",
        " ".join(f"within_{x}_record_pct" for x in mt.RECORD_LIMITS),
    )
    c.add(
        "G14_within_units_records",
        lambda t: mt.within_units(t.predictions, [SEGMENT]),
        "SELECT usage_type, "
        + ", ".join(
            f"100.0 * count(*) FILTER (abs(e) <= {x}) / count(*) AS within_{x}_units_pct" for x in mt.UNIT_LIMITS
        )
        + " FROM pe GROUP BY 1",
        " ".join(f"within_{x}_units_pct" for x in mt.UNIT_LIMITS),
    )
    rates_by_unit = " ".join(f"Error_Rate_{x}" for x in mt.UNIT_LIMITS)
    c.add(
        "G15_key_unit_error",
        lambda t: mt.key_unit_error(t.predictions),
        "SELECT * FROM unit_errors",
        f"{rates_by_unit} RMSE MAE",
    )
    c.add(
        "G16_within_units_keys",
        lambda t: mt.within_units_keys(mt.key_unit_error(t.predictions)),
        "SELECT count(*) AS material_key_count, "
        + ", ".join(
            f"count(*) FILTER (Error_Rate_{x} = 0) AS within_{x}_units_keys, "
            f"100.0 * count(*) FILTER (Error_Rate_{x} = 0) / count(*) AS within_{x}_units_keys_pct"
            for x in (20, 30, 50)
        )
        + " FROM unit_errors",
        " ".join(f"within_{x}_units_keys_pct" for x in (20, 30, 50)),
    )
    c.add(
        "G17_abs_error_stats",
        lambda t: mt.abs_error_stats(t.predictions, [SEGMENT]),
        """SELECT usage_type, avg(abs(e)) AS error_mean, quantile_cont(abs(e), 0.5) AS error_median
        FROM pe GROUP BY 1""",
        "error_mean error_median",
    )
    detail = "actual_sum predicted_sum mean_error_rate median_error_rate max_error_rate min_error_rate"
    c.add("G18_key_detail", _detail, "SELECT * FROM detail", detail)
    c.add(
        "G19_rank_keys",
        lambda t: mt.rank_keys(mt.key_unit_error(t.predictions), "RMSE", 5).select(KEY, "RMSE", "MAE", "rank", "end"),
        """SELECT * FROM (SELECT material_key, RMSE, MAE,
          CAST(row_number() OVER (ORDER BY RMSE, material_key) AS INTEGER) AS rank, 'best' AS "end" FROM unit_errors
          UNION ALL SELECT material_key, RMSE, MAE,
          CAST(row_number() OVER (ORDER BY RMSE DESC, material_key) AS INTEGER), 'worst' FROM unit_errors)
        WHERE rank <= 5""",
        "RMSE MAE",
    )
    c.add(
        "G20_scale_quartiles",
        lambda t: mt.scale_quartiles(_detail(t)),
        """SELECT CASE WHEN actual_sum <= q1 THEN 'small' WHEN actual_sum <= q2 THEN 'medium_low'
          WHEN actual_sum <= q3 THEN 'medium_high' ELSE 'large' END AS band,
        count(*) AS key_count, avg(mean_error_rate) AS mean_error_rate
        FROM detail, (SELECT quantile_cont(actual_sum, 0.25) AS q1, quantile_cont(actual_sum, 0.5) AS q2,
          quantile_cont(actual_sum, 0.75) AS q3 FROM detail) GROUP BY 1""",
        "mean_error_rate",
    )
    c.add(
        "G21_metrics_by_segment",
        lambda t: mt.metrics_by_segment(t.predictions),
        f"""SELECT usage_type, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
        coalesce(avg(100 * rate), 0) AS mape_pct, corr(predicted, actual) AS correlation, {main} AS r2,
        100.0 * count(*) FILTER (100 * rate <= 20) / count(rate) AS within_20_record_pct,
        100.0 * count(*) FILTER (100 * rate <= 30) / count(rate) AS within_30_record_pct,
        100.0 * count(*) FILTER (100 * rate <= 50) / count(rate) AS within_50_record_pct, {UNIT_SQL}
        FROM ({ALL_SEGMENTS}) GROUP BY 1""",
        " ".join(n for n in RECORD_METRICS if n != "n"),
    )
    record = ", ".join(f"max(CASE WHEN metric = '{n}' THEN value END) AS {n}" for n in RECORD_METRICS if n != "n")
    c.add(
        "G21_metrics_by_segment_materials",
        lambda t: mt.metrics_by_segment(t.material_predictions),
        f"""SELECT segment AS usage_type, CAST(max(CASE WHEN metric = 'n' THEN value END) AS BIGINT) AS n, {record}
        FROM runs_m WHERE run = 'a' GROUP BY segment""",
        " ".join(n for n in RECORD_METRICS if n != "n"),
    )
    c.add("G22_combine_segments", _combined, "SELECT * FROM pred", "actual predicted")
    means = "actual_value_mean predict_value_mean error_value_mean"
    c.add("G23_material_summary", lambda t: mt.material_summary(t.predictions), "SELECT * FROM summary", means)
    c.add("G24_enrich_summary", _enriched, "SELECT * FROM enriched", means)
    c.add(
        "G25_enrich_fallback",
        lambda t: mt.enrich_fallback(_enriched(t)),
        """SELECT * REPLACE (actual_value_count_in_predict_period * 12 AS actual_value_count_in_train_period)
        FROM enriched""",
        means,
    )
    c.add(
        "G26_order_columns",
        lambda t: mt.order_columns(_enriched(t).withColumn("other", F.lit(1))),
        f"SELECT {', '.join(mt.SUMMARY_COLUMNS)} FROM enriched",
        means,
    )
    c.add(
        "G27_summary_counts",
        lambda t: mt.summary_counts(_enriched(t)),
        """SELECT usage_type, count(*) AS summary_rows,
        count(*) FILTER (actual_value_count_in_train_period > 0) AS with_train_activity,
        count(*) FILTER (actual_value_count_in_predict_period > 0) AS with_predict_activity
        FROM (SELECT * FROM enriched UNION ALL SELECT * REPLACE ('all' AS usage_type) FROM enriched) GROUP BY 1""",
    )
    c.add(
        "G28_month_accuracy",
        lambda t: mt.month_accuracy(t.predictions),
        """SELECT *, (1 - abs(predicted - actual) / nullif(actual, 0)) * 100 AS accuracy FROM (
        SELECT material_key, strftime(date, '%Y-%m') AS year_month, round_even(sum(predicted), 0) AS predicted,
          round_even(sum(actual), 0) AS actual FROM pred GROUP BY 1, 2)""",
        "predicted actual accuracy",
    )
    c.add(
        "G29_pred_distribution",
        lambda t: mt.pred_distribution(t.predictions),
        """SELECT avg(predicted) AS pred_mean, stddev_samp(predicted) AS pred_std,
        quantile_cont(predicted, 0.5) AS pred_median FROM pred""",
        "pred_mean pred_std pred_median",
    )
    c.add(
        "G30_grade",
        _graded,
        """SELECT *, CASE WHEN mape_pct < 10 THEN 'excellent' WHEN mape_pct < 20 THEN 'good'
        WHEN mape_pct < 30 THEN 'acceptable' ELSE 'needs_work' END AS grade
        FROM (SELECT material_key, coalesce(avg(100 * rate), 0) AS mape_pct FROM pe GROUP BY 1)""",
        "mape_pct",
    )
    c.add(
        "G31_export_totals",
        lambda t: mt.export_totals(mt.key_metrics(t.predictions)),
        """SELECT p.*, u.RMSE, u.MAE, p.m AS MAPE, u.Error_Rate_10, u.Error_Rate_20
        FROM (SELECT material_key, avg(actual) * count(*) AS actual_sum, avg(predicted) * count(*) AS predicted_sum,
          100 * avg(rate) AS m FROM pe GROUP BY 1) p JOIN unit_errors u ON u.material_key = p.material_key""".replace(
            "p.*", "p.material_key, p.actual_sum, p.predicted_sum"
        ),
        "actual_sum predicted_sum RMSE MAE MAPE Error_Rate_10 Error_Rate_20",
    )
    _bias(c)


def _histogram_sql(name: str, values: str) -> str:
    return f"""SELECT '{name}' AS measure, bin, lo + bin * w AS bin_start, count(*) AS n FROM (
      SELECT lo, (hi - lo) / 50 AS w,
        CAST(least(floor((x - lo) / nullif((hi - lo) / 50, 0)), 49) AS INTEGER) AS bin
      FROM ({values}) AS v, (SELECT min(x) AS lo, max(x) AS hi FROM ({values}) AS v2)) GROUP BY 1, 2, 3"""


def _bias(c: Catalog) -> None:
    c.add(
        "H01_prediction_ratio",
        lambda t: bs.prediction_ratio(t.predictions),
        """SELECT avg(ratio) AS ratio_mean, count(ratio) AS ratio_count, quantile_cont(ratio, 0.5) AS ratio_median
        FROM pe""",
        "ratio_mean ratio_median",
    )
    c.add(
        "H02_direction_counts",
        lambda t: bs.direction_counts(t.predictions),
        """SELECT *, 100.0 * over / total AS over_pct, 100.0 * under / total AS under_pct,
        100.0 * exact / total AS exact_pct FROM (SELECT count(*) AS total, count(*) FILTER (e > 0) AS over,
        count(*) FILTER (e < 0) AS under, count(*) FILTER (e = 0) AS exact FROM pe)""".replace(
            " over,", ' "over",'
        ).replace("* over /", '* "over" /'),
        "over_pct under_pct exact_pct",
    )
    band = """CASE WHEN actual <= 0 THEN NULL WHEN actual <= 10 THEN '0-10' WHEN actual <= 50 THEN '10-50'
      WHEN actual <= 100 THEN '50-100' WHEN actual <= 500 THEN '100-500' ELSE '500+' END"""
    c.add(
        "H03_bias_by_scale",
        lambda t: bs.bias_by_scale(t.predictions),
        f"""SELECT {band} AS actual_scale, avg(ratio) AS ratio_mean, count(ratio) AS ratio_count,
        avg(e) AS error_mean, avg(e / nullif(actual, 0)) AS relative_error_mean,
        quantile_cont(ratio, 0.5) AS ratio_median FROM pe WHERE actual > 0 GROUP BY 1""",
        "ratio_mean error_mean relative_error_mean ratio_median",
    )
    c.add(
        "H04_bias_by_key",
        lambda t: bs.bias_by_key(t.predictions),
        "SELECT * FROM key_bias",
        "actual_value_sum actual_value_mean actual_value_std predicted_value_sum predicted_value_mean "
        "predicted_value_std prediction_ratio_mean prediction_ratio_median absolute_error_mean overprediction_score",
    )
    c.add(
        "H05_bias_rank",
        lambda t: bs.bias_rank(bs.bias_by_key(t.predictions)),
        """WITH s AS (SELECT material_key, actual_value_sum, predicted_value_sum, overprediction_score,
          1 / (1 + abs(overprediction_score - 1)) AS accuracy_score FROM key_bias
          WHERE overprediction_score IS NOT NULL)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY overprediction_score DESC, material_key) AS INTEGER)
          AS rank, 'overpredicted' AS list FROM s
          UNION ALL SELECT *, CAST(row_number() OVER (ORDER BY accuracy_score DESC, material_key) AS INTEGER),
          'accurate' FROM s) WHERE rank <= 10""",
        "actual_value_sum predicted_value_sum overprediction_score accuracy_score",
    )
    c.add(
        "H06_bias_by_day",
        lambda t: bs.bias_by_day(t.predictions),
        """SELECT date, sum(actual) AS actual_value, sum(predicted) AS predicted_value,
        avg(ratio) AS prediction_ratio, sum(predicted) / nullif(sum(actual), 0) AS overprediction_rate
        FROM pe GROUP BY 1""",
        "actual_value predicted_value prediction_ratio overprediction_rate",
    )
    c.add(
        "H07_bias_by_weekday",
        lambda t: bs.bias_by_weekday(t.predictions),
        """SELECT CAST(isodow(date) AS INTEGER) - 1 AS weekday, avg(ratio) AS prediction_ratio,
        avg(e) AS absolute_error FROM pe GROUP BY 1""",
        "prediction_ratio absolute_error",
    )
    base = "CASE WHEN actual = 0 THEN 1 ELSE actual END"
    c.add(
        "H08_high_overprediction",
        lambda t: bs.high_overprediction(t.predictions.withColumn(PREDICTED, F.col(PREDICTED) * (F.col(KEY) % 20))),
        f"""SELECT count(*) AS key_count, avg(a) AS mean_actual, avg(p) AS mean_predicted,
        count(*) FILTER (a < 10) AS small_keys, 100.0 * count(*) FILTER (a < 10) / count(*) AS small_pct,
        quantile_cont(a, 0.5) AS median_actual
        FROM (SELECT material_key, avg(predicted * (material_key % 20) / {base}) AS r, avg(actual) AS a,
          avg(predicted * (material_key % 20)) AS p FROM pe GROUP BY 1) WHERE r > 5""",
        "mean_actual mean_predicted small_pct median_actual",
    )
    errors = "SELECT abs(e) AS x FROM pe WHERE abs(e) < (SELECT quantile_cont(abs(e), 0.95) FROM pe)"
    ratios = "SELECT ratio AS x FROM pe WHERE ratio < 10"
    c.add(
        "H09_error_histogram",
        lambda t: bs.error_histogram(t.predictions),
        f"{_histogram_sql('abs_error', errors)} UNION ALL {_histogram_sql('prediction_ratio', ratios)}",
        "bin_start",
    )
    c.add(
        "H10_bias_overall",
        lambda t: bs.bias_overall(t.predictions),
        """SELECT avg(actual) AS mean_actual, avg(predicted) AS mean_predicted, avg(ratio) AS mean_prediction_ratio,
        100.0 * count(*) FILTER (e > 0) / count(*) AS overprediction_percentage FROM pe""",
        "mean_actual mean_predicted mean_prediction_ratio overprediction_percentage",
    )
    c.add(
        "H11_test_rows",
        lambda t: bs.test_rows(t.predictions, 2001),
        "SELECT * FROM pred WHERE year(date) = 2001",
        "actual predicted",
    )
    c.add(
        "J08_bias_rules",
        lambda t: bs.bias_rules(t.predictions),
        f"""WITH one AS (SELECT (SELECT avg(ratio) FROM pe) AS a,
          (SELECT max(m) - min(m) FROM (SELECT avg(ratio) AS m FROM pe WHERE actual > 0 GROUP BY {band})) AS b,
          (SELECT CAST(count(*) FILTER (overprediction_score > 2) AS DOUBLE) FROM key_bias) AS c)
        SELECT rule, measured, CAST("limit" AS DOUBLE) AS "limit", CAST(measured > "limit" AS INTEGER) AS applies
        FROM (SELECT unnest(['mean_ratio', 'band_spread', 'keys_over_2']) AS rule, unnest([a, b, c]) AS measured,
          unnest([1.2, 0.5, 0.0]) AS "limit" FROM one)""",
        "measured",
    )
