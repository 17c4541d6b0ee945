"""SQL twins of ``driver_tables`` for checking results against another engine."""

from __future__ import annotations

from demandgrid.operators.metrics import UNIT_LIMITS
from demandgrid.plans.driver_tables import HOLIDAYS, TRAIN_END

UNIT_METRICS = [f"within_{x}_units_pct" for x in UNIT_LIMITS]
UNIT_SQL = ", ".join(f"100.0 * count(*) FILTER (abs(e) <= {x}) / count(e) AS within_{x}_units_pct" for x in UNIT_LIMITS)
RECORD_METRICS = (
    "n rmse mae mape_pct correlation r2 within_20_record_pct within_30_record_pct within_50_record_pct".split()
    + UNIT_METRICS
)
KEY_METRICS = (
    "key_count error_rate_mean within_20_percent_ratio within_30_percent_ratio within_50_percent_ratio "
    "error_rate_median".split()
)


def _metrics(run: str, table: str) -> str:
    names = RECORD_METRICS + KEY_METRICS
    record = f"""
      SELECT segment, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
        coalesce(avg(100 * rate), 0) AS mape_pct, corr(predicted, actual) AS correlation,
        1 - sum(e * e) / (var_pop(actual) * count(*)) AS r2,
        100.0 * count(*) FILTER (100 * rate <= 20) / count(rate) AS within_20_record_pct,
        100.0 * count(*) FILTER (100 * rate <= 30) / count(rate) AS within_30_record_pct,
        100.0 * count(*) FILTER (100 * rate <= 50) / count(rate) AS within_50_record_pct, {UNIT_SQL}
      FROM rows_ GROUP BY segment"""
    by_key = """
      SELECT segment, count(*) AS key_count, avg(r) AS error_rate_mean,
        1.0 * count(*) FILTER (r <= 0.2) / count(*) AS within_20_percent_ratio,
        1.0 * count(*) FILTER (r <= 0.3) / count(*) AS within_30_percent_ratio,
        1.0 * count(*) FILTER (r <= 0.5) / count(*) AS within_50_percent_ratio,
        quantile_cont(r, 0.5) AS error_rate_median
      FROM (SELECT segment, material_key, avg(rate) AS r FROM rows_ WHERE actual > 0 GROUP BY ALL) GROUP BY segment"""
    values = ", ".join(f"CAST({n} AS DOUBLE)" for n in names)
    labels = ", ".join(f"'{n}'" for n in names)
    return f"""
      WITH rows_ AS (
        SELECT usage_type AS segment, *, predicted - actual AS e,
          CASE WHEN actual > 0 THEN abs(predicted - actual) / actual END AS rate FROM {table}
        UNION ALL
        SELECT 'all' AS segment, *, predicted - actual AS e,
          CASE WHEN actual > 0 THEN abs(predicted - actual) / actual END AS rate FROM {table}),
      rec AS ({record}), bykey AS ({by_key})
      SELECT '{run}' AS run, segment, unnest([{labels}]) AS metric, unnest([{values}]) AS value
      FROM rec JOIN bykey USING (segment)"""


_HOLIDAY_LIST = ", ".join(f"({m}, {d})" for m, d in HOLIDAYS)

TABLES = {
    "raw_lines": """
      SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS material_key,
        l_suppkey AS store_code, CAST(l_shipdate AS DATE) AS file_date, l_quantity AS actual_value
      FROM lineitem""",
    "store_dim": """
      SELECT s_suppkey AS material_key,
        CASE WHEN starts_with(r_name, 'A') THEN 'household' ELSE 'business' END AS usage_type
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "msd": """
      SELECT r.material_key, r.store_code, r.file_date, r.actual_value, s.usage_type
      FROM (SELECT material_key, store_code, file_date, sum(actual_value) AS actual_value
            FROM raw_lines GROUP BY ALL) r
      JOIN store_dim s ON s.material_key = r.store_code""",
    "md": "SELECT material_key, file_date, sum(actual_value) AS actual_value FROM raw_lines GROUP BY ALL",
    "sd": """
      SELECT store_code AS material_key, file_date, sum(actual_value) AS actual_value
      FROM raw_lines GROUP BY ALL""",
    "day_list": """
      SELECT CAST(unnest(generate_series(min(file_date), max(file_date), INTERVAL 1 DAY)) AS DATE) AS file_date
      FROM raw_lines""",
    "dense": """
      SELECT k.material_key, d.file_date, coalesce(s.actual_value, CAST(0 AS DOUBLE)) AS actual_value
      FROM (SELECT DISTINCT material_key FROM sd) k CROSS JOIN day_list d
      LEFT JOIN sd s ON s.material_key = k.material_key AND s.file_date = d.file_date""",
    "densu": "SELECT d.*, s.usage_type FROM dense d JOIN store_dim s ON s.material_key = d.material_key",
    "pd": """
      SELECT p_brand AS material_key, file_date, sum(actual_value) AS actual_value
      FROM raw_lines JOIN part ON p_partkey = material_key GROUP BY 1, 2""",
    "pdense": """
      SELECT k.material_key, d.file_date, coalesce(s.actual_value, CAST(0 AS DOUBLE)) AS actual_value
      FROM (SELECT DISTINCT material_key FROM pd) k CROSS JOIN day_list d
      LEFT JOIN pd s ON s.material_key = k.material_key AND s.file_date = d.file_date""",
    "holiday_list": f"""
      SELECT make_date(y, m, d) AS holiday
      FROM (SELECT unnest(generate_series(year(min(file_date)), year(max(file_date)))) AS y FROM raw_lines),
        (VALUES {_HOLIDAY_LIST}) AS v(m, d)""",
    "pred": """
      SELECT material_key, file_date AS date, actual_value AS actual,
        floor((actual_value * (CAST(1 AS DOUBLE) + ((material_key * 7) % 13 - 6) / CAST(10 AS DOUBLE)
          + (day(file_date) % 5 - 2) / CAST(50 AS DOUBLE))
          + ((material_key + day(file_date)) % 4) * CAST(0.25 AS DOUBLE)) * 64 + CAST(0.5 AS DOUBLE))
          / CAST(64 AS DOUBLE) AS predicted,
        usage_type
      FROM densu""",
    "pred_b": """
      SELECT material_key, file_date AS date, actual_value AS actual,
        floor(coalesce(avg(actual_value) OVER (PARTITION BY material_key ORDER BY file_date
          ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) * 64 + CAST(0.5 AS DOUBLE))
          / CAST(64 AS DOUBLE) AS predicted,
        usage_type
      FROM densu""",
    # Materials by store: a material is sold in several segments.
    "pred_m": """
      SELECT material_key, file_date AS date, actual_value AS actual,
        floor(actual_value * (CAST(1 AS DOUBLE) + ((material_key * 7 + store_code) % 13 - 6) / CAST(10 AS DOUBLE)) * 64
          + CAST(0.5 AS DOUBLE)) / CAST(64 AS DOUBLE) AS predicted,
        usage_type
      FROM msd""",
    "pred_m_b": """
      SELECT material_key, date, actual, floor((actual + predicted) * 32 + CAST(0.5 AS DOUBLE)) / CAST(64 AS DOUBLE) AS predicted,
        usage_type
      FROM pred_m""",
    # Predictions with the derived columns most metrics need.
    "pe": """
      SELECT *, predicted - actual AS e,
        CASE WHEN actual > 0 THEN abs(predicted - actual) / actual END AS rate,
        predicted / nullif(actual, 0) AS ratio
      FROM pred""",
    "key_rates": """
      SELECT material_key, avg(rate) AS error_rate_mean, count(*) AS n_records,
        sum(actual) AS total_actual, sum(predicted) AS total_predicted
      FROM pe WHERE actual > 0 GROUP BY material_key""",
    "unit_errors": """
      SELECT material_key, count(*) AS "count",
        avg(CASE WHEN abs(e) > 5 THEN 100.0 ELSE 0 END) AS Error_Rate_5,
        avg(CASE WHEN abs(e) > 10 THEN 100.0 ELSE 0 END) AS Error_Rate_10,
        avg(CASE WHEN abs(e) > 20 THEN 100.0 ELSE 0 END) AS Error_Rate_20,
        avg(CASE WHEN abs(e) > 30 THEN 100.0 ELSE 0 END) AS Error_Rate_30,
        avg(CASE WHEN abs(e) > 50 THEN 100.0 ELSE 0 END) AS Error_Rate_50,
        sqrt(avg(e * e)) AS RMSE, avg(abs(e)) AS MAE
      FROM pe GROUP BY material_key""",
    "detail": """
      SELECT material_key, count(rate) AS record_count, sum(actual) AS actual_sum,
        sum(predicted) AS predicted_sum, avg(100 * rate) AS mean_error_rate,
        quantile_cont(100 * rate, 0.5) AS median_error_rate, max(100 * rate) AS max_error_rate,
        min(100 * rate) AS min_error_rate
      FROM pe GROUP BY material_key HAVING sum(actual) <> 0 AND count(rate) > 0""",
    "summary": """
      SELECT material_key, strftime(date, '%Y-%m') AS predict_year_month, usage_type,
        count(*) FILTER (actual > 0) AS actual_value_count,
        round_even(round(avg(actual), 8) * 100, 0) / 100 AS actual_value_mean,
        round_even(round(avg(predicted), 8) * 100, 0) / 100 AS predict_value_mean,
        round_even(round(avg(rate), 10) * 10000, 0) / 10000 AS error_value_mean
      FROM pe GROUP BY 1, 2, 3""",
    "enriched": f"""
      SELECT s.*, coalesce(t.n, 0) AS actual_value_count_in_train_period,
        coalesce(p.n, 0) AS actual_value_count_in_predict_period
      FROM summary s
      LEFT JOIN (SELECT material_key, count(*) AS n FROM sd
                 WHERE file_date <= DATE '{TRAIN_END}' AND actual_value > 0 GROUP BY 1) t
        ON t.material_key = s.material_key
      LEFT JOIN (SELECT material_key, count(*) AS n FROM pred WHERE actual > 0 GROUP BY 1) p
        ON p.material_key = s.material_key""",
    "key_bias": """
      SELECT material_key, sum(actual) AS actual_value_sum, avg(actual) AS actual_value_mean,
        stddev_samp(actual) AS actual_value_std, sum(predicted) AS predicted_value_sum,
        avg(predicted) AS predicted_value_mean, stddev_samp(predicted) AS predicted_value_std,
        avg(ratio) AS prediction_ratio_mean, quantile_cont(ratio, 0.5) AS prediction_ratio_median,
        avg(e) AS absolute_error_mean, sum(predicted) / nullif(sum(actual), 0) AS overprediction_score
      FROM pe GROUP BY material_key""",
    "runs": f"{_metrics('a', 'pred')} UNION ALL SELECT * FROM ({_metrics('b', 'pred_b')})",
    "runs_m": f"{_metrics('a', 'pred_m')} UNION ALL SELECT * FROM ({_metrics('b', 'pred_m_b')})",
    "active": """
      SELECT material_key, count(*) AS active_count FROM md WHERE actual_value > 0 GROUP BY material_key""",
    "volume": "SELECT material_key, sum(actual_value) AS total_value FROM md GROUP BY material_key",
}

_DIRECTIONS = (
    [(m, -1) for m in ("rmse", "mae", "mape_pct", "error_rate_mean", "error_rate_median")]
    + [(f"within_{x}_percent_ratio", 1) for x in (20, 30, 50)]
    + [(f"within_{x}_record_pct", 1) for x in (20, 30, 50)]
    + [(m, 1) for m in (*UNIT_METRICS, "correlation", "r2")]
)
TABLES["directions"] = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {s})" for m, s in _DIRECTIONS) + ") AS v(metric, sgn)"


def _run_diff(runs: str) -> str:
    return f"""
      SELECT a.segment, a.metric, a.value AS before, b.value AS after, b.value - a.value AS diff,
        100 * sgn * (b.value - a.value) / nullif(abs(a.value), 0) AS improvement_pct
      FROM {runs} a JOIN {runs} b ON a.segment = b.segment AND a.metric = b.metric AND a.run = 'a' AND b.run = 'b'
      JOIN directions d ON d.metric = a.metric
      WHERE a.value IS NOT NULL AND b.value IS NOT NULL"""


TABLES["run_diff"] = _run_diff("runs")
TABLES["run_diff_m"] = _run_diff("runs_m")
