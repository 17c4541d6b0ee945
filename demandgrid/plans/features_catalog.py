"""D: time-series and profile features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from demandgrid.operators import features as ft
from demandgrid.plans.catalog import Catalog
from demandgrid.plans.driver_tables import TRAIN_END, DriverTables
from demandgrid.schema import KEY, STORE

W = "PARTITION BY material_key ORDER BY file_date"
SQL_STAT = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}


def _lag(n: int) -> str:
    return f"lag(actual_value, {n}) OVER ({W})"


def _roll(stat: str, n: int, name: str | None = None) -> str:
    frame = f"{W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"{SQL_STAT[stat]}(actual_value) OVER ({frame}) AS {name or f'rolling_{stat}_{n}_f'}"


def _trend(n: int) -> str:
    return f"(actual_value - {_lag(n)}) / ({_lag(n)} + 1) AS trend_{n}d_f"


DOW = "CAST(isodow(file_date) AS INTEGER) - 1"
BUSINESS_DOW = f"CASE WHEN {DOW} < 5 THEN {DOW} + 1 END"
DOW_MEAN = f"""CASE WHEN {DOW} < 5 THEN avg(actual_value) OVER (PARTITION BY material_key, {BUSINESS_DOW}
  ORDER BY file_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS material_dow_mean_f"""
PROFILE = """avg(actual_value) OVER k AS product_mean_f, stddev_samp(actual_value) OVER k AS product_std_f,
  quantile_cont(actual_value, 0.5) OVER k AS product_median_f, min(actual_value) OVER k AS product_min_f,
  max(actual_value) OVER k AS product_max_f"""
PROFILE_NAMES = "product_mean_f product_std_f product_median_f product_min_f product_max_f"

_SERIES = (
    [f"{_lag(n)} AS lag_{n}_f" for n in ft.LAGS]
    + [_roll(s, n) for s in SQL_STAT for n in ft.WINDOWS]
    + [_trend(n) for n in ft.TRENDS]
)
SERIES_NAMES = (
    [f"lag_{n}_f" for n in ft.LAGS]
    + [f"rolling_{s}_{n}_f" for s in SQL_STAT for n in ft.WINDOWS]
    + [f"trend_{n}d_f" for n in ft.TRENDS]
)
PRODUCT_NAMES = ["actual_value", *SERIES_NAMES, *PROFILE_NAMES.split(), "material_dow_mean_f"]


def product_features_sql(table: str) -> str:
    return f"""SELECT *, {', '.join(_SERIES)}, {PROFILE}, {DOW_MEAN},
      {DOW} AS dow, CAST({DOW} >= 5 AS INTEGER) AS is_weekend, {BUSINESS_DOW} AS day_of_week_f,
      CAST(month(file_date) AS INTEGER) AS month, CAST(quarter(file_date) AS INTEGER) AS quarter,
      CAST(year(file_date) AS INTEGER) AS year, CAST(day(file_date) <= 7 AS INTEGER) AS is_month_start,
      CAST(day(file_date) >= 24 AS INTEGER) AS is_month_end,
      CASE WHEN {DOW} >= 5 OR file_date IN (SELECT holiday FROM holiday_list)
        OR (month(file_date) = 1 AND day(file_date) <= 5) OR (month(file_date) = 12 AND day(file_date) >= 30)
        THEN 0 ELSE 1 END AS is_business_day_f,
      CASE WHEN file_date <= DATE '{TRAIN_END}' THEN 'train' ELSE 'test' END AS data_type
      FROM {table} WINDOW k AS (PARTITION BY material_key)"""


_CONFIG = ft.DEFAULT_CONFIG[KEY]
CONFIG_SQL = (
    [f"{_lag(n)} AS lag_{n}_f" for n in _CONFIG["lag"]]
    + [_roll("mean", n) for n in _CONFIG["rolling_mean"]]
    + [_roll("std", n) for n in _CONFIG["rolling_std"]]
    + [
        f"avg(actual_value) OVER (PARTITION BY material_key ORDER BY year(file_date) * 12 + month(file_date) "
        f"RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) AS cumulative_mean_{n}_f"
        for n in _CONFIG["cumulative_mean"]
    ]
)
CONFIG_NAMES = (
    [f"lag_{n}_f" for n in _CONFIG["lag"]]
    + [f"rolling_mean_{n}_f" for n in _CONFIG["rolling_mean"]]
    + [f"rolling_std_{n}_f" for n in _CONFIG["rolling_std"]]
    + [f"cumulative_mean_{n}_f" for n in _CONFIG["cumulative_mean"]]
)
CHANGE = f"({_lag(1)} - {_lag(2)}) / nullif({_lag(2)}, 0) AS change_rate_f"


def segment_features_sql(table: str, with_container: bool) -> str:
    """Window columns from the masked target, which is then restored."""
    container = ", CASE WHEN usage_type = 'business' THEN 1 ELSE 0 END AS container_f" if with_container else ""
    keep = "material_key, file_date, target" + (", usage_type" if with_container else "")
    onehot = ", ".join(f"CAST({DOW} = {i} AS INTEGER) AS day_of_week_{i}_f" for i in range(7))
    return f"""SELECT * EXCLUDE (target), target AS actual_value, {DOW} AS day_of_week_f,
      CAST({DOW} >= 5 AS INTEGER) AS is_weekend_f, CAST({DOW} < 5 AS INTEGER) AS is_business_day_f,
      CAST(month(file_date) AS INTEGER) AS month_f, CAST(quarter(file_date) AS INTEGER) AS quarter_f,
      CAST(year(file_date) AS INTEGER) AS year_f, CAST(day(file_date) AS INTEGER) AS day_of_month_f,
      CAST(week(file_date) AS INTEGER) AS week_of_year_f, {onehot}{container},
      CASE WHEN file_date <= DATE '{TRAIN_END}' THEN 'train' ELSE 'test' END AS data_type
      FROM (SELECT {keep}, {', '.join(CONFIG_SQL)}, {CHANGE}
        FROM (SELECT * REPLACE (CASE WHEN file_date <= DATE '{TRAIN_END}' THEN actual_value END AS actual_value),
          actual_value AS target FROM {table}))"""


def _product_base(t: DriverTables) -> DataFrame:
    return ft.feature_job(t.product_dense, "product", TRAIN_END, t.holidays)


def register(c: Catalog) -> None:
    base = "SELECT *, {} FROM dense"
    c.add(
        "D01_lags",
        lambda t: ft.lags(t.store_dense),
        base.format(", ".join(f"{_lag(n)} AS lag_{n}_f" for n in ft.LAGS)),
        "actual_value " + " ".join(f"lag_{n}_f" for n in ft.LAGS),
    )
    for number, stat in zip(("D02", "D03", "D04", "D05"), SQL_STAT):
        c.add(
            f"{number}_rolling_{stat}",
            lambda t, stat=stat: ft.rolling(t.store_dense, stat),
            base.format(", ".join(_roll(stat, n) for n in ft.WINDOWS)),
            "actual_value " + " ".join(f"rolling_{stat}_{n}_f" for n in ft.WINDOWS),
        )
    c.add(
        "D06_trend",
        lambda t: ft.trend(t.store_dense),
        base.format(", ".join(_trend(n) for n in ft.TRENDS)),
        "actual_value trend_7d_f trend_28d_f",
    )
    c.add(
        "D07_key_weekday_mean",
        lambda t: ft.dow_mean(t.store_dense),
        base.format(DOW_MEAN),
        "actual_value material_dow_mean_f",
    )
    c.add(
        "D08_store_weekday_mean",
        lambda t: ft.entity_dow_mean(t.material_store_daily, STORE),
        f"""SELECT *, CASE WHEN {DOW} < 5 THEN avg(actual_value) OVER (PARTITION BY store_code, {BUSINESS_DOW}
        ORDER BY file_date, material_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END
        AS store_code_dow_mean_f FROM msd""",
        "actual_value store_code_dow_mean_f",
    )
    c.add(
        "D09_cumulative_mean",
        lambda t: ft.cumulative_mean(ft.period_mean(t.store_dense, KEY, "month")),
        "SELECT *, "
        + ", ".join(
            f"avg(period_mean) OVER (PARTITION BY material_key ORDER BY period "
            f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS cumulative_mean_{n}_f"
            for n in (2, 3, 6, 12)
        )
        + " FROM (SELECT material_key, CAST(date_trunc('month', file_date) AS DATE) AS period, "
        "avg(actual_value) AS period_mean FROM dense GROUP BY 1, 2)",
        "period_mean " + " ".join(f"cumulative_mean_{n}_f" for n in (2, 3, 6, 12)),
    )
    c.add(
        "D10_change_rate", lambda t: ft.change_rate(t.store_dense), base.format(CHANGE), "actual_value change_rate_f"
    )
    c.add(
        "D11_mask_after_train_end",
        lambda t: ft.lags(ft.mask_after(t.store_dense, TRAIN_END), [1, 2, 3]),
        f"""SELECT *, {', '.join(f'{_lag(n)} AS lag_{n}_f' for n in (1, 2, 3))} FROM (
        SELECT * REPLACE (CASE WHEN file_date <= DATE '{TRAIN_END}' THEN actual_value END AS actual_value)
        FROM dense)""",
        "actual_value lag_1_f lag_2_f lag_3_f",
    )
    c.add(
        "D12_key_profile",
        lambda t: ft.key_profile(t.store_dense),
        f"SELECT *, {PROFILE} FROM dense WINDOW k AS (PARTITION BY material_key)",
        f"actual_value {PROFILE_NAMES}",
    )
    c.add(
        "D12_key_profile_train_only",
        lambda t: ft.key_profile(t.store_dense, TRAIN_END),
        f"""SELECT d.*, product_mean_f, product_std_f, product_median_f, product_min_f, product_max_f
        FROM dense d JOIN (SELECT material_key, avg(actual_value) AS product_mean_f,
          stddev_samp(actual_value) AS product_std_f, quantile_cont(actual_value, 0.5) AS product_median_f,
          min(actual_value) AS product_min_f, max(actual_value) AS product_max_f
          FROM dense WHERE file_date <= DATE '{TRAIN_END}' GROUP BY 1) p ON p.material_key = d.material_key""",
        f"actual_value {PROFILE_NAMES}",
    )
    for number, unit in (("D13", "week"), ("D14", "month")):
        c.add(
            f"{number}_{unit}ly_mean",
            lambda t, unit=unit: ft.period_mean(t.material_store_daily, STORE, unit).unionByName(
                ft.period_mean(t.material_store_daily, KEY, unit).withColumnRenamed(KEY, STORE)
            ),
            f"""SELECT store_code, CAST(date_trunc('{unit}', file_date) AS DATE) AS period,
            avg(actual_value) AS period_mean FROM msd GROUP BY 1, 2
            UNION ALL SELECT material_key, CAST(date_trunc('{unit}', file_date) AS DATE), avg(actual_value)
            FROM msd GROUP BY 1, 2""",
            "period_mean",
        )
    label = f"CASE WHEN file_date <= DATE '{TRAIN_END}' THEN 'train' ELSE 'test' END AS data_type"
    c.add(
        "D15_label_split",
        lambda t: ft.label_split(t.material_daily, TRAIN_END),
        f"SELECT *, {label} FROM md",
        "actual_value",
    )
    c.add(
        "D16_split_sizes",
        lambda t: ft.split_sizes(ft.label_split(t.material_daily, TRAIN_END)),
        f"""SELECT data_type, count(*) AS row_count, 100.0 * count(*) / (SELECT count(*) FROM md) AS pct
        FROM (SELECT {label} FROM md) GROUP BY 1""",
        "pct",
    )
    names = [n for n in PRODUCT_NAMES if n != "actual_value"]
    numeric = names + ["day_of_week_f", "is_business_day_f"]
    rates = ", ".join(f"avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0 END)" for n in numeric)
    labels = ", ".join(f"'{n}'" for n in numeric)
    c.add(
        "D17_null_rates",
        lambda t: ft.null_rates(t.feature_table),
        f"""SELECT unnest([{labels}]) AS feature, unnest([{rates}]) AS null_rate
        FROM ({product_features_sql('dense')})""",
        "null_rate",
    )
    stats = " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, count({n}) AS "count", avg({n}) AS mean, stddev_samp({n}) AS std,
        CAST(min({n}) AS DOUBLE) AS min, CAST(max({n}) AS DOUBLE) AS max,
        CAST(quantile_cont({n}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({n}, 0.5) AS DOUBLE) AS q50,
        CAST(quantile_cont({n}, 0.75) AS DOUBLE) AS q75 FROM feature_rows"""
        for n in numeric
    )
    c.add(
        "D18_describe_features",
        lambda t: ft.describe_features(_product_base(t)),
        f"WITH feature_rows AS ({product_features_sql('pdense')}) {stats}",
        "mean std min max q25 q50 q75",
    )
    c.add(
        "D19_features_from_config",
        lambda t: ft.features_from_config(t.store_dense),
        base.format(", ".join(CONFIG_SQL)),
        "actual_value " + " ".join(CONFIG_NAMES),
    )
    store_config = {KEY: {"lag": [1]}, STORE: {"lag": [1, 2], "rolling_mean": [3]}}
    sw = "PARTITION BY store_code ORDER BY file_date"
    c.add(
        "D19_features_from_config_two_entities",
        lambda t: ft.features_from_config(t.material_store_daily, store_config, series=[KEY, STORE]),
        f"""SELECT m.*, lag(m.actual_value, 1) OVER (PARTITION BY m.material_key, m.store_code
          ORDER BY m.file_date) AS lag_1_f,
        store_code_lag_1_f, store_code_lag_2_f, store_code_rolling_mean_3_f
        FROM msd m JOIN (SELECT store_code, file_date, lag(v, 1) OVER ({sw}) AS store_code_lag_1_f,
          lag(v, 2) OVER ({sw}) AS store_code_lag_2_f,
          avg(v) OVER ({sw} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS store_code_rolling_mean_3_f
          FROM (SELECT store_code, file_date, sum(actual_value) AS v FROM msd GROUP BY 1, 2)) s
        ON s.store_code = m.store_code AND s.file_date = m.file_date""",
        "actual_value lag_1_f store_code_lag_1_f store_code_lag_2_f store_code_rolling_mean_3_f",
    )
    c.add(
        "D20_feature_job_product", _product_base, product_features_sql("pdense"), " ".join(PRODUCT_NAMES)
    )
    config_names = " ".join(["actual_value", "change_rate_f", *CONFIG_NAMES])
    c.add(
        "D20_feature_job_by_usage_type",
        lambda t: ft.feature_job(t.store_dense_segment, "by_usage_type", TRAIN_END),
        segment_features_sql("densu", True),
        config_names,
    )
    c.add(
        "D20_feature_job_all",
        lambda t: ft.feature_job(t.product_dense, "all", TRAIN_END),
        segment_features_sql("pdense", False),
        config_names,
    )
