"""B: preparation; C: calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.operators import keys as ks
from demandgrid.operators import prepare as pp
from demandgrid.plans.catalog import Catalog
from demandgrid.plans.driver_tables import DriverTables
from demandgrid.schema import DATE, KEY, SEGMENT, STORE, VALUE


def _with_gaps(t: DriverTables) -> DataFrame:
    """Dense store table whose segment is known on sales days only."""
    sparse = t.store_daily.join(t.store_segment, KEY)
    return pp.fill_attributes(pp.fill_zero_global(sparse), [SEGMENT])


def _first_line(t: DriverTables) -> DataFrame:
    lines = t.read("lineitem").select(
        F.col("l_suppkey").alias(STORE), "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber"
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return pp.first_attr(lines, [STORE], ["l_returnflag", "l_linestatus"], order)


def _dropped(t: DriverTables) -> DataFrame:
    table = t.raw.withColumns({"category_lvl1": F.lit("x"), "category_lvl1_mean_f": F.lit(0.0)})
    return pp.drop_matching(table, "category_lvl")


def _reduction(t: DriverTables) -> DataFrame:
    return pp.reduction(t.material_daily, ks.top_active(t.material_daily, 200))


def register(c: Catalog) -> None:
    v = "actual_value"
    c.add(
        "B01_aggregate_store_daily",
        lambda t: pp.aggregate_level(t.raw, STORE),
        "SELECT material_key, material_key AS store_code, file_date, actual_value FROM sd",
        v,
    )
    c.add(
        "B02_aggregate_product_daily",
        lambda t: t.product_daily,
        "SELECT material_key, material_key AS product_key, file_date, actual_value FROM pd",
        v,
    )
    c.add(
        "B03_usage_type_from_prefix",
        lambda t: pp.add_usage_type(t.read("customer"), "c_mktsegment", "HOUSE").select(
            "c_custkey", "c_mktsegment", SEGMENT
        ),
        "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment LIKE 'HOUSE%' THEN 'household' "
        "ELSE 'business' END AS usage_type FROM customer",
    )
    c.add(
        "B04_first_attribute",
        _first_line,
        "SELECT l_suppkey AS store_code, "
        "first(l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS l_returnflag, "
        "first(l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber) AS l_linestatus "
        "FROM lineitem GROUP BY 1",
    )
    c.add("B05_fill_zero_global", lambda t: t.store_dense, "SELECT * FROM dense", v)
    c.add(
        "B06_fill_zero_per_key",
        lambda t: pp.fill_zero_per_key(t.store_daily),
        "SELECT d.* FROM dense d JOIN (SELECT material_key, min(file_date) AS lo, max(file_date) AS hi "
        "FROM sd GROUP BY 1) b ON b.material_key = d.material_key AND d.file_date BETWEEN lo AND hi",
        v,
    )
    c.add("B07_fill_attributes", _with_gaps, "SELECT * FROM densu", v)
    c.add(
        "B08_require_columns",
        lambda t: pp.require_columns(t.raw, [STORE, DATE, VALUE]).select(STORE, DATE, VALUE),
        "SELECT store_code, file_date, actual_value FROM raw_lines",
        v,
    )
    c.add(
        "B09_segment_filter",
        lambda t: pp.segment(t.material_store_daily, "business"),
        "SELECT * FROM msd WHERE usage_type = 'business'",
        v,
    )
    c.add("B10_drop_category_columns", _dropped, "SELECT * FROM raw_lines", v)
    c.add(
        "B11_crop_years",
        lambda t: pp.crop_years(t.raw, 1996, 2000),
        "SELECT * FROM raw_lines WHERE year(file_date) BETWEEN 1996 AND 2000",
        v,
    )
    c.add(
        "B12_preparation_summary",
        lambda t: pp.prep_summary(t.store_dense),
        """SELECT (SELECT count(*) FROM dense) AS row_count, count(*) AS key_count, min(lo) AS date_min,
        max(hi) AS date_max, 100.0 * sum(zeros) / sum(n) AS zero_pct, avg(m) AS mean_daily_value,
        sum(total) AS total_value
        FROM (SELECT material_key, count(*) AS n, min(file_date) AS lo, max(file_date) AS hi,
          count(*) FILTER (actual_value = 0) AS zeros, avg(actual_value) AS m, sum(actual_value) AS total
          FROM dense GROUP BY 1)""",
        "zero_pct mean_daily_value total_value",
    )
    c.add(
        "B13_top10_volume_share",
        lambda t: pp.top_share(t.material_daily, 10),
        """SELECT (SELECT sum(total_value) FROM (SELECT * FROM volume ORDER BY total_value DESC, material_key
        LIMIT 10)) AS top_total, sum(total_value) AS all_total,
        100 * (SELECT sum(total_value) FROM (SELECT * FROM volume ORDER BY total_value DESC, material_key
        LIMIT 10)) / sum(total_value) AS top_pct FROM volume""",
        "top_total all_total top_pct",
    )
    c.add(
        "B14_year_stats",
        lambda t: pp.year_stats(t.material_daily),
        """SELECT CAST(year(file_date) AS INTEGER) AS year, count(DISTINCT material_key) AS key_count,
        sum(actual_value) AS total_value, avg(actual_value) AS mean_value FROM md GROUP BY 1""",
        "total_value mean_value",
    )
    c.add(
        "B15_narrow_floats",
        lambda t: pp.narrow_floats(t.store_daily),
        "SELECT material_key, file_date, CAST(actual_value AS FLOAT) AS actual_value FROM sd",
    )
    c.add(
        "B16_since",
        lambda t: pp.since(t.raw, "2001-01-01"),
        "SELECT * FROM raw_lines WHERE file_date >= DATE '2001-01-01'",
        v,
    )
    c.add(
        "B17_date_alias",
        lambda t: pp.with_date(t.raw),
        "SELECT *, file_date AS date FROM raw_lines",
        v,
    )
    c.add(
        "B18_reduction",
        _reduction,
        """WITH kept AS (SELECT material_key FROM active ORDER BY active_count DESC, material_key LIMIT 200)
        SELECT *, 100 - 100.0 * rows_after / rows_before AS reduction_pct FROM (
        SELECT count(*) AS rows_before,
          count(*) FILTER (material_key IN (SELECT material_key FROM kept)) AS rows_after,
          count(DISTINCT material_key) AS keys_before,
          count(DISTINCT material_key) FILTER (material_key IN (SELECT material_key FROM kept)) AS keys_after
        FROM md)""",
        "reduction_pct",
    )

    ids = ["order_key", "line_number", DATE]

    def per_line(name: str, columns, sql: str) -> None:
        c.add(
            name,
            lambda t: t.raw.withColumns(columns()).select(*ids, *columns()),
            f"SELECT order_key, line_number, file_date, {sql} FROM raw_lines",
        )

    dow = "CAST(isodow(file_date) AS INTEGER) - 1"
    per_line("C01_day_of_week", lambda: {"dow": cal.dow(DATE)}, f"{dow} AS dow")
    per_line(
        "C02_is_weekend", lambda: {"is_weekend": cal.is_weekend(DATE)}, f"CAST({dow} >= 5 AS INTEGER) AS is_weekend"
    )
    per_line(
        "C03_business_weekday",
        lambda: {"day_of_week_f": cal.day_of_week_f(DATE)},
        f"CASE WHEN {dow} < 5 THEN {dow} + 1 END AS day_of_week_f",
    )
    c.add(
        "C04_is_business_day",
        lambda t: cal.is_business_day_f(t.raw.select(*ids), t.holidays),
        f"""SELECT order_key, line_number, file_date, CASE WHEN {dow} >= 5
        OR file_date IN (SELECT holiday FROM holiday_list)
        OR (month(file_date) = 1 AND day(file_date) <= 5) OR (month(file_date) = 12 AND day(file_date) >= 30)
        THEN 0 ELSE 1 END AS is_business_day_f FROM raw_lines""",
    )
    per_line(
        "C05_is_business_day_simple",
        lambda: {"is_business_day_f": cal.is_business_day_simple(DATE)},
        f"CAST({dow} < 5 AS INTEGER) AS is_business_day_f",
    )
    per_line(
        "C06_month_quarter_year",
        lambda: cal.month_parts(DATE),
        "CAST(month(file_date) AS INTEGER) AS month_f, CAST(quarter(file_date) AS INTEGER) AS quarter_f, "
        "CAST(year(file_date) AS INTEGER) AS year_f",
    )
    per_line(
        "C07_day_of_month_iso_week",
        lambda: cal.day_parts(DATE),
        "CAST(day(file_date) AS INTEGER) AS day_of_month_f, CAST(week(file_date) AS INTEGER) AS week_of_year_f",
    )
    per_line(
        "C08_month_edges",
        lambda: cal.month_edges(DATE),
        "CAST(day(file_date) <= 7 AS INTEGER) AS is_month_start, "
        "CAST(day(file_date) >= 24 AS INTEGER) AS is_month_end",
    )
    per_line(
        "C09_onehot_day_of_week",
        lambda: cal.onehot_dow(DATE),
        ", ".join(f"CAST({dow} = {i} AS INTEGER) AS day_of_week_{i}_f" for i in range(7)),
    )
    c.add(
        "C10_container",
        lambda t: t.material_store_daily.withColumn("container_f", cal.container_f()),
        "SELECT *, CASE WHEN usage_type = 'business' THEN 1 ELSE 0 END AS container_f FROM msd",
        v,
    )
    per_line(
        "C11_year_month", lambda: {"year_month": cal.year_month(DATE)}, "strftime(file_date, '%Y-%m') AS year_month"
    )


