"""E: key selection, on the material-day table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.operators import keys as ks
from demandgrid.plans.catalog import Catalog
from demandgrid.plans.driver_tables import TRAIN_END, DriverTables
from demandgrid.schema import KEY, SEGMENT

TOP = 200
TEST_MONTH = ("2001-01-01", "2001-01-31")
PERIOD = ("1997-01-01", "2000-12-31")
VOLUME_NS = [10, 100, 500, 1000, 1500, 5000]
ACTIVE_NS = [10, 50, 200, 1000, 3000]
PRESET = ks.Preset(TOP, 4)
SEGMENT_PRESETS = {"business": ks.Preset(20, 3), "household": ks.Preset(15, 4)}

IN_TRAIN = f"file_date <= DATE '{TRAIN_END}'"
IN_TEST = f"file_date > DATE '{TRAIN_END}'"
IN_MONTH = f"file_date BETWEEN DATE '{TEST_MONTH[0]}' AND DATE '{TEST_MONTH[1]}'"


def _counts(where: str = "true", table: str = "md") -> str:
    return (
        f"SELECT material_key, count(*) AS active_count FROM {table} "
        f"WHERE actual_value > 0 AND {where} GROUP BY material_key"
    )


def _top(n: int, where: str = "true") -> str:
    return f"SELECT * FROM ({_counts(where)}) ORDER BY active_count DESC, material_key LIMIT {n}"


def _top_volume(n: int, where: str = "true") -> str:
    return (
        f"SELECT material_key, sum(actual_value) AS total_value FROM md WHERE {where} GROUP BY 1 "
        f"ORDER BY total_value DESC, material_key LIMIT {n}"
    )


def _month_counts(t: DriverTables) -> DataFrame:
    return ks.active_counts(t.material_daily, *TEST_MONTH)


def _stats(t: DriverTables) -> DataFrame:
    return ks.threshold_stats(t.store_daily, 300, TRAIN_END, PERIOD)


def _order_bounds(t: DriverTables) -> DataFrame:
    orders = t.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("train_end"))
    one, six = cal.test_bounds("train_end", 1), cal.test_bounds("train_end", 6)
    return orders.withColumns({**one, "test_end_6": six["test_end"]})


def _coverage_sql(table: str, measure: str, ns: list[int]) -> str:
    return f"""SELECT n, top_total, 100.0 * top_total / all_total AS coverage_pct,
      (1 - n / CAST(keys AS DOUBLE)) * 100 AS key_reduction_pct
      FROM (SELECT CAST(n AS INTEGER) AS n, CAST(sum(m) FILTER (rk <= n) AS {measure}) AS top_total,
        sum(m) AS all_total, count(*) AS keys
        FROM (SELECT *, row_number() OVER (ORDER BY m DESC, material_key) AS rk FROM {table}),
          (SELECT unnest({ns}) AS n) GROUP BY n)
      WHERE n <= keys"""


THRESHOLD_STATS = f"""SELECT material_key,
  count(*) FILTER (file_date BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}') AS actual_value_count,
  count(*) FILTER (file_date BETWEEN DATE '{PERIOD[0]}' AND DATE '{TRAIN_END}') AS train_count,
  count(*) FILTER ({IN_MONTH}) AS test_count
  FROM sd WHERE actual_value > 0 GROUP BY 1"""
SELECTED = (
    f"SELECT material_key FROM ({THRESHOLD_STATS.replace('FROM sd', 'FROM md')}) "
    "WHERE actual_value_count >= 20 OR test_count > 0"
)


def register(c: Catalog) -> None:
    v = "actual_value"
    c.add(
        "E01_active_counts",
        lambda t: ks.active_counts(t.material_daily, *PERIOD),
        _counts(f"file_date BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'"),
    )
    c.add("E02_top_active", lambda t: ks.top_active(t.material_daily, TOP, TRAIN_END), _top(TOP, IN_TRAIN))
    c.add(
        "E03_active_in_test",
        lambda t: ks.active_in_test(t.material_daily, 4, "2001-01-01"),
        f"SELECT * FROM ({_counts(IN_TEST)}) WHERE active_count >= 4",
    )
    union = (
        f"SELECT material_key FROM ({_top(TOP, IN_TRAIN)}) UNION "
        f"SELECT material_key FROM ({_counts(IN_TEST)}) WHERE active_count >= {{}}"
    )
    c.add(
        "E04_select_keys",
        lambda t: ks.select_keys(t.material_daily, TRAIN_END, 2, PRESET),
        f"SELECT * FROM md WHERE material_key IN ({union.format(8)})",
        v,
    )
    c.add(
        "E04_select_keys_by_segment",
        lambda t: ks.select_keys_by_segment(
            t.store_daily.join(t.store_segment, KEY), TRAIN_END, 20, SEGMENT_PRESETS
        ).select(KEY, "file_date", "actual_value", SEGMENT),
        f"""WITH c AS (SELECT usage_type, material_key, count(*) FILTER ({IN_TRAIN}) AS tr,
            count(*) FILTER ({IN_TEST}) AS te
          FROM sd JOIN store_dim USING (material_key) WHERE actual_value > 0 GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY usage_type ORDER BY tr DESC, material_key) AS rk
          FROM c WHERE tr > 0)
        SELECT sd.*, usage_type FROM sd JOIN store_dim USING (material_key) WHERE (usage_type, material_key) IN (
          SELECT (usage_type, material_key) FROM ranked
            WHERE rk <= CASE usage_type WHEN 'business' THEN 20 ELSE 15 END
          UNION SELECT (usage_type, material_key) FROM c
            WHERE te >= CASE usage_type WHEN 'business' THEN 60 ELSE 80 END)""",
        v,
    )
    c.add(
        "E05_select_products",
        lambda t: ks.select_products(t.product_daily.drop("product_key"), TRAIN_END, 3, ks.Preset(10, 64))[0],
        f"""SELECT * FROM pd WHERE material_key IN (
        SELECT material_key FROM (SELECT * FROM ({_counts(IN_TRAIN, 'pd')})
          ORDER BY active_count DESC, material_key LIMIT 10)
        UNION SELECT material_key FROM ({_counts(IN_TEST, 'pd')}) WHERE active_count >= 192)""",
        v,
    )
    c.add(
        "E05_product_targets",
        lambda t: ks.select_products(t.product_daily, TRAIN_END, 3, ks.Preset(10, 64))[1],
        f"SELECT material_key FROM ({_counts(IN_TEST, 'pd')}) WHERE active_count >= 192",
    )
    c.add(
        "E06_select_threshold",
        lambda t: ks.select_threshold(t.material_daily, 20, TRAIN_END, PERIOD),
        f"SELECT * FROM md WHERE material_key IN ({SELECTED})",
        v,
    )
    c.add(
        "E07_attach_key_stats",
        lambda t: ks.attach_key_stats(t.predictions, _stats(t)),
        f"""SELECT p.*, CAST(coalesce(actual_value_count >= 300, false) AS INTEGER) AS is_over_threshold,
        coalesce(actual_value_count, 0) AS actual_value_count,
        coalesce(train_count, 0) AS actual_value_count_in_train_period
        FROM pred p LEFT JOIN ({THRESHOLD_STATS}) s ON s.material_key = p.material_key""",
        "actual predicted",
    )
    c.add(
        "E08_restrict_to_targets",
        lambda t: ks.restrict(t.predictions, ks.active_in_test(t.store_daily, 8, *TEST_MONTH)),
        f"""SELECT * FROM pred WHERE material_key IN (
        SELECT material_key FROM ({_counts(IN_MONTH, 'sd')}) WHERE active_count >= 8)""",
        "actual predicted",
    )
    c.add(
        "E09_select_by_volume",
        lambda t: ks.select_by_volume(t.material_daily, TOP, TRAIN_END, 2),
        f"""SELECT * FROM md WHERE material_key IN (
        SELECT material_key FROM ({_top_volume(TOP, IN_TRAIN)})
        UNION SELECT material_key FROM ({_counts(IN_MONTH)}) WHERE active_count >= 2)""",
        v,
    )
    c.add(
        "E10_set_overlap",
        lambda t: ks.set_overlap(
            ks.top_active(t.material_daily, TOP, TRAIN_END), ks.active_in_test(t.material_daily, 1, *TEST_MONTH)
        ),
        f"""SELECT coalesce(a.material_key, b.material_key) AS material_key,
        CASE WHEN a.material_key IS NULL THEN 'only_b' WHEN b.material_key IS NULL THEN 'only_a'
          ELSE 'both' END AS side
        FROM ({_top(TOP, IN_TRAIN)}) a FULL JOIN ({_counts(IN_MONTH)}) b ON a.material_key = b.material_key""",
    )
    c.add(
        "E11_coverage_by_volume",
        lambda t: ks.coverage(t.material_daily, "sum", VOLUME_NS),
        _coverage_sql("(SELECT material_key, total_value AS m FROM volume)", "DOUBLE", VOLUME_NS),
        "top_total coverage_pct key_reduction_pct",
    )
    c.add(
        "E12_coverage_by_activity",
        lambda t: ks.coverage(t.material_daily, "active", ACTIVE_NS),
        _coverage_sql("(SELECT material_key, active_count AS m FROM active)", "BIGINT", ACTIVE_NS),
        "coverage_pct key_reduction_pct",
    )
    c.add(
        "E13_top_detail",
        lambda t: ks.top_detail(t.material_daily, TOP),
        f"""SELECT count(*) AS key_count, CAST(sum(active_count) AS BIGINT) AS top_total,
        avg(active_count) AS mean, max(active_count) AS max, min(active_count) AS min,
        quantile_cont(active_count, 0.5) AS median,
        (SELECT CAST(sum(active_count) AS BIGINT) FROM active) AS all_total,
        100.0 * sum(active_count) / (SELECT sum(active_count) FROM active) AS coverage_pct
        FROM ({_top(TOP)})""",
        "mean median coverage_pct",
    )
    tested = f"SELECT material_key FROM ({_counts(IN_MONTH)}) WHERE active_count >= 2"
    c.add(
        "E14_coverage_delta",
        lambda t: ks.coverage_delta(t.material_daily, 300, 500, TEST_MONTH, 2),
        f"""SELECT total_n1, total_n2, 100.0 * total_n1 / t AS coverage_n1_pct,
        100.0 * total_n2 / t AS coverage_n2_pct, 100.0 * total_n2 / t - 100.0 * total_n1 / t AS gain_points,
        total_n2 - total_n1 AS added_total, tested_n1, tested_n2, tested_n2 - tested_n1 AS tested_added
        FROM (SELECT CAST(sum(active_count) FILTER (rk <= 300) AS BIGINT) AS total_n1,
          CAST(sum(active_count) FILTER (rk <= 500) AS BIGINT) AS total_n2, sum(active_count) AS t,
          count(*) FILTER (rk <= 300 AND material_key IN ({tested})) AS tested_n1,
          count(*) FILTER (rk <= 500 AND material_key IN ({tested})) AS tested_n2
          FROM (SELECT *, row_number() OVER (ORDER BY active_count DESC, material_key) AS rk FROM active))""",
        "coverage_n1_pct coverage_n2_pct gain_points",
    )
    c.add(
        "E15_rank_overlap",
        lambda t: ks.rank_overlap(t.material_daily, 300),
        f"""SELECT count(a.material_key) FILTER (b.material_key IS NOT NULL) AS overlap,
        count(*) FILTER (b.material_key IS NULL) AS only_active,
        count(*) FILTER (a.material_key IS NULL) AS only_volume,
        count(a.material_key) FILTER (b.material_key IS NOT NULL) / CAST(3 AS DOUBLE) AS overlap_pct
        FROM ({_top(300)}) a FULL JOIN ({_top_volume(300)}) b ON a.material_key = b.material_key""",
        "overlap_pct",
    )
    thresholds = [1, 2, 3, 4, 5, 10, 12, 15, 20, 24, 30, 48, 96]

    def sweep(counts: str, ts: list[int]) -> str:
        return f"""SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (active_count >= t) AS key_count,
        100.0 * count(*) FILTER (active_count >= t) / count(*) AS key_pct
        FROM ({counts}), (SELECT unnest({ts}) AS t) GROUP BY t"""

    c.add(
        "E16_threshold_counts",
        lambda t: ks.threshold_counts(_month_counts(t), thresholds),
        sweep(_counts(IN_MONTH), thresholds),
        "key_pct",
    )
    c.add(
        "E17_count_stats",
        lambda t: ks.count_stats(ks.active_counts(t.material_daily)),
        """SELECT count(*) AS key_count, avg(active_count) AS mean, max(active_count) AS max,
        min(active_count) AS min, quantile_cont(active_count, 0.25) AS q25,
        quantile_cont(active_count, 0.5) AS median, quantile_cont(active_count, 0.75) AS q75 FROM active""",
        "mean q25 median q75",
    )
    c.add(
        "E18_nonzero_ratio",
        lambda t: ks.nonzero_ratio(t.store_dense, 0.1),
        """SELECT * FROM (SELECT material_key, avg(CASE WHEN actual_value > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END)
        AS nonzero_ratio FROM dense GROUP BY 1) WHERE nonzero_ratio > 0.1""",
        "nonzero_ratio",
    )
    c.add(
        "E19_recent_keys",
        lambda t: ks.recent_keys(t.raw, "2001-06-01"),
        "SELECT count(DISTINCT material_key) AS key_count FROM raw_lines WHERE file_date >= DATE '2001-06-01'",
    )
    c.add(
        "E20_key_stats",
        lambda t: ks.key_stats(t.material_daily),
        """SELECT material_key, count(actual_value) AS "count", sum(actual_value) AS total_value,
        avg(actual_value) AS mean_value, stddev_samp(actual_value) AS std_value FROM md GROUP BY 1""",
        "total_value mean_value std_value",
    )
    c.add(
        "E21_threshold_sweep",
        lambda t: ks.threshold_sweep(t.store_daily, "2001-01-01"),
        sweep(_counts(IN_TEST, "sd"), list(ks.TEST_THRESHOLDS)),
        "key_pct",
    )
    c.add(
        "E22_test_bounds",
        _order_bounds,
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS train_end,
        CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS test_start,
        CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS test_end,
        CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) AS test_end_6 FROM orders""",
    )
