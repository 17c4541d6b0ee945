import random

import pytest
from pyspark.sql import functions as F

from demandgrid.operators import features as ft
from demandgrid.operators import prepare as pp

FIVE = [("A", f"2024-01-0{i + 1}", v) for i, v in enumerate([10.0, 0.0, 0.0, 5.0, 20.0])]


def column(df, name):
    return [r[name] for r in df.orderBy("material_key", "file_date").collect()]


@pytest.mark.parametrize(
    "name, build, want",
    [
        ("lag_1_f", lambda d: ft.lags(d, [1]), [None, 10, 0, 0, 5]),
        ("rolling_mean_2_f", lambda d: ft.rolling(d, "mean", [2]), [None, 10, 5, 0, 2.5]),
        ("rolling_std_2_f", lambda d: ft.rolling(d, "std", [2]), [None, None, 7.071068, 0, 3.535534]),
        ("rolling_max_2_f", lambda d: ft.rolling(d, "max", [2]), [None, 10, 10, 0, 5]),
        ("rolling_min_2_f", lambda d: ft.rolling(d, "min", [2]), [None, 10, 0, 0, 0]),
        ("trend_2d_f", lambda d: ft.trend(d, [2]), [None, None, -0.909091, 5, 20]),
        ("change_rate_f", ft.change_rate, [None, None, -1, None, None]),
    ],
)
def test_window_columns(series, name, build, want):
    got = column(build(series(FIVE)), name)
    assert got == pytest.approx(want, abs=1e-6) if None not in want else [
        g if g is None else round(g, 6) for g in got
    ] == want


def test_windows_do_not_depend_on_row_order_or_partitions(series):
    rows = [(k, f"2024-01-{d:02d}", float((d * 7 + ord(k)) % 11)) for k in "ABC" for d in range(1, 29)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    a, b = ft.series_features(series(rows)), ft.series_features(series(shuffled).repartition(5))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_rolling_bounds(series):
    rows = [("A", f"2024-01-{d:02d}", float(d * 13 % 17)) for d in range(1, 29)]
    table = series(rows)
    for stat in ("mean", "min", "max"):
        table = ft.rolling(table, stat, [7])
    bad = table.filter(
        (F.col("rolling_min_7_f") > F.col("rolling_mean_7_f")) | (F.col("rolling_mean_7_f") > F.col("rolling_max_7_f"))
    )
    assert bad.count() == 0


def test_series_features_use_one_exchange_after_the_grid(series):
    grid = pp.fill_zero_global(series(FIVE))
    job = ft.dow_mean(ft.key_profile(ft.series_features(grid)))
    plan = job._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(material_key") == 1


def test_weekday_mean(series):
    mondays = [("A", "2024-01-01", 1.0), ("A", "2024-01-08", 3.0), ("A", "2024-01-15", 5.0), ("A", "2024-01-06", 9.0)]
    got = {r.file_date.day: r.material_dow_mean_f for r in ft.dow_mean(series(mondays)).collect()}
    assert got == {1: None, 8: 1.0, 15: 2.0, 6: None}


@pytest.mark.parametrize("rows_per_cut", [50_000, 3, 1])
def test_entity_weekday_mean_equals_one_window_over_all_rows(series, monkeypatch, rows_per_cut):
    """Also where a store's day is cut into buckets."""
    monkeypatch.setattr(ft, "ROWS_PER_CUT", rows_per_cut)
    rows = [
        (f"m{m}", f"2024-01-{d:02d}", float((m * d) % 7), f"s{(m + d) % 2}") for m in range(6) for d in range(1, 22)
    ]
    table = series(rows, "store_code string")
    got = {(r.material_key, r.file_date): r.store_code_dow_mean_f for r in ft.entity_dow_mean(table).collect()}
    data = [(r.material_key, r.file_date, r.actual_value, r.store_code) for r in table.collect()]
    for k, d, _, s in data:
        before = [
            v
            for k2, d2, v, s2 in data
            if s2 == s and d2.weekday() == d.weekday() and (d2, k2) < (d, k)
        ]
        want = sum(before) / len(before) if before and d.weekday() < 5 else None
        assert got[(k, d)] == (pytest.approx(want) if want is not None else None)


def test_a_store_day_of_most_rows_is_divided(spark, series, monkeypatch):
    """One store and day holds nearly all rows; no window does."""
    monkeypatch.setattr(ft, "ROWS_PER_CUT", 200)
    hot = spark.range(20_000).selectExpr("lpad(id, 6, '0') AS material_key", "date'2024-01-08' AS file_date", "cast(id % 7 AS double) AS actual_value", "'s' AS store_code")
    table = hot.unionByName(series([("a", "2024-01-01", 10.0, "s")], "store_code string").select(*hot.columns))
    got = ft.entity_dow_mean(table)
    rows = {r.material_key: r.store_code_dow_mean_f for r in got.collect()}
    total = 10.0
    for i in range(20_000):
        assert rows[f"{i:06d}"] == pytest.approx(total / (i + 1))
        total += i % 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan


def test_entity_weekday_mean_skips_a_missing_entity(series):
    table = series(FIVE)
    assert ft.entity_dow_mean(table, "store_code").columns == table.columns


def test_key_profile_can_be_limited_to_train(series):
    every = ft.key_profile(series(FIVE)).first()
    train = ft.key_profile(series(FIVE), "2024-01-02").first()
    assert (every.product_mean_f, every.product_median_f, every.product_max_f) == (7.0, 5.0, 20.0)
    assert (train.product_mean_f, train.product_median_f, train.product_max_f) == (5.0, 5.0, 10.0)


def test_no_feature_sees_values_after_train_end(series):
    changed = [r if r[1] <= "2024-01-03" else (r[0], r[1], r[2] + 100) for r in FIVE]
    jobs = [
        ft.feature_job(series(r), "all", "2024-01-03").drop("actual_value").orderBy("file_date").collect()
        for r in (FIVE, changed)
    ]
    assert jobs[0] == jobs[1]


def test_split_and_null_date(series):
    table = ft.label_split(series(FIVE + [("A", None, 1.0)]), "2024-01-02")
    sizes = {r.data_type: (r.row_count, round(r.pct, 2)) for r in ft.split_sizes(table).collect()}
    assert sizes == {"train": (2, 33.33), "test": (4, 66.67)}


def test_config_and_feature_names(series):
    table = ft.features_from_config(series(FIVE), {"material_key": {"lag": [1], "rolling_mean": [2]}})
    assert ft.feature_columns(table) == ["lag_1_f", "rolling_mean_2_f"]
    assert ft.feature_columns(table, block=["actual_value"]) == ["lag_1_f", "rolling_mean_2_f"]
    rates = {r.feature: r.null_rate for r in ft.null_rates(table).collect()}
    assert rates == pytest.approx({"lag_1_f": 0.2, "rolling_mean_2_f": 0.2})


def test_describe(series):
    got = ft.describe_features(series(FIVE).withColumnRenamed("actual_value", "v_f")).first()
    assert (got["count"], got["mean"], got.q25, got.q50, got.q75) == (5, 7.0, 0.0, 5.0, 10.0)


def test_unknown_mode(series):
    with pytest.raises(ValueError, match="mode"):
        ft.feature_job(series(FIVE), "other", "2024-01-01")


def test_a_forecast_table_sorts_its_rows_once_for_months_and_once_for_days(series):
    grid = series([("A", "2024-01-01", 1.0), ("B", "2024-01-02", 2.0)])
    plan = ft.forecast_table(grid, "all", "2024-01-31")._jdf.queryExecution().executedPlan().toString()
    last = plan.split("== Initial Plan ==")[-1]
    assert last.count("Sort [") == 2


def test_a_month_keeps_the_missing_values_of_its_first_row(series):
    days = [("A", f"2024-{m:02d}-0{d}", v) for m, d, v in ((1, 1, None), (1, 2, 4.0), (2, 1, 5.0), (2, 2, 6.0), (4, 1, 7.0), (4, 2, 8.0))]
    table = series([*days, ("A", None, 3.0), ("B", "2024-02-02", 9.0)]).withColumn("x_f", F.col("actual_value"))
    got = ft.known_at_month_start(table, ["x_f"], "2024-03-31").filter("file_date IS NOT NULL").orderBy("material_key", "file_date")
    assert [r.x_f for r in got.collect()] == [None, None, 5.0, 5.0, 7.0, 7.0, 9.0]
