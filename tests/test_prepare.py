import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from demandgrid.operators import prepare as pp
from demandgrid.operators import keys as ks
from demandgrid.sources.readers import normalise

DENSE = [("A", "2024-01-01", 1.0), ("A", "2024-01-04", 2.0), ("B", "2024-01-02", 3.0)]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_global_grid_has_every_key_on_every_day(series):
    grid = pp.fill_zero_global(series(DENSE))
    assert grid.count() == 8
    assert {(r.material_key, r.file_date.day): r.actual_value for r in grid.collect() if r.actual_value} == {
        ("A", 1): 1.0,
        ("A", 4): 2.0,
        ("B", 2): 3.0,
    }


def test_per_key_grid_stays_within_the_key(series):
    assert pp.fill_zero_per_key(series(DENSE)).count() == 5


def test_grid_keeps_repeated_days_and_null_values_as_zero(series):
    grid = pp.fill_zero_global(
        series([("A", "2024-01-01", 1.0), ("A", "2024-01-01", 2.0), ("A", "2024-01-03", None)])
    )
    assert sorted((r.file_date.day, r.actual_value) for r in grid.collect()) == [(1, 1.0), (1, 2.0), (2, 0.0), (3, 0.0)]


def test_grid_partitions_do_not_change_the_result(series):
    table = series(DENSE)
    assert rows(pp.fill_zero_global(table, partitions=7), "material_key", "file_date") == rows(
        pp.fill_zero_global(table), "material_key", "file_date"
    )


def test_carried_attribute_equals_filled_attribute(series):
    table = series([(*r, r[0].lower()) for r in DENSE], "tag string")
    carried = pp.fill_zero_global(table, carry=["tag"])
    filled = pp.fill_attributes(pp.fill_zero_global(table), ["tag"])
    order = ("material_key", "file_date")
    assert rows(carried, *order) == rows(filled, *order)


def test_attributes_fill_forward_then_backward(series):
    tags = [None, "x", None, "y", None]
    table = series([("A", f"2024-01-0{i + 1}", 0.0, t) for i, t in enumerate(tags)], "tag string")
    assert [r.tag for r in pp.fill_attributes(table, ["tag"]).orderBy("file_date").collect()] == list("xxxyy")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from("ABC"), st.integers(0, 30)), min_size=1, max_size=20))
def test_grid_size_is_keys_times_days(series, points):
    start = dt.date(2024, 1, 1)
    table = series([(k, (start + dt.timedelta(days=n)).isoformat(), 1.0) for k, n in points])
    days = {n for _, n in points}
    keys = {k for k, _ in points}
    grid = pp.fill_zero_global(table)
    assert grid.count() == len(keys) * (max(days) - min(days) + 1)
    assert grid.agg(F.sum("actual_value")).first()[0] == len(points)


def test_aggregate_level_drops_null_keys_and_sums_nan_as_zero(series):
    table = series([("A", "2024-01-01", float("nan")), (None, "2024-01-01", 5.0), ("B", "2024-01-01", 2.0)])
    got = pp.aggregate_level(normalise(table), "material_key")
    assert rows(got, "material_key") == [("A", dt.date(2024, 1, 1), 0.0), ("B", dt.date(2024, 1, 1), 2.0)]


def test_nan_is_not_greater_than_zero_after_reading(series):
    table = normalise(series([("A", "2024-01-01", float("nan")), ("A", "2024-01-02", 1.0)]))
    assert rows(ks.active_counts(table), "material_key") == [("A", 1)]


def test_usage_type_by_prefix(spark):
    table = spark.createDataFrame([("A1",), ("B1",), (None,)], "store_code string")
    assert [r.usage_type for r in pp.add_usage_type(table, "store_code").collect()] == [
        "household",
        "business",
        "business",
    ]


def test_missing_columns_raise(series):
    with pytest.raises(ValueError, match="store_code"):
        pp.require_columns(series(DENSE), ["store_code", "file_date"])


def test_first_attribute_skips_null_and_follows_order(series):
    table = series(
        [("A", "2024-01-03", 1.0, "late"), ("A", "2024-01-01", 1.0, None), ("A", "2024-01-02", 1.0, "first")],
        "tag string",
    )
    assert pp.first_attr(table, ["material_key"], ["tag"], ["file_date"]).first().tag == "first"


def test_drop_matching_and_narrow_floats(series):
    table = series([(*DENSE[0], "c", 1.0)], "category_lvl1 string, category_lvl1_mean_f double")
    kept = pp.drop_matching(table)
    assert kept.columns == ["material_key", "file_date", "actual_value"]
    assert dict(pp.narrow_floats(kept).dtypes)["actual_value"] == "float"


def test_date_filters_reach_the_scan(spark, series, tmp_path):
    series(DENSE).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = pp.since(pp.crop_years(table, 2024, 2024), "2024-01-02").select("file_date")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(file_date,2024-01-01)" in text
    assert "ReadSchema: struct<file_date:date>" in text
    assert plan.count() == 2


def test_summaries(series):
    table = series(DENSE + [("B", "2025-01-01", 0.0)])
    summary = pp.prep_summary(table).first()
    assert (summary.row_count, summary.key_count, summary.zero_pct) == (4, 2, 25.0)
    assert summary.mean_daily_value == 1.5
    assert rows(pp.year_stats(table), "year") == [(2024, 2, 6.0, 2.0), (2025, 1, 0.0, 0.0)]
    assert pp.top_share(table, 1).first().top_pct == 50.0
    cut = pp.reduction(table, table.filter("material_key = 'A'")).first()
    assert (cut.rows_before, cut.rows_after, cut.keys_after, cut.reduction_pct) == (4, 2, 1, 50.0)


def test_a_grid_of_segment_and_key(series):
    table = series([("A", "2024-01-01", 1.0, "x"), ("A", "2024-01-03", 2.0, "y"), ("A", "2024-01-04", 3.0, "x")], "usage_type string")
    got = pp.fill_zero_per_key(table, ["usage_type", "material_key"]).collect()
    assert sorted((r.usage_type, r.file_date.day, r.actual_value) for r in got) == [("x", 1, 1.0), ("x", 2, 0.0), ("x", 3, 0.0), ("x", 4, 3.0), ("y", 3, 2.0)]
