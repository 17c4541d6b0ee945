import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from demandgrid.operators import keys as ks
from demandgrid.operators import ranking as rk

TRAIN_END = "2024-12-31"


def days(key, month, n, value=1.0):
    return [(key, f"{month}-{i + 1:02d}", value) for i in range(n)]


@pytest.fixture
def demand(series):
    """Train counts A 5, B 5, C 2, D 0; test counts B 4, E 6."""
    rows = (
        days("A", "2024-11", 5)
        + days("B", "2024-11", 5)
        + days("C", "2024-11", 2)
        + days("D", "2024-11", 3, 0.0)
        + days("B", "2025-01", 4)
        + days("E", "2025-01", 6)
    )
    return series(rows)


def names(df):
    return sorted({r.material_key for r in df.collect()})


def test_ties_go_to_the_smaller_key_and_zero_counts_are_not_ranked(demand):
    assert names(ks.top_active(demand, 1, TRAIN_END)) == ["A"]
    assert names(ks.top_active(demand, 10, TRAIN_END)) == ["A", "B", "C"]
    detail = ks.top_detail(demand.filter("file_date <= '2024-12-31'"), 1).first()
    assert detail.coverage_pct == pytest.approx(100 * 5 / 12)


def test_selection_is_the_union_of_top_and_test_active(demand):
    preset = ks.Preset(2, 4)
    kept = ks.select_keys(demand, TRAIN_END, 1, preset)
    assert names(kept) == ["A", "B", "E"]
    assert kept.count() == 5 + 9 + 6
    rows, targets = ks.select_products(demand, TRAIN_END, 1, preset)
    assert names(rows) == ["A", "B", "E"] and names(targets) == ["B", "E"]
    assert names(ks.active_in_test(demand, 6, "2025-01-01")) == ["E"]


def test_selection_per_segment(series):
    rows = [(*r, "business") for r in days("A", "2024-11", 5) + days("B", "2024-11", 4)]
    rows += [(*r, "household") for r in days("C", "2024-11", 3) + days("D", "2025-01", 2) + days("E", "2024-11", 1)]
    table = series(rows, "usage_type string")
    presets = {"business": ks.Preset(1, 2), "household": ks.Preset(1, 2)}
    assert names(ks.select_keys_by_segment(table, TRAIN_END, 1, presets)) == ["A", "C", "D"]


def test_threshold_selection_and_statistics(demand):
    period = ("2024-01-01", TRAIN_END)
    assert names(ks.select_threshold(demand, 5, TRAIN_END, period)) == ["A", "B", "E"]
    stats = {r.material_key: r for r in ks.threshold_stats(demand, 5, TRAIN_END, period).collect()}
    assert (stats["B"].actual_value_count, stats["B"].test_count, stats["B"].is_over_threshold) == (5, 4, 1)
    marked = {r.material_key: r for r in ks.attach_key_stats(demand, ks.threshold_stats(demand, 5, TRAIN_END, period)).collect()}
    assert (marked["D"].is_over_threshold, marked["D"].actual_value_count) == (0, 0)


def test_volume_selection(series):
    table = series(days("A", "2024-11", 1, 100.0) + days("B", "2024-11", 5) + days("C", "2025-01", 3))
    assert names(ks.select_by_volume(table, 1, TRAIN_END, 3)) == ["A", "C"]


def test_set_overlap(spark):
    a, b = (spark.createDataFrame([(k,) for k in s], "material_key string") for s in ("ab", "bc"))
    got = {r.material_key: r.side for r in ks.set_overlap(a, b).collect()}
    assert got == {"a": "only_a", "b": "both", "c": "only_b"}


def test_coverage_rows_and_delta(demand):
    got = {r.n: r for r in ks.coverage(demand, "active", [1, 2, 4, 99]).collect()}
    assert sorted(got) == [1, 2, 4]
    assert got[1].top_total == 9 and got[4].coverage_pct == 100.0
    delta = ks.coverage_delta(demand, 1, 2, ("2025-01-01", "2025-01-31"), 4).first()
    assert (delta.total_n1, delta.total_n2, delta.tested_n1, delta.tested_n2, delta.tested_added) == (9, 15, 1, 2, 1)


def test_rank_overlap(series):
    table = series(days("A", "2024-11", 1, 100.0) + days("B", "2024-11", 5) + days("C", "2024-11", 4))
    got = ks.rank_overlap(table, 2).first()
    assert (got.overlap, got.only_active, got.only_volume, got.overlap_pct) == (1, 1, 1, 50.0)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("ABCDEFG"), st.integers(1, 9), min_size=1))
def test_coverage_is_monotone_and_selection_holds_the_top(series, counts):
    table = series([r for k, n in counts.items() for r in days(k, "2024-11", n)])
    cover = [r.coverage_pct for r in ks.coverage(table, "active", [1, 2, 3, 4, 5, 6, 7]).orderBy("n").collect()]
    assert cover == sorted(cover) and cover[-1] == pytest.approx(100.0)
    top = set(names(ks.top_active(table, 3, TRAIN_END)))
    assert top <= set(names(ks.select_keys(table, TRAIN_END, 1, ks.Preset(3, 1))))


def test_distributions(demand):
    counts = ks.active_counts(demand)
    assert {r.threshold: r.key_count for r in ks.threshold_counts(counts, [1, 5, 9, 50]).collect()} == {
        1: 4,
        5: 3,
        9: 1,
        50: 0,
    }
    stats = ks.count_stats(counts).first()
    assert (stats.key_count, stats.max, stats.min, stats.median) == (4, 9, 2, 5.5)
    assert names(ks.nonzero_ratio(demand, 0.1)) == ["A", "B", "C", "E"]
    assert ks.recent_keys(demand, "2025-01-01").first().key_count == 2


def test_top_per_group_limits_before_the_shuffle(demand):
    plan = rk.top_per_group(demand, 2, "actual_value", "material_key", ["file_date"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4


def test_other_segments_get_the_general_preset(series):
    from demandgrid.schema import ALL

    presets = {"business": ks.Preset(1, 5), ALL: ks.Preset(2, 5)}
    rows = [(f"{s or 'none'}{k}", f"2024-01-{d:02d}", 1.0, s) for s in ("business", "other", None) for k in range(3) for d in range(1, 4 + k)]
    got = ks.select_keys_by_segment(series(rows, "usage_type string"), "2024-01-31", presets=presets)
    assert {r.material_key for r in got.collect()} == {"business2", "other1", "other2", "none1", "none2"}
