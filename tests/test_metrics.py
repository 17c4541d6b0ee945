import numpy as np
import pytest

from demandgrid.operators import bias as bs
from demandgrid.operators import metrics as mt

HITS = {5: (15.0, 18.0), 12: (8.0, 25.0), 19: (42.0, 38.0), 26: (10.0, 22.0)}


@pytest.fixture
def january(predictions):
    """One key over 31 days; all other days have actual 0 and predicted 2."""
    rows = []
    for day in range(1, 32):
        actual, predicted = HITS.get(day, (0.0, 2.0))
        rows.append(("K", f"2025-01-{day:02d}", actual, predicted, "business"))
    return predictions(rows)


def test_unit_error_rates(january):
    got = mt.key_unit_error(january).first()
    assert got.Error_Rate_5 == pytest.approx(6.451613, abs=1e-6)
    assert got.Error_Rate_10 == pytest.approx(6.451613, abs=1e-6)
    assert (got.Error_Rate_20, got.Error_Rate_30, got.Error_Rate_50) == (0, 0, 0)


def test_error_definitions_differ(january):
    rates = mt.key_error_rate(january)
    row = rates.first()
    assert (row.n_records, row.error_rate_mean) == (4, pytest.approx(0.905060, abs=1e-6))
    everything = mt.rmse_mae(january).first()
    assert (everything.mae, everything.rmse) == pytest.approx((2.903226, 4.272946), abs=1e-6)
    positive = mt.positive_metrics(january).first()
    assert (positive.mae_positive, positive.rmse_positive) == pytest.approx((9.0, 10.700467), abs=1e-6)
    record = mt.within_record(january).first()
    assert (record.n_positive, record.within_20_record_pct) == (4, 50.0)
    assert mt.within_units_keys(mt.key_unit_error(january)).first().within_20_units_keys == 1
    assert mt.within_rate(rates).first().within_20_percent == 0


def test_within_rate_is_monotone_and_inclusive(predictions):
    table = predictions([(f"k{i}", "2025-01-01", 10.0, 10.0 + i, "business") for i in range(12)])
    got = mt.within_rate(mt.key_error_rate(table)).first()
    counts = [got[f"within_{x}_percent"] for x in mt.RATE_LIMITS]
    assert counts == [3, 4, 6, 11]


def test_zero_actuals_have_no_rate(predictions):
    table = predictions([("A", "2025-01-01", 0.0, 5.0, "business"), ("B", "2025-01-01", 0.0, 0.0, "business")])
    assert mt.key_error_rate(table).count() == 0
    assert mt.mape_pct(table).first()[0] == 0.0
    assert mt.positive_metrics(table).first().mape == 0.0
    assert mt.key_detail(table).count() == 0
    assert [mt.r2(table, z).first().r2 for z in ("zero", "sentinel", "epsilon")] == [0.0, -999.0, 0.0]


def test_mape_cap(predictions):
    table = predictions([("A", "2025-01-01", 1.0, 101.0, "b"), ("A", "2025-01-02", 10.0, 10.0, "b")])
    assert mt.mape_capped(table).first()[0] == 500.0
    assert mt.mape_pct(table).first()[0] == 5000.0


def test_both_layouts_become_one(spark):
    table = spark.createDataFrame(
        [("A", 1.0, 2.0, "train"), ("A", 3.0, 4.0, "test")],
        "material_key string, actual_value double, predicted_value double, data_type string",
    )
    got = mt.canonical(table)
    assert [(r.actual, r.predicted) for r in got.collect()] == [(3.0, 4.0)]
    assert mt.canonical(table, test_only=False).count() == 2


def test_segments_and_overall(predictions):
    table = predictions(
        [("A", "2025-01-01", 10.0, 12.0, "business"), ("B", "2025-01-01", 10.0, 10.0, "household")]
    )
    got = {r.usage_type: r.mae for r in mt.metrics_by_segment(table).collect()}
    assert got == {"business": 2.0, "household": 0.0, "all": 1.0}
    long = {(r.segment, r.metric): r.value for r in mt.evaluation(table, "x").collect()}
    assert long[("all", "key_count")] == 2 and long[("all", "error_rate_median")] == pytest.approx(0.1)
    parts = {s: table.filter(f"usage_type = '{s}'").drop("usage_type") for s in ("business", "household")}
    assert sorted(map(str, mt.combine(parts).select(*table.columns).collect())) == sorted(map(str, table.collect()))


def test_material_summary_rounds_half_to_even(predictions, series):
    table = predictions(
        [("A", "2025-01-01", 0.0, 0.125, "business"), ("B", "2025-01-01", 2.0, 0.375, "business")]
    )
    summary = mt.material_summary(table)
    got = {r.material_key: r for r in summary.collect()}
    assert (got["A"].predict_value_mean, got["B"].predict_value_mean) == (0.12, 0.38)
    assert (got["A"].actual_value_count, got["A"].error_value_mean) == (0, None)
    train = series([("A", "2024-12-30", 3.0), ("A", "2025-01-05", 3.0)])
    rich = {r.material_key: r for r in mt.enrich_summary(summary, train, table, "2024-12-31").collect()}
    assert rich["A"].actual_value_count_in_train_period == 1
    assert rich["B"].actual_value_count_in_train_period == 0
    assert rich["B"].actual_value_count_in_predict_period == 1
    fallback = mt.enrich_fallback(mt.enrich_summary(summary, train, table, "2024-12-31"))
    assert {r.material_key: r.actual_value_count_in_train_period for r in fallback.collect()} == {"A": 0, "B": 12}
    ordered = mt.order_columns(fallback)
    assert ordered.columns == list(mt.SUMMARY_COLUMNS)


def test_export_totals_without_counts(spark):
    table = spark.createDataFrame([("A", 2.0)], "material_key string, Mean_Actual double")
    got = mt.export_totals(table).first()
    assert (got.actual_sum, got.predicted_sum, got.RMSE) == (62.0, 0.0, 0.0)


def test_rank_ties(predictions):
    table = predictions([(k, "2025-01-01", 10.0, 11.0, "b") for k in "BAC"])
    got = mt.rank_keys(mt.key_unit_error(table), "RMSE", 2).collect()
    assert [(r.end, r["rank"], r.material_key) for r in got] == [
        ("best", 1, "A"),
        ("best", 2, "B"),
        ("worst", 1, "A"),
        ("worst", 2, "B"),
    ]


def test_grades(spark):
    table = spark.createDataFrame([(9.9,), (10.0,), (29.9,), (30.0,)], "m double")
    got = [r.g for r in table.select(mt.grade("m").alias("g")).collect()]
    assert got == ["excellent", "good", "acceptable", "needs_work"]


def test_scale_bands(spark):
    table = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (500.0,), (600.0,), (None,)], "actual double")
    got = [r.b for r in table.select(bs.scale_band().alias("b")).collect()]
    assert got == [None, "0-10", "10-50", "100-500", "500+", None]


def test_bias(predictions):
    table = predictions(
        [
            ("A", "2025-01-06", 10.0, 30.0, "b"),
            ("A", "2025-01-07", 0.0, 1.0, "b"),
            ("B", "2025-01-06", 10.0, 5.0, "b"),
            ("C", "2025-01-06", 10.0, 10.0, "b"),
        ]
    )
    ratio = bs.prediction_ratio(table).first()
    assert (ratio.ratio_mean, ratio.ratio_count, ratio.ratio_median) == (1.5, 3, 1.0)
    direction = bs.direction_counts(table).first()
    assert (direction.over, direction.under, direction.exact, direction.over_pct) == (2, 1, 1, 50.0)
    ranked = [(r["list"], r.material_key) for r in bs.bias_rank(bs.bias_by_key(table), 1).collect()]
    assert ranked == [("overpredicted", "A"), ("accurate", "C")]
    assert {r.weekday for r in bs.bias_by_weekday(table).collect()} == {0, 1}
    assert {str(r.date): r.overprediction_rate for r in bs.bias_by_day(table).collect()} == {
        "2025-01-06": 1.5,
        "2025-01-07": None,
    }
    rules = {r.rule: r.applies for r in bs.bias_rules(table).collect()}
    assert rules == {"mean_ratio": 1, "band_spread": 0, "keys_over_2": 1}
    high = bs.high_overprediction(table, 1.5).first()
    assert (high.key_count, high.mean_actual, high.median_actual) == (1, 5.0, 5.0)
    assert bs.test_rows(table, 2024).count() == 0


def test_histogram_counts_every_kept_record(predictions):
    table = predictions([("A", f"2025-01-{d:02d}", 10.0, 10.0 + d, "b") for d in range(1, 29)])
    got = bs.error_histogram(table).collect()
    assert sum(r.n for r in got if r.measure == "abs_error") == 26
    assert sum(r.n for r in got if r.measure == "prediction_ratio") == 28
    assert max(r.bin for r in got) == 49


def test_evaluation_covers_every_row_and_counts_a_key_once(predictions):
    rows = [
        ("A", "2024-01-01", 10.0, 10.0, "business"),
        ("A", "2024-01-02", 10.0, 5.0, "household"),
        ("B", "2024-01-01", 10.0, 12.5, "household"),
        ("C", "2024-01-01", 4.0, 104.0, None),
        (None, "2024-01-01", 2.0, 3.0, "business"),
    ]
    got = {(r.segment, r.metric): r.value for r in mt.evaluation(predictions(rows), "a").collect()}
    whole = mt.rmse_mae(predictions(rows)).first()
    assert got["all", "n"] == whole.n == 5 and got["all", "rmse"] == pytest.approx(whole.rmse)
    assert got["all", "key_count"] == 3
    assert got["all", "error_rate_mean"] == pytest.approx((0.25 + 0.25 + 25) / 3)
    assert got["all", "error_rate_median"] == pytest.approx(0.25)
    assert (got["business", "key_count"], got["household", "key_count"], got["business", "n"]) == (1, 2, 2)
    assert got["household", "error_rate_mean"] == pytest.approx(0.375)
    assert got["all", "within_5_units_pct"] == pytest.approx(80.0)
    assert {s for s, _ in got} == {"all", "business", "household"}
    by = {r.usage_type: r.n for r in mt.metrics_by_segment(predictions(rows)).collect()}
    assert by == {"all": 5, "business": 2, "household": 2}


def test_a_large_mean_costs_no_digits(predictions):
    rows = [(k, f"2024-01-{d:02d}", 1e9 + d + i, 1e9 + d * (1 + i), s) for i, (k, s) in enumerate((("A", "x"), ("B", "y"), ("C", "x"))) for d in range(1, 20)]
    a, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    got = {r.usage_type: r.correlation for r in mt.metrics_by_segment(predictions(rows)).collect()}
    assert got["all"] == pytest.approx(np.corrcoef(a, p)[0, 1], rel=1e-6)
