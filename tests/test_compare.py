import numpy as np
import pandas as pd
import pytest

from demandgrid.operators import compare as cp
from demandgrid.operators import diagnostics as dg
from demandgrid.schema import METRICS_SCHEMA


@pytest.fixture
def metrics(spark):
    def build(*rows):
        return spark.createDataFrame([(r, "all", m, float(v)) for r, m, v in rows], METRICS_SCHEMA)

    return build


def test_improvement_follows_the_direction(metrics):
    table = metrics(
        ("a", "rmse", 10), ("b", "rmse", 8), ("a", "r2", -2), ("b", "r2", -1), ("a", "mae", 0), ("b", "mae", 1),
        ("a", "mape_pct", 1000), ("b", "mape_pct", 1000.5), ("a", "n", 5), ("b", "n", 6),
    )
    cmp = cp.compare_runs(table, "a", "b")
    got = {r.metric: (r.improvement_pct, r.verdict) for r in cp.verdict(cmp).collect()}
    assert got["rmse"] == (20.0, "improved")
    assert got["r2"] == (50.0, "improved")
    assert got["mae"] == (None, "no_change")
    assert got["mape_pct"][1] == "no_change"
    assert "n" not in got
    overall = cp.overall_verdict(cmp).first()
    assert (overall.improved, overall.worsened, overall.overall) == (2, 1, "improved")


@pytest.mark.parametrize(
    "rmse, mae, within, want",
    [(8, 8, 10, "much_better"), (9.9, 9.9, 0, "better"), (10.1, 10.1, 0, "similar"), (12, 12, 0, "worse")],
)
def test_score_bands(metrics, rmse, mae, within, want):
    table = metrics(
        ("a", "rmse", 10), ("b", "rmse", rmse), ("a", "mae", 10), ("b", "mae", mae),
        ("a", "within_20_record_pct", 50), ("b", "within_20_record_pct", 50 + within),
    )
    cmp = cp.compare_runs(table, "a", "b")
    assert cp.score(cmp).first().judgement == want
    assert cp.within_change(cmp).first().change_points == within


@pytest.mark.parametrize(
    "rmse, mae, keys, accuracy, advice",
    [
        (4, 5, 70, "high_better", "high_strong"),
        (16, 14, 70, "low_better", "low_strong"),
        (10.5, 9, 40, "mixed", "high"),
        (10.5, 9, 90, "mixed", "depends"),
    ],
)
def test_threshold_recommendation(metrics, rmse, mae, keys, accuracy, advice):
    table = metrics(
        ("l", "rmse", 10), ("l", "mae", 10), ("l", "r2", 0), ("l", "key_count", 100),
        ("h", "rmse", rmse), ("h", "mae", mae), ("h", "r2", 0), ("h", "key_count", keys),
    )
    got = cp.recommend_threshold(table, "l", "h").first()
    assert (got.accuracy, got.recommendation) == (accuracy, advice)


def test_best_run(metrics):
    table = metrics(("b", "error_rate_mean", 0.2), ("a", "error_rate_mean", 0.2), ("c", "error_rate_mean", 0.3))
    assert cp.best_run(table).first().run == "a"


def test_top_volume(predictions):
    rows = [(k, "2025-01-01", v, v + 3, s) for k, v, s in (("A", 1.0, "x"), ("B", 5.0, "x"), ("C", 2.0, "y"))]
    got = cp.top_volume_rmse(predictions(rows), 1).collect()
    assert sorted((r.usage_type, r.material_key, r.rmse) for r in got) == [("x", "B", 3.0), ("y", "C", 3.0)]


def test_profile_equals_pandas(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"a": rng.exponential(2, 60), "b": rng.normal(size=60), "c": np.r_[np.zeros(59), 1.0]})
    frame.loc[3, "b"] = None
    table = spark.createDataFrame(frame).replace(float("nan"), None)
    got = {r.feature: r for r in dg.profile_columns(table).collect()}
    for c in frame:
        want = frame[c]
        assert got[c]["skew"] == pytest.approx(want.skew())
        assert got[c].kurtosis == pytest.approx(want.kurtosis())
        assert got[c]["median"] == pytest.approx(want.median())
        assert got[c].missing_rate == pytest.approx(want.isna().mean())
        assert got[c].zero_rate == pytest.approx((want == 0).mean())
    flags = {(r.feature, r.flag) for r in dg.profile_flags(dg.profile_columns(table)).collect()}
    assert {("c", "high_skew"), ("c", "high_kurtosis"), ("c", "high_zero_rate")} <= flags


def test_correlated_pairs_use_rows_with_both_values(spark):
    rows = [(float(i), float(2 * i) if i % 3 else None, float(i % 2), 1.0) for i in range(20)]
    table = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = dg.correlated_pairs(table).collect()
    assert [(r.feature_a, r.feature_b) for r in got] == [("a", "b")]
    assert got[0].r == pytest.approx(1.0)
    assert [r.feature for r in dg.low_variance(table).collect()] == ["k"]
    assert [r.feature for r in dg.high_missing(table).collect()] == ["b"]
