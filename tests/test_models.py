import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.operators import features as ft
from demandgrid.operators import models as md
from demandgrid.operators.search import Range, minimise
from demandgrid.session import concurrently
from demandgrid.sources import readers as rd
from demandgrid.sources import writers as wr

SMALL = {"maxIter": 2, "maxDepth": 2}


def month(key, m, values, *more):
    return [(key, f"2024-{m:02d}-{i + 1:02d}", float(v), *more) for i, v in enumerate(values)]


@pytest.fixture
def table(series):
    rows = []
    for key, segment in (("A", "business"), ("B", "business"), ("C", "household")):
        for m in range(1, 5):
            rows += month(key, m, [(i * 3 + m + ord(key)) % 7 for i in range(28)], segment)
    return ft.feature_job(series(rows, "usage_type string"), "by_usage_type", "2024-02-29")


def test_hampel_replaces_a_spike(series):
    got = md.hampel(series(month("A", 1, [1, 2, 1, 90, 2, 1, 2, 3])), n=7)
    assert [r.actual_value for r in got.orderBy("file_date").collect()] == [1, 2, 1, 2, 2, 1, 2, 3]


def test_winsorize_clips_both_tails(series):
    got = md.winsorize(series(month("A", 1, [0, *[10] * 19, 100])), 0.05, 0.95)
    assert {r.actual_value for r in got.collect()} == {10.0}


def test_fit_predicts_only_positive_rows_of_the_test_month(table):
    fit = md.fit_predict(table, "2024-02-29", 1, clean=["winsorize", "hampel"], **SMALL)
    rows = fit.predictions.collect()
    assert rows and all(r.actual > 0 and r.date.month == 3 for r in rows)
    assert "actual_value" not in fit.features and not set(ft.LEAKING) & set(fit.features)
    names = [r.feature for r in fit.importance.collect()]
    assert names[: len(fit.features)] == fit.features and all(n.endswith(md.MISSING_FLAG) for n in names[len(fit.features) :])
    assert fit.by_key.count() == 3 and fit.metrics.first().n == len(rows)
    assert fit.params["maxIter"] == 2


def test_test_rows_do_not_change_the_model(table):
    from pyspark.sql import functions as F

    changed = table.withColumn(
        "actual_value", F.when(F.col("file_date") > "2024-02-29", F.col("actual_value") * 3).otherwise(F.col("actual_value"))
    )
    a, b = (md.fit_predict(t, "2024-02-29", 1, **SMALL).model.stages[-1].toDebugString for t in (table, changed))
    assert a.split("\n", 1)[1] == b.split("\n", 1)[1]


def build(grid, cutoff):
    return ft.forecast_table(grid, "all", cutoff)


def test_walk_forward_predicts_whole_months(series):
    days = [(f"2024-{m:02d}-{d:02d}", m, d) for m in range(1, 5) for d in range(1, (31, 29, 31, 30)[m - 1] + 1)]
    grid = series([("A", day, 1.0 + d % 5) for day, _, d in days])
    got = md.walk_forward(grid, "2024-01-31", 3, build, **SMALL).select("step", "date").collect()
    assert sorted((r.step, r.date.month, r.date.day) for r in got) == [(m - 1, m, d) for _, m, d in days if m > 1]


def demand(series, keys=12, months=10):
    """Weekly demand around a level of the key that rises from month to month."""
    rows = [
        (f"K{k:02d}", f"2024-{m:02d}-{d:02d}", float((3 + k) * m * (1 + (d + k) % 7 / 10)))
        for k in range(keys) for m in range(1, months + 1) for d in range(1, 29)
    ]
    return series(rows)


def test_features_of_a_month_use_no_value_of_it_or_later(series):
    grid = demand(series, 3, 6)
    cutoff = "2024-04-30"
    table = ft.forecast_table(grid, "all", cutoff)
    features = md.training_features(table)
    for first in ("2024-03-01", "2024-05-01"):
        changed = grid.withColumn("actual_value", F.when(F.col("file_date") >= first, F.rand(1)).otherwise(F.col("actual_value")))
        last = "2024-03-31" if first < cutoff else "2024-12-31"
        of_month = F.col("file_date").between(first, last)
        a, b = (
            sorted(map(str, t.filter(of_month).select("material_key", "file_date", *features).collect()))
            for t in (table, ft.forecast_table(changed, "all", cutoff))
        )
        assert a == b and len(a) > 50
    known = {}
    for name, rows in (("train", table.filter("file_date between '2024-02-01' and '2024-04-30'")), ("test", table.filter("file_date > '2024-04-30'"))):
        shares = [F.avg(F.col(f).isNull().cast("double")).alias(f) for f in ("lag_1_f", "rolling_mean_6_f", "cumulative_mean_2_f")]
        known[name] = rows.agg(*shares).first()
    assert all(abs(known["train"][f] - known["test"][f]) < 0.1 for f in ("lag_1_f", "rolling_mean_6_f", "cumulative_mean_2_f"))


def test_the_model_beats_the_mean_of_each_key(series):
    grid = demand(series)
    got = md.walk_forward(grid, "2024-08-31", 2, build)
    means = grid.filter("file_date <= '2024-08-31'").groupBy("material_key").agg(F.avg("actual_value").alias("mean"))
    both = got.join(means, "material_key").agg(
        F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2)).alias("model"),
        F.sqrt(F.avg((F.col("actual") - F.col("mean")) ** 2)).alias("mean"),
    ).first()
    assert both.model < both.mean


def test_intermittent_demand_survives_hampel(series):
    values = [0, 0, 5, 0, 0, 0, 7, 0, 0, 9, 0, 0, 0, 0]
    got = md.hampel(series(month("A", 1, values)), n=7)
    assert [r.actual_value for r in got.orderBy("file_date").collect()] == values


def test_every_segment_gets_a_model(series):
    rows = [r for k, s in (("A", "business"), ("B", "other"), ("C", None)) for m in (1, 2, 3) for r in month(k, m, range(1, 29), s)]
    table = ft.calendar_features(series(rows, "usage_type string"))
    predictions, fits = md.fit_by_segment(table, "2024-02-29", **SMALL)
    assert set(fits) == {"business", "other", None} and predictions.count() == 3 * 28
    with pytest.raises(ValueError, match="other"):
        md.fit_by_segment(table, "2024-02-29", ["business", None], **SMALL)


def test_a_linear_fit_is_least_squares(series):
    table = ft.calendar_features(series([r for m in (1, 2, 3) for r in month("A", m, [2 * d + 5 for d in range(28)])]))
    got = md.fit_predict(table, "2024-02-29", features=["day_of_month_f"], regressor="linear").predictions.collect()
    assert all(r.predicted == pytest.approx(r.actual) for r in got) and len(got) == 28


def test_missing_features_are_flagged(series):
    table = series(month("A", 1, [1, 2])).withColumn("x_f", F.when(F.col("actual_value") > 1, F.lit(-5e6)))
    rows = md.model_input(table, ["x_f"]).orderBy("label").collect()
    assert [(r.x_f, r.x_f_missing) for r in rows] == [(0.0, 1.0), (-5e6, 0.0)]


def test_nothing_stays_in_the_scratch_folder(spark, table):
    from demandgrid import session as ss

    md.fit_predict(table, "2024-02-29", 1, clean=["winsorize"], **SMALL).predictions.count()
    assert any("model-input" in n for n, _ in rd.listed(spark, ss.shared_dir(spark)))
    ss.release()
    assert not any("model-input" in n for n, _ in rd.listed(spark, ss.shared_dir(spark)))


def test_segments_tuning_and_saved_model(table, tmp_path):
    predictions, fits = md.fit_by_segment(table, "2024-02-29", ["business", "household"], **SMALL)
    assert {r.usage_type for r in predictions.select("usage_type").distinct().collect()} == {"business", "household"}
    ranked = md.importance(fits).collect()
    assert [r.usage_type for r in ranked] == sorted(r.usage_type for r in ranked)
    trials = md.tune(table, "2024-02-29", {"maxDepth": [1, 2], "maxIter": [1, 2]}, trials=2).collect()
    assert len({t.trial for t in trials}) == 2 and all(math.isfinite(t.rmse) for t in trials)
    fit = fits["business"]
    wr.save_model(fit.model, str(tmp_path), "business")
    loaded = wr.load_model(str(tmp_path), "business")
    rows = md.model_input(table.filter("file_date > '2024-02-29'"), fit.features)
    before, after = (sorted(r.predicted for r in m.transform(rows).collect()) for m in (fit.model, loaded))
    assert before == after


def test_baseline_forecast(series):
    flat = md.baseline_forecast(series(month("A", 1, [5] * 20)), 2, amplitude=0.0).orderBy("date").collect()
    assert [(str(r.date), r.predicted) for r in flat] == [("2024-01-21", 5.0), ("2024-01-22", 5.0)]
    rising = [("A", f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(i)) for i in range(60)]
    got = md.baseline_forecast(series(rising), 3, amplitude=0.0).orderBy("date").collect()
    assert [r.predicted for r in got] == pytest.approx([44.5, 45.5, 46.5])
    short = md.baseline_forecast(series(rising[:40]), 2, amplitude=0.0).orderBy("date").collect()
    assert [r.predicted for r in short] == pytest.approx([24.5, 24.5 + (24.5 - 14.5) / 30])
    falling = md.baseline_forecast(series(month("A", 1, [0] * 5)), 1, amplitude=-200.0).first()
    assert falling.predicted == 0.0


def test_prediction_scope(spark, predictions):
    table = predictions([("A", f"2025-01-0{d}", 1.0, float(d), "b") for d in range(1, 4)] + [("B", "2025-01-01", 1.0, 9.0, "b")])
    period = ("2025-01-01", "2025-01-02")
    got = {r.material_key: r.predicted for r in md.predict_scope(table, "future", "median", *period).collect()}
    assert got == {"A": 1.5, "B": 9.0}
    assert md.predict_scope(table, "single-date", start="2025-01-03").count() == 1
    keys = spark.createDataFrame([("B",)], "material_key string")
    assert md.predict_scope(table, "material-key", "sum", keys=keys).first().predicted == 9.0
    assert md.predict_scope(table, "material-key", keys=keys, start="2025-01-02").count() == 0
    assert md.predict_scope(table, "walk-forward", end="2025-01-01").count() == 2
    with pytest.raises(ValueError):
        md.predict_scope(table, "other")


def test_search_reaches_the_best_grid_point_in_fewer_trials():
    """A known surface with one valley; a grid of 9 x 9 points against 25 trials."""
    space = {"a": Range(0.0, 1.0), "b": Range(1e-3, 1.0, log=True)}

    def surface(a, b):
        return (a - 0.63) ** 2 + 0.05 * (np.log10(b) + 1.4) ** 2

    grid = min(surface(a, b) for a in np.linspace(0, 1, 9) for b in np.logspace(-3, 0, 9))
    for seed in range(5):
        done = minimise(lambda p, share: surface(p["a"], p["b"]) + (1 - share), space, 25, seed)
        assert len(done) == 25 and min(t.loss for t in done if t.share == 1.0) <= grid
        assert any(t.share < 1.0 for t in done)
    again = [minimise(lambda p, share: surface(p["a"], p["b"]), space, 8, 3) for _ in range(2)]
    assert again[0] == again[1]


def test_ranges_are_kept():
    assert [Range(2, 8, whole=True).at(u) for u in (0.0, 0.5, 1.0)] == [2, 5, 8]
    assert Range(0.01, 1.0, log=True).at(0.5) == pytest.approx(0.1)


def test_work_at_once(spark):
    """In order, together, and a failure is named."""
    begin = time.time()
    got = concurrently(spark, {i: lambda i=i: time.sleep(0.5) or spark.range(i).count() for i in range(8)}, 8)
    assert got == {i: i for i in range(8)} and list(got) == list(range(8))
    assert time.time() - begin < 3.0
    with pytest.raises(RuntimeError, match="'b' failed"):
        concurrently(spark, {"a": lambda: 1, "b": lambda: 1 / 0})
    assert concurrently(spark, {}) == {}


def test_a_walk_writes_each_row_once(series, monkeypatch):
    """Blocks: the first holds all up to its month, each later one its month."""
    written = []
    kept = md.materialise
    monkeypatch.setattr(md, "materialise", lambda df, name, by=(): written.append((name, df.count())) or kept(df, name, by))
    rows = [r for m in range(1, 5) for r in month("A", m, range(1, 29))]
    md.walk_forward(series(rows), "2024-01-31", 3, build, **SMALL)
    assert [n for name, n in written if name == "model-input-block"] == [2 * 28, 28, 28]


def test_a_failed_fit_names_its_segment(table, monkeypatch):
    kept = md._fit

    def fit(rows, *more):
        if rows.select("usage_type").first()[0] == "household":
            raise ValueError("no")
        return kept(rows, *more)

    monkeypatch.setattr(md, "_fit", fit)
    with pytest.raises(RuntimeError, match="'household' failed: no"):
        md.fit_by_segment(table, "2024-02-29", **SMALL)


def test_search_on_a_table(table):
    told = md.search(table, "2024-03-31", {"maxDepth": Range(1, 3, whole=True), "stepSize": Range(0.1, 0.5)}, trials=2, max_iter=4).collect()
    assert [r.trial for r in told] == [0, 1] and all(r.rmse > 0 and r.trees == 4 for r in told)


def test_error_beside_that_of_the_mean(series):
    rows = series([("A", "2024-01-01", 2.0), ("A", "2024-01-02", 4.0), ("A", "2024-02-01", 9.0), ("B", "2024-02-01", 1.0)])
    guess = rows.where("file_date > '2024-01-31'").selectExpr("material_key", "actual_value AS actual", "8.0 AS predicted")
    assert tuple(md.against_mean(rows, guess, "2024-01-31").first()) == (1, 1.0, 6.0)


def test_first_trials_of_a_search_are_fitted_once(table, monkeypatch):
    """Their early losses come from the first trees of the whole model."""
    made, kept = [], md._fit
    monkeypatch.setattr(md, "_fit", lambda *a, **k: made.append(a[5]["maxIter"]) or kept(*a, **k))
    md.search(table, "2024-03-31", {"maxDepth": Range(1, 3, whole=True), "stepSize": Range(0.1, 0.5)}, trials=2, max_iter=4).collect()
    assert made == [4, 4]


@pytest.mark.parametrize("rate", [1.0, 0.6])
def test_first_trees_are_those_of_a_shorter_fit(table, rate):
    features = md.training_features(table)
    rows = md.training_table(table, features, "2024-02-29", "2024-03-31")
    period, params = ("2024-03-01", "2024-03-31"), {"maxDepth": 2, "subsamplingRate": rate}
    few, many = (md._fit(rows, "2024-02-29", period, features, (), {**params, "maxIter": n}) for n in (1, 4))
    due = rows.filter("file_date > '2024-02-29' AND label > 0")
    assert md._rmse_of_first(many.model, due, 1) == pytest.approx(few.metrics.first()["rmse"])
    assert md._rmse_of_first(many.model, due, 4) == pytest.approx(many.metrics.first()["rmse"])


def test_written_vectors_give_the_same_model(table):
    features = md.training_features(table)
    rows = md.training_table(table, features, "2024-02-29", "2024-03-31")
    vectors = md.training_vectors(rows, "2024-02-29", features)
    period = ("2024-03-01", "2024-03-31")
    one, other = (md._fit(rows, "2024-02-29", period, features, (), {"maxIter": 2, "maxDepth": 2}, vectors=v) for v in (None, vectors))
    assert one.model.stages[-1].toDebugString.split("\n")[1:] == other.model.stages[-1].toDebugString.split("\n")[1:]


@pytest.mark.parametrize("allowed, most", [(10**9, 4), (1, 1)])
def test_trials_at_once_are_bounded_by_rows(table, monkeypatch, allowed, most):
    asked, kept = [], md.concurrently
    monkeypatch.setattr(md, "ROWS_AT_ONCE", allowed)
    monkeypatch.setattr(md, "concurrently", lambda spark, work, n=4: asked.append(n) or kept(spark, work, n))
    assert md.tune(table, "2024-02-29", {"maxDepth": [1, 2], "maxIter": [1]}).count() == 2
    assert asked == [most]


def test_flags_that_repeat_are_left_out(spark, monkeypatch):
    """Constant ones, and those equal to an earlier flag on every row; also beyond the flags of one mask."""
    names = [f"{n}_missing" for n in "abcdef"]
    rows = spark.createDataFrame([(5.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0), (5.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0)], ["x", *names])
    inputs = ["x", *names]
    assert md.tree_inputs(rows, inputs) == ["x", "a_missing", "e_missing"]
    monkeypatch.setattr(md, "FLAGS_AT_ONCE", 3)
    assert md.tree_inputs(rows, inputs) == ["x", "a_missing", "d_missing", "e_missing"]
    assert md.tree_inputs(rows.limit(0), inputs) == inputs and md.tree_inputs(rows, ["x"]) == ["x"]


def test_trees_without_repeated_flags_are_the_same(table):
    features = md.training_features(table)
    rows = md.training_table(table, features, "2024-02-29", "2024-03-31")
    inputs, period = md.model_inputs(rows, features), ("2024-03-01", "2024-03-31")
    fit = md._fit(rows, "2024-02-29", period, features, (), {"maxIter": 4, "maxDepth": 4})
    assert len(fit.model.stages[0].getInputCols()) < len(inputs)
    whole = md._assembled(inputs, maxIter=4, maxDepth=4).fit(rows.filter("file_date <= '2024-02-29'"))
    told = {r.feature: r.importance for r in fit.importance.collect()}
    assert list(told) == inputs and list(told.values()) == list(whole.stages[-1].featureImportances.toArray())
    due = rows.filter("file_date > '2024-02-29' AND label > 0").orderBy("material_key", "file_date")
    one, other = ([r.predicted for r in m.transform(due).collect()] for m in (fit.model, whole))
    assert one == other and len(one) > 0


@pytest.mark.parametrize("allowed, most", [(10**9, 4), (1, 1)])
def test_segments_at_once_are_bounded_by_rows(table, monkeypatch, allowed, most):
    asked, kept = [], md.concurrently
    monkeypatch.setattr(md, "ROWS_AT_ONCE", allowed)
    monkeypatch.setattr(md, "concurrently", lambda spark, work, n=4: asked.append(n) or kept(spark, work, n))
    predictions, fits = md.fit_by_segment(table, "2024-02-29", **SMALL)
    assert set(fits) == {"business", "household"} and predictions.count() > 0
    assert asked == [most]
