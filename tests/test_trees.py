import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from demandgrid.operators import models as md
from demandgrid.operators import trees as tr

NAMES = {"labelCol": "label", "featuresCol": "features", "predictionCol": "predicted", "seed": 42}
INPUTS = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def rows(spark):
    """Fewer rows than bin limits are drawn from: values of a month, of a day, rare ones, and a constant. No two cuts of the rows gain the same."""
    rng, n = np.random.default_rng(5), 3000
    month = np.arange(n) // 30
    level, trend = rng.normal(10, 3, month.max() + 1).round(1)[month], rng.gamma(2, 2, month.max() + 1).round(2)[month]
    columns = [level, trend, np.arange(n) % 7, np.arange(n) % 30, rng.random(n) < 0.05, np.ones(n), rng.normal(size=n), month % 12]
    label = (level * 2 + (np.arange(n) % 7 == 3) * 5 + trend * (month % 12 > 5) + rng.normal(0, 3, n))
    table = np.column_stack([*columns, label]).astype(float).tolist()
    return spark.createDataFrame(table, [*INPUTS, "label"]).coalesce(2).cache()


def vectors(rows):
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(rows)


def predicted(model, rows):
    return np.array([r.predicted for r in model.transform(vectors(rows)).select("predicted").collect()])


@pytest.mark.parametrize("params", [{"maxIter": 3, "maxDepth": 5}, {"maxIter": 2, "maxDepth": 8, "minInstancesPerNode": 3}, {"maxIter": 1, "maxDepth": 0}])
def test_the_trees_are_those_of_spark(rows, params):
    own, theirs = tr.HistogramTrees(**NAMES, **params).fit_table(rows, INPUTS), GBTRegressor(**NAMES, **params).fit(vectors(rows))
    assert np.abs(predicted(own, rows) - predicted(theirs, rows)).max() < 1e-9
    assert own.getNumTrees == theirs.getNumTrees and own.treeWeights == theirs.treeWeights
    assert own.getMaxIter() == params["maxIter"] and own.numFeatures == len(INPUTS)
    a, b = (m._java_obj.trees()[0].rootNode() for m in (own, theirs))
    assert a.impurity() == pytest.approx(b.impurity()) and a.impurityStats().rawCount() == b.impurityStats().rawCount()
    assert a.getClass() == b.getClass() and a.prediction() == pytest.approx(b.prediction())
    # Below, features that cut a node's rows alike differ by rounding alone.
    if params["maxDepth"]:
        assert a.split().featureIndex() == b.split().featureIndex() and a.split().threshold() == b.split().threshold()
        assert a.gain() == pytest.approx(b.gain())


def test_vectors_and_columns_give_one_model(rows):
    trees = tr.HistogramTrees(**NAMES, maxIter=2, maxDepth=3)
    assert (predicted(trees.fit(vectors(rows)), rows) == predicted(trees.fit_table(rows, INPUTS), rows)).all()


@pytest.mark.parametrize("name, value", [("TASK_BYTES", 1), ("DRIVER_BYTES", 0), ("TREES_BACK", 2), ("CHANGES", -1.0), ("BLOCK_ROWS", 100), ("WALKED", 2)])
def test_how_rows_are_kept_and_counted_changes_no_tree(rows, monkeypatch, name, value):
    trees = tr.HistogramTrees(**NAMES, maxIter=3, maxDepth=4)
    before = predicted(trees.fit_table(rows, INPUTS), rows)
    monkeypatch.setattr(tr, name, value)
    assert np.abs(predicted(trees.fit_table(rows, INPUTS), rows) - before).max() < 1e-9


def test_features_of_a_month_are_kept_by_run(rows):
    binned = tr.HistogramTrees(**NAMES).binned(rows, INPUTS)
    layout, blocks = binned.layout, binned.codes.collect()
    assert {f for f in range(len(INPUTS)) if layout.column[f] >= layout.by_row and len(layout.limits[f])} == {0, 1, 4, 7}
    assert sum(len(b[3]) for b in blocks) < 3000 / 5 and sum(int(b[3].sum()) for b in blocks) == 3000
    binned.release()


def test_part_of_the_rows_per_tree(rows):
    """Another part for each tree, and the same one again in the same fit."""
    trees = tr.HistogramTrees(**NAMES, maxIter=2, maxDepth=2, subsamplingRate=0.5)
    one, again = (trees.fit_table(rows, INPUTS) for _ in range(2))
    assert (predicted(one, rows) == predicted(again, rows)).all()
    counts = [t.rootNode().impurityStats().rawCount() for t in one._java_obj.trees()]
    assert all(1300 < n < 1700 for n in counts) and counts[0] != counts[1]


def test_missing_inputs_are_an_error(rows):
    with pytest.raises(Exception, match="missing or NaN"):
        tr.HistogramTrees(**NAMES, maxIter=1).fit_table(rows.withColumn("x0", F.lit(float("nan"))), INPUTS)


def test_weighted_fits_are_left_to_spark(rows):
    weighted = rows.withColumn("w", F.lit(2.0))
    model = tr.HistogramTrees(**NAMES, maxIter=1, maxDepth=2, weightCol="w").fit_table(weighted, INPUTS)
    assert model._java_obj.trees()[0].rootNode().impurityStats().count() == 6000.0


def test_trials_share_their_binned_rows(series, monkeypatch):
    made, kept = [], tr.Binned.__init__
    monkeypatch.setattr(tr.Binned, "__init__", lambda self, *a: made.append(1) or kept(self, *a))
    days = [("A", f"2024-{m:02d}-{d:02d}", float(d * m % 11)) for m in range(1, 5) for d in range(1, 29)]
    table = series(days).withColumns({"dom_f": F.dayofmonth("file_date"), "month_f": F.month("file_date")})
    assert md.tune(table, "2024-04-28", {"maxDepth": [1, 2], "maxIter": [1]}).count() == 2
    assert len(made) == 1
