import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from demandgrid.functions import quantiles as qt

FIXTURE_OK = [HealthCheck.function_scoped_fixture]


@settings(max_examples=8, deadline=None, suppress_health_check=FIXTURE_OK)
@given(
    st.lists(
        st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False, allow_subnormal=False)),
        min_size=1,
        max_size=40,
    ),
    st.lists(st.sampled_from([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]), min_size=1, max_size=3, unique=True),
)
def test_equals_linear_interpolation(spark, values, probs):
    table = spark.createDataFrame([(v,) for v in values], "x double")
    got = qt.quantile_columns(table, "x", {f"q{i}": p for i, p in enumerate(probs)}).first()
    assert list(got) == pytest.approx([float(np.quantile(values, p)) for p in probs], rel=1e-9, abs=1e-9)


def test_hot_group_and_overall(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(0, 100, 3000).tolist()
    rows = [("hot", v) for v in hot] + [("b", float(i)) for i in range(10)] + [("c", None)]
    table = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in qt.quantile_columns(table, "x", {"m": 0.5, "p9": 0.9}, ["g"], overall_of="g").collect()}
    everything = hot + [float(i) for i in range(10)]
    assert got["hot"].m == pytest.approx(np.median(hot))
    assert got["b"].p9 == pytest.approx(8.1)
    assert got["all"].p9 == pytest.approx(np.quantile(everything, 0.9))
    assert "c" not in got


def test_many_equal_values(spark):
    table = spark.createDataFrame([(7.0,)] * 99 + [(9.0,)], "x double")
    got = qt.quantile_columns(table, "x", {"a": 0.5, "b": 0.99, "c": 1.0}).first()
    assert (got.a, got.b, got.c) == (7.0, pytest.approx(7.02), 9.0)


@pytest.mark.parametrize("margin", [0.0, 0.2])
def test_brackets_that_miss_their_rank(spark, monkeypatch, margin):
    """Sketches of eight values: some brackets are wrong, which the counts must notice."""
    monkeypatch.setattr(qt, "_SKETCH", 8)
    monkeypatch.setattr(qt, "_MARGIN", margin)
    rng = np.random.default_rng(5)
    groups = {g: rng.normal(0, 10, n).round(r).tolist() for g, n, r in (("a", 20, 1), ("b", 57, 0), ("c", 200, 2), ("d", 7, 1))}
    table = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    ps = {"q0": 0.0, "q1": 0.05, "q2": 0.25, "q3": 0.5, "q4": 0.95, "q5": 1.0}
    got = {r.g: [r[n] for n in ps] for r in qt.quantile_columns(table, "x", ps, ["g"]).collect()}
    assert {g: pytest.approx(list(np.quantile(v, list(ps.values()))), rel=1e-9, abs=1e-9) for g, v in groups.items()} == got


def test_empty(spark):
    table = spark.createDataFrame([], "x double")
    assert qt.quantile_columns(table, "x", {"m": 0.5}).first().m is None


def test_few_rows_are_shuffled(spark):
    """Values without repetition: only those near a wanted rank leave their task."""
    table = spark.range(200_000).selectExpr("cast(id % 3 AS string) AS g", "ln(id + 1) * 7.3 AS x")
    got = qt.quantile_columns(table, "x", {"q": 0.5}, ["g"])
    kept = [f for f in got.inputFiles() if "quantile-values" in f]
    assert spark.read.parquet(*kept).count() < 2000 and got.count() == 3


def test_values_close_together_are_split(spark):
    """A million distinct values within 1e-5 of 1: one coarse bin, sorted in many parts."""
    table = spark.range(1_000_000).selectExpr("1 + id * 1e-11 AS x")
    codes = table.select(qt._code(F.col("x")).alias("c"))
    parts = codes.agg(F.countDistinct(F.shiftright("c", qt._COARSE)), F.countDistinct(F.shiftright("c", qt._FINE))).first()
    assert parts[0] == 1 and parts[1] > 500
    assert qt.quantile_columns(table, "x", {"m": 0.5}).first().m == pytest.approx(1 + 499_999.5e-11, abs=1e-15)


@settings(max_examples=30, deadline=None, suppress_health_check=FIXTURE_OK)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=60))
def test_codes_keep_the_order(spark, values):
    edges = [2.0**k * (1 - e) for k in (-3, 0, 50) for e in (0, 2**-53, 2**-52)]
    rows = spark.createDataFrame([(float(v),) for v in values + edges], "x double").select("x", qt._code(F.col("x")).alias("c"))
    codes = [r.c for r in sorted(rows.collect(), key=lambda r: r.x)]
    assert codes == sorted(codes) and None not in codes


def test_columns_of_a_wide_table_equal_the_general_way(spark, monkeypatch):
    """Ties, NULL, NaN, infinities and a column without values; also where a bracket misses its rank."""
    wide = spark.range(30_000, numPartitions=5).selectExpr(
        "cast(id % 7919 AS double) AS a",
        "IF(id % 5 = 0, id * 0.37D, 0.0D) AS b",
        "IF(id % 3 = 0, NULL, -id / 7) AS c",
        "CASE WHEN id % 4 = 0 THEN double('NaN') WHEN id % 97 = 1 THEN -double('inf') WHEN id % 89 = 2 THEN double('inf') ELSE id * 1.5 END AS d",
        "cast(NULL AS double) AS e",
    )
    ps = {"lo": 0.01, "m": 0.5, "hi": 0.7}
    long = wide.unpivot([], wide.columns, "feature", "_x")
    for margin in (qt._MARGIN, -0.01):
        monkeypatch.setattr(qt, "_MARGIN", margin)
        want = {r.feature: tuple(r) for r in qt.quantile_columns(long, "_x", ps, ["feature"]).collect()}
        got = {r.feature: tuple(r) for r in qt.quantiles_by_column(wide, ps).collect()}
        assert got == want and set(got) == set("abcd")


def test_values_of_a_wide_table_are_not_shuffled(spark):
    """A batch leaves a row per region, and one per distinct value inside a bracket."""
    wide = spark.range(40_000, numPartitions=4).selectExpr("cast(id AS double) AS a")
    brackets = spark.createDataFrame([("a", 19_990.0, 20_010.0)], "feature string, _lo0 double, _hi0 double")
    counts = {(r._region, r._v): r._n for r in qt._counted_by_column(wide, brackets, "feature", 1).collect()}
    assert counts == {(0, None): 19_990, (2, None): 19_989} | {(1, float(v)): 1 for v in range(19_990, 20_011)}
