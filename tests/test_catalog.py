import math

from pyspark.sql import functions as F

from demandgrid.plans import catalog


def test_rounding_equals_that_of_decimals(spark):
    """Also of halves, negative, huge and missing values."""
    values = [0.0, -0.0, 1 / 128, -1 / 128, 0.1234565, 2.5e-7, -4e-7, 1e-300, 123456.7891234, 8.5e9 + 1 / 64, 1e17, -1e300, math.inf, -math.inf, math.nan, None]
    values += [(-1) ** i * i * math.pi for i in range(1, 2000)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").repartition(3)
    got = table.select("i", "x", F.round(F.col("x") + catalog.NUDGE, catalog.DIGITS).alias("want")).join(catalog._rounded(table).withColumnRenamed("x", "got"), "i")
    assert got.count() == len(values)
    assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    assert {math.copysign(1, r.got) for r in got.filter("got = 0").collect()} == {1.0}


def test_few_values_become_decimals(spark):
    """A decimal number per value took most of the time of wide results."""
    plan = catalog._rounded(spark.range(3).select((F.col("id") / 7).alias("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "rint(" in plan and "CASE WHEN" in plan
