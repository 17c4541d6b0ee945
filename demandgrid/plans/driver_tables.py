"""The star-schema tables expressed in the demand data model.

material_key = part, store_code = supplier, product_key = brand, file_date = ship
date, actual_value = quantity, usage_type from the first letter of the supplier's
region.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandgrid.operators import features as ft
from demandgrid.operators import metrics as mt
from demandgrid.operators import prepare as pp
from demandgrid.schema import ACTUAL, DATE, KEY, PRED_DATE, PREDICTED, SEGMENT, STORE, VALUE
from demandgrid.session import spread
from demandgrid.sources.readers import normalise

TRAIN_END = "2000-12-31"
# Fixed-date holidays (month, day) used to exercise the holiday join.
HOLIDAYS = ((1, 1), (2, 11), (4, 29), (5, 3), (5, 4), (5, 5), (11, 3), (11, 23))


@dataclass(frozen=True)
class DriverTables:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """One row per order line."""
        return normalise(
            self.read("lineitem").select(
                F.col("l_orderkey").alias("order_key"),
                F.col("l_linenumber").alias("line_number"),
                F.col("l_partkey").alias(KEY),
                F.col("l_suppkey").alias(STORE),
                F.col("l_shipdate").alias(DATE),
                F.col("l_quantity").alias(VALUE),
            )
        )

    @cached_property
    def stores(self) -> DataFrame:
        """Store and its segment."""
        nation = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        supplier = self.read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return pp.add_usage_type(supplier, "r_name").select(F.col("s_suppkey").alias(STORE), SEGMENT)

    @cached_property
    def material_store_daily(self) -> DataFrame:
        """Material x store x day with the store's segment."""
        # Nearly every line is a group of its own.
        daily = spread(self.raw, KEY, STORE, DATE).groupBy(KEY, STORE, DATE).agg(F.sum(VALUE).alias(VALUE))
        return daily.join(self.stores, STORE)

    @cached_property
    def material_daily(self) -> DataFrame:
        return pp.aggregate_level(self.raw, KEY)

    @cached_property
    def store_daily(self) -> DataFrame:
        """Sparse store-day table; the store is the key."""
        return pp.aggregate_level(self.raw, STORE).drop(STORE)

    @cached_property
    def store_segment(self) -> DataFrame:
        return self.stores.withColumnRenamed(STORE, KEY)

    @cached_property
    def store_dense(self) -> DataFrame:
        return pp.fill_zero_global(self.store_daily, dates=self.raw)

    @cached_property
    def store_dense_segment(self) -> DataFrame:
        """Dense table with the segment, joined before the grid is filled."""
        sparse = self.store_daily.join(self.store_segment, KEY)
        return pp.fill_zero_global(sparse, carry=[SEGMENT], dates=self.raw)

    @cached_property
    def product_lines(self) -> DataFrame:
        brand = self.read("part").select(F.col("p_partkey").alias(KEY), F.col("p_brand").alias("product_key"))
        return self.raw.join(brand, KEY)

    @cached_property
    def product_daily(self) -> DataFrame:
        return pp.aggregate_level(self.product_lines, "product_key")

    @cached_property
    def product_dense(self) -> DataFrame:
        return pp.fill_zero_global(self.product_daily.drop("product_key"), dates=self.raw)

    @cached_property
    def holidays(self) -> DataFrame:
        """In every year of the order lines."""
        dates = self.raw.agg(F.year(F.min(DATE)).alias("first"), F.year(F.max(DATE)).alias("last"))
        days = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in HOLIDAYS]))
        years = dates.select(F.explode(F.sequence("first", "last")).alias("y"))
        years = years.select("y", days.alias("md"))
        return years.select(F.make_date("y", "md.m", "md.d").alias("holiday"))

    @cached_property
    def predictions(self) -> DataFrame:
        """Run ``a``: the dense store table with a known miss per store and day.

        Values are multiples of 1/64, so sums are exact in any order.
        """
        k, day = F.col(KEY), F.dayofmonth(DATE)
        by_store = ((k * 7) % 13 - 6) / F.lit(10.0)
        by_day = (day % 5 - 2) / F.lit(50.0)
        guess = F.col(VALUE) * (F.lit(1.0) + by_store + by_day) + ((k + day) % 4) * F.lit(0.25)
        return self.store_dense_segment.select(
            KEY,
            F.col(DATE).alias(PRED_DATE),
            F.col(VALUE).alias(ACTUAL),
            (F.floor(guess * 64.0 + 0.5) / F.lit(64.0)).alias(PREDICTED),
            SEGMENT,
        )

    @cached_property
    def predictions_b(self) -> DataFrame:
        """Run ``b``: the mean of the 28 days before, on the same rows."""
        rolled = ft.rolling(self.store_dense_segment, "mean", [28])
        guess = F.coalesce(F.col("rolling_mean_28_f"), F.lit(0.0))
        return rolled.select(
            KEY,
            F.col(DATE).alias(PRED_DATE),
            F.col(VALUE).alias(ACTUAL),
            (F.floor(guess * 64.0 + 0.5) / F.lit(64.0)).alias(PREDICTED),
            SEGMENT,
        )

    @cached_property
    def material_predictions(self) -> DataFrame:
        """Material x store x day, run ``a``: a material belongs to the segments of all its stores."""
        miss = ((F.col(KEY) * 7 + F.col(STORE)) % 13 - 6) / F.lit(10.0)
        guess = F.floor(F.col(VALUE) * (F.lit(1.0) + miss) * 64.0 + 0.5) / F.lit(64.0)
        columns = F.col(DATE).alias(PRED_DATE), F.col(VALUE).alias(ACTUAL), guess.alias(PREDICTED)
        return self.material_store_daily.select(KEY, *columns, SEGMENT)

    @cached_property
    def material_runs(self) -> DataFrame:
        """Long metrics of run ``a`` of the materials and of a run half as far off."""
        nearer = F.floor((F.col(ACTUAL) + F.col(PREDICTED)) * 32.0 + 0.5) / F.lit(64.0)
        b = self.material_predictions.withColumn(PREDICTED, nearer)
        return mt.evaluation(self.material_predictions, "a").unionByName(mt.evaluation(b, "b"))

    @cached_property
    def runs(self) -> DataFrame:
        """Long metrics of both runs."""
        return mt.evaluation(self.predictions, "a").unionByName(mt.evaluation(self.predictions_b, "b"))

    @cached_property
    def feature_table(self) -> DataFrame:
        """Product feature set on the dense store table."""
        return ft.feature_job(self.store_dense, "product", TRAIN_END, self.holidays)
