"""A: sources and sinks, each as a write and read back over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgrid.operators import features as ft
from demandgrid.operators import metrics as mt
from demandgrid.operators import models as md
from demandgrid.operators import prepare as pp
from demandgrid.plans.catalog import Catalog
from demandgrid.plans.driver_tables import TRAIN_END, DriverTables
from demandgrid.schema import BUSINESS, HOUSEHOLD, KEY, PREDICTED, SEGMENT, VALUE
from demandgrid.session import scratch_path
from demandgrid.sources import readers as rd
from demandgrid.sources import writers as wr

PREDICTION_SCHEMA = "material_key long, date date, actual double, predicted double, usage_type string"
SUMMARY_SCHEMA = (
    "material_key long, predict_year_month string, usage_type string, actual_value_count long, "
    "actual_value_mean double, predict_value_mean double, error_value_mean double"
)


def _csv_read(t: DriverTables) -> DataFrame:
    path = wr.write_csv(t.predictions, scratch_path(t.spark, "predictions-csv"))
    return rd.read_csv(t.spark, path, PREDICTION_SCHEMA)


def _fallback(t: DriverTables) -> DataFrame:
    root = scratch_path(t.spark, "segments")
    table = t.store_daily.join(t.store_segment, KEY)
    pp.segment(table, BUSINESS).withColumn("container_f", F.lit(1)).drop(SEGMENT).write.parquet(f"{root}/business")
    pp.segment(table, HOUSEHOLD).drop(SEGMENT).write.parquet(f"{root}/household")
    return rd.read_features(
        t.spark, f"{root}/whole", {BUSINESS: f"{root}/business", HOUSEHOLD: f"{root}/household"}
    )


def _versioned(t: DriverTables) -> DataFrame:
    root = scratch_path(t.spark, "versioned")
    wr.write_versioned(t.store_daily.withColumn(VALUE, F.lit(-1.0)), root, "store_daily", "20001201_000000")
    paths = wr.write_versioned(t.store_daily, root, "store_daily", "20010101_000000")
    version, latest = rd.read_demand(t.spark, paths["version"]), rd.read_latest(t.spark, root, "store_daily")
    return version.withColumn("copy", F.lit("version")).unionByName(latest.withColumn("copy", F.lit("latest")))


def _csv_sink(t: DriverTables) -> DataFrame:
    summary = mt.material_summary(t.predictions)
    return rd.read_csv(t.spark, wr.write_csv(summary, scratch_path(t.spark, "summary-csv")), SUMMARY_SCHEMA)


def _json_sink(t: DriverTables) -> DataFrame:
    path = wr.write_metrics_json(mt.evaluation(t.predictions, "a"), scratch_path(t.spark, "metrics-json"))
    return rd.read_metrics_json(t.spark, path)


def _features_sink(t: DriverTables) -> DataFrame:
    path = wr.write_features(t.store_dense_segment, scratch_path(t.spark, "features"))
    return rd.read_demand(t.spark, path)


def _newest_version(t: DriverTables) -> DataFrame:
    root = scratch_path(t.spark, "snapshots")
    base = f"{root}/daily/versions"
    t.store_daily.withColumn(VALUE, F.lit(-1.0)).write.parquet(f"{base}/run_ts=20010101_000000")
    t.store_daily.write.parquet(f"{base}/run_ts=20010201_000000")
    return rd.read_latest(t.spark, root, "daily")


def _model_round_trip(t: DriverTables) -> DataFrame:
    """Predictions of a model before it is saved and after it is loaded."""
    table = ft.forecast_table(t.store_dense_segment, "by_usage_type", TRAIN_END)
    fit = md.fit_predict(table, TRAIN_END, 1)
    root = scratch_path(t.spark, "models")
    wr.save_model(fit.model, root, "all")
    rows = md.model_input(table.filter(F.col(VALUE) > 0), fit.features)
    for name, model in (("before", fit.model), ("after", wr.load_model(root, "all"))):
        rows = model.transform(rows).withColumnRenamed(PREDICTED, name).drop("features")
    same = F.col("before").isNotNull() & (F.col("before") == F.col("after"))
    return rows.select(KEY, "file_date", F.col("label").alias("actual"), same.alias("is_same"))


def _metrics_document(t: DriverTables) -> DataFrame:
    # One document: segments x metrics entries, a fixed small number.
    sections = (
        mt.evaluation(t.predictions, "a")
        .groupBy("segment")
        .agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
        .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("segment", "m")))).alias("value"))
    )
    path = scratch_path(t.spark, "metrics-document")
    sections.write.text(path)
    return rd.read_metrics_document(t.spark, path, "a", overall=("all",))


def register(c: Catalog) -> None:
    c.add(
        "A01_read_demand",
        lambda t: rd.read_demand(t.spark, f"{t.sf_dir}/lineitem.parquet", date="l_shipdate"),
        "SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem",
        doubles="l_quantity l_extendedprice l_discount l_tax",
    )
    c.add("A02_read_csv", _csv_read, "SELECT * FROM pred", doubles="actual predicted")
    c.add(
        "A03_read_features_fallback",
        _fallback,
        "SELECT sd.*, CASE WHEN usage_type = 'business' THEN 1 END AS container_f, usage_type "
        "FROM sd JOIN store_dim USING (material_key)",
        doubles="actual_value",
    )
    c.add(
        "A04_write_versioned",
        _versioned,
        "SELECT *, 'version' AS copy FROM sd UNION ALL SELECT *, 'latest' AS copy FROM sd",
        doubles="actual_value",
    )
    c.add(
        "A05_write_csv",
        _csv_sink,
        "SELECT * FROM summary",
        doubles="actual_value_mean predict_value_mean error_value_mean",
    )
    c.add("A06_write_metrics_json", _json_sink, "SELECT * FROM runs WHERE run = 'a'", doubles="value")
    c.add("A07_write_features", _features_sink, "SELECT * FROM densu", doubles="actual_value")
    c.add("A08_read_latest", _newest_version, "SELECT * FROM sd", doubles="actual_value")
    c.add(
        "A09_save_model",
        _model_round_trip,
        "SELECT material_key, file_date, actual_value AS actual, true AS is_same FROM densu WHERE actual_value > 0",
        doubles="actual",
    )
    c.add("A10_read_metrics_json", _metrics_document, "SELECT * FROM runs WHERE run = 'a'", doubles="value")
