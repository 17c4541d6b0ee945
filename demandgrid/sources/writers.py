"""Sinks. Every write is distributed; nothing is collected."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from demandgrid.schema import KEY, SEGMENT
from demandgrid.sources.readers import LATEST


def write_versioned(df: DataFrame, root: str, name: str, run_ts: str) -> dict[str, str]:
    """Writes ``versions/run_ts=…`` and then points ``latest`` at it.

    ``latest`` is a small file with the run's name, put in place by one rename when the version
    is complete, so a reader finds the old version or the new one, never half of either.
    """
    base = f"{root.rstrip('/')}/{name}"
    version = f"{base}/versions/run_ts={run_ts}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(version)
    publish_text(df.sparkSession, f"{base}/{LATEST}", run_ts)
    return {"version": version, "latest": f"{base}/{LATEST}"}


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole, on the file system that owns the path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(draft), files.makeQualified(place), options)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_metrics_json(metrics: DataFrame, path: str) -> str:
    """One JSON object per row of the long metrics table."""
    metrics.write.mode("overwrite").json(path)
    return path


def write_features(df: DataFrame, path: str, buckets: int | None = None, key: str = KEY, segment: str = SEGMENT) -> str:
    """Feature table split by segment.

    Rebalancing on the segment and the key keeps files even: AQE splits a hot key
    and merges small ones, so no batch loop over keys is needed.
    """
    spread = df.hint("rebalance", F.col(segment), F.col(key)) if buckets is None else df.repartition(buckets, key)
    spread.write.mode("overwrite").partitionBy(segment).option("compression", "snappy").parquet(path)
    return path


def save_model(model: PipelineModel, root: str, segment: str) -> str:
    path = f"{root.rstrip('/')}/segment={segment}"
    model.write().overwrite().save(path)
    return path


def load_model(root: str, segment: str) -> PipelineModel:
    return PipelineModel.load(f"{root.rstrip('/')}/segment={segment}")
