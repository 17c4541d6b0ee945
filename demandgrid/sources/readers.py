"""Readers that return the data model's tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from demandgrid.functions.numeric import nan_to_null
from demandgrid.schema import DATE, METRICS_SCHEMA, SEGMENT

LATEST = "latest"


def read_demand(spark: SparkSession, *paths: str, date: str = DATE) -> DataFrame:
    """Parquet table with ``date`` as DATE and NaN as NULL."""
    return normalise(spark.read.parquet(*paths), date)


def normalise(df: DataFrame, date: str = DATE) -> DataFrame:
    if date in df.columns and not isinstance(df.schema[date].dataType, T.DateType):
        df = df.withColumn(date, F.to_date(date))
    return nan_to_null(df)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header under a declared schema; no inference pass."""
    return nan_to_null(spark.read.csv(path, header=True, schema=schema))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that owns the path, so any scheme works."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def read_features(
    spark: SparkSession,
    whole: str | None = None,
    by_segment: Mapping[str, str] | None = None,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """First source that exists: whole table, union of segment tables, fallback plan.

    Segment tables may differ in columns; missing ones are NULL, and each row
    carries its segment.
    """
    if whole and path_exists(spark, whole):
        return read_demand(spark, whole)
    parts = [
        read_demand(spark, path).withColumn(SEGMENT, F.lit(name))
        for name, path in (by_segment or {}).items()
        if path_exists(spark, path)
    ]
    if parts:
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part, allowMissingColumns=True)
        return table
    if fallback is None:
        raise FileNotFoundError(f"no feature table at {whole} or {dict(by_segment or {})}")
    return fallback


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version that ``latest`` names, else the newest complete one; only that one is read.

    A version is complete once its ``_SUCCESS`` file stands.
    """
    base = f"{root.rstrip('/')}/{name}"
    if path_exists(spark, f"{base}/{LATEST}"):
        run = spark.read.text(f"{base}/{LATEST}").first()[0]
        return read_demand(spark, f"{base}/versions/run_ts={run}")
    runs = [n for n, _ in listed(spark, f"{base}/versions") if n.startswith("run_ts=")]
    complete = [r for r in runs if path_exists(spark, f"{base}/versions/{r}/_SUCCESS")]
    if not complete:
        raise FileNotFoundError(f"no complete version under {base}/versions")
    return read_demand(spark, f"{base}/versions/{max(complete)}")


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and modification time of what a folder holds, from the file system alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return [(f.getPath().getName(), f.getModificationTime()) for f in found]


def read_newest_file(spark: SparkSession, path: str, name_contains: str = "") -> DataFrame:
    """Rows of the most recently modified file of a folder whose name holds the given text; only that file is read."""
    files = [(at, n) for n, at in listed(spark, path) if name_contains in n and not n.startswith(("_", "."))]
    if not files:
        raise FileNotFoundError(f"no file with {name_contains!r} in its name under {path}")
    return read_demand(spark, f"{path.rstrip('/')}/{max(files)[1]}")


def read_metrics_json(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Long metrics table as written by ``write_metrics_json``; ``run`` renames it."""
    lines = spark.read.schema(METRICS_SCHEMA).json(path)
    return lines if run is None else lines.withColumn("run", F.lit(run))


def read_metrics_document(spark: SparkSession, path: str, run: str, overall: Sequence[str] = ("overall",)) -> DataFrame:
    """Nested ``{section: {metric: value}}`` JSON as rows of the metrics table.

    Sections named in ``overall`` and numbers at the top level belong to the segment
    ``all``; values that are not numbers are left out.
    """
    raw = spark.read.text(path, wholetext=True)
    sections = raw.select(F.from_json("value", "map<string,string>").alias("doc")).select(F.explode("doc"))
    nested = F.from_json("value", "map<string,string>")
    is_section = F.ltrim("value").startswith("{")
    pairs = sections.select(
        F.when(F.col("key").isin(*overall) | ~is_section, F.lit("all")).otherwise(F.col("key")).alias("segment"),
        F.explode(F.when(is_section, nested).otherwise(F.create_map("key", "value"))).alias("metric", "text"),
    )
    return pairs.select(
        F.lit(run).alias("run"), "segment", "metric", F.expr("try_cast(text AS double)").alias("value")
    ).filter(F.col("value").isNotNull())
