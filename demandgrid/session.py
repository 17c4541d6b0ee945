"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

K, V = TypeVar("K"), TypeVar("V")

#: Rows of a task of ``spread``, on average.
ROWS_PER_TASK = 500_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Jobs that run at once share the executors evenly.
    "spark.scheduler.mode": "FAIR",
}


def build_session(master: str | None = None, app: str = "demandgrid", **extra: str) -> SparkSession:
    """Session with the settings the operators rely on.

    Shuffle partitions are left to the cluster and AQE; pass
    ``**{"spark.sql.shuffle.partitions": "8"}`` for a small local run.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write, whatever the master.

    The setting ``spark.checkpoint.dir``. A session without a cluster may do without it and gets a folder in its
    warehouse; on a cluster that could be a folder of one machine, so there it is a ``ValueError``.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Writes the table to the shared folder and reads it back, split into folders ``by`` columns.

    Cuts the lineage for work that reads its input many times, survives the loss of
    any executor, and keeps column pruning and filter pushdown for the readers. The table
    stays until ``release`` or the end of the program, since results are read lazily.
    """
    path = scratch_path(df.sparkSession, name)
    if not _written:
        atexit.register(release)
    _written[path] = df.sparkSession
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._scratch = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    if spark.sparkContext._jsc is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Deletes a table as ``materialise`` returned it, once nothing reads it any more.

    Shuffle files of jobs that are done go with the plans that made them, when the driver collects
    garbage; a loop that writes and discards asks for that, as it may otherwise not happen for long.
    """
    if getattr(table, "_scratch", None) in _written:
        _delete(table._scratch)
        table.sparkSession._jvm.System.gc()


def release() -> None:
    """Deletes all tables that ``materialise`` has written; results that still read them end with this."""
    for path in list(_written):
        _delete(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by hash of ``by`` to tasks of about ``ROWS_PER_TASK``, where a task a core would get more than that.

    A group-by after it needs no other exchange. AQE sizes tasks by compressed bytes and merges them down to one a core, so that the
    hash table of a task over many small groups grows with the table. Counts the rows: meant for tables read from files.
    """
    rows = df.count()
    if rows <= ROWS_PER_TASK * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // ROWS_PER_TASK), *by)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Gives iterative fits a checkpoint folder unless the session has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def concurrently(spark: SparkSession, work: Mapping[K, Callable[[], V]], most: int = 4) -> dict[K, V]:
    """Results of ``work`` by name, in its order; at most ``most`` of its Spark jobs run at once, each in a pool of its own.

    A small job leaves most executors idle between its stages; the others use them. What fails is
    raised as a ``RuntimeError`` that names it, once the others have ended.
    """
    if not work:
        return {}
    context = spark.sparkContext

    def run(turn: int, task: Callable[[], V]) -> V:
        context.setLocalProperty("spark.scheduler.pool", f"concurrent-{turn % most}")
        try:
            return task()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(min(most, len(work))) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(run), turn, task) for turn, (name, task) in enumerate(work.items())}
        out, failed = {}, None
        for name, future in started.items():
            try:
                out[name] = future.result()
            except Exception as error:
                failed = failed or (name, error)
    if failed:
        raise RuntimeError(f"{failed[0]!r} failed: {failed[1]}") from failed[1]
    return out
