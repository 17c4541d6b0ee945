import pytest
from pyspark.sql import functions as F

from demandgrid import session as ss
from demandgrid.operators import metrics as mt
from demandgrid.sources import readers as rd
from demandgrid.sources import writers as wr

ROWS = [("A", "2024-01-01", 1.0), ("B", "2024-01-02", 2.0)]


def same(a, b):
    return sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_versioned_write_and_latest(spark, series, tmp_path):
    first, second = series(ROWS), series(ROWS[:1])
    wr.write_versioned(first, str(tmp_path), "t", "20240101_000000")
    wr.write_versioned(second, str(tmp_path), "t", "20240102_000000")
    assert same(rd.read_latest(spark, str(tmp_path), "t"), second)
    versions = spark.read.parquet(str(tmp_path / "t" / "versions"))
    assert versions.select("run_ts").distinct().count() == 2


def test_newest_version_without_latest(spark, series, tmp_path):
    base = tmp_path / "t" / "versions"
    series(ROWS).write.parquet(str(base / "run_ts=20240101_000000"))
    series(ROWS[1:]).write.parquet(str(base / "run_ts=20240201_000000"))
    assert same(rd.read_latest(spark, str(tmp_path), "t"), series(ROWS[1:]))


def test_an_unfinished_version_is_not_read(spark, series, tmp_path):
    paths = wr.write_versioned(series(ROWS), str(tmp_path), "t", "20240101_000000")
    half = tmp_path / "t" / "versions" / "run_ts=20240301_000000"
    series(ROWS[:1]).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert same(rd.read_latest(spark, str(tmp_path), "t"), series(ROWS))
    (tmp_path / "t" / "latest").unlink()
    newest = rd.read_latest(spark, str(tmp_path), "t")
    assert same(newest, series(ROWS)) and all(paths["version"] in f for f in newest.inputFiles())
    (tmp_path / "t" / "versions" / "run_ts=20240101_000000" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        rd.read_latest(spark, str(tmp_path), "t")


def test_newest_file(spark, series, tmp_path):
    series(ROWS).coalesce(1).write.parquet(str(tmp_path / "f"))
    series(ROWS[:1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    assert same(rd.read_newest_file(spark, str(tmp_path / "f"), "part"), series(ROWS[:1]))


def test_csv_round_trip(spark, series, tmp_path):
    table = series(ROWS)
    path = wr.write_csv(table, str(tmp_path / "c"))
    assert same(rd.read_csv(spark, path, table.schema), table)


def test_metrics_round_trip_and_document(spark, predictions, tmp_path):
    long = mt.evaluation(predictions([("A", "2024-01-01", 1.0, 2.0, "business")]), "a")
    path = wr.write_metrics_json(long, str(tmp_path / "m"))
    assert rd.read_metrics_json(spark, path).count() == long.filter("value IS NOT NULL").count() + long.filter(
        "value IS NULL"
    ).count()
    document = tmp_path / "doc.json"
    document.write_text(
        '{\n "overall": {"rmse": 1.5},\n "business": {"mae": 2, "note": "text"},\n "total": 7, "name": "x"\n}'
    )
    got = {(r.segment, r.metric): r.value for r in rd.read_metrics_document(spark, str(document), "base").collect()}
    assert got == {("all", "rmse"): 1.5, ("business", "mae"): 2.0, ("all", "total"): 7.0}


def test_fallback_order(spark, series, tmp_path):
    table = series(ROWS)
    segments = {"business": str(tmp_path / "b"), "household": str(tmp_path / "h")}
    with pytest.raises(FileNotFoundError):
        rd.read_features(spark, str(tmp_path / "whole"), segments)
    assert rd.read_features(spark, str(tmp_path / "whole"), segments, fallback=table) is table
    table.withColumn("x_f", F.lit(1)).write.parquet(segments["business"])
    table.write.parquet(segments["household"])
    union = rd.read_features(spark, str(tmp_path / "whole"), segments)
    assert union.count() == 4 and union.filter("usage_type = 'household' AND x_f IS NULL").count() == 2
    table.write.parquet(str(tmp_path / "whole"))
    assert rd.read_features(spark, str(tmp_path / "whole"), segments).count() == 2


def test_features_are_split_by_segment(spark, series, tmp_path):
    table = series([(*r, s) for r, s in zip(ROWS, ("business", "household"))], "usage_type string")
    for buckets in (None, 3):
        path = wr.write_features(table, str(tmp_path / f"f{buckets}"), buckets)
        assert same(rd.read_demand(spark, path), table)
        assert {p.name for p in (tmp_path / f"f{buckets}").iterdir() if p.is_dir()} == {
            "usage_type=business",
            "usage_type=household",
        }


def test_lineage_is_cut_in_the_configured_folder(spark, series):
    written = ss.materialise(series(ROWS), "rows")
    assert same(written, series(ROWS))
    assert all(f.startswith("file://" + ss.shared_dir(spark)) for f in written.inputFiles())
    ss.ensure_checkpoint_dir(spark)
    assert ss.shared_dir(spark) in spark.sparkContext.getCheckpointDir()
