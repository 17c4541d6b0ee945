import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from demandgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Builds an entity-day table from (key, iso day, value, *more) rows."""

    def build(rows, more=""):
        schema = "material_key string, file_date string, actual_value double" + (f", {more}" if more else "")
        frame = spark.createDataFrame(rows, schema)
        return frame.withColumn("file_date", frame.file_date.cast("date"))

    return build


@pytest.fixture
def predictions(spark):
    def build(rows):
        frame = spark.createDataFrame(
            rows, "material_key string, date string, actual double, predicted double, usage_type string"
        )
        return frame.withColumn("date", frame.date.cast("date"))

    return build
