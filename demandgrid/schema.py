"""Column names of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "material_key"
DATE = "file_date"
VALUE = "actual_value"
SEGMENT = "usage_type"
STORE = "store_code"
PRODUCT = "product_key"
SPLIT = "data_type"

PRED_DATE = "date"
ACTUAL = "actual"
PREDICTED = "predicted"

TRAIN, TEST = "train", "test"
BUSINESS, HOUSEHOLD = "business", "household"
ALL = "all"

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
