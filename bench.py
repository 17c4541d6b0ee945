"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs in full (every column of every row is computed, nothing is
collected). ``rows`` gives the size of the day grids that the feature queries build.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from demandgrid.operators import features as ft  # noqa: E402
from demandgrid.operators import models as md  # noqa: E402
from demandgrid.operators import prepare as pp  # noqa: E402
from demandgrid.plans.all_queries import catalog  # noqa: E402
from demandgrid.plans.driver_tables import TRAIN_END, DriverTables  # noqa: E402
from demandgrid.session import build_session  # noqa: E402

HEADLINE = (
    "B05_fill_zero_global",
    "B12_preparation_summary",
    "D07_key_weekday_mean",
    "D08_store_weekday_mean",
    "D12_key_profile",
    "D20_feature_job_by_usage_type",
    "E06_select_threshold",
    "E11_coverage_by_volume",
    "E12_coverage_by_activity",
    "F05_hampel",
    "F08_baseline_forecast",
    "G12_error_rate_percentiles",
    "G17_abs_error_stats",
    "G21_metrics_by_segment",
    "G23_material_summary",
    "H04_bias_by_key",
    "H09_error_histogram",
    "I01_profile_columns",
    "I05_correlated_pairs",
    "J01_compare_runs",
)


def series_features(t: DriverTables) -> DataFrame:
    """Grid, lags, rolling statistics and trends of every store."""
    return ft.series_features(t.store_dense)


def material_grid_features(t: DriverTables) -> DataFrame:
    """Preparation and features over the per-key day grid of all materials."""
    grid = pp.fill_zero_per_key(t.material_daily)
    return ft.calendar_features(ft.series_features(grid, lag_ns=(1, 2, 3), window_ns=(7, 28)))


def train(t: DriverTables) -> DataFrame:
    table = ft.forecast_table(t.store_dense_segment, "by_usage_type", TRAIN_END)
    return md.fit_predict(table, TRAIN_END, 1).predictions


def run_all(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            # A few times the cores, as on a cluster.
            "spark.sql.shuffle.partitions": str(4 * int(cpus)),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
        },
    )
    run_all(catalog().queries["G03_rmse_mae"].run(spark, sf_dir))  # warm up

    seconds: dict[str, float] = {}

    def timed(name: str, plan) -> None:
        begin = time.perf_counter()
        run_all(plan(DriverTables(spark, sf_dir)))
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)

    for name in HEADLINE:
        timed(name, catalog().queries[name].plan)
    timed("series_features", series_features)
    timed("material_grid_features", material_grid_features)
    timed("train_predict", train)

    t = DriverTables(spark, sf_dir)
    grid = t.material_daily.groupBy("material_key").agg(
        (F.datediff(F.max("file_date"), F.min("file_date")) + 1).alias("days")
    )
    grid_rows = grid.agg(F.sum("days")).first()[0]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "rows": {"material_grid": grid_rows, "store_grid": t.store_dense.count()},
                "material_grid_rows_per_sec": round(grid_rows / seconds["material_grid_features"]),
            }
        )
    )


if __name__ == "__main__":
    main()
