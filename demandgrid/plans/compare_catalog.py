"""I: feature diagnostics; J: comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandgrid.operators import compare as cp
from demandgrid.operators import diagnostics as dg
from demandgrid.operators import features as ft
from demandgrid.operators import keys as ks
from demandgrid.operators import metrics as mt
from demandgrid.plans.catalog import Catalog
from demandgrid.plans.driver_tables import DriverTables
from demandgrid.plans.features_catalog import _lag, _roll

LAGS = (1, 7, 28, 300)
STATS = ("mean", "max")
COLUMNS = (
    ["actual_value"]
    + [f"lag_{n}_f" for n in LAGS]
    + [f"rolling_{s}_{n}_f" for s in STATS for n in (7, 14)]
    + ["rolling_mean_15_f", "is_promo_f"]
)
TABLE_SQL = (
    "SELECT material_key, file_date, actual_value, "
    + ", ".join(f"{_lag(n)} AS lag_{n}_f" for n in LAGS)
    + ", "
    + ", ".join(_roll(s, n) for s in STATS for n in (7, 14))
    + ", "
    + _roll("mean", 15)
    + ", CASE WHEN month(file_date) = 2 AND day(file_date) = 29 THEN CAST(1 AS DOUBLE) ELSE 0 END AS is_promo_f"
    + " FROM dense"
)


def _table(t: DriverTables) -> DataFrame:
    cols = ft.lag_columns(LAGS)
    for stat in STATS:
        cols.update(ft.rolling_columns(stat, (7, 14)))
    cols.update(ft.rolling_columns("mean", (15,)))
    leap = (F.month("file_date") == 2) & (F.dayofmonth("file_date") == 29)
    cols["is_promo_f"] = F.when(leap, 1.0).otherwise(0.0)
    return t.store_dense.withColumns(cols)


def _union(template: str) -> str:
    body = " UNION ALL ".join(template.format(c) for c in COLUMNS)
    return f"WITH feats AS ({TABLE_SQL}) {body}"


PROFILE = """SELECT '{0}' AS feature, avg({0}) AS mean, stddev_samp({0}) AS std, CAST(min({0}) AS DOUBLE) AS min,
  CAST(max({0}) AS DOUBLE) AS max, skewness({0}) AS skew, kurtosis({0}) AS kurtosis,
  avg(CASE WHEN {0} IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS missing_rate,
  avg(CASE WHEN {0} = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS zero_rate,
  CAST(quantile_cont({0}, 0.5) AS DOUBLE) AS median FROM feats"""


def _thresholds(t: DriverTables) -> DataFrame:
    """Metrics of run ``a`` on the keys left by two selection thresholds."""
    parts = []
    for run, least in (("low", 480), ("high", 545)):
        keys = ks.active_counts(t.store_daily).filter(F.col("active_count") >= least)
        parts.append(mt.evaluation(ks.restrict(t.predictions, keys), run))
    return parts[0].unionByName(parts[1])


def register(c: Catalog) -> None:
    c.add(
        "I01_profile_columns",
        lambda t: dg.profile_columns(_table(t), COLUMNS),
        _union(PROFILE),
        "mean std min max skew kurtosis missing_rate zero_rate median",
    )
    c.add(
        "I02_profile_flags",
        lambda t: dg.profile_flags(dg.profile_columns(_table(t), COLUMNS)),
        f"""WITH p AS ({_union(PROFILE)})
        SELECT feature, 'high_skew' AS flag, skew AS measured FROM p WHERE abs(skew) > 3
        UNION ALL SELECT feature, 'high_kurtosis', kurtosis FROM p WHERE kurtosis > 10
        UNION ALL SELECT feature, 'high_zero_rate', zero_rate FROM p WHERE zero_rate > 0.9""",
        "measured",
    )
    c.add(
        "I03_high_missing",
        lambda t: dg.high_missing(_table(t), cols=COLUMNS),
        "SELECT * FROM ("
        + _union(
            "SELECT '{0}' AS feature, avg(CASE WHEN {0} IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) "
            "AS missing_rate FROM feats"
        )
        + ") WHERE missing_rate > 0.1",
        "missing_rate",
    )
    c.add(
        "I04_low_variance",
        lambda t: dg.low_variance(_table(t), cols=COLUMNS),
        "SELECT * FROM ("
        + _union("SELECT '{0}' AS feature, var_samp({0}) AS variance FROM feats")
        + ") WHERE variance < 0.01",
        "variance",
    )
    pairs = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]
    corr = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM feats" for a, b in pairs
    )
    c.add(
        "I05_correlated_pairs",
        lambda t: dg.correlated_pairs(_table(t), cols=COLUMNS),
        f"WITH feats AS ({TABLE_SQL}), r AS ({corr}) SELECT * FROM r WHERE abs(r) > 0.95",
        "r",
    )

    diff = "before after diff improvement_pct"
    c.add("J01_compare_runs", lambda t: cp.compare_runs(t.runs, "a", "b"), "SELECT * FROM run_diff", diff)
    c.add(
        "J01_compare_runs_materials",
        lambda t: cp.compare_runs(t.material_runs, "a", "b"),
        "SELECT * FROM run_diff_m",
        diff,
    )
    c.add(
        "J02_verdict",
        lambda t: cp.verdict(cp.compare_runs(t.runs, "a", "b")),
        """SELECT *, CASE WHEN improvement_pct IS NULL OR abs(improvement_pct) < 0.1 THEN 'no_change'
        WHEN improvement_pct > 0 THEN 'improved' ELSE 'worsened' END AS verdict FROM run_diff""",
        diff,
    )
    c.add(
        "J03_overall_verdict",
        lambda t: cp.overall_verdict(cp.compare_runs(t.runs, "a", "b")),
        """SELECT *, CASE WHEN improved > worsened THEN 'improved' WHEN improved < worsened THEN 'worsened'
        ELSE 'mixed' END AS overall FROM (SELECT segment, count(*) FILTER (improvement_pct > 0) AS improved,
        count(*) FILTER (improvement_pct < 0) AS worsened FROM run_diff GROUP BY 1)""",
    )
    c.add(
        "J04_score",
        lambda t: cp.score(cp.compare_runs(t.runs, "a", "b")),
        """SELECT *, CASE WHEN score > 5 THEN 'much_better' WHEN score > 0 THEN 'better'
        WHEN score > -5 THEN 'similar' ELSE 'worse' END AS judgement
        FROM (SELECT *, (rmse_pct + mae_pct + within_20_points) / 3 AS score FROM (
          SELECT segment, max(improvement_pct) FILTER (metric = 'rmse') AS rmse_pct,
          max(improvement_pct) FILTER (metric = 'mae') AS mae_pct,
          max(diff) FILTER (metric = 'within_20_record_pct') AS within_20_points FROM run_diff GROUP BY 1))""",
        "rmse_pct mae_pct within_20_points score",
    )
    kept = (
        "SELECT p.*, predicted - actual AS e FROM pred p WHERE material_key IN "
        "(SELECT material_key FROM sd WHERE actual_value > 0 GROUP BY 1 HAVING count(*) >= {})"
    )
    side = (
        "(SELECT sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(actual) * count(*)) AS r2, "
        "count(DISTINCT material_key) AS k FROM ({}))"
    )
    c.add(
        "J05_recommend_threshold",
        lambda t: cp.recommend_threshold(_thresholds(t), "low", "high"),
        f"""SELECT *, CASE WHEN rmse_diff < 0 AND mae_diff < 0 THEN 'high_better'
          WHEN rmse_diff > 0 AND mae_diff > 0 THEN 'low_better' ELSE 'mixed' END AS accuracy,
        CASE WHEN rmse_diff < -5 AND mae_diff < -3 AND key_reduction_pct > 20 THEN 'high_strong'
          WHEN rmse_diff > 5 AND mae_diff > 3 THEN 'low_strong'
          WHEN key_reduction_pct > 50 AND abs(rmse_diff) < 2 THEN 'high' ELSE 'depends' END AS recommendation
        FROM (SELECT h.rmse - l.rmse AS rmse_diff, h.mae - l.mae AS mae_diff, h.r2 - l.r2 AS r2_diff,
          CAST(l.k AS DOUBLE) AS keys_low, CAST(h.k AS DOUBLE) AS keys_high,
          coalesce(100.0 * (l.k - h.k) / l.k, 0) AS key_reduction_pct
          FROM {side.format(kept.format(480))} l, {side.format(kept.format(545))} h)""",
        "rmse_diff mae_diff r2_diff keys_low keys_high key_reduction_pct",
    )
    c.add(
        "J06_best_run",
        lambda t: cp.best_run(t.runs),
        """SELECT run, value FROM runs WHERE metric = 'error_rate_mean' AND segment = 'all'
        ORDER BY value, run LIMIT 1""",
        "value",
    )
    c.add(
        "J07_top_volume_rmse",
        lambda t: cp.top_volume_rmse(t.predictions),
        """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY usage_type
          ORDER BY actual_sum DESC, material_key) AS INTEGER) AS rank
        FROM (SELECT usage_type, material_key, sum(actual) AS actual_sum, sqrt(avg(e * e)) AS rmse
          FROM pe GROUP BY 1, 2)) WHERE rank <= 5""",
        "actual_sum rmse",
    )
    c.add(
        "J09_within_change",
        lambda t: cp.within_change(cp.compare_runs(t.runs, "a", "b")),
        """SELECT segment, metric, before, after, diff AS change_points FROM run_diff
        WHERE metric LIKE 'within_%_record_pct'""",
        "before after change_points",
    )
