"""Training and prediction with Spark ML, and the statistical baselines."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from demandgrid.functions import calendar as cal
from demandgrid.operators.features import LEAKING, feature_columns
from demandgrid.operators.keys import test_period
from demandgrid.operators.metrics import key_metrics, rmse_mae
from demandgrid.operators.search import EARLY_AFTER, EARLY_SHARE, Range, minimise
from demandgrid.operators.trees import HistogramTrees
from demandgrid.schema import ACTUAL, DATE, KEY, PRED_DATE, PREDICTED, SEGMENT, VALUE
from demandgrid.session import concurrently, ensure_checkpoint_dir, materialise

# Beside every feature that may be missing stands a 0/1 column that says so; the feature itself is then 0.
MISSING_FLAG = "_missing"

# Fixed values of the data model.
WINSOR_TAIL = 0.05
HAMPEL_WINDOW = 7
HAMPEL_LIMIT = 3.0
MAD_TO_STD = 1.4826
RECENT_DAYS = 30
SEASON_AMPLITUDE = 200.0
DAYS_IN_YEAR = 365
# Rows that trials or segments run at once may hold together, some 40 bytes each: a fit keeps all its rows, binned.
ROWS_AT_ONCE = 30_000_000
# Flags that are compared with each other at once: bits of a long, less two for 0 and 1.
FLAGS_AT_ONCE = 60

Day = str | dt.date


@dataclass(frozen=True)
class Fit:
    """Named result of one training run."""

    predictions: DataFrame
    by_key: DataFrame
    importance: DataFrame
    params: dict[str, object]
    model: PipelineModel
    metrics: DataFrame
    features: list[str] = field(default_factory=list)


# --- outlier handling ----------------------------------------------------------------


def winsorize(
    df: DataFrame, lo: float = WINSOR_TAIL, hi: float = 1.0 - WINSOR_TAIL, key: str = KEY, value: str = VALUE
) -> DataFrame:
    """Values of each key pulled to the key's lower and upper quantile."""
    cuts = F.percentile(value, F.array(F.lit(lo), F.lit(hi))).over(Window.partitionBy(key))
    clipped = F.least(F.greatest(F.col(value), F.col("_cuts")[0]), F.col("_cuts")[1])
    kept = F.when(F.col(value).isNotNull(), clipped)
    return df.withColumn("_cuts", cuts).withColumn(value, kept).drop("_cuts")


def _middle(values: Column) -> Column:
    """Median of an array without NULLs."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
    mid = (F.try_element_at(ordered, low) + F.try_element_at(ordered, high)) / 2.0
    return F.when(n > 0, mid)


def hampel(
    df: DataFrame,
    k: float = HAMPEL_LIMIT,
    n: int = HAMPEL_WINDOW,
    key: str = KEY,
    date: str = DATE,
    value: str = VALUE,
) -> DataFrame:
    """Replaces a value by the median of its centred ``n``-row window when it is more
    than ``k`` robust standard deviations away. The frame holds ``n // 2`` rows on each side of the row.

    Where the deviations have median 0 (half of the window is one value, as with intermittent demand)
    there is no scale to call anything an outlier by, and the value stays.
    """
    half = n // 2
    frame = Window.partitionBy(key).orderBy(date).rowsBetween(-half, half)
    near = df.withColumn("_near", F.collect_list(value).over(frame)).withColumn("_med", _middle(F.col("_near")))
    spread = _middle(F.transform("_near", lambda x: F.abs(x - F.col("_med"))))
    with_spread = near.withColumn("_mad", spread)
    outlier = (F.col("_mad") > 0) & (F.abs(F.col(value) - F.col("_med")) > F.col("_mad") * (k * MAD_TO_STD))
    cleaned = F.when(outlier, F.col("_med")).otherwise(F.col(value))
    return with_spread.withColumn(value, cleaned).drop("_near", "_med", "_mad")


# --- learned models --------------------------------------------------------------------


def training_features(df: DataFrame, target: str = VALUE) -> list[str]:
    """Feature columns without those built from the current target."""
    return [c for c in feature_columns(df) if c not in LEAKING and c != target]


def _assembled(inputs: Sequence[str], regressor: str = "trees", **params: object) -> Pipeline:
    """Gradient-boosted trees, or ``linear``: least squares by the normal equations."""
    names = {"labelCol": "label", "featuresCol": "features", "predictionCol": PREDICTED}
    if regressor == "linear":
        stage = LinearRegression(**names, solver="normal").setParams(**params)
    else:
        stage = HistogramTrees(**names).setParams(**{"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42, **params})
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features"), stage])


def model_inputs(table: DataFrame, features: Sequence[str]) -> list[str]:
    """The features and their missing flags that a model input has."""
    return [*features, *[f for c in features if (f := c + MISSING_FLAG) in table.columns]]


def tree_inputs(train: DataFrame, inputs: Sequence[str]) -> list[str]:
    """The inputs without missing flags that are constant, or equal to an earlier flag on every row.

    Of equal splits a tree takes that of the first input, so trees without these are the same trees; each input costs
    time in every pass and memory for every row. Reads the flags once, however many there are.
    """
    flags = [c for c in inputs if c.endswith(MISSING_FLAG)]
    groups = [flags[i : i + FLAGS_AT_ONCE] for i in range(0, len(flags), FLAGS_AT_ONCE)]
    differs = []
    for group in groups:
        bits = [F.lit(0).cast("long"), F.lit(1).cast("long"), *[F.col(f"`{c}`").cast("long") for c in group]]
        row = reduce(Column.bitwiseOR, [F.shiftleft(b, i) for i, b in enumerate(bits)])
        # A bit of the result is set where some row has another value there than in the flag itself.
        differs += [F.bit_or(row.bitwiseXOR(-b)) for b in bits[2:]]
    if not differs:
        return list(inputs)
    masks = iter(train.agg(*[d.alias(f"_{i}") for i, d in enumerate(differs)]).first())
    spare = set()
    for group in groups:
        for i, (name, mask) in enumerate(zip(group, masks)):
            # Without rows there is no mask, and nothing to leave out.
            if mask is not None and any(not mask >> j & 1 for j in range(i + 2)):
                spare.add(name)
    return [c for c in inputs if c not in spare]


def model_input(df: DataFrame, features: Sequence[str], target: str = VALUE) -> DataFrame:
    """Only what a fit needs: features without NULL, their missing flags and the label."""
    optional = {f.name for f in df.schema.fields if f.nullable}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    flags = [F.col(c).isNull().cast("double").alias(c + MISSING_FLAG) for c in features if c in optional]
    kept = [c for c in (KEY, DATE, SEGMENT) if c in df.columns]
    return df.select(*kept, F.col(target).cast("double").alias("label"), *filled, *flags)


def _day(day: Day) -> Column:
    return F.lit(str(day)).cast("date")


def training_table(
    df: DataFrame,
    features: Sequence[str],
    train_end: Day,
    until: Day,
    target: str = VALUE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Written model input: rows up to ``train_end`` and later rows worth predicting.

    Fits read it several times, and several fits share it, so the feature plan runs
    once. Split into folders ``by`` columns, a fit on one value reads its part only.
    """
    rows = model_input(df.filter(F.col(DATE) <= _day(until)), features, target)
    useful = F.col("label").isNotNull() & ((F.col(DATE) <= _day(train_end)) | (F.col("label") > 0))
    return materialise(rows.filter(useful), "model-input", by)


def training_vectors(rows: DataFrame, train_end: Day, features: Sequence[str]) -> DataFrame:
    """The rows up to ``train_end`` with their ``tree_inputs`` and label, binned once for all fits that get them.

    ``release_vectors`` gives up what is kept for it.
    """
    train = rows.filter(F.col(DATE) <= _day(train_end))
    needed = tree_inputs(train, model_inputs(rows, features))
    vectors = train.select(*needed, "label")
    vectors._binned = _assembled(needed).getStages()[-1].binned(vectors, needed)
    return vectors


def release_vectors(vectors: DataFrame) -> None:
    if vectors._binned is not None:
        vectors._binned.release()


def importance_of(model: PipelineModel, inputs: Sequence[str], like: DataFrame) -> DataFrame:
    """Importance of each model input, of a linear model its coefficient (a bounded list).

    Inputs that the trees can do without (``tree_inputs``) have 0, as they would if the trees had them.
    """
    fitted = model.stages[-1]
    weights = fitted.coefficients if hasattr(fitted, "coefficients") else fitted.featureImportances
    known = {name: float(weights[i]) for i, name in enumerate(model.stages[0].getInputCols())}
    rows = [(name, known.get(name, 0.0)) for name in inputs]
    return like.sparkSession.createDataFrame(rows, "feature string, importance double")


def _fit(
    rows: DataFrame,
    train_end: Day,
    period: tuple[Day, Day],
    features: list[str],
    clean: Sequence[str],
    params: Mapping[str, object],
    regressor: str = "trees",
    vectors: DataFrame | None = None,
) -> Fit:
    """One fit on a training table and its predictions for the period.

    ``vectors`` may hold the training rows as ``training_vectors`` binned them.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    train = rows.filter(F.col(DATE) <= _day(train_end))
    for name in clean:
        train = {"winsorize": winsorize, "hampel": hampel}[name](train, value="label")
    if clean:
        train = materialise(train, "model-input-cleaned")
    inputs = model_inputs(rows, features)
    if regressor == "linear":
        model = _assembled(inputs, regressor, **params).fit(train)
    else:
        needed = vectors.columns[:-1] if vectors is not None else tree_inputs(train, inputs)
        assembler, trees = _assembled(needed, regressor, **params).getStages()
        shared = vectors._binned if vectors is not None else None
        model = PipelineModel([assembler, trees.fit_table(vectors if vectors is not None else train, needed, shared)])
    due = rows.filter(F.col(DATE).between(_day(period[0]), _day(period[1])) & (F.col("label") > 0))
    scored = model.transform(due)
    segment = [SEGMENT] if SEGMENT in scored.columns else []
    predictions = scored.select(KEY, F.col(DATE).alias(PRED_DATE), F.col("label").alias(ACTUAL), PREDICTED, *segment)
    return Fit(
        predictions=predictions,
        by_key=key_metrics(predictions),
        importance=importance_of(model, inputs, rows),
        params={p.name: v for p, v in model.stages[-1].extractParamMap().items()},
        model=model,
        metrics=rmse_mae(predictions),
        features=features,
    )


def fit_predict(
    df: DataFrame,
    train_end: Day,
    step: int = 1,
    features: Sequence[str] | None = None,
    clean: Sequence[str] = (),
    target: str = VALUE,
    regressor: str = "trees",
    **params: object,
) -> Fit:
    """Fits on rows up to ``train_end`` and predicts the next ``step`` months.

    Only rows with a positive actual are predicted. ``clean`` may name ``winsorize``
    and ``hampel``, applied to the training target only.
    """
    features = list(features or training_features(df, target))
    period = test_period(train_end, step)
    rows = training_table(df, features, train_end, period[1], target)
    return _fit(rows, train_end, period, features, clean, params, regressor)


def walk_forward(
    grid: DataFrame,
    train_end: Day,
    steps: int,
    build: Callable[[DataFrame, str], DataFrame],
    features: Sequence[str] | None = None,
    clean: Sequence[str] = (),
    target: str = VALUE,
    **params: object,
) -> DataFrame:
    """Month by month: train on everything before the month, predict the month.

    ``build(grid, cutoff)`` makes the feature table of a step from the dense grid, such as
    ``features.forecast_table``; it gets no row after the month to predict. The model input is written in blocks: all rows up
    to the first cutoff once, then the month of each step as it looks at its own cutoff, which later steps
    train on. So a row is written once, however many steps there are. Step fits run one after another, as each
    table grows by the month before.
    """
    end = cal.to_day(train_end)
    # Counted from the first end, so that month ends stay month ends.
    ends = [cal.add_months(end, i) for i in range(steps + 1)]
    months, blocks, names = [], [], list(features or [])
    for i, (cutoff, last) in enumerate(zip(ends, ends[1:])):
        table = build(grid.filter(F.col(DATE) <= _day(last)), str(cutoff))
        names = names or training_features(table, target)
        block = model_input(table.filter(F.col(DATE) > _day(cutoff)) if blocks else table, names, target)
        blocks.append(materialise(block.filter(F.col("label").isNotNull() & (F.col(DATE) <= _day(last))), "model-input-block"))
        rows = reduce(DataFrame.unionByName, blocks)
        period = (cutoff + dt.timedelta(days=1), last)
        predicted = _fit(rows, cutoff, period, names, clean, params).predictions
        months.append(predicted.withColumn("step", F.lit(i + 1)))
    return reduce(DataFrame.unionByName, months)


def fit_by_segment(
    df: DataFrame,
    train_end: Day,
    segments: Sequence[str | None] | None = None,
    step: int = 1,
    features: Sequence[str] | None = None,
    clean: Sequence[str] = (),
    target: str = VALUE,
    by: str = SEGMENT,
    at_once: int = 4,
    **params: object,
) -> tuple[DataFrame, dict[str | None, Fit]]:
    """One model per segment; returns the union of predictions and the fits.

    Up to ``at_once`` segments are fitted at the same time, as many as ``ROWS_AT_ONCE`` allows: the rows of large ones, held
    at once, would go to disk, and one of them keeps all cores busy. A fit that fails raises ``RuntimeError`` with its segment.

    Without ``segments`` every segment of the table gets a model, rows without one too (``None``).
    A list that leaves out a segment of the table raises ``ValueError``.
    """
    features = list(features or training_features(df, target))
    period = test_period(train_end, step)
    rows = training_table(df, features, train_end, period[1], target, [by])
    found = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if segments is None:
        segments = sorted(found, key=lambda s: (s is None, s or ""))
    elif left := set(found) - set(segments):
        raise ValueError(f"segments without a model: {sorted(map(str, left))}")
    ensure_checkpoint_dir(df.sparkSession)

    def fit(s: str | None) -> Fit:
        return _fit(rows.filter(F.col(by).eqNullSafe(F.lit(s))), train_end, period, features, clean, params)

    most = max(1, min(at_once, ROWS_AT_ONCE // max([1, *found.values()])))
    fits = concurrently(df.sparkSession, {s: partial(fit, s) for s in segments if s in found}, most)
    return reduce(DataFrame.unionByName, [f.predictions for f in fits.values()]), fits


def tune(
    df: DataFrame,
    train_end: Day,
    grid: Mapping[str, Sequence[object]],
    trials: int | None = None,
    features: Sequence[str] | None = None,
    target: str = VALUE,
    seed: int = 42,
) -> DataFrame:
    """Validation RMSE of each parameter setting, or of a random ``trials`` of them.

    Rows are never sampled: the last month up to ``train_end`` is held out and the
    rest trains, like a walk-forward step. All trials read one training table; some run at once, as many as
    ``ROWS_AT_ONCE`` allows.
    """
    features = list(features or training_features(df, target))
    cutoff = cal.add_months(cal.to_day(train_end), -1)
    period = (cutoff + dt.timedelta(days=1), train_end)
    rows = training_table(df, features, cutoff, train_end, target)
    names = sorted(grid)
    settings = [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]
    chosen = range(len(settings))
    if trials is not None and trials < len(settings):
        chosen = sorted(random.Random(seed).sample(chosen, trials))
    ensure_checkpoint_dir(df.sparkSession)
    vectors = training_vectors(rows, cutoff, features)

    def rmse(trial: int) -> float:
        return _fit(rows, cutoff, period, features, (), settings[trial], vectors=vectors).metrics.first()["rmse"]

    most = max(1, min(4, ROWS_AT_ONCE // max(1, vectors.count())))
    losses = concurrently(df.sparkSession, {trial: partial(rmse, trial) for trial in chosen}, most)
    release_vectors(vectors)
    results = [(trial, ",".join(f"{n}={v}" for n, v in settings[trial].items()), loss) for trial, loss in losses.items()]
    return df.sparkSession.createDataFrame(results, "trial int, params string, rmse double")


def _rmse_of_first(model: PipelineModel, due: DataFrame, trees: int) -> float:
    """RMSE of the first trees of a model: those that a fit of so many trees has."""
    assembler, boosted = model.stages
    return math.sqrt(boosted.evaluateEachIteration(assembler.transform(due), "squared")[trees - 1])


#: Ranges of the tree models, for ``search``.
TREE_RANGES = {"maxDepth": Range(2, 8, whole=True), "stepSize": Range(0.01, 0.4, log=True), "subsamplingRate": Range(0.5, 1.0)}


def search(
    df: DataFrame,
    train_end: Day,
    space: Mapping[str, Range] = TREE_RANGES,
    trials: int = 20,
    features: Sequence[str] | None = None,
    target: str = VALUE,
    seed: int = 42,
    max_iter: int = 20,
) -> DataFrame:
    """Validation RMSE of ``trials`` settings (trial, params, rmse, trees), each chosen from the ones before.

    The last month up to ``train_end`` is held out, as in ``tune``, and all trials read one training table. ``trees`` is
    ``max_iter``, or the share of it after which a poor trial was given up.
    """
    features = list(features or training_features(df, target))
    cutoff = cal.add_months(cal.to_day(train_end), -1)
    period = (cutoff + dt.timedelta(days=1), train_end)
    rows = training_table(df, features, cutoff, train_end, target)

    def trees(share: float) -> int:
        return max(1, round(max_iter * share))

    vectors = training_vectors(rows, cutoff, features)
    due = rows.filter(F.col(DATE).between(_day(period[0]), _day(period[1])) & (F.col("label") > 0))
    fitted = []

    def loss(params: dict[str, float | int], share: float) -> float:
        """The first trials are never given up: one fit tells what the first trees reach and what all do."""
        if fitted and fitted[-1][0] is params:
            return fitted[-1][1]
        in_full = share == EARLY_SHARE and len(fitted) < EARLY_AFTER
        fit = _fit(rows, cutoff, period, features, (), {**params, "maxIter": trees(1.0 if in_full else share)}, vectors=vectors)
        rmse = fit.metrics.first()["rmse"]
        if not in_full:
            return rmse
        fitted.append((params, rmse))
        return _rmse_of_first(fit.model, due, trees(share))

    done = minimise(loss, space, trials, seed)
    release_vectors(vectors)
    told = [(t.number, ",".join(f"{n}={v}" for n, v in t.params.items()), t.loss, trees(t.share)) for t in done]
    return df.sparkSession.createDataFrame(told, "trial int, params string, rmse double, trees int")


def against_mean(df: DataFrame, predictions: DataFrame, train_end: Day, key: str = KEY, target: str = VALUE) -> DataFrame:
    """(n, rmse, mean_rmse): the error of the predictions, and that of each key's mean up to ``train_end`` on the same rows.

    Rows of keys without an earlier value have no mean and do not count.
    """
    means = df.filter((F.col(DATE) <= _day(train_end)) & F.col(target).isNotNull()).groupBy(key).agg(F.avg(target).alias("_mean"))
    rows = predictions.join(means, key)

    def root(guess: str) -> Column:
        return F.sqrt(F.avg(F.pow(F.col(guess) - F.col(ACTUAL), 2)))

    return rows.agg(F.count(F.lit(1)).alias("n"), root(PREDICTED).alias("rmse"), root("_mean").alias("mean_rmse"))


def importance(fits: Mapping[str, Fit], by: str = SEGMENT) -> DataFrame:
    """Importances of all segments, sorted within each."""
    parts = [fit.importance.withColumn(by, F.lit(name)) for name, fit in fits.items()]
    return reduce(DataFrame.unionByName, parts).orderBy(by, F.desc("importance"), "feature")


# --- baseline and scope ------------------------------------------------------------------


def baseline_forecast(
    df: DataFrame,
    horizon: int,
    amplitude: float = SEASON_AMPLITUDE,
    recent: int = RECENT_DAYS,
    key: str = KEY,
    date: str = DATE,
    value: str = VALUE,
) -> DataFrame:
    """Mean of the last days plus trend plus a yearly sine, never below 0.

    The trend compares the last ``recent`` rows with the ``recent`` before them (the
    earliest ones when the key has fewer than twice as many) and is 0 for a key with
    fewer than ``recent`` rows. At most ``2 * recent`` rows per key leave the map side.
    """
    latest = Window.partitionBy(key).orderBy(F.desc(date))
    tail = df.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= 2 * recent)
    per_key = tail.groupBy(key).agg(
        F.max(date).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.col("_rank") <= recent, F.col(value))).alias("_recent"),
        F.sort_array(F.collect_list(F.struct(F.col("_rank"), F.col(value).alias("v")))).alias("_tail"),
    )
    older = F.slice("_tail", F.greatest(F.col("_n") - recent + 1, F.lit(1)), F.lit(recent))
    older_mean = F.aggregate(older, F.lit(0.0), lambda acc, x: acc + x["v"]) / recent
    trend = F.when(F.col("_n") >= recent, (F.col("_recent") - older_mean) / recent).otherwise(0.0)
    days = per_key.select(
        key, "_last", "_recent", trend.alias("_trend"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("_i")
    )
    day = F.date_add("_last", F.col("_i") + 1)
    season = F.sin(F.dayofyear(day) * (2.0 * math.pi / DAYS_IN_YEAR)) * amplitude
    return days.select(
        key,
        day.alias(PRED_DATE),
        F.greatest(F.lit(0.0), F.col("_recent") + F.col("_trend") * F.col("_i") + season).alias(PREDICTED),
    )


def predict_scope(
    pred: DataFrame,
    mode: str,
    agg: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
    keys: DataFrame | None = None,
    key: str = KEY,
    date: str = PRED_DATE,
) -> DataFrame:
    """Predictions of a period, one day or listed keys, optionally aggregated per key.

    ``walk-forward`` takes the output of ``walk_forward``: a period like ``future``, of all steps.
    ``start`` and ``end`` may be left open, except for ``single-date``.
    """
    inside = F.lit(True)
    inside = inside if start is None else inside & (F.col(date) >= _day(start))
    inside = inside if end is None else inside & (F.col(date) <= _day(end))
    if mode in ("future", "walk-forward"):
        scoped = pred.filter(inside)
    elif mode == "single-date":
        scoped = pred.filter(F.col(date) == _day(start))
    elif mode == "material-key":
        scoped = pred.filter(inside).join(keys.select(key), key, "left_semi")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if agg is None:
        return scoped
    days = F.count(F.lit(1)).alias("day_count")
    # A key has a row per day, so its median fits the aggregation that runs anyway.
    how = {"sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}[agg]
    return scoped.groupBy(key).agg(how(PREDICTED).alias(PREDICTED), days)
