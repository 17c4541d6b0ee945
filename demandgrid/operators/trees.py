"""Gradient-boosted regression trees as Spark ML grows them, from rows that are binned once.

Spark ML's own trees read an integer per feature and row in every pass and add up one feature of one row at a time.
Here rows are kept as blocks of numpy columns. Features share a column as far as their bins together stay few, so that one count
of a column serves all of them; features that keep their bin over many rows on end, as those of a month do, are kept and counted by
run; only the smaller one of two sibling nodes is counted, the other is the rest of their parent.
Every row, feature, tree and level counts as there: bins, ties and leaves follow the same rules, and the result is Spark ML's model.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, functions as F

# Functions sent to executors carry their code: a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block, and bins that the features of one column may have together: counts of a few nodes stay in a core's cache.
BLOCK_ROWS, CELLS = 1 << 16, 1024
#: Rows that bin limits are drawn from, as in Spark ML, when there are more: at least this, or the square of the number of bins.
LIMIT_ROWS = 10_000
#: Features are kept by run if each changes, and together they change, in at most these shares of the rows; rows looked at for that.
CHANGES, CHANGES_OF_ALL, ROWS_SEEN = 1 / 8, 1 / 4, 1 << 14
#: Bytes of the counts that one task holds; the nodes of a deep level that need more are counted in several passes.
TASK_BYTES = 64 << 20
#: Bytes of the counts of all tasks that the driver adds up itself; beyond, executors add them first.
DRIVER_BYTES = 128 << 20
#: Trees after which the target of a row is worked out from its label again: a lost part repeats that many at most.
TREES_BACK = 10
#: Levels of a tree that are walked at once: a bit of a word for each node they end in.
WALKED = 6

#: Per node that is split: the column it looks at, and for each of its codes whether that goes left. The root is 1, children 2i and 2i + 1.
Cuts = Mapping[int, tuple[int, np.ndarray]]
#: Number of the block, codes by row and by run (column, ...), and the rows of each run.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Layout:
    """Where a feature is found: ``column``, the product of the bins before it (``stride``) and its bins.

    The first ``by_row`` columns hold a code for each row, the others one for each run.
    """

    limits: list[np.ndarray]
    column: list[int]
    stride: list[int]
    sizes: list[int]
    by_row: int

    def bins(self, feature: int) -> int:
        return len(self.limits[feature]) + 1

    @property
    def most(self) -> int:
        return max(len(x) for x in self.limits) + 1

    @property
    def kind(self) -> type:
        return np.uint16 if max(self.sizes, default=1) <= 1 << 16 else np.uint32

    def goes_left(self, feature: int, split: int) -> np.ndarray:
        codes = np.arange(self.sizes[self.column[feature]])
        return codes // self.stride[feature] % self.bins(feature) <= split

    def codes(self, x: Sequence[np.ndarray]) -> np.ndarray:
        """Columns of codes; a value that equals a limit is in the bin below it."""
        out = np.zeros((len(self.sizes), len(x[0])), self.kind)
        for f, limits in enumerate(self.limits):
            if len(limits):
                out[self.column[f]] += (np.searchsorted(limits, x[f]) * self.stride[f]).astype(out.dtype)
        return out

    def by_feature(self, counted: Sequence[np.ndarray], nodes: int) -> np.ndarray:
        """Counts (node, feature, bin) from those of the columns, each (node, code)."""
        out = np.zeros((nodes, len(self.limits), self.most))
        for f, limits in enumerate(self.limits):
            if len(limits):
                n = self.bins(f)
                out[:, f, :n] = counted[self.column[f]].reshape(nodes, -1, n, self.stride[f]).sum(axis=(1, 3))
        return out


@dataclass
class Node:
    """Rows, sum and sum of squares of the target; ``gain``, ``feature`` and ``split`` where it has children."""

    rows: float
    total: float
    squares: float
    gain: float = 0.0
    feature: int | None = None
    split: int = 0

    @property
    def mean(self) -> float:
        return self.total / self.rows

    @property
    def impurity(self) -> float:
        return max(0.0, self.squares / self.rows - self.mean**2)


def limits_of(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` limits between the values: between all of them, or where about as many rows lie below each as Spark ML has it."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = len(values) / (most + 1)
    below = np.cumsum(counts)
    out, target = [], stride
    for i in range(1, len(distinct)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def laid_out(limits: list[np.ndarray], by_run: Sequence[int] = ()) -> Layout:
    """Features with the most bins first, each in the first column of its kind that has room for it."""
    column, stride, sizes, by_row = [0] * len(limits), [1] * len(limits), [], 0
    for slow in (False, True):
        own = [f for f in range(len(limits)) if (f in by_run) == slow and len(limits[f])]
        for f in sorted(own, key=lambda f: -len(limits[f])):
            n = len(limits[f]) + 1
            place = next((c for c in range(by_row, len(sizes)) if sizes[c] * n <= CELLS), len(sizes))
            if place == len(sizes):
                sizes.append(1)
            column[f], stride[f] = place, sizes[place]
            sizes[place] *= n
        by_row = by_row if slow else len(sizes)
    return Layout(limits, column, stride, sizes, by_row)


def steady(changes: np.ndarray) -> list[int]:
    """Features that keep their values for long, given whether each differs from the row before (row, feature)."""
    shares = changes.mean(axis=0) if len(changes) else np.ones(changes.shape[1])
    kept = [int(f) for f in np.argsort(shares, kind="stable") if shares[f] <= CHANGES]
    while kept and changes[:, kept].any(axis=1).mean() > CHANGES_OF_ALL:
        kept.pop()
    return sorted(kept)


# --- on executors ----------------------------------------------------------------------


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack(_columns(batch)).tobytes()], pa.binary())], ["x"])


def _blocks_of(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, labels, rows = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            codes = np.concatenate(held, axis=1)
            slow = codes[layout.by_row :]
            starts = np.concatenate([[0], np.flatnonzero((slow[:, 1:] != slow[:, :-1]).any(axis=0)) + 1])
            lengths = np.diff(starts, append=rows).astype(np.int32)
            parts = codes[: layout.by_row], slow[:, starts], lengths, np.concatenate(labels)
            columns = [pa.array([number]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
            return pa.RecordBatch.from_arrays(columns, ["number", "codes", "slow", "lengths", "label"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, label = _columns(batch), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            if any(np.isnan(c).any() for c in (*x, label)):
                raise ValueError("inputs and labels of a fit must not be missing or NaN")
            held.append(layout.codes(x))
            labels.append(label)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                number, held, labels, rows = number + 1, [], [], 0
        if rows:
            yield block()

    return blocks


@dataclass(frozen=True)
class Walk:
    """How a row comes to its node: of the bits of ``ends`` each column's word leaves those that its code allows, all words one.

    ``deeper`` has the walks below those ends that are split themselves.
    """

    ends: list[int]
    words: dict[int, np.ndarray]
    deeper: dict[int, Walk]

    def names(self) -> list[int]:
        """The nodes by the numbers that ``placed`` gives; those walked past have no rows."""
        return [*self.ends, *(n for walk in self.deeper.values() for n in walk.names())]


def walk_of(cuts: Cuts, root: int = 1) -> Walk:
    ends: list[int] = []
    words: dict[int, np.ndarray] = {}
    every = np.uint64(2**64 - 1)

    def visit(node: int, level: int) -> int:
        if node not in cuts or level == WALKED:
            ends.append(node)
            return 1 << len(ends) - 1
        left, right = visit(2 * node, level + 1), visit(2 * node + 1, level + 1)
        column, goes = cuts[node]
        word = np.where(goes, every ^ np.uint64(right), every ^ np.uint64(left))
        words[column] = words[column] & word if column in words else word
        return left | right

    whole = visit(root, 0)
    kind = np.uint32 if len(ends) <= 32 else np.uint64
    words = {c: (word & np.uint64(whole)).astype(kind) for c, word in words.items()}
    return Walk(ends, words, {i: walk_of(cuts, n) for i, n in enumerate(ends) if n in cuts})


def placed(block: Block, walk: Walk, rows: np.ndarray | None = None, runs: np.ndarray | None = None) -> np.ndarray:
    """For each row, or those given with their runs, the number of its node in ``walk.names()``."""
    _, codes, slow, lengths = block
    word = by_run = None
    for c, allowed in walk.words.items():
        if c < len(codes):
            here = allowed.take(codes[c] if rows is None else codes[c].take(rows))
            word = here if word is None else np.bitwise_and(word, here, out=word)
        else:
            here = allowed.take(slow[c - len(codes)])
            by_run = here if by_run is None else by_run & here
    if by_run is not None:
        here = np.repeat(by_run, lengths) if rows is None else by_run.take(runs)
        word = here if word is None else np.bitwise_and(word, here, out=word)
    if word is None:
        at = np.zeros(int(lengths.sum()) if rows is None else len(rows), np.intp)
    else:
        # The exponent of a power of two.
        at = (word.astype(np.float64).view(np.int64) >> 52) - 1023
    if walk.deeper:
        runs = np.repeat(np.arange(len(lengths)), lengths) if rows is None else runs
        out, number = at.copy(), len(walk.ends)
        for i, below in walk.deeper.items():
            there = np.flatnonzero(at == i)
            out[there] = placed(block, below, there if rows is None else rows.take(there), runs.take(there)) + number
            number += len(below.names())
        at = out
    return at


def _left_out(number: int, n: int, rate: float, seed: int, tree: int) -> np.ndarray | None:
    """Rows of a block that a tree is not grown from, the same in each pass."""
    return None if rate >= 1.0 else np.random.default_rng([seed, tree, number]).random(n) >= rate


def _counting(layout: Layout, cuts: Cuts, wanted: list[int], sample: tuple[float, int, int]) -> Callable[[Iterator], Iterator]:
    """Rows and sums (node, feature, bin) and (rows, sum, sum of squares) of the wanted nodes, and the squares of the tree before."""

    def count(pairs: Iterator) -> Iterator:
        k, walk = len(wanted), walk_of(cuts)
        number_of = {node: i for i, node in enumerate(wanted)}
        slots = np.array([number_of.get(node, -1) for node in walk.names()])
        rows, sums = ([np.zeros(k * size) for size in layout.sizes] for _ in range(2))
        about, before = np.zeros((k, 3)), 0.0
        for block, (target, squares) in pairs:
            number, codes, slow, lengths = block
            before = before + squares
            out = _left_out(number, len(target), *sample)
            every = not cuts and out is None
            if every:
                y, which = target, None
                about[0] += len(y), y.sum(), y @ y
            else:
                slot = slots.take(placed(block, walk))
                if out is not None:
                    slot[out] = -1
                at = np.flatnonzero(slot >= 0)
                y, which = target.take(at), slot.take(at)
                about += np.stack([np.bincount(which, w, k) for w in (None, y, y * y)], axis=1)
            for c, size in enumerate(layout.sizes[: layout.by_row]):
                code = codes[c].astype(np.intp) if every else codes[c].take(at) + which * size
                rows[c] += np.bincount(code, minlength=k * size)
                sums[c] += np.bincount(code, weights=y, minlength=k * size)
            if not len(slow):
                continue
            # Rows and sums of each run in each node, and then of the codes that the runs have.
            if every:
                run, which, n, total = slice(None), None, lengths, np.add.reduceat(y, np.cumsum(lengths) - lengths)
            else:
                pair = np.repeat(np.arange(len(lengths)) * k, lengths).take(at) + which
                n, total = (np.bincount(pair, w) for w in (None, y))
                pair = np.flatnonzero(n)
                run, which, n, total = pair // k, pair % k, n.take(pair), total.take(pair)
            for c, size in enumerate(layout.sizes[layout.by_row :]):
                code = slow[c][run] if which is None else slow[c].take(run) + which * size
                rows[layout.by_row + c] += np.bincount(code, n, k * size)
                sums[layout.by_row + c] += np.bincount(code, total, k * size)
        yield (*(layout.by_feature([x.reshape(k, -1) for x in xs], k) for xs in (rows, sums)), about, before)

    return count


def _stepped(trees: Sequence[tuple[Cuts, Mapping[int, float], float, tuple[float, int, int]]], first: bool) -> Callable:
    """The target of the next tree after ``trees``, and by leaf of the last of them the sum of squares of the target it had.

    The target of the first tree is the label, that of later ones twice what is left of it.
    """

    def steps(pairs: Iterator) -> Iterator:
        walks = [(walk := walk_of(cuts), np.array([values.get(n, 0.0) * weight for n in walk.names()])) for cuts, values, weight, _ in trees]
        for block, (target, _) in pairs:
            for i, (walk, values) in enumerate(walks):
                at = placed(block, walk)
                if i == len(walks) - 1:
                    out = _left_out(block[0], len(target), *trees[i][3])
                    squares = np.bincount(at, target * target if out is None else np.where(out, 0.0, target * target), len(values))
                target = target - values.take(at)
                if first and i == 0:
                    target *= 2.0
            yield target, squares

    return steps


def _squares(states: Iterator) -> Iterator:
    yield sum((squares for _, squares in states), 0.0)


# --- on the driver ---------------------------------------------------------------------


def _kept(rdd: RDD) -> RDD:
    """One block per batch, so that two such tables can be read side by side."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


class Binned:
    """Training rows as blocks of codes, kept until ``release``, for any number of fits.

    ``table`` has the features and then the label, all doubles; a part that is lost is read again and must have its rows in the same order.
    """

    def __init__(self, table: DataFrame, rows: int, most: int, seed: int) -> None:
        self.most = most
        width = len(table.columns) - 1

        def read(some: DataFrame) -> np.ndarray:
            return np.concatenate([np.zeros(0), *(np.frombuffer(r[0]) for r in some.mapInArrow(_as_bytes, "x binary").collect())]).reshape(-1, width)

        enough = max(LIMIT_ROWS, most * most)
        values = read(table if rows <= enough else table.sample(False, enough / rows, seed))
        # No more bins than rows.
        limits = [limits_of(values[:, f], min(most, rows) - 1) for f in range(width)]
        # Rows as they stand in the files; what they tell changes how the codes are kept, and no result.
        head = read(table.limit(ROWS_SEEN))
        self.layout = layout = laid_out(limits, steady(head[1:] != head[:-1]))

        def block(r: Sequence) -> tuple[Block, np.ndarray]:
            codes, slow = (np.frombuffer(x, layout.kind) for x in (r[1], r[2]))
            lengths, label = np.frombuffer(r[3], np.int32), np.frombuffer(r[4])
            by_run = len(layout.sizes) - layout.by_row
            return (r[0], codes.reshape(layout.by_row, len(label)), slow.reshape(by_run, len(lengths)), lengths), label

        written = table.mapInArrow(_blocks_of(layout), "number long, codes binary, slow binary, lengths binary, label binary").rdd
        whole = written.map(block).persist(StorageLevel.MEMORY_AND_DISK)
        self.codes = _kept(whole.map(lambda b: b[0]))
        self.labels = _kept(whole.map(lambda b: (b[1], 0.0)))
        # Both are written before the rows they come from are given up.
        self.codes.zip(self.labels).count()
        whole.unpersist()

    def release(self) -> None:
        self.codes.unpersist()
        self.labels.unpersist()

    def added(self, states: RDD, count: Callable, size: int) -> list[np.ndarray]:
        """Sums over all tasks of what ``count`` yields, ``size`` bytes each; in the order of the parts if the driver adds."""
        counted = states.mapPartitions(count)

        def plus(a: tuple, b: tuple) -> tuple:
            return tuple(x + y for x, y in zip(a, b))

        if size * counted.getNumPartitions() > DRIVER_BYTES:
            return list(counted.treeReduce(plus))
        parts = counted.collect()
        out = parts[0]
        for part in parts[1:]:
            out = plus(out, part)
        return list(out)


def best_split(layout: Layout, rows: np.ndarray, sums: np.ndarray, node: Node, least: float) -> tuple[float, int, int] | None:
    """Gain in variance, feature and split; of equal ones that of the first feature, and the lowest."""
    below, total = rows.cumsum(axis=1)[:, :-1], sums.cumsum(axis=1)[:, :-1]
    above, rest = node.rows - below, node.total - total
    splits = np.array([len(x) for x in layout.limits])[:, None] > np.arange(below.shape[1])
    allowed = splits & (below >= max(1.0, least)) & (above >= max(1.0, least))
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, below * above / node.rows**2 * (total / below - rest / above) ** 2, -1.0)
    feature, split = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[feature, split]), feature, split


def grown(binned: Binned, states: RDD, depth: int, least: float, enough: float, sample: tuple[float, int, int]) -> tuple[dict[int, Node], Cuts, object]:
    """One tree on the targets in ``states``, its cuts, and the squares by leaf of the tree before it."""
    layout, nodes, cuts, counts, squares = binned.layout, {}, {}, {}, None
    at_once = max(1, TASK_BYTES // (16 * (sum(layout.sizes) + 1)))
    frontier = [1]
    for level in range(max(1, depth)):
        if level == 0:
            wanted = [1]
        else:
            wanted = [n if nodes[n].rows <= nodes[n + 1].rows else n + 1 for n in frontier[::2]]
        for i in range(0, len(wanted), at_once):
            group = wanted[i : i + at_once]
            size = 16 * len(group) * len(layout.limits) * layout.most
            rows, sums, about, before = binned.added(states, _counting(layout, dict(cuts), group, sample), size)
            squares = before if squares is None else squares
            for node, r, s, a in zip(group, rows, sums, about):
                counts[node] = r, s
                nodes[node] = Node(*a)
        if level:
            for node in wanted:
                parent, (r, s), (r0, s0) = nodes[node >> 1], counts[node], counts[node >> 1]
                own, rest = nodes[node], r0 - r
                # Bins without a row have no sum, whatever rounding leaves there.
                counts[node ^ 1] = rest, np.where(rest > 0, s0 - s, 0.0)
                nodes[node ^ 1] = Node(parent.rows - own.rows, parent.total - own.total, max(0.0, parent.squares - own.squares))
            for node in {n >> 1 for n in wanted}:
                del counts[node]
        after = []
        if level < depth:
            for n in frontier:
                node, found = nodes[n], best_split(layout, *counts[n], nodes[n], least) if nodes[n].rows else None
                if found is None or found[0] <= 0.0 or found[0] < enough:
                    continue
                node.gain, node.feature, node.split = found
                cuts[n] = layout.column[node.feature], layout.goes_left(node.feature, node.split)
                r, s = (x[node.feature, : node.split + 1].sum() for x in counts[n])
                # Which of the two is the smaller is known before they are counted; the squares of the lowest level come with the next tree.
                nodes[2 * n], nodes[2 * n + 1] = Node(r, s, 0.0), Node(node.rows - r, node.total - s, 0.0)
                after += [2 * n, 2 * n + 1]
        frontier = after
        if not frontier:
            break
    return nodes, cuts, squares


class HistogramTrees(GBTRegressor):
    """``GBTRegressor`` with this module's way to fit; what that has no part for is left to Spark ML."""

    def _plain(self) -> bool:
        """Squared loss of all features, without weights or rows kept aside."""
        asked = [p for p in ("weightCol", "validationIndicatorCol") if self.isDefined(p)]
        return (
            not asked and self.getLossType() == "squared" and self.getImpurity() == "variance"
            and self.getFeatureSubsetStrategy() == "all" and not self.getMinWeightFractionPerNode()
        )

    def binned(self, table: DataFrame, inputs: Sequence[str]) -> Binned | None:
        """The rows of a table as fits of any other parameters can share them; ``None`` without rows."""
        rows = table.count()
        doubles = [F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate((*inputs, self.getLabelCol()))]
        return Binned(table.select(*doubles), rows, self.getMaxBins(), self.getSeed()) if rows else None

    def fit_table(self, table: DataFrame, inputs: Sequence[str], shared: Binned | None = None) -> GBTRegressionModel:
        """``fit`` from the inputs and the label, without a vector a row; ``shared`` has them binned already."""
        if shared is not None and shared.most == self.getMaxBins() and self._plain():
            return self._copyValues(self._create_model(self._java_model(*self._boosted(shared))))
        own = self.binned(table, inputs) if self._plain() else None
        if own is None:
            return self.fit(VectorAssembler(inputCols=list(inputs), outputCol=self.getFeaturesCol()).transform(table))
        try:
            return self.fit_table(table, inputs, own)
        finally:
            own.release()

    def _fit_java(self, dataset: DataFrame) -> object:
        kinds = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        one = dataset.select(self.getFeaturesCol()).first() if self._plain() and not set(kinds) - {"numeric"} else None
        if one is None:
            return super()._fit_java(dataset)
        names = [f"_{i}" for i in range(one[0].size)]
        vector = dataset.select(vector_to_array(self.getFeaturesCol()).alias("_x"), self.getLabelCol())
        binned = self.binned(vector.select(*[F.col("_x")[i].alias(n) for i, n in enumerate(names)], self.getLabelCol()), names)
        try:
            return self._java_model(*self._boosted(binned))
        finally:
            binned.release()

    def _boosted(self, binned: Binned) -> tuple[Layout, list[dict[int, Node]], list[float]]:
        rate, seed, depth = self.getSubsamplingRate(), self.getSeed() & (1 << 63) - 1, self.getMaxDepth()
        codes, states, old, done, trees = binned.codes, binned.labels, None, [], []
        for m in range(self.getMaxIter()):
            sample = rate, seed, m
            pairs = codes.zip(states)
            nodes, cuts, squares = grown(binned, pairs, depth, self.getMinInstancesPerNode(), self.getMinInfoGain(), sample)
            self._told(trees, squares)
            # The pass over the new state has written it, so that the one before can go.
            if old is not None:
                old.unpersist()
            weight = 1.0 if m == 0 else self.getStepSize()
            values = {n: node.mean if node.rows else 0.0 for n, node in nodes.items() if n not in cuts}
            # Targets of later trees are twice what is left, so a step takes twice the leaf from them.
            done.append((cuts, values, weight if m == 0 else 2.0 * weight, sample))
            trees.append(nodes)
            old = states if states is not binned.labels else None
            if len(done) % TREES_BACK:
                states = _kept(pairs.mapPartitions(_stepped(done[-1:], m == 0)))
            else:
                states = _kept(codes.zip(binned.labels).mapPartitions(_stepped(list(done), True)))
        self._told(trees, sum(states.mapPartitions(_squares).collect()))
        for state in (old, states):
            if state is not None:
                state.unpersist()
        return binned.layout, trees, [t[2] if m == 0 else t[2] / 2.0 for m, t in enumerate(done)]

    @staticmethod
    def _told(trees: list[dict[int, Node]], squares: object) -> None:
        """The leaves of the last tree get the sums of squares that the rows had there."""
        if trees:
            nodes = trees[-1]
            for n, s in zip(walk_of({n: (0, np.ones(1, bool)) for n, node in nodes.items() if node.feature is not None}).names(), squares):
                if nodes[n].feature is None:
                    nodes[n].squares = float(s)

    def _java_model(self, layout: Layout, trees: list[dict[int, Node]], weights: list[float]) -> object:
        context = SparkContext._active_spark_context
        jvm, gateway, width = context._jvm, context._gateway, len(layout.limits)
        tree, regression = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression
        variance = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

        def java(nodes: dict[int, Node], n: int) -> tuple[object, float | None]:
            """The node, and its prediction if it is a leaf: children that predict the same are one leaf, as in Spark ML."""
            node = nodes[n]
            stats = gateway.new_array(jvm.double, 3)
            stats[0], stats[1], stats[2] = float(node.rows), float(node.total), float(node.squares)
            about = variance(stats, int(node.rows))
            mean, impurity = float(node.mean) if node.rows else 0.0, float(node.impurity) if node.rows else 0.0
            if node.feature is not None:
                (left, a), (right, b) = java(nodes, 2 * n), java(nodes, 2 * n + 1)
                if a is None or a != b:
                    split = tree.ContinuousSplit(node.feature, float(layout.limits[node.feature][node.split]))
                    return tree.InternalNode(mean, impurity, float(node.gain), left, right, split, about), None
                mean = a
            return tree.LeafNode(mean, impurity, about), mean

        made = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
        for i, nodes in enumerate(trees):
            made[i] = regression.DecisionTreeRegressionModel(f"{self.uid}_tree{i}", java(nodes, 1)[0], width)
        shares = gateway.new_array(jvm.double, len(trees))
        for i, w in enumerate(weights):
            shares[i] = float(w)
        return regression.GBTRegressionModel(self.uid, made, shares, width)
