"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and holds centroids only. Every vector is assigned to
a leaf. A query walks the tree best bin first: a priority queue holds nodes by the inner
product of query and centroid, and leaves come out in the order to visit. Leaf visits are
widened until the calibration queries, whose true neighbours are known from all vectors,
find the wanted share of them. The vectors of a leaf are cut into bounded blocks, which meet
blocks of the queries that visit the leaf; only the nearest of each meeting move on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.common import bounded_batches, pick, stored

#: Vectors to fit the tree on; leaves per fitted vector; children of a node.
FIT_ROWS, ROWS_PER_LEAF, BRANCHES = 20_000, 100, 8
CALIBRATION, RECALL = 256, 0.97
BLOCK_ROWS = 1024


class Tree:
    """Nodes with centroids; ``children[i]`` is empty for a leaf, ``leaf[i]`` its number."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int, seed: int = 7):
        self.centroids, self.children, self.leaf = [vectors.mean(axis=0)], [[]], []
        rng = np.random.default_rng(seed)
        todo = [(0, vectors)]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf_rows:
                continue
            centres, label = _k_means(own, min(BRANCHES, -(-len(own) // leaf_rows)), rng)
            if len(centres) < 2:
                continue
            for j, centre in enumerate(centres):
                self.children[node].append(len(self.centroids))
                self.centroids.append(centre)
                self.children.append([])
                todo.append((len(self.centroids) - 1, own[label == j]))
        self.centroids = np.array(self.centroids)
        leaves = [i for i, c in enumerate(self.children) if not c]
        self.leaf = np.full(len(self.children), -1)
        self.leaf[leaves] = np.arange(len(leaves))
        self.leaves = len(leaves)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node the child with the nearest centroid."""
        at = np.zeros(len(vectors), np.int64)
        half = (self.centroids**2).sum(axis=1) / 2
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            kids = np.array(self.children[node], np.int64)
            if not len(rows) or not len(kids):
                at[rows] = self.leaf[node]
                continue
            best = np.argmax(vectors[rows] @ self.centroids[kids].T - half[kids], axis=1)
            todo += [(int(k), rows[best == j]) for j, k in enumerate(kids)]
        return at

    def visits(self, query: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, and more until they hold ``least`` of the ``rows`` per leaf."""
        out, queue, held = [], [(0.0, 0)], 0
        near = self.centroids @ query
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(int(self.leaf[node]))
                held += 0 if rows is None else int(rows[out[-1]])
            for kid in self.children[node]:
                heapq.heappush(queue, (-near[kid], kid))
        return out


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres (distinct, each with rows) and the nearest centre of each row."""
    centres = np.unique(x[rng.choice(len(x), k, replace=False)], axis=0)
    for _ in range(rounds):
        label = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        used, label = np.unique(label, return_inverse=True)
        centres = np.array([x[label == j].mean(axis=0) for j in range(len(used))])
    label = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
    used, label = np.unique(label, return_inverse=True)
    return centres[used], label


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that are neither null nor zero and have finite components only, as doubles.

    Vectors of another length than the most common one (the shorter of ties) have no inner
    product with the others and take no part either, nor do rows without an id.
    """
    v = F.col("embedding").cast("array<double>")
    rows = pick(table, "vec_id", "embedding").select("vec_id", v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def nearest(scores: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(index of the query, index of the candidate, score) of the k largest per query, ties to smaller ids.

    ``own`` and ``rows`` are the row numbers of queries and candidates: a query is no candidate of itself. Candidates come from the product of the blocks; their scores are summed anew row by row,
    so that equal vectors score equally wherever they stand.
    """
    out = []
    for i in range(len(q)):
        s = np.where(rows == own[i], -np.inf, scores[i])
        few = min(k, len(s))
        least = np.partition(s, len(s) - few)[len(s) - few]
        at = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least))) & (rows != own[i]))
        exact = (v[at] * q[i]).sum(axis=1)
        first = np.lexsort((rows[at], ids[at], -exact))[:k]
        out += [(i, int(at[j]), float(exact[j])) for j in first]
    return out


def _blocked(rows: DataFrame, side: str) -> DataFrame:
    """(row, vec_id, v) of each leaf in blocks of about BLOCK_ROWS: leaf, and ``side`` with block, rows, ids, vectors."""
    counts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_n"))
    dealt = rows.join(counts, "leaf").withColumn("block", F.pmod(F.xxhash64("row"), "_n"))
    members = dealt.groupBy("leaf", "block").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("m"))
    return members.select("leaf", F.struct("block", F.col("m.row").alias("rows"), F.col("m.vec_id").alias("ids"), F.flatten("m.v").alias("vectors")).alias(side))


def search(table: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query by inner product, itself left out.

    Fewer than k candidates: all of them. Vectors that ``usable`` leaves out give and
    get no rows. Equal vectors all count; a repeated id is one candidate for each of its rows, and each of
    its rows asks for itself, finding the others. An empty table gives no rows.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    # Rows are told apart by a number of their own, given once, when they are written.
    rows = stored(usable(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    order = F.xxhash64("vec_id", F.lit(7))
    sample = np.array([r["v"] for r in rows.orderBy(order, "vec_id", "row").limit(FIT_ROWS).select("v").collect()])
    tree = Tree(sample, ROWS_PER_LEAF)
    # The tree goes to the tasks with the code: FIT_ROWS bounds its size, whatever the data.

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=tree.assign(np.stack(f["v"].to_numpy())) if len(f) else [])

    indexed = stored(rows.mapInPandas(assign, "vec_id long, v array<double>, row long, leaf long"), "index")
    queries = indexed.where(is_query)
    most = _calibrated(indexed, queries, tree, k, recall)
    held = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row per leaf: FIT_ROWS bounds them, too
        held[r["leaf"]] = r["count"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                # One more than asked for: the query lies in one of the leaves itself.
                leaves = tree.visits(np.asarray(v.as_py()), most, held, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(leaves), pa.int64()), pa.array(leaves, pa.int64())], names=["row", "leaf"])

    # Walks are pairs of numbers; vectors join them where blocks are made.
    walks = queries.select("row", "v").mapInArrow(visit, "row long, leaf long")
    asks = _blocked(walks.join(queries.select("row", "vec_id", "v"), "row"), "q")
    holds = _blocked(indexed, "c")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (own, own_ids, q), (rows_, ids, v) = (_block(batch.column(side)[at]) for side in (0, 1))
                found = nearest(q @ v.T, own, rows_, ids, q, v, k)
                i, j, s = zip(*found) if found else ((), (), ())
                i, j = np.array(i, np.int64), np.array(j, np.int64)
                arrays = [pa.array(x) for x in (own[i], own_ids[i], rows_[j], ids[j], np.array(s, float))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "query_id", "at", "vec_id", "score"])

    cells = asks.join(holds, "leaf").select("q", "c").repartition(F.xxhash64("q.rows", "c.rows"))
    found = cells.mapInArrow(meet, "row long, query_id long, at long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "at"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _block(cell: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids, vectors = (cell[name].values.to_numpy(zero_copy_only=False) for name in ("rows", "ids", "vectors"))
    return rows, ids, vectors.reshape(len(rows), -1)


def _calibrated(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaf visits that find the wanted share of the true neighbours of a fixed number of queries.

    Their true neighbours come from one pass over all vectors, block by block.
    """
    trial = queries.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "row").limit(CALIBRATION).select("row", "v").collect()
    if not trial:
        return 1
    own, q = np.array([r["row"] for r in trial]), np.array([r["v"] for r in trial])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v, ids, rows, leaf = np.stack(f["v"].to_numpy()), *(f[c].to_numpy() for c in ("vec_id", "row", "leaf"))
                found = nearest(q @ v.T, own, rows, ids, q, v, k)
                yield pd.DataFrame([(i, rows[j], ids[j], leaf[j], s) for i, j, s in found], columns=["i", "row", "vec_id", "leaf", "score"])

    found = indexed.mapInPandas(scan, "i long, row long, vec_id long, leaf long, score double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vec_id", "row"))
    truth = found.withColumn("r", rank).where(F.col("r") <= k).select("i", "leaf").collect()
    walks = [{leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves), 1)} for v in q]
    needed = np.sort([walks[r["i"]][r["leaf"]] for r in truth])
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1
