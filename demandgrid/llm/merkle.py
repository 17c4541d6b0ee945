"""Merkle manifest of a table: a tree of digests per source, and one over the sources.

Leaves are numbered by a range partitioning of the narrow digest table and offsets per range,
so no task holds a source. Numbers are cut into chunks of ``ARITY ** LEVELS``: a run never
crosses a chunk. Inside a chunk one sort serves all levels. At level i the nodes stand on the
rows that begin a node, ``ARITY ** i`` rows apart: lag and lead columns of that fixed offset,
masked by the slot in the run and the run's length, supply the siblings, the first child's row
hashes the parent, and the siblings are carried on to the other rows of the node. Chunk
digests are the nodes of the next round, until one is left per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.common import pick, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, a fixed value of the manifest.
ARITY = 3
#: Levels of a round: a window holds ARITY ** LEVELS rows at most.
LEVELS = 7


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The digest of a row with ``text`` as its text."""
    return digest(*(field(F.col(c)) for c in COLUMNS[:-1]), field(text))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order`` within the group) and ``n`` (rows of the group).

    Rows equal in group and order must be equal in all columns. ``group`` is never null.
    """
    # Equal rows may be many; they are told apart by where they were read, so that ranges divide them, too.
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [group, *order, "_row"]
    ranged = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranged")
    # A row per range and group that meets it: ranges and groups, not rows.
    counts = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("n")
    )
    return ranged.join(base, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def climbed(nodes: DataFrame, group: str) -> DataFrame:
    """One round up from (group, pos, n, node): adds ``chunk``, ``top`` and ``path``.

    ``top`` is the digest of the chunk, on its first row. ``path`` lists (left, right), the digests
    of the run beside the row's node, for each level at which the group has more than one node.
    """
    rows = nodes.withColumns({"chunk": F.expr(f"pos div {ARITY**LEVELS}"), "_d": F.col("node")})
    line = Window.partitionBy(group, "chunk").orderBy("pos")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.lit("")
    for level in range(LEVELS):
        step = ARITY**level
        count = F.expr(f"(n + {step - 1}) div {step}")
        index = F.expr(f"pos div {step}")
        slot = index % ARITY
        run = F.least(F.lit(ARITY), count - (index - slot))
        begins = F.col("pos") % step == 0
        near = {f"_lag{j}": F.lag("_d", j * step).over(line) for j in range(1, ARITY)}
        near |= {f"_lead{j}": F.lead("_d", j * step).over(line) for j in range(1, ARITY)}
        rows = rows.withColumns(near)
        left = F.concat(*(F.when(slot >= j, F.col(f"_lag{j}")).otherwise(nothing) for j in range(ARITY - 1, 0, -1)))
        right = F.concat(*(F.when(slot + j < run, F.col(f"_lead{j}")).otherwise(nothing) for j in range(1, ARITY)))
        beside = F.when(begins & (count > 1), F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(count > 1, digest(F.col("_d"), right)).otherwise(F.col("_d"))
        rows = rows.withColumns({f"_beside{level}": beside, "_d": F.when(F.col("pos") % (step * ARITY) == 0, parent)})
        rows = rows.withColumn(f"_beside{level}", F.last(f"_beside{level}", ignorenulls=True).over(upto)).drop(*near)
    pairs = [f"_beside{level}" for level in range(LEVELS)]
    path = F.filter(F.array(*pairs), lambda pair: pair.isNotNull())
    return rows.withColumn("path", path).withColumnRenamed("_d", "top").drop(*pairs)


def with_paths(nodes: DataFrame, group: str, above: DataFrame | None = None) -> DataFrame:
    """``nodes`` (group, pos, n, node, ...) with ``path`` to the root of the group, and ``top``, that root.

    ``nodes`` must be a stored table. With ``above`` (group, path, and more columns), the paths go on with those of
    that table, whose other columns are added, too. Nothing but the size of the largest group goes to the driver.
    """
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        top = climbed(rounds[-1], group).where(F.col("pos") % ARITY**LEVELS == 0)
        rounds.append(stored(top.select(group, F.col("chunk").alias("pos"), F.expr(f"(n + {ARITY**LEVELS - 1}) div {ARITY**LEVELS}").alias("n"), F.col("top").alias("node")), "tops"))
        most = -(-most // ARITY**LEVELS)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    known = rounds[-1].select(group, F.col("pos").alias("chunk"), F.col("node").alias("top"), *([no_path.alias("path")] if above is None else []))
    if above is not None:
        known = known.join(above, group)
    # A lone leaf is its own root: there is one round at least, in which nothing is hashed.
    for at in range(max(0, len(rounds) - 2), -1, -1):
        own = climbed(rounds[at], group).drop("top").withColumnRenamed("path", "_path")
        joined = own.join(known, [group, "chunk"]).withColumn("path", F.concat("_path", "path")).drop("_path", "chunk")
        if at:
            joined = stored(joined.withColumnRenamed("pos", "chunk").drop("n", "node"), "paths")
        known = joined
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the digests beside its path."""
    return F.aggregate(path, start, lambda own, pair: digest(pair["left"], own, pair["right"]))


def manifest(rows: DataFrame, altered: Column | None = None) -> DataFrame:
    """One row per row of ``rows``: doc_id, leaf, subroot, root, path, altered.

    ``path``: (left, right) per level from the leaf over the subroot to the root. ``altered``: the leaf with the
    text ``altered`` (a column of the table's columns) in place of the row's own; without it, the leaf.

    A null value enters a leaf as ``-``, an empty text as ``0:``; texts are hashed whole, however long. Within a source leaves
    ascend by doc_id, null first, those of one id by their digest, so that repeated rows are leaves of their own beside each other.
    Rows without a source are a source of their own, the first one. An empty table gives no rows; other columns are ignored.
    """
    picked = pick(rows, *COLUMNS)
    other = leaf(altered) if altered is not None else leaf(F.col("text"))
    # Null comes before every source, also the empty one, without null keys in joins.
    src = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    leaves = stored(picked.select(src.alias("src"), "doc_id", leaf(F.col("text")).alias("node"), other.alias("altered")), "leaves")
    nodes = stored(numbered(leaves, "src", "doc_id", "node", "altered"), "nodes")
    subroots = with_paths(nodes, "src").where("pos = 0").select("src", F.col("top").alias("node"), F.lit(0).alias("all"))
    subroots = stored(subroots, "subroots")
    over = with_paths(stored(numbered(subroots, "all", "src", "node"), "sources"), "all")
    over = stored(over.select("src", "path", F.col("top").alias("root")), "roots")
    out = with_paths(nodes, "src", over)
    return out.select("doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", "path", "altered")


def verified(rows: DataFrame, altered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: does each altered row still prove the root?

    ``proof_sha256`` is the digest of the proof: all digests beside the path, level by level, left to right.
    """
    proof = F.array_join(F.transform("path", lambda pair: F.concat(pair["left"], pair["right"])), "")
    told = manifest(rows, altered).withColumn("folded_root", folded(F.col("altered"), F.col("path")))
    return told.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
