"""Top-k with one tie rule: value first, then the smaller key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


# Parts of a group that are ranked on their own first.
PARTS = 32


def _order(value: str, key: str, ascending: bool = False) -> list[Column]:
    first = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return [first, F.col(key).asc()]


def top_n(df: DataFrame, n: int, value: str, key: str, ascending: bool = False) -> DataFrame:
    """The ``n`` best rows; planned as a top-k per task and one merge of ``n`` rows."""
    return df.orderBy(*_order(value, key, ascending)).limit(n)


def ranked_top(df: DataFrame, n: int, value: str, key: str, ascending: bool = False, out: str = "rank") -> DataFrame:
    """``top_n`` with its rank. The unpartitioned window sees at most ``n`` rows."""
    over_few = Window.orderBy(*_order(value, key, ascending))
    return top_n(df, n, value, key, ascending).withColumn(out, F.row_number().over(over_few))


def top_per_group(
    df: DataFrame, n: int, value: str, key: str, by: Sequence[str], ascending: bool = False, out: str = "rank"
) -> DataFrame:
    """``n`` best rows per group; the rank limit is applied before the shuffle too.

    Ranked first in parts of each group, by key, so that the task of a group sees
    ``n`` rows of each part at most, however many tasks there were.
    """
    best = _order(value, key, ascending)
    parts = df.withColumn("_part", F.pmod(F.hash(key), F.lit(PARTS)))
    first = Window.partitionBy(*by, "_part").orderBy(*best)
    few = parts.withColumn(out, F.row_number().over(first)).filter(F.col(out) <= n).drop("_part")
    return few.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col(out) <= n)
