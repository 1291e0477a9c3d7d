"""Deterministic top-k, globally and per group.

Each ordering is completed with every remaining output column, so a limit never
depends on how rows happened to be laid out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField, VariantType

UNSORTABLE = (MapType, VariantType)


def sortable(field: StructField) -> Column:
    """The column, or its JSON text if its type has no order."""
    c = F.col(f"`{field.name}`")
    return F.to_json(c) if isinstance(field.dataType, UNSORTABLE) else c


def tie_break(df: DataFrame) -> list[Column]:
    """All columns; those without an order come last, as text."""
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, UNSORTABLE)]
    return [sortable(f).asc_nulls_last() for f in [*plain, *(f for f in df.schema.fields if f not in plain)]]


def top_k(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """Global top k; planned as TakeOrderedAndProject, so nothing is shuffled but k rows per task.

    No k means all rows, unordered: a full sort is left to the caller.
    """
    return df if k is None else df.orderBy(*order, *tie_break(df)).limit(max(1, k))


# Intermediate merge points per group; bounds what any one task ranks.
SPREAD = 32


def _ranked(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column], rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    n: int | None,
    *order: Column,
    rank_as: str | None = None,
    spread: int = SPREAD,
) -> DataFrame:
    """Top n rows of each group; all rows if n is None.

    The rank filter sits directly on the window, so every map task keeps at most
    n rows per group before the shuffle. Those rows still add up for a group that
    occurs in every task of a very large scan, so they are merged in two steps:
    first within ``spread`` shares of the input tasks, then per group.
    """
    rank = rank_as or "_rank"
    order = [*order, *tie_break(df)]
    if n is None:
        return df if not rank_as else df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if n > 1 and spread > 1:
        shared = df.withColumn("_share", F.spark_partition_id() % spread)
        df = _ranked(shared, [*keys, "_share"], n, order, "_rank").drop("_share", "_rank")
    ranked = _ranked(df, keys, n, order, rank)
    return ranked if rank_as else ranked.drop(rank)


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first under ``order``."""
    return top_n_per_group(df, keys, 1, *order)


def abs_desc(name: str) -> Column:
    return F.abs(F.col(name)).desc_nulls_last()
