"""Sharding by a Hilbert curve over several metadata dimensions.

Every dimension is cut into cells of about equal row counts, a row's cells give its index on the curve, rows are sorted
by that index, and the sorted sequence is cut into runs. Neighbours on the curve are neighbours in every dimension, so
each run spans a small box and a filter on any dimension skips most runs.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.layout import cell_limits, cell_of
from .ordering import positions, stored


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Transitions of the curve in ``dims`` dimensions: next state and digit for state * 2^dims + cell bits.

    A state is an entry corner and a direction; digits follow the Gray code seen from that corner.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turned(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank = {gray(i): i for i in range(size)}

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    following, digits = [], []
    for state in range(size * dims):
        corner, axis = divmod(state, dims)
        for cell in range(size):
            digit = rank[turned(cell ^ corner, axis + 1)]
            entry = gray(2 * ((digit - 1) // 2)) if digit else 0
            shift = 0 if not digit else trailing_ones(digit - 1 if digit % 2 == 0 else digit) % dims
            following.append((corner ^ turned(entry, -(axis + 1))) * dims + (axis + shift + 1) % dims)
            digits.append(digit)
    return following, digits


def curve_index(cells: list[Column], bits: int) -> Column:
    """Index on the curve of cells in [0, 2^bits), a long."""
    dims = len(cells)
    following, digits = (F.lit(t) for t in curve_tables(dims))
    levels = F.array(*[
        reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(c.cast("int"), k).bitwiseAND(1), i) for i, c in enumerate(cells)])
        for k in reversed(range(bits))
    ])

    def step(acc: Column, level: Column) -> Column:
        at = acc["state"] * (1 << dims) + level
        index = F.shiftleft(acc["index"], dims) + F.get(digits, at)
        return F.struct(index.alias("index"), F.get(following, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(levels, start, step, lambda acc: acc["index"])


def on_curve(df: DataFrame, dims: Mapping[str, Column], bits: int = 4, name: str = "curve") -> DataFrame:
    """Adds the curve index over ``dims`` (label: column expression), each cut into at most 2^bits cells.

    Cells hold about equal numbers of rows: their limits are values at equal steps of the counts of all values in
    order, whole strings included. A null lies in the lowest cell. An empty table stays empty.
    """
    taken = {k: f"__dim{i}" for i, k in enumerate(dims)}
    values = df.select(*[c.alias(taken[k]) for k, c in dims.items()])
    cells = [cell_of(c, cell_limits(values, taken[k], 1 << bits)) for k, c in dims.items()]
    return df.withColumn(name, curve_index(cells, bits))


def write_runs(df: DataFrame, path: str, dims: Mapping[str, Column], runs: int, bits: int = 4) -> None:
    """Writes the rows as ``runs`` Parquet files, each a run of the curve, so that filters on any dimension skip files."""
    placed = on_curve(df, dims, bits, "__curve")
    placed.repartitionByRange(runs, "__curve").sortWithinPartitions("__curve").drop("__curve").write.parquet(path)


def shards(docs: DataFrame, n_shards: int = 8, bits: int = 4) -> DataFrame:
    """Runs of equal row counts along the curve over language, source and size: one row per document.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (null text: 0), shard, slot
    (place in the shard, from 0) and curve. Shard row counts differ by one at most. Ties on the curve follow doc_id,
    then checksum and size; only rows equal in all of these are interchangeable. A null language, source or doc_id
    sorts first. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.col("lang").alias("__lang"), F.col("source").alias("__source"),
    ), "curve-rows")
    total = slim.count()
    if not total:
        return slim.select("doc_id", "size", "text_crc32", *[F.lit(None).cast("long").alias(c) for c in ("shard", "slot", "curve")])
    placed = on_curve(slim, {"lang": F.col("__lang"), "source": F.col("__source"), "size": F.col("size")}, bits)
    placed = placed.select("doc_id", "size", "text_crc32", "curve")
    placed = positions(placed, [F.col(c) for c in ("curve", "doc_id", "text_crc32", "size")], "__position", "curve-order")
    # Whole numbers throughout: div() truncates, so shard s starts at the least position p with p * n >= s * total.
    shard = F.expr(f"(__position * {n_shards}) div {total}")
    slot = F.col("__position") - F.expr(f"(__shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("__shard", shard).select(
        "doc_id", "size", "text_crc32", F.col("__shard").alias("shard"), slot.alias("slot"), "curve",
    )
