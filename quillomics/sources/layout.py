"""File layouts over several columns: Z-order clustering, and what files a filter has to read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import sortable

#: Ranges that a column's values are counted in, per cell.
FINENESS = 4


def cell_limits(df: DataFrame, column: str, cells: int) -> list:
    """Least values of the second to last of ``cells`` cells with about equal numbers of rows, in order.

    Values are counted first, so a value that many rows share is one row afterwards. Ranges of values are summed up where
    they are; FINENESS * cells rows reach the driver. A frequent value fills a cell alone, so there may be fewer limits.
    """
    counts = df.select(F.col(column).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.repartitionByRange(FINENESS * cells, "v").groupBy(F.spark_partition_id().alias("range"))
    found = sorted((tuple(r) for r in ranges.agg(F.min("v").alias("least"), F.sum("n").alias("n")).select("least", "n").collect()))
    total, limits, below, passed = sum(n for _, n in found), [], 0, 0
    for least, n in found:
        if below * cells // total > passed:
            limits.append(least)
            passed = below * cells // total
        below += n
    return limits


def cell_of(value: Column, limits: Sequence) -> Column:
    """Number of limits at or below the value, by halving; null lies in cell 0."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(limits[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(value.isNull(), 0).otherwise(between(0, len(limits)))


def interleaved(cells: Sequence[Column], bits: int) -> Column:
    """A long whose bits come from the cells in turn, highest bits first."""
    n = len(cells)
    if n * bits > 63:
        raise ValueError("the bits of all columns must fit a long")
    parts = [
        F.shiftleft(F.shiftright(c.cast("bigint"), k).bitwiseAND(F.lit(1).cast("bigint")), k * n + n - 1 - i)
        for i, c in enumerate(cells) for k in range(bits)
    ]
    return reduce(Column.bitwiseOR, parts)


def z_order(df: DataFrame, columns: Sequence[str], bits: int = 5) -> Column:
    """Place of each row on the Z curve over the columns, each cut into 2^bits cells of about equal row counts."""
    return interleaved([cell_of(F.col(c), cell_limits(df, c, 1 << bits)) for c in columns], bits)


def zordered(df: DataFrame, *columns: str, files: int | None = None, bits: int = 5) -> DataFrame:
    """The rows in the partitions and the order that ``write_zordered`` writes."""
    # A column of its own: as an expression it would be worked out again in every comparison of the sort.
    place = "_place" + "_" * max(map(len, df.columns))
    placed = df.withColumn(place, z_order(df, columns, bits))
    order = [F.col(place), F.xxhash64(*[sortable(f) for f in df.schema.fields])]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(place, *columns).drop(place)


def write_zordered(df: DataFrame, path: str, *columns: str, files: int | None = None, bits: int = 5) -> None:
    """Files that each hold a small box of the columns, so that a filter on any of them skips most files.

    Rows are dealt out by ranges of the Z curve, continued by a hash of the row, so cells that many rows share go to
    several files. Numbers, dates and strings have their own order; null lies in the lowest cell. ``files`` is the number
    of files, the number of shuffle partitions if None.
    """
    zordered(df, *columns, files=files, bits=bits).write.mode("overwrite").parquet(path)


def file_ranges(df: DataFrame, *columns: str) -> DataFrame:
    """Per file of a table read from files: file_path, n_rows and the least and greatest value of each column."""
    measures = [f(c).alias(f"{side}_{c}") for c in columns for side, f in (("least", F.min), ("greatest", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("n_rows"), *measures)


def files_for(ranges: DataFrame, column: str, value) -> DataFrame:
    """Files, of those that ``file_ranges`` gives, whose range holds the value."""
    return ranges.filter((F.col(f"least_{column}") <= F.lit(value)) & (F.col(f"greatest_{column}") >= F.lit(value)))
