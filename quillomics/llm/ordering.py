"""Positions of rows in a global order, without a task that holds more than its range of keys."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: monotonically_increasing_id() keeps the row's place in its partition in so many low bits.
_PLACE_BITS = 33


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared scratch folder and read again: computed once, and no lineage to redo.

    Shuffle files behind them are of no use afterwards, but stay on the executors' disks until the driver collects the
    garbage that names them; so it does that here.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` gave and that nothing reads any more: what came of them is itself stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def positions(df: DataFrame, order: Sequence[Column], name: str, label: str = "ordered") -> DataFrame:
    """The rows with their place, from 0, in the order given: a long column ``name``.

    Rows are dealt out by ranges of the order and sorted there; a row's place in its range comes with the sort. What
    meets in one task afterwards is one count per range. The order must be complete (equal keys only for rows that are
    equal), else places of ties are arbitrary.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__place", F.monotonically_increasing_id()), label)
    ranged = ranged.withColumn("__range", F.shiftright("__place", _PLACE_BITS))
    # One row per range of the sort: bounded by the number of shuffle partitions.
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("__range").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    starts = spark.createDataFrame(starts, "__range long, __start long")
    place = F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        ranged.join(F.broadcast(starts), "__range")
        .withColumn(name, F.col("__start") + place)
        .drop("__range", "__start", "__place")
    )
