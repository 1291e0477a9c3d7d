"""Incremental ingestion as file streams: shards in, tables out, resumable by checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import tables

FILES_PER_BATCH = 50
Transform = Callable[[DataFrame], DataFrame]


def shard_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New Parquet shards of a folder (or glob), a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_shards(
    spark: SparkSession, path: str, schema: StructType, target: str, checkpoint: str,
    transform: Transform | None = None, files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Load every shard not loaded yet, then stop.

    The checkpoint remembers files, not row counts, so a run that was killed
    resumes where it stopped: nothing is lost and nothing is loaded twice.
    """
    rows = shard_stream(spark, path, schema, files_per_batch)
    rows = transform(rows) if transform else rows
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


LEDGER = "stream string, batch_id long, step string"


class Ledger:
    """Which steps of which batches are done, kept as appended rows beside a table."""

    def __init__(self, spark: SparkSession, path: str, stream: str):
        self.spark, self.path, self.stream = spark, path, stream
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)

    def done(self, batch_id: int) -> set[str]:
        rows = self.spark.read.schema(LEDGER).parquet(self.path)
        return {r["step"] for r in rows.filter((F.col("stream") == self.stream) & (F.col("batch_id") == batch_id)).select("step").distinct().collect()}

    def add(self, batch_id: int, step: str) -> None:
        self.spark.createDataFrame([(self.stream, batch_id, step)], LEDGER).coalesce(1).write.mode("append").parquet(self.path)


def upsert_batch(
    batch: DataFrame, batch_id: int, table: tables.Keyed, ledger: Ledger, order: Sequence[str], replace: bool = False, feed: str | None = None,
) -> None:
    """One batch of an upserting stream. What the ledger lists of it is not done again.

    The feed of changes is taken and listed before the table changes, so a batch repeated between the two finds it whole.
    """
    done = ledger.done(batch_id)
    if "table" in done:
        return
    if feed and "feed" not in done:
        tables.upsert_feed(batch, table, *order).write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")
        ledger.add(batch_id, "feed")
    if replace and batch_id == 0:
        tables.overwrite(tables.latest_per_key(batch.select(*table.schema.fieldNames()), table.keys, *order), table)
    else:
        tables.upsert(batch, table, *order)
    ledger.add(batch_id, "table")


def upsert_shards(
    spark: SparkSession, path: str, schema: StructType, table: tables.Keyed, checkpoint: str, order: Sequence[str],
    transform: Transform | None = None, files_per_batch: int = FILES_PER_BATCH, replace: bool = False, feed: str | None = None,
) -> StreamingQuery:
    """Upsert every batch of new shards into a keyed table, which is made if it is missing.

    With ``replace`` the first batch of a checkpoint replaces the table and the
    later ones are upserted: a full refresh. ``feed`` is a folder for the changes
    of each batch.

    The ledger in the checkpoint's folder lists finished batches: one that the
    stream repeats after a failure writes nothing. Keys seen in earlier batches
    are settled by the table itself; no deduplication state is kept in the stream.
    """
    rows = shard_stream(spark, path, schema, files_per_batch)
    rows = transform(rows) if transform else rows
    ledger = Ledger(spark, f"{checkpoint.rstrip('/')}-ledger", checkpoint)
    empty = spark.createDataFrame([], StructType([*table.schema.fields, StructField(tables.BUCKET, IntegerType())]))
    empty.write.mode("ignore").partitionBy(tables.BUCKET).parquet(table.path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, table, ledger, order, replace, feed)

    return (
        rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def distinct_records(rows: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Drop repeated keys in an unbounded stream; state is kept only for the given delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def append_log(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append log entries as they arrive, then stop."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_observed(
    rows: DataFrame, target: str, summary: str, checkpoint: str, ok: Column, sources: Sequence[str],
) -> StreamingQuery:
    """Appends landed rows as they arrive and, per batch, the counts that the writing job took of them.

    A batch has a folder of its own in both places, so one that is repeated after a failure replaces itself.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        counts = tables.write_observed(batch, f"{target}/batch={batch_id}", ok, sources, mode="overwrite")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{summary}/batch={batch_id}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
