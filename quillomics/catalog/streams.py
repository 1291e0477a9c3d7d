"""Incremental ingestion with its checking SQL: each stream is compared with the batch result."""

from pyspark.sql import functions as F

from ..operators import records as op
from ..session import scratch_path
from ..sources import tables
from ..streaming import ingest
from . import query


def shards(t, table):
    """Glob of a table's shards, whether it is one file or a folder of files."""
    return f"{t.sf_dir}/{table}.parque[t]"


@query("s01_append_shards", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def _(t):
    """Load all shards, run again, and find nothing loaded twice."""
    target, checkpoint = scratch_path(t.spark, "shards"), scratch_path(t.spark, "shards-cp")
    for _ in range(2):
        ingest.append_shards(
            t.spark, shards(t, "lineitem"), t("lineitem").schema, target, checkpoint,
            lambda rows: rows.select("l_orderkey", "l_linenumber", "l_extendedprice"),
        ).awaitTermination()
    return t.spark.read.parquet(target)


UPSERT_SQL = """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""


@query("s02_upsert_shards", UPSERT_SQL)
def _(t):
    """The latest order of every customer, kept by an upserting stream."""
    columns = ["o_custkey", "o_orderkey", "o_totalprice"]
    schema = t("orders").select(*columns).schema
    table = tables.Keyed(scratch_path(t.spark, "latest"), schema, ("o_custkey",), buckets=8)
    ingest.upsert_shards(
        t.spark, shards(t, "orders"), t("orders").schema, table, scratch_path(t.spark, "latest-cp"), ["o_orderkey"],
        lambda rows: rows.select(*columns),
    ).awaitTermination()
    return tables.read_keyed(t.spark, table)


@query("s02_upsert_out_of_order", UPSERT_SQL)
def _(t):
    """The same from eight shards of mixed ages, one per batch: a later batch with an older order changes nothing."""
    columns = ["o_custkey", "o_orderkey", "o_totalprice"]
    orders = t("orders").select(*columns)
    folder = scratch_path(t.spark, "order-shards")
    orders.repartition(8, F.xxhash64("o_orderkey")).write.parquet(folder)
    table = tables.Keyed(scratch_path(t.spark, "latest"), orders.schema, ("o_custkey",), buckets=8)
    ingest.upsert_shards(
        t.spark, folder, orders.schema, table, scratch_path(t.spark, "latest-cp"), ["o_orderkey"], files_per_batch=1,
    ).awaitTermination()
    return tables.read_keyed(t.spark, table)


@query("s02_change_feed", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS last FROM orders)
SELECT 'insert' AS change_type, o_custkey, o_orderkey, o_totalprice FROM r WHERE first = 1
UNION ALL SELECT 'update_preimage', o_custkey, o_orderkey, o_totalprice FROM r WHERE first = 1 AND last > 1
UNION ALL SELECT 'update_postimage', o_custkey, o_orderkey, o_totalprice FROM r WHERE last = 1 AND first > 1""")
def _(t):
    """Changes of two batches, the first and the last order of every customer, the second of them sent twice."""
    columns = ["o_custkey", "o_orderkey", "o_totalprice"]
    keyed = t("orders").select(*columns)
    orders = t("orders").groupBy("o_custkey").agg(
        F.min(F.struct("o_orderkey", "o_totalprice")).alias("first"), F.max(F.struct("o_orderkey", "o_totalprice")).alias("last"),
    )
    table = tables.Keyed(scratch_path(t.spark, "latest"), keyed.schema, ("o_custkey",), buckets=8)
    ledger = ingest.Ledger(t.spark, scratch_path(t.spark, "ledger"), "orders")
    feed = scratch_path(t.spark, "feed")
    tables.clear(t.spark, table)
    for batch_id, part in ((0, "first"), (1, "last"), (1, "last")):
        ingest.upsert_batch(orders.select("o_custkey", f"{part}.*"), batch_id, table, ledger, ["o_orderkey"], feed=feed)
    return t.spark.read.parquet(feed).drop("batch")


@query("s03_distinct_records", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    """Each (user, event type) once; the delay covers the whole table, so no repeat can pass."""
    target, checkpoint = scratch_path(t.spark, "distinct"), scratch_path(t.spark, "distinct-cp")
    rows = ingest.shard_stream(t.spark, shards(t, "events"), t("events").schema)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    unique = ingest.distinct_records(rows, ["user_id", "event_type"], "ts", "3650 days")
    ingest.append_log(unique.select("user_id", "event_type"), target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target)


@query("s04_log_and_history", """
SELECT query_id, timestamp, user_email, query_text FROM (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS timestamp, role AS user_email, text AS query_text FROM conversations)
ORDER BY timestamp DESC, query_id, user_email, query_text LIMIT 50""")
def _(t):
    target = scratch_path(t.spark, "log")
    rows = ingest.shard_stream(t.spark, shards(t, "conversations"), t("conversations").schema)
    log = rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("timestamp"),
        F.col("role").alias("user_email"), F.col("text").alias("query_text"),
    )
    ingest.append_log(log, target, scratch_path(t.spark, "log-cp")).awaitTermination()
    return op.query_history(t.spark.read.parquet(target))
