"""Table maintenance on Parquet: layouts, upserts, change feeds, inventories and DDL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType, VariantType

from ..functions.ranking import sortable
from ..session import scratch_path
from .registry import SOURCES, Source
from .schemas import schema

RECORD_KEYS = ("record_id", "source_key")
#: Columns of a record that are never missing.
REQUIRED = (*RECORD_KEYS, "payload", "ingested_at")


def write_partitioned(df: DataFrame, path: str, *keys: str, mode: str = "overwrite", dynamic: bool = False) -> None:
    """Partitioned write that stays balanced.

    Rebalancing by key sizes the write tasks from measured data: small keys share
    a task, and a key holding a third of the rows is split over many. A dynamic
    overwrite replaces only the partitions that ``df`` has rows for.
    """
    writer = df.hint("rebalance", *[F.col(k) for k in keys]).write.mode(mode).partitionBy(*keys)
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)


def write_clustered(df: DataFrame, path: str, *columns: str, partitions: int | None = None) -> None:
    """Range-clustered layout, so selective reads skip files and row groups by their statistics.

    Ranges run on through a hash of the other columns, so a value that many rows share is written by several tasks.
    """
    order = [F.col(c) for c in columns]
    rest = [sortable(f) for f in df.schema.fields if f.name not in columns]
    cuts = [*order, F.xxhash64(*rest)] if rest else order
    ranged = df.repartitionByRange(partitions, *cuts) if partitions else df.repartitionByRange(*cuts)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_merged(spark: SparkSession, *paths: str) -> DataFrame:
    """Files whose schemas grew over time, as one table."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the last under ``order``; combined map-side. Other columns settle equal orders."""
    rest = [c for c in df.columns if c not in keys]
    ties = [sortable(df.schema[c]).alias(c) for c in rest if c not in order]
    last = F.max_by(F.struct(*rest), F.struct(*order, *ties)).alias("_last")
    out = df.groupBy(*keys).agg(last).select(*keys, "_last.*")
    return out.select(*df.columns)


def merge(target: DataFrame, batch: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Update matching rows and insert the others; the batch is reduced to one row per key first.

    With an order the later row of target and batch stays, whichever came first; at equal order, and without one, the
    batch's does.
    """
    fresh = latest_per_key(batch, keys, *order)
    if order:
        matching = target.join(fresh.select(*keys), list(keys), "left_semi")
        both = matching.withColumn("_fresh", F.lit(0)).unionByName(fresh.select(*target.columns, F.lit(1).alias("_fresh")))
        fresh = latest_per_key(both, keys, *order, "_fresh").drop("_fresh")
    kept = target.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh)


def row_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of the non-key columns; VARIANT is compared by its JSON text."""
    parts = [
        F.to_json(F.col(f.name)) if isinstance(f.dataType, VariantType) else F.col(f.name)
        for f in df.schema.fields
        if f.name not in keys
    ]
    return F.xxhash64(*parts)


# Change types of a feed.
INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inserted, deleted and updated (both images) between two versions, keyed uniquely."""
    columns = new.columns

    def side(df: DataFrame, name: str) -> DataFrame:
        hashed = df.select(*columns).withColumn("_h", row_hash(df.select(*columns), keys))
        return hashed.select(*keys, F.struct(*columns).alias(f"_{name}"), F.col("_h").alias(f"_h_{name}"))

    both = side(old, "old").join(side(new, "new"), list(keys), "full_outer")

    def event(kind: str, row: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(row).alias("row"))

    events = (
        F.when(F.col("_h_old").isNull(), F.array(event(INSERT, "_new")))
        .when(F.col("_h_new").isNull(), F.array(event(DELETE, "_old")))
        .when(F.col("_h_old") != F.col("_h_new"), F.array(event(BEFORE, "_old"), event(AFTER, "_new")))
    )
    return both.select(F.explode(events).alias("e")).select(F.col("e.kind").alias("change_type"), "e.row.*")


def replay(old: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Apply a change feed to the older version."""
    gone = feed.filter(F.col("change_type").isin(DELETE, BEFORE)).select(*keys)
    added = feed.filter(F.col("change_type").isin(INSERT, AFTER)).drop("change_type")
    return old.join(gone, list(keys), "left_anti").unionByName(added.select(*old.columns))


@dataclass(frozen=True)
class Keyed:
    """A plain Parquet table with one row per key, partitioned by a hash bucket of the key. The number of buckets is
    fixed when the table is made. One writer at a time."""

    path: str
    schema: StructType
    keys: tuple[str, ...] = RECORD_KEYS
    buckets: int = 64


BUCKET = "_bucket"


def _bucketed(rows: DataFrame, table: Keyed) -> DataFrame:
    bucket = F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")
    return rows.select(*table.schema.fieldNames()).withColumn(BUCKET, bucket)


def overwrite(rows: DataFrame, table: Keyed) -> None:
    """Replaces the table; rows have unique keys. No rows clear it."""
    write_partitioned(_bucketed(rows, table), table.path, BUCKET)


def clear(spark: SparkSession, table: Keyed) -> None:
    overwrite(spark.createDataFrame([], table.schema), table)


def read_keyed(spark: SparkSession, table: Keyed, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table, or the rows of some of its buckets: only their folders are read."""
    rows = spark.read.schema(StructType([*table.schema.fields, StructField(BUCKET, IntegerType())])).parquet(table.path)
    rows = rows if buckets is None else rows.filter(F.col(BUCKET).isin(list(buckets)))
    return rows.select(*table.schema.fieldNames())


def _met(batch: DataFrame, table: Keyed) -> DataFrame:
    """Rows of the buckets that the batch falls into."""
    touched = sorted(r[0] for r in _bucketed(batch, table).select(BUCKET).distinct().collect())  # at most one per bucket
    return read_keyed(batch.sparkSession, table, touched)


def upsert(batch: DataFrame, table: Keyed, *order: str) -> None:
    """Updates and inserts a batch: the buckets it falls into are read, merged, and replaced by a dynamic overwrite.

    What they become is first written to the shared folder, so a lost task never reads what is being replaced. The same
    batch again leaves the table as it is, so a failed upsert is repeated.
    """
    if batch.isEmpty():
        return
    spark, path = batch.sparkSession, scratch_path(batch.sparkSession, "merged")
    merged = merge(_met(batch, table), batch.select(*table.schema.fieldNames()), table.keys, *order)
    merged.write.parquet(path)
    fresh = _bucketed(spark.read.schema(table.schema).parquet(path), table)
    write_partitioned(fresh, table.path, BUCKET, dynamic=True)


def upsert_feed(batch: DataFrame, table: Keyed, *order: str) -> DataFrame:
    """What an upsert of the batch would change, as a feed; to be stored before the upsert. Other buckets are not read."""
    old = _met(batch, table)
    return changes(old, merge(old, batch.select(*table.schema.fieldNames()), table.keys, *order), table.keys)


def merge_into(batch: DataFrame, name: str, keys: Sequence[str]) -> None:
    """Upserts a batch with unique keys into a table of a catalog that offers row-level changes."""
    same = [F.col(f"{name}.{k}").eqNullSafe(F.col(f"batch.{k}")) for k in keys]
    batch.alias("batch").mergeInto(name, reduce(Column.__and__, same)).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def write_bucketed(df: DataFrame, name: str, *keys: str, buckets: int = 64) -> None:
    """A catalog table bucketed and sorted by the keys: joins of such tables on them need no shuffle.

    Rows are dealt out by the same hash as the buckets. A bucket is written by one task, as one sorted file, until its
    measured size asks for several: a file and a sort stay bounded, however large a bucket is.
    """
    dealt = df.hint("rebalance", buckets, *[F.col(k) for k in keys])
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def create_table_sql(source: Source, database: str, location: str | None = None) -> str:
    """DDL of a source's record table."""
    place = f"\nLOCATION '{location}'" if location else ""
    columns = ",\n  ".join(f"{f.name} {f.dataType.simpleString()}{' NOT NULL' if f.name in REQUIRED else ''}" for f in schema("records").fields)
    return f"""CREATE TABLE IF NOT EXISTS {database}.{source.target_table} (
  {columns}
)
USING PARQUET{place}
COMMENT '{source.name}'
TBLPROPERTIES ('source_type' = '{source.source_type}', 'priority' = '{source.priority}',
  'ingest_method' = '{source.ingest_method}', 'change_feed' = 'true')"""


def create_source_tables(spark: SparkSession, database: str, locations: dict[str, str] | None = None) -> list[str]:
    """Create the record table of every registered source (or of those with a location)."""
    wanted = [s for s in SOURCES if locations is None or s.key in locations]
    for source in wanted:
        spark.sql(create_table_sql(source, database, (locations or {}).get(source.key)))
    return [f"{database}.{s.target_table}" for s in wanted]


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables as one result."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in frames.items()]
    out = counts[0]
    for frame in counts[1:]:
        out = out.unionByName(frame)
    return out


def inventory(spark: SparkSession, expected: Sequence[str], present: DataFrame) -> DataFrame:
    """Expected tables with EXISTS or MISSING, against present (table_name, n_bytes)."""
    wanted = spark.createDataFrame([(e,) for e in expected], "table_name string")
    status = F.when(F.col("_seen"), "EXISTS").otherwise("MISSING")
    marked = present.withColumn("_seen", F.lit(True))
    return wanted.join(marked, "table_name", "left").withColumn("status", status).drop("_seen")


def run_summary(records: DataFrame, rejected: DataFrame) -> DataFrame:
    """Records written and errors per source and gene, over the whole run."""
    written = records.groupBy("source_key", "gene_symbol").agg(
        F.count(F.lit(1)).alias("records_written"), F.lit(0).cast("bigint").alias("errors")
    )
    failed = rejected.groupBy("source_key", "gene_symbol").agg(
        F.lit(0).cast("bigint").alias("records_written"), F.count(F.lit(1)).alias("errors")
    )
    return (
        written.unionByName(failed)
        .groupBy("source_key", "gene_symbol")
        .agg(F.sum("records_written").alias("records_written"), F.sum("errors").alias("errors"))
    )


def summary_metrics(ok: Column, sources: Sequence[str]) -> list[Column]:
    """Counts of good and bad rows of each source, for ``DataFrame.observe``: two numbers per source."""
    source = F.col("source_key")
    return [
        F.count_if((source == key) & (ok if good else ~ok)).alias(f"{key}|{'written' if good else 'errors'}")
        for key in sources for good in (True, False)
    ]


SUMMARY = "source_key string, records_written bigint, errors bigint"


def write_observed(rows: DataFrame, path: str, ok: Column, sources: Sequence[str], mode: str = "append") -> DataFrame:
    """Writes rows, good ones apart from bad ones, and returns what it wrote per source: source_key, records_written, errors.

    The counts are taken by the writing job itself, so nothing is read twice. Rows with a source that is not listed are
    written and not counted; a source without rows is left out.
    """
    seen = Observation()
    marked = rows.withColumn("_good", F.coalesce(ok, F.lit(False)))
    marked = marked.observe(seen, *summary_metrics(F.col("_good"), sources))
    write_partitioned(marked, path, "_good", mode=mode)
    counts = [(key, seen.get[f"{key}|written"], seen.get[f"{key}|errors"]) for key in sources]
    return rows.sparkSession.createDataFrame([c for c in counts if c[1] or c[2]], SUMMARY)
