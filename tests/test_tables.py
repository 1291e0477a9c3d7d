from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillomics.session import scratch_path
from quillomics.sources import files, registry, tables, views
from quillomics.streaming import ingest
from tests.conftest import SF_DIR, rows

COLUMNS = ["record_id", "source_key", "title", "event_id"]


@pytest.fixture
def records(spark):
    return views.load(spark, SF_DIR, "v_records").select(*COLUMNS)


def new_table(schema, path, buckets=8):
    return tables.Keyed(path, schema, buckets=buckets)


def listing(path):
    """Data files under a table's folder."""
    return {str(f.relative_to(path)) for f in Path(path).rglob("part-*")}


def test_upsert_twice_is_upsert_once(spark, records):
    old, batch = records.filter("event_id < 600"), records.filter("event_id >= 400").withColumn("title", F.lit("new"))
    table = new_table(records.schema, scratch_path(spark, "t"))
    tables.overwrite(tables.latest_per_key(old, tables.RECORD_KEYS, "event_id"), table)
    for _ in range(2):
        tables.upsert(batch, table, "event_id")
        want = tables.merge(tables.latest_per_key(old, tables.RECORD_KEYS, "event_id"), batch, tables.RECORD_KEYS, "event_id")
        assert rows(tables.read_keyed(spark, table)) == rows(want)


def test_small_batch_rewrites_only_its_bucket(spark, records, tmp_path):
    table = new_table(records.schema, str(tmp_path / "t"), buckets=32)
    tables.overwrite(tables.latest_per_key(records, tables.RECORD_KEYS, "event_id"), table)
    before, n = listing(table.path), tables.read_keyed(spark, table).count()
    tables.upsert(records.filter("event_id = 5").withColumn("title", F.lit("changed")), table, "event_id")
    after = listing(table.path)
    touched = {f.split("/")[0] for f in before ^ after}
    assert len(touched) == 1 and len({f.split("/")[0] for f in before}) == 32
    assert tables.read_keyed(spark, table).count() == n
    plan = tables.read_keyed(spark, table, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan


def test_empty_batch_changes_nothing(spark, records, tmp_path):
    table = new_table(records.schema, str(tmp_path / "t"))
    tables.overwrite(tables.latest_per_key(records, tables.RECORD_KEYS, "event_id"), table)
    before = listing(table.path)
    tables.upsert(records.limit(0), table, "event_id")
    assert listing(table.path) == before
    tables.clear(spark, table)
    assert tables.read_keyed(spark, table).count() == 0


def test_feed_replays_onto_the_older_rows(spark, records, tmp_path):
    table = new_table(records.schema, str(tmp_path / "t"))
    tables.overwrite(tables.latest_per_key(records.filter("event_id < 700"), tables.RECORD_KEYS, "event_id"), table)
    batch = records.filter("event_id > 600").withColumn("title", F.lit("t"))
    old = spark.createDataFrame(tables.read_keyed(spark, table).collect(), records.schema)
    tables.upsert_feed(batch, table, "event_id").write.parquet(str(tmp_path / "feed"))
    tables.upsert(batch, table, "event_id")
    feed = spark.read.parquet(str(tmp_path / "feed"))
    assert {r[0] for r in feed.select("change_type").distinct().collect()} == {"insert", "update_preimage", "update_postimage"}
    assert rows(tables.replay(old, feed, tables.RECORD_KEYS)) == rows(tables.read_keyed(spark, table))


def test_merge_needs_a_catalog_that_offers_it(spark, tmp_path):
    spark.sql(f"CREATE TABLE plain_merge (k INT, v STRING) USING parquet LOCATION '{tmp_path / 'm'}'")
    try:
        with pytest.raises(Exception, match="MERGE|merge|UNSUPPORTED"):
            tables.merge_into(spark.createDataFrame([(1, "a")], "k int, v string"), "plain_merge", ["k"])
    finally:
        spark.sql("DROP TABLE plain_merge")


def test_repeated_batch_writes_nothing(spark, records, tmp_path):
    table = new_table(records.schema, str(tmp_path / "t"))
    tables.clear(spark, table)
    ledger = ingest.Ledger(spark, str(tmp_path / "ledger"), "s")
    other = ingest.Ledger(spark, str(tmp_path / "ledger"), "another stream")
    feed = str(tmp_path / "feed")
    ingest.upsert_batch(records, 0, table, ledger, ["event_id"], feed=feed)
    before = listing(tmp_path)
    ingest.upsert_batch(records.withColumn("title", F.lit("never")), 0, table, ledger, ["event_id"], feed=feed)
    assert listing(tmp_path) == before and other.done(0) == set() and ledger.done(0) == {"feed", "table"}


def test_batch_lost_after_its_feed_keeps_the_feed(spark, records, tmp_path, monkeypatch):
    table = new_table(records.schema, str(tmp_path / "t"))
    tables.clear(spark, table)
    ledger, feed = ingest.Ledger(spark, str(tmp_path / "ledger"), "s"), str(tmp_path / "feed")
    done = tables.upsert

    def fails(batch, table, *order):
        done(batch, table, *order)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(tables, "upsert", fails)
    with pytest.raises(RuntimeError):
        ingest.upsert_batch(records, 0, table, ledger, ["event_id"], feed=feed)
    monkeypatch.setattr(tables, "upsert", done)
    ingest.upsert_batch(records, 0, table, ledger, ["event_id"], feed=feed)
    assert spark.read.parquet(feed).filter("change_type = 'insert'").count() == tables.read_keyed(spark, table).count()


def test_hot_key_is_written_by_several_tasks(spark, tmp_path):
    """Nearly all rows share one key; the write still splits them."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        df = spark.range(0, 400_000, 1, 16).select(
            F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id") % 7)).otherwise("non-targeting").alias("k"),
            F.sha1(F.col("id").cast("string")).alias("x"),
        )
        tables.write_partitioned(df, str(tmp_path / "w"), "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "w" / "k=non-targeting").glob("*.parquet"))) > 2
    assert spark.read.parquet(str(tmp_path / "w")).count() == 400_000


def test_clustered_files_share_limits_only(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_clustered(views.load(spark, SF_DIR, "v_diff_expr"), path, "de_gene", partitions=4)
    ranges = (
        spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f"))
        .agg(F.min("de_gene").alias("lo"), F.max("de_gene").alias("hi")).orderBy("lo").collect()
    )
    # A value at a limit may go on in the next file: frequent values are split.
    assert len(ranges) > 1 and all(a["hi"] <= b["lo"] for a, b in zip(ranges, ranges[1:]))


def test_source_tables_from_ddl(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS ddl_test")
    try:
        names = tables.create_source_tables(spark, "ddl_test")
        assert len(names) == 21
        described = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE ddl_test.src_kegg").collect()}
        assert described["payload"] == "variant" and described["source_updated_at"] == "timestamp"
        assert {s.target_table for s in registry.SOURCES} == {t.name for t in spark.catalog.listTables("ddl_test")}
    finally:
        spark.sql("DROP DATABASE ddl_test CASCADE")


def test_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    items = views.read(spark, SF_DIR, "lineitem")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    half = items.filter("l_linenumber <= 3")
    half.repartition(5).write.parquet(source)
    ingest.append_shards(spark, source, items.schema, target, checkpoint, files_per_batch=2).awaitTermination()
    assert spark.read.parquet(target).count() == half.count()
    items.filter("l_linenumber > 3").repartition(3).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.append_shards(spark, source, items.schema, target, checkpoint, files_per_batch=2).awaitTermination()
    assert rows(spark.read.parquet(target)) == rows(items)


def test_failed_upsert_stream_resumes(spark, tmp_path, records, monkeypatch):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    records.repartitionByRange(6, "event_id").write.parquet(source)
    table = new_table(records.schema, str(tmp_path / "t"))
    attempts, done = [], tables.upsert

    def fails(batch, table, *order):
        done(batch, table, *order)
        attempts.append(1)
        if len(attempts) == 2:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(tables, "upsert", fails)
    with pytest.raises(Exception):
        ingest.upsert_shards(spark, source, records.schema, table, checkpoint, ["event_id"], files_per_batch=2).awaitTermination()
    ingest.upsert_shards(spark, source, records.schema, table, checkpoint, ["event_id"], files_per_batch=2).awaitTermination()
    keys = tables.read_keyed(spark, table).select("record_id", "source_key")
    assert keys.count() == keys.distinct().count() == records.select("record_id", "source_key").distinct().count()


def test_refresh_replaces_the_table(spark, tmp_path, records):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    records.filter("event_id >= 500").repartition(4).write.parquet(source)
    table = new_table(records.schema, str(tmp_path / "t"))
    tables.overwrite(records.filter("event_id < 500"), table)
    ingest.upsert_shards(
        spark, source, records.schema, table, checkpoint, ["event_id"], files_per_batch=2, replace=True
    ).awaitTermination()
    want = tables.latest_per_key(records.filter("event_id >= 500"), tables.RECORD_KEYS, "event_id")
    assert rows(tables.read_keyed(spark, table)) == rows(want)


def test_cell_shards_leave_side_files_out(spark):
    found = spark.createDataFrame([("/d/b.parquet",), ("/d/a.parquet",), ("/d/drug_annot.parquet",), ("/d/x.csv",)], "path string")
    assert [r[0] for r in files.cell_shards(found).collect()] == ["/d/a.parquet", "/d/b.parquet"]


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_later_row_wins_whichever_came_first(spark):
    target = spark.createDataFrame([(1, 20, "new"), (2, 5, "old"), (3, 1, "kept")], "k int, o int, v string")
    batch = spark.createDataFrame([(1, 10, "late"), (2, 6, "fresh"), (4, 1, "added")], "k int, o int, v string")
    got = {r.k: r.v for r in tables.merge(target, batch, ["k"], "o").collect()}
    assert got == {1: "new", 2: "fresh", 3: "kept", 4: "added"}
    assert {r.k: r.v for r in tables.merge(target, batch, ["k"]).collect()}[1] == "late"


def test_search_by_unknown_field_is_an_error(spark):
    from quillomics.operators import records
    from quillomics.sources import views
    from tests.conftest import SF_DIR

    rows = views.load(spark, SF_DIR, "v_sources")
    assert records.search(rows, "kegg", "record", limit=None, gene="GENE_NOT_THERE").count() == 0
    with pytest.raises(ValueError, match="colour"):
        records.search(rows, "kegg", "record", colour="red")


def test_repeated_cells_of_a_matrix(spark):
    from quillomics.operators import aggregates

    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 2.0), ("b", "x", 5.0)], "e string, k string, v double")
    got = {(r.e, r.k): r.v for r in aggregates.entity_matrix(rows, "e", "k", "v", "a").collect()}
    assert got == {("a", "x"): 3.0, ("b", "x"): 5.0}


def test_clustered_write_splits_a_frequent_value(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    tables.write_clustered(rows, str(tmp_path / "c"), "k", partitions=8)
    hot = [pq.read_table(f).column("k").to_pylist().count("hot") for f in (tmp_path / "c").glob("part-*")]
    assert sum(hot) == 36_000 and max(hot) < 9_000
