"""Scans, sinks and table maintenance with their checking SQL.

Written tables go to the folder named by spark.checkpoint.dir.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import payload as V
from ..session import scratch_path
from ..sources import files, layout, registry, schemas, tables, views
from . import query


@query("a01_column_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def _(t):
    return files.scan(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_extendedprice"])


@query("a02_significant_effects", """
SELECT gene_target, de_gene, group_name, log2fc, pvalue_adj, n_cells_ko, n_cells_ctrl FROM v_diff_expr WHERE pvalue_adj < 0.05E0""")
def _(t):
    raw = t("v_diff_expr").withColumnsRenamed({
        "de_gene": "names", "log2fc": "logfoldchanges", "pvalue_adj": "pvals_adj", "n_cells_ko": "n_pert_matched",
        "n_cells_ctrl": "n_ctrl_matched",
    })
    return files.significant_effects(raw)


def write_text_table(t, df, label, sep, header):
    path = scratch_path(t.spark, label)
    df.write.option("sep", sep).option("header", header).csv(path)
    return path


@query("a03_delimited_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    columns = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = write_text_table(t, columns, "customers", "\t", True)
    return files.read_delimited(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("a04_sheets_with_provenance", """
SELECT p_name AS gene, p_size / 10.0E0 AS phenotype_score, p_brand AS hit_class, true AS has_file FROM part
UNION ALL SELECT c_name, c_acctbal, NULL, true FROM customer""")
def _(t):
    parts = t("part").select(F.col("p_name").alias("Gene"), (F.col("p_size") / 10).alias("Phenotype"), F.col("p_brand").alias("Hit Class"))
    customers = t("customer").select(F.col("c_acctbal").alias("score"), F.col("c_name").alias("gene"))
    guides = t("nation").select(F.col("n_name").alias("sgRNA"))
    paths = [
        write_text_table(t, df, label, sep, True)
        for df, label, sep in ((parts, "sheet1", ","), (customers, "sheet2", "\t"), (guides, "sheet3", ","))
    ]
    target = StructType.fromDDL("gene string, phenotype_score double, hit_class string")
    candidates = {"gene": ("Gene", "gene"), "phenotype_score": ("Phenotype", "phenotype", "score"), "hit_class": ("Hit Class", "hit_class")}
    rows = files.load_sheets(t.spark, paths, target, candidates, "gene")
    return rows.withColumn("has_file", F.col("source_file").endswith(".csv")).drop("source_file")


@query("a05_vocabulary_names", """
SELECT p_partkey, unnest([p_name, p_type]) AS name FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, unnest([p_brand, 'x' || p_size]) FROM part WHERE p_size % 2 <> 0""")
def _(t):
    documents = t("part").selectExpr(
        "p_partkey", "parse_json(if(p_size % 2 = 0, to_json(array(p_name, p_type)), to_json(map(p_brand, 1, concat('x', p_size), 2)))) AS doc"
    )
    return files.vocabulary_names(documents, ["p_partkey"])


@query("a05_json_lines", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def _(t):
    path = scratch_path(t.spark, "json")
    t("events").select(F.to_json(F.struct("event_id", F.from_json("props", "k int").alias("props")))).write.text(path)
    docs = files.read_json_lines(t.spark, path)
    return docs.select(V.field("event_id", "bigint", "doc").alias("event_id"), V.field("props.k", "int", "doc").alias("k"))


@query("a08_literal_lookup", """
SELECT n_name, 'orexin receptor ' || CASE n_regionkey WHEN 1 THEN '1' ELSE '2' END AS target FROM nation WHERE n_regionkey IN (1, 2)""")
def _(t):
    targets = t.spark.createDataFrame([(1, "orexin receptor 1"), (2, "orexin receptor 2")], "n_regionkey int, target string")
    return t("nation").join(targets, "n_regionkey").select("n_name", "target")


def rows_of(t, chosen):
    """Rows in the chosen files, by table: each table's files are read, one row comes back per table."""
    paths = {}
    for name, path in sorted(tuple(r) for r in chosen.select(files.table_of(), "path").collect()):
        paths.setdefault(name, []).append(path)
    counts = [t.spark.read.parquet(*p).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, counts)


def rows_sql(*names):
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in names)


KINDS = {"facts": "/(lineitem|orders)[.]parquet", "dimension": "/(part|supplier|customer|nation|region)[.]parquet"}


@query("a09_discover_files", rows_sql("lineitem", "orders"))
def _(t):
    found = files.classify_files(files.list_files(t.spark, t.sf_dir, "*.parquet"), KINDS)
    return rows_of(t, found.filter("kind = 'facts'"))


@query("a09_other_files", rows_sql("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"))
def _(t):
    found = files.classify_files(files.list_files(t.spark, t.sf_dir, "*.parquet"), KINDS)
    return rows_of(t, found.filter("kind NOT IN ('facts', 'dimension')"))


@query("a09_every_nth_file", rows_sql("benchmark", "documents", "labels", "orders", "region"))
def _(t):
    return rows_of(t, files.every_nth(files.list_files(t.spark, t.sf_dir, "*.parquet"), 3))


@query("a10_align_to_schema", """
SELECT drug, moa, cell_line_id, cluster, CAST(NULL AS VARCHAR) AS canonical_smiles, CAST(NULL AS VARCHAR) AS pubchem_cid,
       CAST(NULL AS VARCHAR) AS sample, CAST(NULL AS VARCHAR) AS barcode FROM v_drug_cells""")
def _(t):
    raw = t("v_drug_cells").withColumnsRenamed({"moa": "moa-fine", "cluster": "plate", "drug": "perturbation"})
    return schemas.align_to_schema(raw, "drug_cells", schemas.DRUG_CELL_NAMES)


def profile_sql(table, columns):
    parts = [
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null, min(left(CAST({c} AS VARCHAR), 60)) AS sample, count(*) AS n_rows FROM {table}"
        for c, kind in columns
    ]
    return "\nUNION ALL ".join(parts)


@query("a11_profile", profile_sql("v_ndd_genes", [
    ("gene", "string"), ("gene_id", "string"), ("chromosome", "string"), ("FDR_TADA_ASD", "string"), ("p_TADA_ASD", "string"), ("ASD72", "int")]))
def _(t):
    return files.profile(t("v_ndd_genes"))


# Sketched distinct counts have no exact SQL counterpart: bounds are checked in the tests.
@query("a11_profile_distinct")
def _(t):
    return files.profile(t("part"), distinct=True)


@query("a12_overwrite_append_merge_schema", """
SELECT l_orderkey, l_linenumber, l_quantity, CAST(NULL AS DOUBLE) AS l_tax FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_returnflag <> 'A'""")
def _(t):
    path = scratch_path(t.spark, "grown")
    items = t("lineitem")
    items.filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity").write.mode("overwrite").parquet(path)
    items.filter("l_returnflag <> 'A'").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").write.mode("append").parquet(path)
    return tables.read_merged(t.spark, path)


@query("a13_partitioned_write", "SELECT * FROM v_diff_expr")
def _(t):
    path = scratch_path(t.spark, "by_target")
    tables.write_partitioned(t("v_diff_expr"), path, "gene_target")
    return t.spark.read.parquet(path)


@query("a14_table_from_query", "SELECT drug, moa, cell_line_id, cluster FROM v_drug_cells WHERE drug IS NOT NULL")
def _(t):
    path = scratch_path(t.spark, "clustered")
    t("v_drug_cells").filter("drug IS NOT NULL").select("drug", "moa", "cell_line_id", "cluster").write.parquet(path)
    return t.spark.read.parquet(path)


def scratch_database(t, label):
    """A new database in the scratch folder."""
    path = scratch_path(t.spark, label)
    name = f"{label}_{path.rsplit('-', 1)[1][:12]}"
    t.spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


@query("a14_create_table_as_select", "SELECT drug, moa, cell_line_id, count(*) AS n_cells FROM v_drug_cells WHERE drug IS NOT NULL GROUP BY ALL")
def _(t):
    """A catalog table made by SQL from a query."""
    name = scratch_database(t, "ctas")
    t("v_drug_cells").createOrReplaceTempView(f"{name}_cells")
    t.spark.sql(f"""CREATE TABLE {name}.counts USING parquet AS
        SELECT drug, moa, cell_line_id, count(*) AS n_cells FROM {name}_cells WHERE drug IS NOT NULL GROUP BY ALL""")
    return t.spark.table(f"{name}.counts")


@query("a14_bucketed_join", """
WITH e AS (SELECT gene_target, count(*) AS n_effects, min(pvalue_adj) AS best_pvalue FROM v_diff_expr GROUP BY 1),
 c AS (SELECT gene_target, count(*) AS n_cells FROM v_cell_metadata GROUP BY 1)
SELECT gene_target, n_effects, best_pvalue, n_cells FROM e JOIN c USING (gene_target)""")
def _(t):
    """Two tables bucketed by target, summed up and joined where their buckets lie: no row is shuffled."""
    name = scratch_database(t, "bucketed")
    tables.write_bucketed(t("v_diff_expr").select("gene_target", "pvalue_adj"), f"{name}.effects", "gene_target", buckets=8)
    tables.write_bucketed(t("v_cell_metadata").select("gene_target", "cell_barcode"), f"{name}.cells", "gene_target", buckets=8)
    effects = t.spark.table(f"{name}.effects").groupBy("gene_target")
    effects = effects.agg(F.count(F.lit(1)).alias("n_effects"), F.min("pvalue_adj").alias("best_pvalue"))
    cells = t.spark.table(f"{name}.cells").groupBy("gene_target").agg(F.count(F.lit(1)).alias("n_cells"))
    return effects.join(cells.hint("merge"), "gene_target")


@query("a15_clustered_write", "SELECT drug, moa, cell_line_id, cluster FROM v_drug_cells WHERE drug = 'red widget'")
def _(t):
    path = scratch_path(t.spark, "ranged")
    tables.write_clustered(t("v_drug_cells"), path, "drug", "moa", "cell_line_id")
    return t.spark.read.parquet(path).filter("drug = 'red widget'")


@query("a15_zordered_write", """
SELECT 'drug' AS filter, drug, moa, cell_line_id, cluster FROM v_drug_cells WHERE drug = 'red widget'
UNION ALL SELECT 'moa', drug, moa, cell_line_id, cluster FROM v_drug_cells WHERE moa = 'MEDIUM'
UNION ALL SELECT 'cell_line_id', drug, moa, cell_line_id, cluster FROM v_drug_cells WHERE cell_line_id = 'Supplier#000000016'""")
def _(t):
    """One layout for filters on each of three columns."""
    path = scratch_path(t.spark, "zordered")
    layout.write_zordered(t("v_drug_cells"), path, "drug", "moa", "cell_line_id", files=16)
    cells = t.spark.read.parquet(path)
    wanted = {"drug": "red widget", "moa": "MEDIUM", "cell_line_id": "Supplier#000000016"}
    found = [
        cells.filter(F.col(c) == value).select(F.lit(c).alias("filter"), "drug", "moa", "cell_line_id", "cluster")
        for c, value in wanted.items()
    ]
    return reduce(DataFrame.unionByName, found)


def split_records(t):
    """Older records as the table, newer ones as the batch that arrives."""
    rows = t("v_records").select("record_id", "source_key", "gene_symbol", "disease", "title", "source_updated_at", "event_id")
    late = F.col("source_updated_at") >= F.lit("2024-01-15").cast("timestamp")
    return rows.filter(~late), rows.filter(late)


LATEST_SQL = """
WITH l AS (SELECT record_id, source_key, gene_symbol, disease, title, source_updated_at, event_id,
    source_updated_at >= TIMESTAMP '2024-01-15' AS late FROM v_records),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, source_key ORDER BY event_id DESC) AS rn FROM l WHERE NOT late) WHERE rn = 1),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, source_key ORDER BY event_id DESC) AS rn FROM l WHERE late) WHERE rn = 1),
 m AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.record_id = o.record_id AND n.source_key = o.source_key))
"""
RECORD_LIST = "record_id, source_key, gene_symbol, disease, title, source_updated_at, event_id"


def record_table(t, old):
    table = tables.Keyed(scratch_path(t.spark, "records"), old.schema, buckets=16)
    tables.overwrite(tables.latest_per_key(old, tables.RECORD_KEYS, "event_id"), table)
    return table


@query("a16_upsert", LATEST_SQL + f"SELECT {RECORD_LIST} FROM m")
def _(t):
    old, new = split_records(t)
    table = record_table(t, old)
    for _ in range(2):
        tables.upsert(new, table, "event_id")
    return tables.read_keyed(t.spark, table)


@query("a16_merge_frames", LATEST_SQL + f"SELECT {RECORD_LIST} FROM m")
def _(t):
    """The merge itself, without writing a table."""
    old, new = split_records(t)
    return tables.merge(tables.latest_per_key(old, tables.RECORD_KEYS, "event_id"), new, tables.RECORD_KEYS, "event_id")


@query("a17_clear_and_append", "SELECT query_id, user_email, query_text FROM v_query_log")
def _(t):
    log = t("v_query_log").select("query_id", "user_email", "query_text")
    table = tables.Keyed(scratch_path(t.spark, "log"), log.schema, ("query_id",), buckets=4)
    tables.overwrite(log, table)
    tables.clear(t.spark, table)
    tables.upsert(log, table, "query_text")
    return tables.read_keyed(t.spark, table)


@query("a18_source_tables", """
SELECT source_key, count(*) AS n, true AS is_source_table FROM v_sources GROUP BY source_key""")
def _(t):
    """Tables created by DDL over the source folders of one partitioned write."""
    spark = t.spark
    path = scratch_path(spark, "sources")
    database = "rec_" + path.rsplit("-", 1)[1][:12]
    records = t("v_sources").select(
        "record_id", "source_key", "gene_symbol", F.upper("gene_symbol").alias("gene_key"), "disease", "drug", "title",
        "summary", "payload", F.lit("2024-02-01").cast("timestamp").alias("ingested_at"), "source_updated_at", F.lit(None).cast("string").alias("api_version"),
        F.col("source_key").alias("folder"),
    )
    tables.write_partitioned(records, path, "folder")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}-db'")
    # At most one row per registered source comes back.
    present = {r[0] for r in records.select("source_key").distinct().collect()}
    places = {s.key: f"{path}/folder={s.key}" for s in registry.SOURCES if s.key in present}
    created = tables.create_source_tables(spark, database, places)
    parts = [spark.table(name).groupBy("source_key").agg(F.count(F.lit(1)).alias("n")) for name in created]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("is_source_table", F.lit(True))


@query("a19_change_feed", LATEST_SQL + f"""
SELECT 'update_preimage' AS change_type, {', '.join('o.' + c.strip() for c in RECORD_LIST.split(','))} FROM o JOIN n USING (record_id, source_key)
UNION ALL SELECT 'update_postimage', {', '.join('n.' + c.strip() for c in RECORD_LIST.split(','))} FROM n JOIN o USING (record_id, source_key)
UNION ALL SELECT 'insert', {RECORD_LIST} FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.record_id = o.record_id AND n.source_key = o.source_key)""")
def _(t):
    old, new = split_records(t)
    table, path = record_table(t, old), scratch_path(t.spark, "feed")
    tables.upsert_feed(new, table, "event_id").write.parquet(path)
    tables.upsert(new, table, "event_id")
    return t.spark.read.parquet(path)


@query("a19_replay", LATEST_SQL + f"SELECT {RECORD_LIST} FROM m")
def _(t):
    """Replaying the feed of two versions onto the older one gives the newer one."""
    old, new = split_records(t)
    before = tables.latest_per_key(old, tables.RECORD_KEYS, "event_id")
    after = tables.merge(before, new, tables.RECORD_KEYS, "event_id")
    return tables.replay(before, tables.changes(before, after, tables.RECORD_KEYS), tables.RECORD_KEYS)


@query("a20_inventory", """
SELECT table_name, CASE WHEN table_name = 'signatures' THEN 'MISSING' ELSE 'EXISTS' END AS status, n_rows FROM (
  SELECT 'lineitem' AS table_name, (SELECT count(*) FROM lineitem) AS n_rows UNION ALL SELECT 'part', (SELECT count(*) FROM part)
  UNION ALL SELECT 'events', (SELECT count(*) FROM events) UNION ALL SELECT 'signatures', NULL)""")
def _(t):
    found = files.list_files(t.spark, t.sf_dir, "*.parquet")
    present = found.groupBy(files.table_of().alias("table_name")).agg(F.sum("n_bytes").alias("n_bytes"))
    counts = tables.row_counts({name: t(name) for name in ("lineitem", "part", "events")})
    status = tables.inventory(t.spark, ["lineitem", "part", "events", "signatures"], present)
    return status.join(counts, "table_name", "left").select("table_name", "status", "n_rows")


@query("a21_row_counts", "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in views.TABLES))
def _(t):
    return tables.row_counts({name: t(name) for name in views.TABLES})


@query("a22_run_summary", """
SELECT source_key, gene_symbol, CAST(count_if(event_id % 11 <> 0) AS BIGINT) AS records_written, CAST(count_if(event_id % 11 = 0) AS BIGINT) AS errors
FROM v_records GROUP BY 1, 2""")
def _(t):
    from ..plans import normalize

    landed = t("v_records").select(
        "source_key", "gene_symbol", F.when(F.col("event_id") % 11 == 0, "{oops").otherwise(F.to_json("payload")).alias("raw")
    )
    return tables.run_summary(normalize.readable(landed, "score double"), normalize.quarantine(landed, "score double"))


LANDED_SQL = """
SELECT source_key, CAST(count_if(event_id % 11 <> 0) AS BIGINT) AS records_written, CAST(count_if(event_id % 11 = 0) AS BIGINT) AS errors
FROM v_sources GROUP BY 1"""


def landed_rows(t):
    return t("v_sources").select("source_key", "gene_symbol", "record_id", "event_id", "title")


@query("a22_observed_summary", LANDED_SQL)
def _(t):
    """Counts per source taken by the job that writes the rows."""
    keys = [s.key for s in registry.SOURCES]
    return tables.write_observed(landed_rows(t), scratch_path(t.spark, "landed"), F.col("event_id") % 11 != 0, keys)


@query("a22_observed_stream", LANDED_SQL)
def _(t):
    """The same counts from a file stream, added up over its batches."""
    from ..streaming import ingest

    source, target, summary = (scratch_path(t.spark, n) for n in ("shards", "landed", "counts"))
    landed_rows(t).repartition(4).write.parquet(source)
    rows = ingest.shard_stream(t.spark, source, landed_rows(t).schema, 2)
    keys = [s.key for s in registry.SOURCES]
    ingest.append_observed(rows, target, summary, scratch_path(t.spark, "landed-cp"), F.col("event_id") % 11 != 0, keys).awaitTermination()
    counts = t.spark.read.schema(tables.SUMMARY).parquet(summary).groupBy("source_key")
    return counts.agg(F.sum("records_written").alias("records_written"), F.sum("errors").alias("errors"))


@query("a11_merged_profile", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null, {number} FROM v_expression"
    for c, kind, number in (
        ("gene_symbol", "string", "CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS greatest"), ("tissue", "string", "NULL, NULL"),
        ("sample_id", "bigint", "CAST(min(sample_id) AS DOUBLE), CAST(max(sample_id) AS DOUBLE)"), ("tpm", "double", "min(tpm), max(tpm)"))))
def _(t):
    """Sketches of two snapshots, stored and merged: the exact part of the profile; estimates are held by the tests."""
    rows, path = t("v_expression").select("gene_symbol", "tissue", "sample_id", "tpm"), scratch_path(t.spark, "sketches")
    for part in (rows.filter("sample_id % 3 = 0"), rows.filter("sample_id % 3 <> 0")):
        files.profile_sketches(part).write.mode("append").parquet(path)
    return files.merged_profile(t.spark.read.parquet(path)).drop("n_distinct", "median")
