"""Layouts, indexes and plans that read only what a query needs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillomics.functions import stats
from quillomics.operators import aggregates, expression, perturbation
from quillomics.operators import records as Q
from quillomics.plans import gene_profile, search_index
from quillomics.sources import layout, registry, tables, views
from tests.conftest import SF_DIR, rows


def plan_of(df):
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]


def cells(spark, n=20_000):
    rng = random.Random(1)
    data = [(f"drug {rng.randrange(400)}" if rng.random() > 0.3 else "drug 7", f"moa {rng.randrange(60)}", rng.randrange(50), i) for i in range(n)]
    return spark.createDataFrame(data, "drug string, moa string, line int, id long")


# --- Z order

def test_filters_on_each_column_read_few_files(spark, tmp_path):
    df = cells(spark)
    layout.write_zordered(df, str(tmp_path / "z"), "drug", "moa", "line", files=64)
    table = spark.read.parquet(str(tmp_path / "z"))
    assert rows(table) == rows(df)
    ranges = layout.file_ranges(table, "drug", "moa", "line").cache()
    n = ranges.count()
    assert n > 32
    for column, value in (("drug", "drug 123"), ("moa", "moa 31"), ("line", 17)):
        named = layout.files_for(ranges, column, value)
        assert 0 < named.count() < n / 2
        inside = table.filter(F.col(column) == value).select(F.col("_metadata.file_path").alias("file_path")).distinct()
        assert inside.join(named, "file_path", "left_anti").count() == 0
    ranges.unpersist()


def test_frequent_value_goes_to_several_files(spark, tmp_path):
    df = spark.range(30_000).select(F.lit("hot").alias("a"), F.lit(1).alias("b"), "id")
    layout.write_zordered(df, str(tmp_path / "z"), "a", "b", files=8)
    sizes = [r["n_rows"] for r in layout.file_ranges(spark.read.parquet(str(tmp_path / "z")), "a").collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 8_000


def test_places_on_the_curve_are_worked_out_once_per_row(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, None), (None, 3, 6), ("a", 1, 5)], "_place string, _place_ long, x long")
    found = layout.zordered(df, "_place", "x", files=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sort = next(line for line in plan.splitlines() if "Sort [" in line)
    assert "shiftleft" in plan and "shiftleft" not in sort
    assert found.columns == df.columns and rows(found) == rows(df)


def test_cells_hold_equal_counts(spark):
    df = spark.range(10_000).select((F.col("id") * F.col("id")).alias("x")).unionByName(spark.createDataFrame([(None,)] * 5, "x long"))
    limits = layout.cell_limits(df, "x", 8)
    assert limits == sorted(limits) and len(limits) == 7
    counts = {r[0]: r[1] for r in df.groupBy(layout.cell_of(F.col("x"), limits)).count().collect()}
    assert set(counts) == set(range(8)) and max(counts.values()) < 2 * 10_000 / 8
    assert layout.cell_limits(df.limit(0), "x", 8) == []


def test_interleaved_bits(spark):
    got = spark.range(64).select("id", layout.interleaved([F.col("id").bitwiseAND(7), F.shiftright("id", 3)], 3).alias("z")).collect()
    for r in got:
        a, b = r["id"] & 7, r["id"] >> 3
        want = sum(((a >> k & 1) << (2 * k + 1)) | ((b >> k & 1) << (2 * k)) for k in range(3))
        assert r["z"] == want
    with pytest.raises(ValueError):
        layout.interleaved([F.col("id")] * 13, 5)


# --- search by trigrams

TEXTS = [
    ("1", "kegg", "ABC1", None, None, "alpha beta", "Gamma delta"), ("2", "kegg", "abc1", "Beta", "d", None, "the alphabet"),
    ("3", "gnomad", None, "", "", "", ""), (None, "kegg", "x", "ALPHA", None, "t", "s"), ("5", "civic", "ab", "cd", "ef", "gh", "ij"),
    ("6", "civic", "ünïcode", "größe 漢字漢字", "100%", "a_b", "tab\tnew"), ("1", "kegg", "ABC1", None, None, "alpha beta", "Gamma delta"),
]


@pytest.mark.parametrize("text", ["alpha", "ALPHA b", "phab", "zzz", "ab", "a", "", "漢字漢", "GRÖSSE", "größe", "100%", "a_b", "b\tn", "alpha beta gamma"])
def test_index_finds_what_a_scan_finds(spark, tmp_path, text):
    columns = "record_id string, source_key string, gene_symbol string, disease string, drug string, title string, summary string"
    records = spark.createDataFrame(TEXTS, columns).withColumns({
        "payload": F.parse_json(F.lit("{}")), "source_updated_at": F.timestamp_seconds(F.xxhash64("title") % 1000),
    })
    path = str(tmp_path / "index")
    search_index.build(records, path, buckets=8)
    keys = ["kegg", "gnomad", "civic"]
    found = search_index.search_sources(records, search_index.Index(spark, path, buckets=8), keys, text, None)
    assert rows(found.drop("payload")) == rows(Q.search_sources(records, keys, text, None).drop("payload"))


def test_trigrams_are_those_of_the_text_in_one_pass(spark):
    texts = ["", "ab", "abc", "Disease 23", "a\nb\r\nc d", "x\U0001F9ECy\U0001F9EC\U0001F9ECz", "ÄÖÜß€", "aaaaa"]
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select("t", search_index._trigrams(F.col("t")).alias("g"))
    assert {r["t"]: sorted(set(r["g"])) for r in df.collect()} == {x: search_index.grams_of(x) for x in texts} | {None: []}
    assert "substring" not in plan_of(df)


def test_index_reads_the_asked_partitions_only(spark, tmp_path):
    records = views.load(spark, SF_DIR, "v_sources")
    search_index.build(records, str(tmp_path / "i"))
    index = search_index.Index(spark, str(tmp_path / "i"))
    found = index.candidates("Disease 23")
    plan = plan_of(found)
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*In\(gram", plan)
    folders = {f.rsplit("/", 2)[1] for f in index._rows("postings", search_index.grams_of("Disease 23")[:4]).inputFiles()}
    read = spark.read.parquet(str(tmp_path / "i/postings")).filter(F.col("gram").isin(search_index.grams_of("Disease 23")[:4]))
    assert {f"bucket={r[0]}" for r in read.select("bucket").distinct().collect()} <= folders
    metric = re.search(r"bucket#\d+ IN \(([\d,]+)\)|bucket#\d+ = (\d+)", plan)
    assert metric and len((metric[1] or metric[2]).split(",")) <= search_index.LOOKED_UP


# --- similarity of a batch

@pytest.mark.parametrize("block", [256, 3])
def test_batch_equals_single_searches(spark, block):
    items = views.read(spark, SF_DIR, "embeddings")
    queries = items.filter("vec_id % 97 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = expression.nearest_batch(items, queries, 4, block=block).collect()
    for q in queries.collect():
        want = [(r.vec_id, r.similarity) for r in expression.nearest(items, list(q.embedding), 4).collect()]
        assert [(r.vec_id, r.similarity) for r in sorted((r for r in got if r.query_id == q.query_id), key=lambda r: r.rank)] == want


def test_batch_is_one_scan_of_the_items(spark, tmp_path):
    views.read(spark, SF_DIR, "embeddings").write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    queries = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [0.0] * 64)], "query_id int, embedding array<double>")
    found = expression.nearest_batch(items, queries, 2)
    assert plan_of(found).count("FileScan") == 1
    assert {(r.query_id, r.similarity is None) for r in found.collect()} == {(1, False), (2, True), (3, True)}


# --- medians

def test_median_reads_twice(spark, tmp_path):
    rng = random.Random(3)
    data = [(k, None if rng.random() < 0.1 else rng.choice([rng.random(), 0.5])) for k in ["a"] * 5000 + ["b"] * 7 + [None] * 4 for _ in (1,)]
    spark.createDataFrame(data + [("n", None)], "k string, v double").write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "m"))
    found = stats.exact_median(df, ["k"], "v", "median", F.count("*").alias("n"))
    plan = plan_of(found)
    scans = len(re.findall(r"FileScan", plan))
    assert scans == 2 and len(re.findall(r"\bExchange\b", plan)) <= 7
    import statistics

    for r in found.collect():
        values = [v for k, v in data if k == r.k and v is not None]
        assert (r.median is None and not values) or r.median == statistics.median(values)
    assert {r.k for r in found.collect()} == {"a", "b", None, "n"}


# --- co-located joins and pruned partitions

def test_bucketed_tables_join_without_a_shuffle(spark):
    a = spark.range(500).select((F.col("id") % 40).cast("string").alias("gene"), "id")
    b = spark.range(40).select(F.col("id").cast("string").alias("gene"), (F.col("id") * 2).alias("x"))
    try:
        tables.write_bucketed(a, "bucketed_a", "gene", buckets=4)
        tables.write_bucketed(b, "bucketed_b", "gene", buckets=4)
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b").hint("merge"), "gene")
        assert "Exchange" not in plan_of(joined) and joined.count() == 500
    finally:
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_large_bucket_is_written_by_several_tasks(spark):
    a = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 4 != 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("gene"), "id")
    b = a.select("gene").distinct()
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64KB")
    try:
        tables.write_bucketed(a, "bucketed_hot", "gene", buckets=4)
        tables.write_bucketed(b, "bucketed_dim", "gene", buckets=4)
        sizes = [r["n"] for r in spark.table("bucketed_hot").groupBy("_metadata.file_path").agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 15_000
        joined = spark.table("bucketed_hot").join(spark.table("bucketed_dim").hint("merge"), "gene")
        assert "Exchange" not in plan_of(joined) and rows(joined) == rows(a)
    finally:
        spark.conf.unset(size)
        for name in ("bucketed_hot", "bucketed_dim"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_panel_reads_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "effects")
    tables.write_partitioned(views.load(spark, SF_DIR, "v_diff_expr"), path, "gene_target")
    views.read(spark, SF_DIR, "part").select("p_brand", "p_size").write.parquet(str(tmp_path / "part"))
    effects = spark.read.parquet(path)
    panel = spark.read.parquet(str(tmp_path / "part")).filter("p_size = 7").select("p_brand").distinct()
    found = perturbation.knockout_effects_by_target(effects, n=3, targets=panel)
    assert "dynamicpruning" in plan_of(found)
    wanted = {r[0] for r in panel.collect()}
    all_rows = perturbation.knockout_effects_by_target(effects, n=3).filter(F.col("gene_target").isin(list(wanted)))
    assert rows(found) == rows(all_rows)
    listed = spark.createDataFrame([(g,) for g in sorted(wanted)], "g string")
    assert rows(perturbation.knockout_effects_by_target(effects, n=3, targets=listed)) == rows(all_rows)


# --- matrices

def test_matrices_gather_no_keys(spark):
    df = spark.createDataFrame(
        [(f"r{i % 9}", f"c{i * 7 % 23}", float(i % 31) - 9) for i in range(300)] + [("r1", None, 50.0), (None, "c1", 1.0)], "r string, c string, v double",
    )
    mean = aggregates.mean_matrix(df, "r", "c", "v", 4)
    plan = plan_of(mean)
    assert "Window" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    data = df.collect()
    peaks = {}
    for r in data:
        peaks[r.r] = max(peaks.get(r.r, 0), abs(r.v))
    top = sorted(peaks, key=lambda k: (-peaks[k], k is None, k))[:4]
    columns = {r.c for r in data if r.r in top and r.c is not None}
    want = {}
    for a in top:
        for c in columns:
            values = [x.v for x in data if x.r == a and x.c == c]
            want[a, c] = sum(values) / len(values) if values else 0.0
    assert {(r.r, r.c): round(r.mean_value, 9) for r in mean.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_entity_matrix_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "KEY_BLOCK", 3)
    df = spark.createDataFrame([(f"e{i % 5}", f"k{i * 3 % 17}", float(i)) for i in range(60)] + [(None, "k3", 1.0)], "e string, k string, v double")
    got = aggregates.entity_matrix(df, "e", "k", "v", "e1")
    assert "collect_set" not in plan_of(got)
    data = df.collect()
    keys = {r.k for r in data if r.e == "e1"}
    want = {(e, k): max([r.v for r in data if (r.e, r.k) == (e, k)], default=0.0) for e in {r.e for r in data} for k in keys}
    assert {(r.e, r.k): r.v for r in got.collect()} == want and got.count() == len(want)


# --- profiles

def test_profile_on_records_without_a_summary(spark):
    records = views.load(spark, SF_DIR, "v_records").withColumn("source_key", F.lit("opentargets"))
    found = gene_profile.profile(records)
    assert found.count() > 0 and found.filter(F.size("associations") > 20).count() == 0


def test_profile_caps_are_arguments(spark):
    records = views.load(spark, SF_DIR, "v_sources")
    few = gene_profile.profile(records, {"associations": 2, "pathways": None}).select("gene", F.size("associations").alias("n"))
    every = gene_profile.profile(records, {n: None for n in gene_profile.CAPS}).select("gene", F.size("variants").alias("n"))
    assert {r.n for r in few.collect()} == {2}
    counts = {r.gene: r.n_variants for r in gene_profile.coverage(records, capped=False).collect()}
    assert {r.gene: r.n for r in every.collect()} == counts
    assert len(registry.SOURCES) == 21


# --- stored sketches

def test_profile_of_old_and_new_shards_rereads_nothing(spark, tmp_path):
    from quillomics.sources import files

    df = spark.range(40_000).select(
        (F.col("id") % 9_000).alias("k"), (F.xxhash64("id") % 100_000 / 1000).alias("x"), F.when(F.col("id") % 4 > 0, (F.col("id") % 37).cast("string")).alias("s"),
        F.lit(None).cast("int").alias("none"),
    )
    old, new = df.filter("k < 5000"), df.filter("k >= 5000")
    for part in (old, new, df.limit(0)):
        files.profile_sketches(part).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    merged = files.merged_profile(stored)
    assert len({f for f in merged.inputFiles()}) == len(stored.inputFiles())  # nothing but the sketches is read
    got = {r["column"]: r for r in merged.collect()}
    assert {c: (r.n_rows, r.n_null) for c, r in got.items()} == {"k": (40_000, 0), "x": (40_000, 0), "s": (40_000, 10_000), "none": (40_000, 40_000)}
    assert abs(got["k"].n_distinct - 9_000) < 0.05 * 9_000 and abs(got["s"].n_distinct - 37) <= 1 and got["none"].n_distinct == 0
    for c in ("k", "x"):
        below = df.filter(F.col(c) <= got[c].median).count() / 40_000
        assert 0.47 < below < 0.53
        assert (got[c].least, got[c].greatest) == tuple(map(float, df.agg(F.min(c), F.max(c)).first()))
    assert got["s"].median is None and got["none"].median is None
