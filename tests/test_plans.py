"""Physical plans: what must not appear, and what must be pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from quillomics import catalog
from quillomics.functions import stats
from quillomics.operators import expression, joins, perturbation, records
from quillomics.sources import files, tables, views
from tests.conftest import SF_DIR

catalog.load_all()

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapPartitions")
# These write tables or run streams while being built; their operators are planned elsewhere here.
EAGER = ("a03", "a04", "a05_json", "a12", "a13", "a14", "a15", "a16_upsert", "a17", "a18", "a19_change", "s0")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith(EAGER)))
def test_no_pairs_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    assert [w for w in FORBIDDEN if w in text] == []


def test_top_k_is_not_a_global_sort(spark):
    text = plan(perturbation.knockout_effects(views.load(spark, SF_DIR, "v_diff_expr"), "Brand#7"))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_group_limit_runs_before_the_shuffle(spark):
    text = plan(perturbation.knockout_effects_by_target(views.load(spark, SF_DIR, "v_diff_expr"), 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "effects")
    raw = views.load(spark, SF_DIR, "v_diff_expr").withColumnsRenamed({"de_gene": "names", "pvalue_adj": "pvals_adj"})
    raw.write.parquet(path)
    text = plan(files.significant_effects(spark.read.parquet(path)).select("gene_target", "log2fc"))
    assert "LessThan(pvals_adj,0.05)" in text
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", text)[1].replace("...", "").split(",")) <= {
        "gene_target:string", "log2fc:double", "pvals_adj:double"}


def test_partition_pruning_by_target(spark, tmp_path):
    path = str(tmp_path / "by_target")
    tables.write_partitioned(views.load(spark, SF_DIR, "v_diff_expr"), path, "gene_target")
    text = plan(perturbation.knockout_effects(spark.read.parquet(path), "Brand#7"))
    assert re.search(r"PartitionFilters: \[[^\]]*Brand#7", text)


def test_gene_key_is_pushed(spark, tmp_path):
    path = str(tmp_path / "records")
    views.load(spark, SF_DIR, "v_sources").withColumn("gene_key", F.upper("gene_symbol")).write.parquet(path)
    text = plan(records.titled(spark.read.parquet(path), "gene7"))
    assert "EqualTo(gene_key,GENE7)" in text


def test_lookups_are_not_forced_into_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = views.read(spark, SF_DIR, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
        text = plan(joins.lookup(facts, views.read(spark, SF_DIR, "part"), ["p_partkey"]))
        assert "SortMergeJoin" in text and "Broadcast" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_median_reads_the_rows_twice_and_never_gathers_a_group(spark):
    text = plan(stats.exact_median(views.read(spark, SF_DIR, "lineitem"), ["l_returnflag"], "l_extendedprice"))
    assert "collect_list" not in text and "percentile(" not in text.replace("percentile_approx(", "")


def test_similarity_search_forms_no_pairs(spark):
    items = views.read(spark, SF_DIR, "embeddings")
    text = plan(expression.nearest(items, [0.1] * 64))
    assert "Join" not in text and "TakeOrderedAndProject" in text


def test_stored_keys_prune_the_scan(spark, tmp_path):
    from quillomics.functions import predicates as P
    from quillomics.operators import expression, perturbation, pharmacology

    def stored(view, *names):
        path = str(tmp_path / view)
        P.with_keys(views.load(spark, SF_DIR, view), *names).write.parquet(path)
        return spark.read.parquet(path)

    screens, signatures = stored("v_screens", "gene"), stored("v_signatures", "compound", "gene_symbol", "cell_line")
    activities, values = stored("v_activities", "target_gene", "target_alias", "standard_type"), stored("v_expression", "gene_symbol", "cohort")
    asked = {
        "gene_key": perturbation.screen_hits(screens, "nation_3"),
        "compound_key": pharmacology.drug_perturbations(signatures, compound="red widget"),
        "standard_type_key": pharmacology.receptor_pharmacology(activities, assay_type="ki"),
        "gene_symbol_key": expression.expression_summary(values, "click"),
    }
    for name, df in asked.items():
        assert f"EqualTo({name}," in df._jdf.queryExecution().executedPlan().toString(), name
    plain = perturbation.screen_hits(views.load(spark, SF_DIR, "v_screens"), "nation_3")
    assert asked["gene_key"].collect() == plain.collect()
