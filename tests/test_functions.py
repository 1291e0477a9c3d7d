import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillomics.functions import predicates as P
from quillomics.functions import ranking as R
from quillomics.functions import scalars as S
from quillomics.functions import stats
from quillomics.operators import aggregates, joins, perturbation, pharmacology
from quillomics.sources import files, views
from tests.conftest import SF_DIR, rows

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@RELAXED
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=60))
def test_exact_median_matches_definition(spark, data):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double")
    got = {r["k"]: r["median"] for r in stats.exact_median(df, ["k"], "v").collect()}
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).extend([] if v is None else [float(v)])
    assert got == {k: statistics.median(v) if v else None for k, v in groups.items()}


def test_exact_median_of_a_hot_group(spark):
    """One group holds nearly all rows and more of them than the sketch keeps."""
    df = spark.range(200_001).select(
        F.when(F.col("id") < 7, "small").otherwise("hot").alias("k"), (F.pmod(F.hash("id"), F.lit(1_000_003)) * 1.0).alias("v")
    )
    exact = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {r["k"]: r["median"] for r in stats.exact_median(df, ["k"], "v").collect()} == exact


@RELAXED
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-9, 9), st.integers(0, 5)), min_size=1, max_size=80), st.integers(1, 4))
def test_top_n_per_group_matches_sorting(spark, data, n):
    df = spark.createDataFrame(data, "k int, v int, w int").repartition(4)
    got = sorted(tuple(r) for r in R.top_n_per_group(df, ["k"], n, F.col("v").desc()).collect())
    want = []
    for key in {d[0] for d in data}:
        want += sorted([d for d in data if d[0] == key], key=lambda d: (-d[1], d[0], d[1], d[2]))[:n]
    assert got == sorted(want)


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(5000).select(F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    for how in ("inner", "left"):
        assert rows(joins.salted(facts, dim, ["k"], how)) == rows(facts.join(dim, "k", how))
    with pytest.raises(ValueError):
        joins.salted(facts, dim, ["k"], "full")


def test_copies_of_a_salted_join_are_not_broadcast(spark):
    """The dim is under the broadcast threshold by its estimate, its copies are not counted in it."""
    facts, dim = spark.range(5000).withColumn("k", F.col("id") % 50), spark.range(40).withColumnRenamed("id", "k")
    for how in ("inner", "left"):
        joined = joins.salted(facts, dim, ["k"], how, buckets=1000)
        assert joined.count() == facts.join(dim, "k", how).count()
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_not_among_treats_missing_keys_as_equal(spark):
    left = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert rows(joins.not_among(left, spark.createDataFrame([("a",), (None,)], "k string"), "k")) == [("b",)]
    assert rows(joins.not_among(left, spark.createDataFrame([("a",)], "k string"), "k")) == [("b",), (None,)]


def test_scalars(spark):
    df = spark.createDataFrame([("C9orf72", "nan", 0.0), ("psen1", "1e-3", None), ("a-b c", "x", 2.0)], "g string, t string, n double")
    got = [tuple(r) for r in df.select(S.capitalize("g"), S.parse_double("t"), S.or_default("n", 1.0), S.cut("g", 3, "…")).collect()]
    assert got == [("C9orf72", None, 1.0, "C9o…"), ("Psen1", 0.001, 1.0, "pse…"), ("A-b c", None, 2.0, "a-b…")]


def test_user_text_is_not_a_pattern(spark):
    df = spark.createDataFrame([("50% up",), ("50 up",), ("a_b",), ("axb",)], "t string")
    assert rows(P.where(df, P.has_text_ignore_case("t", "50%"))) == [("50% up",)]
    assert rows(P.where(df, P.has_text("t", "a_b"))) == [("a_b",)]


def test_limits_and_required_filters(spark):
    numbers = spark.range(300)
    assert [R.top_k(numbers, k).count() for k in (-3, 0, 7, 299, None)] == [1, 1, 7, 299, 300]
    with pytest.raises(ValueError):
        pharmacology.drug_perturbations(views.load(spark, SF_DIR, "v_signatures"))
    with pytest.raises(ValueError):
        perturbation.ndd_risk_genes(views.load(spark, SF_DIR, "v_ndd_genes"), "OCD")


def test_nan_scores_never_pass_a_threshold(spark):
    df = spark.createDataFrame([("g", "1", "c", "nan", "0.1")], "gene string, gene_id string, chromosome string, FDR_TADA_DD string, p_TADA_DD string")
    assert perturbation.ndd_risk_genes(df, "dd", 1e9).count() == 0


def test_sketched_counts_are_close(spark):
    cells = views.load(spark, SF_DIR, "v_drug_cells")
    exact = {r["moa"]: r for r in pharmacology.moa_distribution(cells).collect()}
    for row in pharmacology.moa_distribution_approx(cells).collect():
        assert row["n_cells"] == exact[row["moa"]]["n_cells"]
        assert abs(row["n_drugs"] - exact[row["moa"]]["n_drugs"]) <= max(1, 0.1 * exact[row["moa"]]["n_drugs"])


def test_profile_marks_metadata_columns(spark):
    got = {r["column"]: r for r in files.profile(views.read(spark, SF_DIR, "orders"), distinct=True).collect()}
    assert got["o_orderstatus"]["is_metadata"] and not got["o_orderkey"]["is_metadata"]
    assert abs(got["o_orderkey"]["n_distinct"] - 1500) < 150


def test_matrix_fills_empty_cells(spark):
    df = spark.createDataFrame([("g1", "c1", 9.0), ("g1", "c2", -1.0), ("g2", "c1", 3.0), ("g3", "c3", 0.5)], "g string, c string, z double")
    got = rows(aggregates.mean_matrix(df, "g", "c", "z", 2).select("g", "c", "mean_value"))
    assert got == [("c1", "g1", 9.0), ("c1", "g2", 3.0), ("c2", "g1", -1.0), ("c2", "g2", 0.0)]
