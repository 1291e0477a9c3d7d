"""Expression, orthology and similarity queries with their checking SQL."""

from pyspark.sql import functions as F

from ..operators import expression as op
from . import query


def baseline_table(t):
    """Median expression per gene and tissue."""
    return (
        t("v_expression")
        .groupBy("gene_symbol", "tissue")
        .agg(F.round(F.avg("tpm"), 4).alias("median_tpm"), F.count(F.lit(1)).alias("n_samples"))
    )


@query("q09_baseline_expression", """
SELECT gene_symbol, tissue, round(avg(tpm), 4) AS median_tpm, count(*) AS n_samples FROM v_expression
WHERE gene_symbol = 'CLICK' AND contains(lower(tissue), 'region 1') GROUP BY gene_symbol, tissue""")
def _(t):
    return op.baseline_expression(baseline_table(t), "click", "Region 1")


@query("q12_human_expression", """
SELECT gene_symbol, cohort, tissue, count(*) AS n_samples, round(avg(tpm), 4) AS mean_tpm,
       round(quantile_cont(tpm, 0.5), 4) AS median_tpm, round(stddev_samp(tpm), 4) AS std_tpm
FROM v_expression WHERE gene_symbol = 'CLICK' AND lower(cohort) = 'rosmap' AND contains(lower(tissue), 'region')
GROUP BY gene_symbol, cohort, tissue""")
def _(t):
    return op.human_expression(t("v_expression"), "click", "Rosmap", "REGION")


@query("q12_expression_summary_all", """
SELECT gene_symbol, cohort, tissue, count(*) AS n_samples, round(avg(tpm), 4) AS mean_tpm,
       round(quantile_cont(tpm, 0.5), 4) AS median_tpm, round(stddev_samp(tpm), 4) AS std_tpm
FROM v_expression GROUP BY gene_symbol, cohort, tissue""")
def _(t):
    return op.expression_summary(t("v_expression"))


def ortholog_table(t):
    """Mouse and human symbols of the same item, from the parts catalogue."""
    return t("part").select(
        F.concat(F.initcap(F.substring("p_type", 1, 4)), F.col("p_partkey").cast("string")).alias("mouse_symbol"),
        F.upper(F.concat(F.substring("p_type", 1, 4), F.col("p_partkey").cast("string"))).alias("human_symbol"),
        F.col("p_size").alias("support_count"),
        F.when(F.col("p_size") > 25, "GOOD").otherwise("MODERATE").alias("category"),
    )


ORTHOLOG_SQL = """
WITH pairs AS (SELECT upper(left(p_type, 1)) || lower(substr(p_type, 2, 3)) || CAST(p_partkey AS VARCHAR) AS mouse_symbol,
    upper(substr(p_type, 1, 4) || CAST(p_partkey AS VARCHAR)) AS human_symbol, p_size AS support_count,
    CASE WHEN p_size > 25 THEN 'GOOD' ELSE 'MODERATE' END AS category FROM part)
"""


@query("q34_orthologs_mouse_to_human", ORTHOLOG_SQL + """
SELECT mouse_symbol AS query_gene, human_symbol AS ortholog, support_count, category, 'mouse_to_human' AS direction FROM pairs""")
def _(t):
    pairs = ortholog_table(t)
    return op.orthologs(pairs, pairs.select(F.lower("mouse_symbol").alias("gene")))


@query("q34_orthologs_human_to_mouse", ORTHOLOG_SQL + """
SELECT human_symbol AS query_gene, mouse_symbol AS ortholog, support_count, category, 'human_to_mouse' AS direction FROM pairs
WHERE support_count > 40""")
def _(t):
    pairs = ortholog_table(t)
    genes = pairs.filter("support_count > 40").select(F.lower("human_symbol").alias("gene"))
    return op.orthologs(pairs, genes, "human_to_mouse")


@query("q36_publication_search", """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)), 6) AS similarity
FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 5""")
def _(t):
    items = t("embeddings")
    # The searched text is itself an indexed item here; one row, fetched as a scalar subquery.
    wanted = items.filter("vec_id = 3").select("embedding").scalar()
    return op.nearest(items, wanted)


@query("q36_batch_search", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 20),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def _(t):
    """A batch of twenty query vectors against all items, in one scan of them."""
    items = t("embeddings")
    return op.nearest_batch(items, items.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding"))
