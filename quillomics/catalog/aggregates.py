"""Rollups and reshaping with their checking SQL."""

from pyspark.sql import functions as F

from ..operators import aggregates as op
from . import query
from .records import num, src


@query("g01_count_by_keys", """
SELECT neuron_type, region_level1, count(*) AS n FROM v_cell_metadata GROUP BY ALL""")
def _(t):
    return op.count_by(t("v_cell_metadata"), "neuron_type", "region_level1")


@query("g02_conditional_sum", """
SELECT phenotype_name, CAST(sum(CASE WHEN hit_class <> 'none' THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM v_screens GROUP BY 1""")
def _(t):
    return t("v_screens").groupBy("phenotype_name").agg(F.count_if(F.col("hit_class") != "none").alias("n_hits"))


@query("g03_mean_abs_and_min", """
SELECT group_name, count(*) AS n, round(avg(abs(log2fc)), 3) AS avg_abs, min(pvalue_adj) AS best FROM v_diff_expr GROUP BY 1""")
def _(t):
    return t("v_diff_expr").groupBy("group_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs("log2fc")), 3).alias("avg_abs"),
        F.min("pvalue_adj").alias("best"),
    )


@query("g04_distinct_counts", """
SELECT count(DISTINCT drug) AS n_drugs, count(DISTINCT moa) AS n_moas, count(DISTINCT cell_line_id) AS n_lines FROM v_drug_cells""")
def _(t):
    pairs = t("v_drug_cells").groupBy("drug", "moa", "cell_line_id").agg(F.count(F.lit(1)).alias("_c"))
    return pairs.agg(
        F.countDistinct("drug").alias("n_drugs"),
        F.countDistinct("moa").alias("n_moas"),
        F.countDistinct("cell_line_id").alias("n_lines"),
    )


@query("g05_exact_median", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price,
       round(stddev_samp(l_extendedprice), 2) AS std_price FROM lineitem GROUP BY 1""")
def _(t):
    from ..functions import stats

    spread = F.round(F.stddev_samp("l_extendedprice"), 2).alias("std_price")
    out = stats.exact_median(t("lineitem"), ["l_returnflag"], "l_extendedprice", "median_price", spread)
    return out.withColumn("median_price", F.round("median_price", 4))


@query("g06_keep_first_gene", """
SELECT chromosome, gene, gene_id, ASD72 FROM (
  SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY gene, gene_id) AS rn FROM v_ndd_genes) WHERE rn = 1""")
def _(t):
    genes = t("v_ndd_genes").select("chromosome", "gene", "gene_id", "ASD72")
    return op.keep_first(genes, ["chromosome"], F.col("gene").asc(), F.col("gene_id").asc())


@query("g07_group_by_payload_field", """
SELECT payload->>'$.clinical_significance' AS clinical_significance, count(*) AS n FROM v_records GROUP BY 1""")
def _(t):
    from ..operators.records import significance

    return t("v_records").groupBy(significance().alias("clinical_significance")).agg(F.count(F.lit(1)).alias("n"))


def mutation_events(t):
    """Single mutations with the cancer type they were seen in."""
    from ..functions.payload import field

    return src(t, "cbioportal").select(
        F.upper("gene_symbol").alias("gene_symbol"),
        field("mutation_type").alias("mutation_type"),
        field("protein_change").alias("protein_change"),
        field("cancer_study").alias("cancer_type"),
    )


@query("g08_mutation_rollup", """
WITH m AS (SELECT upper(gene_symbol) AS gene_symbol, payload->>'$.mutation_type' AS mutation_type,
             payload->>'$.protein_change' AS protein_change, payload->>'$.cancer_study' AS ct
           FROM v_sources WHERE source_key = 'cbioportal'),
 r AS (SELECT gene_symbol, mutation_type, protein_change, count(*) AS sample_count,
         list_sort(list(DISTINCT ct)) AS cts FROM m GROUP BY 1, 2, 3),
 k AS (SELECT * FROM r)
SELECT gene_symbol, mutation_type, protein_change, sample_count, array_to_string(cts, '|') AS cancer_types,
       array_to_string(cts[1:3], '; ') AS disease, protein_change AS title FROM k""")
def _(t):
    rolled = op.mutation_rollup(mutation_events(t))
    return rolled.withColumn("cancer_types", F.array_join("cancer_types", "|"))


@query("g11_top_abs_per_group", """
SELECT cell_line, compound, gene_symbol, zscore FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_line, compound ORDER BY abs(zscore) DESC, gene_symbol, zscore) AS rn
  FROM (SELECT cell_line, compound, gene_symbol, zscore FROM v_signatures)) WHERE rn <= 3""")
def _(t):
    scores = t("v_signatures").select("cell_line", "compound", "gene_symbol", "zscore")
    return op.top_abs_per_group(scores, ["cell_line", "compound"], "zscore", 3)


@query("g12_first_row_per_key", """
SELECT molecule_name, target_alias, standard_value FROM (
  SELECT *, row_number() OVER (PARTITION BY molecule_name, target_alias ORDER BY l_orderkey, l_linenumber, standard_value) AS rn
  FROM v_activities) WHERE rn = 1""")
def _(t):
    return op.representative(
        t("v_activities"), ["molecule_name", "target_alias"], ["standard_value"], "l_orderkey", "l_linenumber"
    )


@query("g13_top_abs_ascending", """
SELECT compound, gene_symbol, zscore FROM v_signatures ORDER BY abs(zscore) DESC, 1, 2, 3 LIMIT 20""")
def _(t):
    return op.top_abs_ascending(t("v_signatures").select("compound", "gene_symbol", "zscore"), "zscore", 20)


@query("g14_top_keys", """
SELECT gene_symbol, max(abs(zscore)) AS peak FROM v_signatures GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    return op.top_keys(t("v_signatures"), "gene_symbol", "zscore", 15)


@query("g15_mean_pivot", """
SELECT compound, round(coalesce(avg(zscore) FILTER (gene_symbol = 'Brand#1'), 0), 12) AS "Brand#1",
       round(coalesce(avg(zscore) FILTER (gene_symbol = 'Brand#2'), 0), 12) AS "Brand#2",
       round(coalesce(avg(zscore) FILTER (gene_symbol = 'Brand#3'), 0), 12) AS "Brand#3"
FROM v_signatures GROUP BY compound""")
def _(t):
    genes = ["Brand#1", "Brand#2", "Brand#3"]
    wide = op.mean_pivot(t("v_signatures"), "compound", "gene_symbol", "zscore", genes)
    return wide.select("compound", *[F.round(F.col(f"`{g}`"), 12).alias(g) for g in genes])


@query("g15_mean_matrix", """
WITH top AS (SELECT gene_symbol FROM v_signatures GROUP BY 1 ORDER BY max(abs(zscore)) DESC, 1 LIMIT 5),
 m AS (SELECT gene_symbol, cell_line, avg(zscore) AS z FROM v_signatures WHERE gene_symbol IN (SELECT gene_symbol FROM top) GROUP BY 1, 2)
SELECT t.gene_symbol, c.cell_line, round(coalesce(m.z, 0), 12) AS mean_value
FROM top t CROSS JOIN (SELECT DISTINCT cell_line FROM m) c LEFT JOIN m ON m.gene_symbol = t.gene_symbol AND m.cell_line = c.cell_line""")
def _(t):
    cells = op.mean_matrix(t("v_signatures"), "gene_symbol", "cell_line", "zscore", 5)
    return cells.withColumn("mean_value", F.round("mean_value", 12))


@query("g17_entity_matrix", """
WITH b AS (SELECT p_type, p_brand, round(avg(p_size), 4) AS m FROM part GROUP BY 1, 2),
 k AS (SELECT p_brand FROM b WHERE p_type = 'ECONOMY')
SELECT g.p_type, k.p_brand, coalesce(b.m, 0) AS m
FROM (SELECT DISTINCT p_type FROM b) g CROSS JOIN k LEFT JOIN b ON b.p_type = g.p_type AND b.p_brand = k.p_brand""")
def _(t):
    means = t("part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_size"), 4).alias("m"))
    return op.entity_matrix(means, "p_type", "p_brand", "m", "ECONOMY")


@query("g18_to_long", """
SELECT l_orderkey, l_linenumber, measure, score FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem)
UNPIVOT (score FOR measure IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def _(t):
    wide = t("lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return op.to_long(
        wide, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure", "score"
    )


@query("g18_expression_pairs", """
SELECT vec_id, CAST(unnest(range(1, len(embedding) + 1)) AS BIGINT) AS gene, unnest(embedding) AS expression FROM embeddings""")
def _(t):
    """Parallel gene and expression arrays of every cell, one row per gene."""
    cells = t("embeddings").select(
        "vec_id",
        F.sequence(F.lit(1).cast("bigint"), F.size("embedding").cast("bigint")).alias("gene"),
        F.col("embedding").alias("expression"),
    )
    return op.explode_pairs(cells, ["vec_id"], "gene", "expression")


@query("g19_vocabulary", """
SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents""")
def _(t):
    return op.vocabulary(t("documents"), F.split("text", " "))


@query("g20_representative_catalog", """
SELECT drug, cell_line_id, moa, arg_min(cluster, cluster) AS cluster FROM v_drug_cells GROUP BY drug, cell_line_id, moa""")
def _(t):
    return op.representative(t("v_drug_cells"), ["drug", "cell_line_id", "moa"], ["cluster"])


@query("g21_coverage_shares", """
SELECT gene_symbol, source_key, count(*) AS n_records,
       round(count(*) / sum(count(*)) OVER (PARTITION BY gene_symbol), 6) AS share
FROM v_sources GROUP BY gene_symbol, source_key""")
def _(t):
    return op.coverage_shares(t("v_sources"), "gene_symbol", "source_key")
