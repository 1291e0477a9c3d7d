"""Chart numbers with their checking SQL."""

from pyspark.sql import functions as F

from ..operators import analytics as op
from ..operators import expression, perturbation, pharmacology, records
from . import query
from .expression import baseline_table
from .records import AREA, SCORE, num, src


def effects(t):
    return t("v_diff_expr").select(
        "gene_target", F.col("de_gene").alias("affected_gene"), F.col("group_name").alias("cell_type"),
        "log2fc", "pvalue_adj",
    )


@query("v01_volcano", """
SELECT gene_target, de_gene AS affected_gene, group_name AS cell_type, log2fc, pvalue_adj,
       round(-log10(greatest(pvalue_adj, 1e-300)), 6) AS neg_log10_p,
       pvalue_adj < 0.05E0 AND abs(log2fc) > 0.5E0 AS significant
FROM v_diff_expr WHERE pvalue_adj > 0""")
def _(t):
    return op.volcano(effects(t))


@query("v02_effect_matrix", """
WITH top AS (SELECT de_gene FROM v_diff_expr GROUP BY de_gene ORDER BY max(abs(log2fc)) DESC, de_gene LIMIT 10)
SELECT de_gene AS affected_gene, group_name AS cell_type, log2fc, abs(log2fc) * 8 AS marker_size
FROM v_diff_expr WHERE de_gene IN (SELECT de_gene FROM top)""")
def _(t):
    return op.effect_matrix(effects(t))


PAIR_SQL = """
WITH p AS (SELECT * FROM v_activities WHERE pchembl_value IS NOT NULL AND pchembl_value <> 0),
 r1 AS (SELECT molecule_name, arg_min(standard_value, (l_orderkey, l_linenumber, standard_value)) AS value_1 FROM p
        WHERE target_alias IN ('OX1R', 'HCRTR1') GROUP BY 1),
 r2 AS (SELECT molecule_name, arg_min(standard_value, (l_orderkey, l_linenumber, standard_value)) AS value_2 FROM p
        WHERE target_alias IN ('OX2R', 'HCRTR2') GROUP BY 1),
 pairs AS (SELECT r1.molecule_name, value_1, value_2 FROM r1 JOIN r2 ON r1.molecule_name = r2.molecule_name)
"""


@query("v03_selectivity_pairs", PAIR_SQL + """
SELECT molecule_name, value_1, value_2, round(value_1 / value_2, 6) AS ratio,
       (SELECT max(greatest(value_1, value_2)) * 1.5 FROM pairs) AS equipotent_bound FROM pairs""")
def _(t):
    return op.selectivity_pairs(t("v_activities"), "l_orderkey", "l_linenumber", "standard_value")


@query("j02_selectivity_join", PAIR_SQL + "SELECT molecule_name, value_1, value_2 FROM pairs")
def _(t):
    return op.selectivity_join(t("v_activities"), "l_orderkey", "l_linenumber")


@query("v04_potency_ranking", """
SELECT molecule_name || ' (' || target_alias || ')' AS label, standard_value, pchembl_value FROM v_activities
WHERE pchembl_value IS NOT NULL AND pchembl_value <> 0""")
def _(t):
    return op.potency_ranking(t("v_activities"))


def dflt(path, default):
    return f"coalesce(nullif({num('constraint.' + path)}, 0), {default})"


@query("v05_constraint_radar", f"""
SELECT gene_symbol, {dflt('pLI', '0E0')} AS lof_intolerance,
       round(greatest(0, 1 - {dflt('oe_lof', '1E0')}), 6) AS lof_constraint,
       round(greatest(0, 1 - {dflt('oe_mis', '1E0')}), 6) AS missense_constraint,
       round(least(1E0, greatest(0E0, ({dflt('mis_z', '0E0')} + 2) / 6)), 6) AS missense_z,
       round(least(1E0, greatest(0E0, ({dflt('lof_z', '0E0')} + 2) / 6)), 6) AS lof_z_scaled
FROM v_sources WHERE source_key = 'gnomad' AND title LIKE '%Constraint%'""")
def _(t):
    rows = src(t, "gnomad").filter(records.is_constraint())
    return op.constraint_radar(rows.select("gene_symbol", *records.constraint_columns()))


@query("v06_constraint_scatter", f"""
SELECT gene_symbol, {dflt('pLI', '0E0')} AS pli, {dflt('oe_lof_upper', '1E0')} AS loeuf,
       greatest(8E0, least(30E0, abs({dflt('mis_z', '0E0')}) * 10)) AS marker_size,
       {dflt('pLI', '0E0')} > 0.9E0 AS lof_intolerant, {dflt('oe_lof_upper', '1E0')} < 0.35E0 AS constrained
FROM v_sources WHERE source_key = 'gnomad' AND title LIKE '%Constraint%'""")
def _(t):
    return op.constraint_scatter(records.constraint_table(src(t, "gnomad")))


@query("v07_evidence_levels", r"""
SELECT CASE WHEN regexp_matches(title, 'Level\s+\w') THEN regexp_extract(title, 'Level\s+(\w)', 1) ELSE '?' END AS level,
       count(*) AS n FROM v_sources WHERE source_key = 'civic' GROUP BY 1""")
def _(t):
    return op.evidence_levels(src(t, "civic"))


@query("v08_title_scores", r"""
SELECT gene_symbol, disease, left(disease, 40) AS label, CAST(regexp_extract(title, 'score:\s*([\d.]+)', 1) AS DOUBLE) AS score
FROM v_sources WHERE source_key = 'opentargets' AND regexp_matches(title, 'score:\s*[\d.]+') AND disease <> ''""")
def _(t):
    return op.title_scores(src(t, "opentargets"))


@query("v09_significance_counts", """
SELECT coalesce(payload->>'$.clinical_significance', 'Other') AS significance, count(*) AS n
FROM v_sources WHERE source_key = 'gnomad' AND title NOT LIKE '%Constraint%' GROUP BY 1""")
def _(t):
    return op.significance_counts(src(t, "gnomad"))


@query("v09_significance_by_gene", """
SELECT gene_symbol, coalesce(payload->>'$.clinical_significance', 'Unknown') AS significance, count(*) AS n
FROM v_sources WHERE source_key = 'gnomad' AND title NOT LIKE '%Constraint%' GROUP BY 1, 2""")
def _(t):
    return op.significance_by_gene(src(t, "gnomad"))


@query("v10_disease_counts", """
SELECT *, left(disease, 35) AS label FROM (
  SELECT coalesce(nullif(disease, ''), 'Unknown') AS disease, count(*) AS n
  FROM v_sources WHERE source_key = 'cbioportal' GROUP BY 1 ORDER BY n DESC, disease LIMIT 15)""")
def _(t):
    return op.disease_counts(src(t, "cbioportal"))


def kind_sql(column, source):
    low = f"lower(coalesce({column}, ''))"
    return f"""
SELECT CASE WHEN contains({low}, 'sequencing') THEN 'Sequencing' WHEN contains({low}, 'panel') THEN 'Gene Panel'
            WHEN contains({low}, 'deletion') OR contains({low}, 'dup') THEN 'Del/Dup' ELSE 'Other' END AS kind,
       count(*) AS n FROM {source} GROUP BY 1"""


@query("v11_test_kinds", kind_sql("title", "v_sources WHERE source_key = 'ncbi_gtr'"))
def _(t):
    return op.test_kinds(src(t, "ncbi_gtr"))


@query("v11_test_kinds_of_documents", kind_sql("text", "documents"))
def _(t):
    return op.test_kinds(t("documents"), "text")


@query("v12_tissue_levels", """
SELECT gene_symbol, trim(split_part(split_part(title, ' in ', 2), ':', 1)) AS tissue,
       CASE trim(split_part(title, ':', -1)) WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 0 END AS level,
       TRY_CAST(payload->>'$.nTPM' AS DOUBLE) AS n_tpm
FROM v_sources WHERE source_key = 'human_protein_atlas' AND contains(title, ' in ') AND contains(title, ':')""")
def _(t):
    return op.tissue_levels(src(t, "human_protein_atlas"))


@query("v13_risk_ranking", """
SELECT gene, fdr, round(-log10(fdr), 6) AS neg_log10_fdr FROM (
  SELECT DISTINCT gene, TRY_CAST(nullif(FDR_TADA_ASD, 'nan') AS DOUBLE) AS fdr FROM v_ndd_genes) WHERE fdr < 0.1E0
ORDER BY fdr, gene LIMIT 25""")
def _(t):
    return op.risk_ranking(perturbation.ndd_risk_genes(t("v_ndd_genes"), "ASD", limit=None))


@query("v14_effects_per_cell_type", """
SELECT group_name AS cell_type, count(*) AS n_sig_effects FROM v_diff_expr
WHERE gene_target = 'Brand#3' AND pvalue_adj < 0.05E0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    return op.effects_per_cell_type(perturbation.cross_species_mouse(t("v_diff_expr"), "brand#3"))


@query("v14_phenotype_bars", """
SELECT screen_name, phenotype_name, left(screen_name, 25) || ' (' || phenotype_name || ')' AS label, phenotype_score FROM v_screens
WHERE upper(gene) = 'NATION_3' ORDER BY abs(phenotype_score) DESC NULLS LAST, screen_name, gene, cell_type, genotype,
  crispr_mode, phenotype_name, phenotype_score, pvalue, hit_class LIMIT 50""")
def _(t):
    return op.phenotype_bars(perturbation.screen_hits(t("v_screens"), "NATION_3"))


@query("v15_association_bars", f"""
WITH r AS (SELECT upper(gene_symbol) AS gene, disease, {SCORE} AS s, {AREA} AS therapeutic_area FROM v_sources
           WHERE source_key = 'opentargets'),
 k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY s DESC NULLS LAST, disease, s, therapeutic_area) AS rn FROM r),
 f AS (SELECT *, min(-rn) OVER (PARTITION BY gene, therapeutic_area) AS fs FROM k WHERE rn <= 10)
SELECT gene, coalesce(disease, 'Unknown') AS disease, left(coalesce(disease, 'Unknown'), 40) AS label, coalesce(s, 0) AS score, therapeutic_area,
       CAST(dense_rank() OVER (PARTITION BY gene ORDER BY fs) AS INTEGER) AS colour FROM f""")
def _(t):
    return op.association_bars(src(t, "opentargets"))


@query("v16_expression_matrix", """
WITH b AS (SELECT gene_symbol, replace(tissue, 'Brain - ', '') AS region, round(avg(tpm), 4) AS m FROM v_expression GROUP BY 1, 2),
 k AS (SELECT region FROM b WHERE gene_symbol = 'CLICK')
SELECT g.gene_symbol, k.region, coalesce(b.m, 0) AS median_tpm
FROM (SELECT DISTINCT gene_symbol FROM b) g CROSS JOIN k LEFT JOIN b ON b.gene_symbol = g.gene_symbol AND b.region = k.region""")
def _(t):
    return op.expression_matrix(baseline_table(t), "CLICK")


@query("v16_expression_profile", """
SELECT replace(tissue, 'Brain - ', '') AS region, round(avg(tpm), 4) AS median_tpm FROM v_expression
WHERE gene_symbol = 'ERROR' GROUP BY 1""")
def _(t):
    rows = expression.baseline_expression(baseline_table(t), "error")
    return rows.select(op.region_name().alias("region"), "median_tpm")


@query("v17_moa_bars", """
SELECT moa, count(DISTINCT drug) AS n_drugs FROM v_drug_cells WHERE moa IS NOT NULL GROUP BY moa
ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    return op.largest(pharmacology.moa_distribution(t("v_drug_cells"), limit=None).select("moa", "n_drugs"), "n_drugs", 20)


@query("v17_cluster_bars", """
SELECT cluster, n_cells FROM (
  SELECT drug, cell_line_id, moa, cluster, count(*) AS n_cells FROM v_drug_cells WHERE contains(lower(drug), 'red') GROUP BY ALL)
ORDER BY n_cells DESC, cluster LIMIT 20""")
def _(t):
    clusters = pharmacology.drug_clusters(t("v_drug_cells"), "red", limit=None)
    return op.largest(clusters.select("cluster", "n_cells"), "n_cells", 20)


@query("v17_cell_type_bars", """
SELECT predicted_class AS cell_type, n_cells FROM (
  SELECT predicted_class, predicted_subclass, neuron_type, region_level1, region_level2, count(*) AS n_cells
  FROM v_cell_metadata WHERE passes_qc GROUP BY ALL)
ORDER BY n_cells DESC, cell_type LIMIT 25""")
def _(t):
    cells = perturbation.brain_cell_types(t("v_cell_metadata"), limit=None)
    return op.largest(cells.select(F.col("predicted_class").alias("cell_type"), "n_cells"), "n_cells", 25)


@query("v18_perturbation_heatmap", """
WITH top AS (SELECT gene_symbol FROM v_signatures GROUP BY 1 ORDER BY max(abs(zscore)) DESC, 1 LIMIT 15),
 m AS (SELECT gene_symbol, compound, avg(zscore) AS z FROM v_signatures WHERE gene_symbol IN (SELECT gene_symbol FROM top) GROUP BY 1, 2)
SELECT t.gene_symbol, c.compound, round(coalesce(m.z, 0), 2) AS mean_value
FROM top t CROSS JOIN (SELECT DISTINCT compound FROM m) c LEFT JOIN m ON m.gene_symbol = t.gene_symbol AND m.compound = c.compound""")
def _(t):
    return op.perturbation_heatmap(t("v_signatures"))


@query("g16_score_heatmap", f"""
WITH l AS (SELECT gene_symbol, disease, {SCORE} AS score FROM v_sources WHERE source_key = 'opentargets'),
 c AS (SELECT disease, gene_symbol, max(score) AS v FROM l WHERE disease <> '' GROUP BY 1, 2),
 d AS (SELECT disease, max(v) AS lead FROM c GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 12),
 n AS (SELECT disease, row_number() OVER (ORDER BY lead DESC NULLS LAST, disease) AS rn FROM d)
SELECT n.disease, g.gene_symbol, CAST(n.rn AS INTEGER) AS row_rank, coalesce(c.v, 0) AS score, left(n.disease, 35) AS label
FROM n CROSS JOIN (SELECT DISTINCT gene_symbol FROM l) g LEFT JOIN c ON c.disease = n.disease AND c.gene_symbol = g.gene_symbol""")
def _(t):
    landscape = src(t, "opentargets").select("gene_symbol", "disease", records.score().alias("score"))
    return op.score_heatmap(landscape)
