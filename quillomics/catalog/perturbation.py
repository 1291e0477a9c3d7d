"""Knockout, screen and risk-gene queries with their checking SQL."""

from ..functions import predicates as P
from ..operators import perturbation as op
from ..session import scratch_path
from ..sources import tables
from . import query

EFFECT_COLUMNS = (
    "group_name AS cell_type, log2fc, pvalue_adj, n_cells_ko AS n_perturbed, n_cells_ctrl AS n_control"
)


@query("q01_knockout_effects", f"""
SELECT de_gene AS affected_gene, {EFFECT_COLUMNS} FROM v_diff_expr
WHERE gene_target = 'Brand#12' AND pvalue_adj < 0.05 AND contains(group_name, 'STAND')
ORDER BY abs(log2fc) DESC, affected_gene, cell_type, log2fc, pvalue_adj, n_perturbed, n_control LIMIT 50""")
def _(t):
    return op.knockout_effects(t("v_diff_expr"), "Brand#12", cell_type="STAND")


@query("q01_knockout_effects_all_types", f"""
SELECT de_gene AS affected_gene, {EFFECT_COLUMNS} FROM v_diff_expr
WHERE gene_target = 'Brand#7' AND pvalue_adj < 0.5
ORDER BY abs(log2fc) DESC, affected_gene, cell_type, log2fc, pvalue_adj, n_perturbed, n_control LIMIT 1000""")
def _(t):
    return op.knockout_effects(t("v_diff_expr"), "Brand#7", pval_threshold=0.5, limit=1000)


@query("q01_knockout_effects_by_target", f"""
SELECT gene_target, affected_gene, cell_type, log2fc, pvalue_adj, n_perturbed, n_control FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_target ORDER BY abs(log2fc) DESC, affected_gene, cell_type, log2fc,
      pvalue_adj, n_perturbed, n_control) AS rn
  FROM (SELECT gene_target, de_gene AS affected_gene, {EFFECT_COLUMNS} FROM v_diff_expr WHERE pvalue_adj < 0.05))
WHERE rn <= 5""")
def _(t):
    return op.knockout_effects_by_target(t("v_diff_expr"), n=5)


@query("q02_knockouts_affecting", f"""
SELECT gene_target AS knockout, {EFFECT_COLUMNS} FROM v_diff_expr
WHERE de_gene = 'red widget' AND pvalue_adj < 0.05
ORDER BY abs(log2fc) DESC, knockout, cell_type, log2fc, pvalue_adj, n_perturbed, n_control LIMIT 50""")
def _(t):
    return op.knockouts_affecting(t("v_diff_expr"), "red widget")


@query("q02_knockouts_affecting_by_gene", f"""
SELECT de_gene, knockout, cell_type, log2fc, pvalue_adj, n_perturbed, n_control FROM (
  SELECT *, row_number() OVER (PARTITION BY de_gene ORDER BY abs(log2fc) DESC, knockout, cell_type, log2fc,
      pvalue_adj, n_perturbed, n_control) AS rn
  FROM (SELECT de_gene, gene_target AS knockout, {EFFECT_COLUMNS} FROM v_diff_expr WHERE pvalue_adj < 0.05))
WHERE rn <= 3""")
def _(t):
    return op.knockouts_affecting_by_gene(t("v_diff_expr"), n=3)


def panel_sql(key, name, panel):
    return f"""
SELECT {key}, {name}, cell_type, log2fc, pvalue_adj, n_perturbed, n_control FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY abs(log2fc) DESC, {name}, cell_type, log2fc,
      pvalue_adj, n_perturbed, n_control) AS rn
  FROM (SELECT {key}, {'de_gene' if key == 'gene_target' else 'gene_target'} AS {name}, {EFFECT_COLUMNS} FROM v_diff_expr
        WHERE pvalue_adj < 0.05 AND {key} IN ({panel})))
WHERE rn <= 5"""


def partitioned_effects(t, key):
    path = scratch_path(t.spark, "effects")
    tables.write_partitioned(t("v_diff_expr"), path, key)
    return t.spark.read.parquet(path)


@query("q01_knockout_panel", panel_sql("gene_target", "affected_gene", "SELECT p_brand FROM part WHERE p_size = 7"))
def _(t):
    """A panel of targets on the table partitioned by target: other partitions are not read."""
    panel = t("part").filter("p_size = 7").select("p_brand").distinct()
    return op.knockout_effects_by_target(partitioned_effects(t, "gene_target"), n=5, targets=panel)


@query("q02_knockouts_affecting_panel", panel_sql("de_gene", "knockout", "SELECT p_name FROM part WHERE p_size = 7"))
def _(t):
    """The reverse lookup of a panel of genes on the table partitioned by gene."""
    panel = t("part").filter("p_size = 7").select("p_name").distinct()
    return op.knockouts_affecting_by_gene(partitioned_effects(t, "de_gene"), n=5, genes=panel)


@query("q03_ndd_risk_genes", """
SELECT DISTINCT gene, gene_id, chromosome, fdr, pvalue, ASD72 FROM (
  SELECT gene, gene_id, chromosome, TRY_CAST(nullif(FDR_TADA_ASD, 'nan') AS DOUBLE) AS fdr,
         TRY_CAST(p_TADA_ASD AS DOUBLE) AS pvalue, ASD72 FROM v_ndd_genes)
WHERE fdr < 0.1E0 ORDER BY fdr, gene, gene_id, chromosome, pvalue, ASD72 LIMIT 50""")
def _(t):
    return op.ndd_risk_genes(t("v_ndd_genes"), "asd")


@query("q04_brain_cell_types", """
SELECT predicted_class, predicted_subclass, neuron_type, region_level1, region_level2, count(*) AS n_cells
FROM v_cell_metadata WHERE passes_qc
  AND (contains(lower(predicted_class), 'econ') OR contains(lower(region_level1), 'econ') OR contains(lower(neuron_type), 'econ'))
GROUP BY ALL ORDER BY n_cells DESC, 1, 2, 3, 4, 5 LIMIT 50""")
def _(t):
    return op.brain_cell_types(t("v_cell_metadata"), "Econ")


@query("q05_knockout_targets", """
SELECT DISTINCT gene_target FROM v_cell_metadata
WHERE gene_target IS NOT NULL AND gene_target <> 'non-targeting' AND contains(lower(gene_target), 'brand#1')
ORDER BY gene_target LIMIT 50""")
def _(t):
    return op.knockout_targets(t("v_cell_metadata"), "BRAND#1")


@query("q06_screen_hits", """
SELECT screen_name, gene, cell_type, genotype, crispr_mode, phenotype_name, phenotype_score, pvalue, hit_class
FROM v_screens WHERE upper(gene) = 'NATION_3' AND contains(lower(cell_type), 'build') AND contains(lower(phenotype_name), 'low')
ORDER BY abs(phenotype_score) DESC NULLS LAST, 1, 2, 3, 4, 5, 6, 7, 8, 9 LIMIT 100""")
def _(t):
    return op.screen_hits(t("v_screens"), "nation_3", "Build", "low", 100)


@query("q07_list_screens", """
SELECT screen_name, cell_type, genotype, crispr_mode, phenotype_name, count(*) AS n_genes,
       CAST(count_if(hit_class <> 'none') AS BIGINT) AS n_hits
FROM v_screens WHERE contains(lower(cell_type), 'a') GROUP BY ALL
ORDER BY n_hits DESC, 1, 2, 3, 4, 5, 6 LIMIT 20""")
def _(t):
    return op.list_screens(t("v_screens"), "A", 20)


@query("q07_screen_validation", """
SELECT screen_name, cell_type, crispr_mode, genotype, count(*) AS n_genes,
       CAST(count_if(hit_class <> 'none') AS BIGINT) AS n_hits, round(avg(phenotype_score), 3) AS avg_phenotype
FROM v_screens GROUP BY screen_name, cell_type, crispr_mode, genotype""")
def _(t):
    return op.screen_validation(t("v_screens"))


# The mouse table is keyed by brand here, the screens by nation: one gene name is mapped onto both.
@query("q08_compare_cross_species", """
(SELECT 'human' AS species, screen_name, cell_type, phenotype_name, phenotype_score, pvalue, hit_class,
        CAST(NULL AS BIGINT) AS n_sig_effects, CAST(NULL AS DOUBLE) AS avg_abs_log2fc, CAST(NULL AS DOUBLE) AS best_pval
 FROM v_screens WHERE upper(gene) = 'BRAND#3'
 ORDER BY abs(phenotype_score) DESC NULLS LAST, 2, 3, 4, 5, 6, 7 LIMIT 30)
UNION ALL
(SELECT 'mouse', NULL, group_name, NULL, NULL, NULL, NULL, count(*), round(avg(abs(log2fc)), 3), min(pvalue_adj)
 FROM v_diff_expr WHERE gene_target = 'Brand#3' AND pvalue_adj < 0.05E0 GROUP BY group_name
 ORDER BY 8 DESC, 3 LIMIT 30)""")
def _(t):
    return op.compare_cross_species(t("v_screens"), t("v_diff_expr"), "bRAND#3")


@query("q08_cross_species_panel", """
WITH h AS (SELECT upper(gene) AS gene_key, count(*) AS human_screens, CAST(count_if(hit_class <> 'none') AS BIGINT) AS human_hits,
             max(abs(phenotype_score)) AS human_max_abs_score FROM v_screens GROUP BY 1),
     m AS (SELECT upper(gene_target) AS gene_key, count(*) AS mouse_effects, round(avg(abs(log2fc)), 3) AS mouse_avg_abs_log2fc,
             min(pvalue_adj) AS mouse_best_pval FROM v_diff_expr WHERE pvalue_adj < 0.05E0 GROUP BY 1)
SELECT coalesce(h.gene_key, m.gene_key) AS gene_key, human_screens, human_hits, human_max_abs_score,
       mouse_effects, mouse_avg_abs_log2fc, mouse_best_pval
FROM h FULL JOIN m ON h.gene_key = m.gene_key""")
def _(t):
    return op.cross_species_panel(t("v_screens"), t("v_diff_expr"))


@query("q13_summarize", """
SELECT 'cells' AS dataset, count(DISTINCT CASE WHEN gene_target <> 'non-targeting' THEN gene_target END) AS n_distinct,
       count(*) AS total_rows FROM v_cell_metadata
UNION ALL SELECT 'screens', count(DISTINCT screen_name), count(*) FROM v_screens""")
def _(t):
    return op.summarize(t("v_cell_metadata"), t("v_screens"))


@query("q33_phenotype_hits", """
SELECT gene_target AS marker_symbol, group_name AS term_name, de_gene AS procedure_name, pvalue_adj AS p_value,
       log2fc AS effect_size, count(*) OVER () AS total_phenotypes
FROM v_diff_expr WHERE gene_target = 'Brand#9' AND contains(lower(group_name), 'e')
ORDER BY p_value, 1, 2, 3, 4, 5 LIMIT 15""")
def _(t):
    return op.phenotype_hits(t("v_diff_expr"), "Brand#9", "E")


@query("j01_target_summary", """
SELECT gene_target, CAST(NULL AS VARCHAR) AS gene_id, CAST(NULL AS VARCHAR) AS chromosome,
       count(DISTINCT batch) AS n_guides, count(*) AS n_cells_targeted
FROM v_cell_metadata WHERE gene_target IS NOT NULL AND gene_target <> 'non-targeting' GROUP BY gene_target""")
def _(t):
    return op.target_summary(t("v_cell_metadata"))


@query("f04_real_targets", """
SELECT count(*) AS n FROM v_cell_metadata WHERE gene_target IS NOT NULL AND gene_target <> 'non-targeting'""")
def _(t):
    from pyspark.sql import functions as F

    return P.where(t("v_cell_metadata"), P.is_target()).agg(F.count(F.lit(1)).alias("n"))
