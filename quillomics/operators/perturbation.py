"""Knockout, risk-gene, cell-type and screen queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import ranking as R
from ..functions import scalars as S

# Disorders, and gene lists flagged in the table.
DISORDERS = ("ASD", "DD", "NDD")
LIST_FLAGS = ("ASD72", "DD309", "NDD373", "SCZ244")


def _effects(df: DataFrame, *lead) -> DataFrame:
    return df.select(
        *lead,
        F.col("group_name").alias("cell_type"),
        "log2fc",
        "pvalue_adj",
        F.col("n_cells_ko").alias("n_perturbed"),
        F.col("n_cells_ctrl").alias("n_control"),
    )


def knockout_effects(
    diff_expr: DataFrame, gene_target: str, cell_type: str = "", pval_threshold: float = 0.05, limit: int | None = 50
) -> DataFrame:
    """Strongest significant effects of one perturbation."""
    hits = P.where(
        diff_expr,
        F.col("gene_target") == gene_target,
        F.col("pvalue_adj") < pval_threshold,
        P.has_text("group_name", cell_type),
    )
    rows = _effects(hits, F.col("de_gene").alias("affected_gene"))
    return R.top_k(rows, limit, R.abs_desc("log2fc"))


def knockouts_affecting(
    diff_expr: DataFrame, gene_name: str, cell_type: str = "", pval_threshold: float = 0.05, limit: int | None = 50
) -> DataFrame:
    """Perturbations that move one gene most."""
    hits = P.where(
        diff_expr,
        F.col("de_gene") == gene_name,
        F.col("pvalue_adj") < pval_threshold,
        P.has_text("group_name", cell_type),
    )
    rows = _effects(hits, F.col("gene_target").alias("knockout"))
    return R.top_k(rows, limit, R.abs_desc("log2fc"))


def knockout_effects_by_target(
    diff_expr: DataFrame, n: int | None = 50, pval_threshold: float = 0.05, targets: DataFrame | None = None
) -> DataFrame:
    """Batched form: the top n effects of every target, or of a panel of targets, in one job.

    On a table partitioned by target only the partitions of the panel are read.
    """
    hits = diff_expr.filter((F.col("pvalue_adj") < pval_threshold) & F.col("gene_target").isNotNull())
    hits = _of_panel(hits, "gene_target", targets)
    rows = _effects(hits, "gene_target", F.col("de_gene").alias("affected_gene"))
    return R.top_n_per_group(rows, ["gene_target"], n, R.abs_desc("log2fc"))


def _of_panel(rows: DataFrame, key: str, panel: DataFrame | None) -> DataFrame:
    """Rows whose key is in the panel's first column; all rows without a panel.

    An empty name is no key. The filter says so, and also tells the optimizer that the panel is a selection, whose keys
    are then found before the rows are read (dynamic partition pruning).
    """
    if panel is None:
        return rows
    wanted = panel.select(F.col(panel.columns[0]).alias(key)).filter(F.length(key) > 0)
    return rows.join(wanted, key, "left_semi")


def knockouts_affecting_by_gene(
    diff_expr: DataFrame, n: int | None = 50, pval_threshold: float = 0.05, genes: DataFrame | None = None
) -> DataFrame:
    """Batched reverse lookup: the top n perturbations of every affected gene, or of a panel of genes.

    On a table partitioned by the affected gene only the partitions of the panel are read.
    """
    hits = diff_expr.filter((F.col("pvalue_adj") < pval_threshold) & F.col("de_gene").isNotNull())
    hits = _of_panel(hits, "de_gene", genes)
    rows = _effects(hits, "de_gene", F.col("gene_target").alias("knockout"))
    return R.top_n_per_group(rows, ["de_gene"], n, R.abs_desc("log2fc"))


def ndd_risk_genes(
    ndd_genes: DataFrame, disorder: str = "NDD", fdr_threshold: float = 0.1, limit: int | None = 50
) -> DataFrame:
    """Genes under a false-discovery threshold for one disorder. Text that is no number counts as missing."""
    disorder = disorder.upper()
    if disorder not in DISORDERS:
        raise ValueError("unsupported disorder: use ASD, DD or NDD")
    flags = [c for c in LIST_FLAGS if c in ndd_genes.columns]
    rows = ndd_genes.select(
        "gene",
        "gene_id",
        "chromosome",
        S.parse_double(f"FDR_TADA_{disorder}").alias("fdr"),
        S.parse_double(f"p_TADA_{disorder}").alias("pvalue"),
        *flags,
    )
    return R.top_k(
        rows.filter(F.col("fdr") < fdr_threshold).distinct(), limit, F.col("fdr").asc()
    )


def brain_cell_types(cell_metadata: DataFrame, region_filter: str = "", limit: int | None = 50) -> DataFrame:
    """Cell counts by class, subclass, neuron type and region, over cells that passed QC."""
    keys = ["predicted_class", "predicted_subclass", "neuron_type", "region_level1", "region_level2"]
    cells = P.where(
        cell_metadata,
        F.col("passes_qc"),
        P.any_has_text(["predicted_class", "region_level1", "neuron_type"], region_filter),
    )
    counts = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
    return R.top_k(counts, limit, F.col("n_cells").desc())


def knockout_targets(cell_metadata: DataFrame, search: str = "", limit: int | None = 50) -> DataFrame:
    """Perturbed genes by name, without the control key."""
    targets = P.where(cell_metadata, P.is_target(), P.has_text_ignore_case("gene_target", search))
    return R.top_k(targets.select("gene_target").distinct(), limit, F.col("gene_target").asc())


def target_summary(cell_metadata: DataFrame) -> DataFrame:
    """Cells and distinct batches (a stand-in for guides) per target, from one grouping.

    Cells are counted per (target, batch) first, so a target holding a third of the
    cells is already spread over its batches when it is shuffled.
    """
    per_batch = (
        cell_metadata.filter(P.is_target())
        .groupBy("gene_target", "batch")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return per_batch.groupBy("gene_target").agg(
        F.lit(None).cast("string").alias("gene_id"),
        F.lit(None).cast("string").alias("chromosome"),
        F.count("batch").alias("n_guides"),
        F.sum("_c").alias("n_cells_targeted"),
    )


def screen_hits(
    screens: DataFrame, gene: str, cell_type: str = "", phenotype: str = "", limit: int | None = 50
) -> DataFrame:
    """Screen results of one gene, strongest phenotype first."""
    wanted = [
        c
        for c in (
            "screen_name", "gene", "cell_type", "genotype", "crispr_mode", "phenotype_name",
            "phenotype_score", "pvalue", "gene_score", "hit_class",
        )
        if c in screens.columns
    ]
    rows = P.where(
        screens,
        P.equals_key(screens, "gene", gene),
        P.has_text_ignore_case("cell_type", cell_type),
        P.has_text_ignore_case("phenotype_name", phenotype),
    )
    return R.top_k(rows.select(*wanted), limit, R.abs_desc("phenotype_score"))


SCREEN_KEYS = ["screen_name", "cell_type", "genotype", "crispr_mode", "phenotype_name"]


def list_screens(screens: DataFrame, cell_type: str = "", limit: int | None = 50) -> DataFrame:
    """Genes and hits per screen, most hits first."""
    rows = P.where(screens, P.has_text_ignore_case("cell_type", cell_type))
    counts = rows.groupBy(*SCREEN_KEYS).agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.count_if(F.col("hit_class") != "none").alias("n_hits"),
    )
    return R.top_k(counts, limit, F.col("n_hits").desc())


def screen_validation(screens: DataFrame) -> DataFrame:
    """Genes, hits and mean phenotype of every screen."""
    return screens.groupBy("screen_name", "cell_type", "crispr_mode", "genotype").agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.count_if(F.col("hit_class") != "none").alias("n_hits"),
        F.round(F.avg("phenotype_score"), 3).alias("avg_phenotype"),
    )


def _mouse_effects(diff_expr: DataFrame, *keys) -> DataFrame:
    return (
        diff_expr.filter(F.col("pvalue_adj") < 0.05)
        .groupBy(*keys, F.col("group_name").alias("cell_type"))
        .agg(
            F.count(F.lit(1)).alias("n_sig_effects"),
            F.round(F.avg(F.abs("log2fc")), 3).alias("avg_abs_log2fc"),
            F.min("pvalue_adj").alias("best_pval"),
        )
    )


def cross_species_human(screens: DataFrame, gene: str, limit: int | None = 30) -> DataFrame:
    rows = screens.filter(P.equals_key(screens, "gene", gene)).select(
        "screen_name", "cell_type", "phenotype_name", "phenotype_score", "pvalue", "hit_class"
    )
    return R.top_k(rows, limit, R.abs_desc("phenotype_score"))


def cross_species_mouse(diff_expr: DataFrame, gene: str, limit: int | None = 30) -> DataFrame:
    """Effects per cell type; mouse symbols are written in title case."""
    effects = _mouse_effects(diff_expr.filter(F.col("gene_target") == gene.capitalize()))
    return R.top_k(effects, limit, F.col("n_sig_effects").desc())


def compare_cross_species(screens: DataFrame, diff_expr: DataFrame, gene: str, limit: int | None = 30) -> DataFrame:
    """Human screens and mouse effects of one gene as one tagged table."""
    human = cross_species_human(screens, gene, limit).select(F.lit("human").alias("species"), "*")
    mouse = cross_species_mouse(diff_expr, gene, limit).select(F.lit("mouse").alias("species"), "*")
    return human.unionByName(mouse, allowMissingColumns=True)


def cross_species_panel(screens: DataFrame, diff_expr: DataFrame) -> DataFrame:
    """Both species side by side for every symbol; each side is aggregated before the join."""
    human = (
        screens.filter(F.col("gene").isNotNull())
        .groupBy(P.key_of(screens, "gene").alias("gene_key"))
        .agg(
            F.count(F.lit(1)).alias("human_screens"),
            F.count_if(F.col("hit_class") != "none").alias("human_hits"),
            F.max(F.abs("phenotype_score")).alias("human_max_abs_score"),
        )
    )
    mouse = (
        diff_expr.filter((F.col("pvalue_adj") < 0.05) & F.col("gene_target").isNotNull())
        .groupBy(F.upper("gene_target").alias("gene_key"))
        .agg(
            F.count(F.lit(1)).alias("mouse_effects"),
            F.round(F.avg(F.abs("log2fc")), 3).alias("mouse_avg_abs_log2fc"),
            F.min("pvalue_adj").alias("mouse_best_pval"),
        )
    )
    return human.join(mouse, "gene_key", "full_outer")


def summarize(cell_metadata: DataFrame, screens: DataFrame) -> DataFrame:
    """Distinct targets and screens with row counts, one row per dataset."""
    cells = cell_metadata.agg(
        F.lit("cells").alias("dataset"),
        F.countDistinct(F.when(P.is_target(), F.col("gene_target"))).alias("n_distinct"),
        F.count(F.lit(1)).alias("total_rows"),
    )
    human = screens.agg(
        F.lit("screens").alias("dataset"),
        F.countDistinct("screen_name").alias("n_distinct"),
        F.count(F.lit(1)).alias("total_rows"),
    )
    return cells.unionByName(human)


def phenotype_hits(
    diff_expr: DataFrame, gene_symbol: str, phenotype_filter: str = "", limit: int | None = 15
) -> DataFrame:
    """Most significant phenotypes of a gene, with the number of matches before the limit."""
    rows = P.where(
        diff_expr, F.col("gene_target") == gene_symbol, P.has_text_ignore_case("group_name", phenotype_filter)
    ).select(
        F.col("gene_target").alias("marker_symbol"),
        F.col("group_name").alias("term_name"),
        F.col("de_gene").alias("procedure_name"),
        F.col("pvalue_adj").alias("p_value"),
        F.col("log2fc").alias("effect_size"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    best = R.top_k(rows, limit, F.col("p_value").asc_nulls_last())
    return best.withColumn("total_phenotypes", total)
