"""Drug signature, receptor activity and drug-cell queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import ranking as R


def drug_perturbations(
    signatures: DataFrame,
    compound: str = "",
    gene_symbol: str = "",
    cell_line: str = "",
    neuronal_only: bool = False,
    limit: int | None = 50,
) -> DataFrame:
    """Expression signatures, largest absolute z-score first. At least one filter is required."""
    filters = [
        P.equals_key(signatures, "compound", compound),
        P.equals_key(signatures, "gene_symbol", gene_symbol),
        P.equals_key(signatures, "cell_line", cell_line),
        F.col("is_neuronal") if neuronal_only else None,
    ]
    P.require_one("give at least one of compound, gene_symbol, cell_line or neuronal_only", *filters)
    wanted = [
        c
        for c in (
            "compound", "moa", "cell_line", "is_neuronal", "gene_symbol", "zscore", "dose_um",
            "timepoint_h", "approval_status", "brand_name",
        )
        if c in signatures.columns
    ]
    return R.top_k(P.where(signatures, *filters).select(*wanted), limit, R.abs_desc("zscore"))


def receptor_pharmacology(
    activities: DataFrame, compound: str = "", target: str = "", assay_type: str = "", limit: int | None = 50
) -> DataFrame:
    """Binding activities, most potent first; without filters, every named molecule."""
    filters = [
        P.has_text_ignore_case("molecule_name", compound),
        P.any_of([P.equals_key(activities, "target_alias", target), P.equals_key(activities, "target_gene", target)]),
        P.equals_key(activities, "standard_type", assay_type),
    ]
    if all(f is None for f in filters):
        filters = [F.col("molecule_name").isNotNull() & (F.col("molecule_name") != "")]
    wanted = [
        c
        for c in (
            "molecule_name", "molecule_id", "target_gene", "target_alias", "compound_brand",
            "compound_company", "selectivity_class", "year_approved", "standard_type", "standard_value",
            "standard_units", "pchembl_value", "assay_description",
        )
        if c in activities.columns
    ]
    rows = P.where(activities, *filters).select(*wanted)
    return R.top_k(rows, limit, F.col("pchembl_value").desc_nulls_last())


def _per_line(cells: DataFrame, *keys: str) -> DataFrame:
    """Cell counts per key set: the only pass over the raw cells, combined map-side."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))


def list_drugs(drug_cells: DataFrame, search: str = "", cell_line: str = "", limit: int | None = 50) -> DataFrame:
    """Cells and distinct cell lines per drug and mechanism."""
    cells = P.where(
        drug_cells,
        F.col("drug").isNotNull(),
        P.has_text_ignore_case("drug", search),
        P.has_text_ignore_case("cell_line_id", cell_line),
    )
    counts = (
        _per_line(cells, "drug", "moa", "cell_line_id")
        .groupBy("drug", "moa")
        .agg(F.sum("_c").alias("n_cells"), F.count("cell_line_id").alias("n_cell_lines"))
    )
    return R.top_k(counts, limit, F.col("n_cells").desc())


def drug_clusters(drug_cells: DataFrame, drug: str = "", cell_line: str = "", limit: int | None = 50) -> DataFrame:
    """Cell counts by drug, line, mechanism and cluster."""
    cells = P.where(
        drug_cells, P.has_text_ignore_case("drug", drug), P.has_text_ignore_case("cell_line_id", cell_line)
    )
    counts = cells.groupBy("drug", "cell_line_id", "moa", "cluster").agg(F.count(F.lit(1)).alias("n_cells"))
    return R.top_k(counts, limit, F.col("drug").asc_nulls_first(), F.col("n_cells").desc())


def moa_distribution(
    drug_cells: DataFrame, moa_filter: str = "", limit: int | None = 50, drop_unknown: bool = False
) -> DataFrame:
    """Distinct drugs, distinct lines and cells per mechanism.

    Cells shrink to one row per (mechanism, drug, line) before the distinct counts.
    """
    cells = P.where(
        drug_cells,
        F.col("moa").isNotNull(),
        P.has_text_ignore_case("moa", moa_filter),
        (F.col("moa") != "unknown") if drop_unknown else None,
    )
    counts = (
        _per_line(cells, "moa", "drug", "cell_line_id")
        .groupBy("moa")
        .agg(
            F.countDistinct("drug").alias("n_drugs"),
            F.sum("_c").alias("n_cells"),
            F.countDistinct("cell_line_id").alias("n_cell_lines"),
        )
    )
    return R.top_k(counts, limit, F.col("n_drugs").desc())


def moa_distribution_approx(drug_cells: DataFrame, rsd: float = 0.02) -> DataFrame:
    """As ``moa_distribution`` over all mechanisms, with sketched distinct counts in a single shuffle."""
    return (
        drug_cells.filter(F.col("moa").isNotNull())
        .groupBy("moa")
        .agg(
            F.approx_count_distinct("drug", rsd).alias("n_drugs"),
            F.count(F.lit(1)).alias("n_cells"),
            F.approx_count_distinct("cell_line_id", rsd).alias("n_cell_lines"),
        )
    )


def allele_products(products: DataFrame, gene_symbol: str, product_type: str = "mice") -> DataFrame:
    """Products of a gene; a product type nobody offers falls back to live lines."""
    kind = product_type if product_type in ("mice", "es_cell") else "mice"
    return products.filter((F.col("gene_symbol") == gene_symbol) & (F.col("product_type") == kind))
