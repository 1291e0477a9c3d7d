"""Canonical table schemas and alignment onto them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names and types of the tables.
SCHEMAS = {
    "diff_expr": "gene_target string, de_gene string, group_name string, log2fc double, pvalue_adj double, "
    "n_cells_ko int, n_cells_ctrl int",
    "cell_metadata": "cell_barcode string, gene_target string, predicted_class string, predicted_subclass string, "
    "neuron_type string, region_level1 string, region_level2 string, passes_qc boolean, batch string",
    "cell_atlas": "cell_barcode string, gene_target string, cell_type string, region string, umap_1 double, "
    "umap_2 double, n_counts int, batch string",
    "gene_metadata": "gene_target string, gene_id string, chromosome string, n_guides bigint, n_cells_targeted bigint",
    "ndd_genes": "gene string, gene_id string, chromosome string, FDR_TADA_ASD double, FDR_TADA_DD double, "
    "FDR_TADA_NDD double, p_TADA_ASD double, p_TADA_DD double, p_TADA_NDD double, ASD72 double, DD309 double, "
    "NDD373 double, SCZ244 double",
    "screens": "screen_name string, gene string, cell_type string, genotype string, crispr_mode string, "
    "phenotype_name string, phenotype_score double, pvalue double, gene_score double, hit_class string, "
    "species string, source string, ingested_at timestamp",
    "expression": "gene_symbol string, cohort string, tissue string, sample_id string, tpm double",
    "baseline_expression": "gene_symbol string, tissue string, tissue_id string, median_tpm double, n_samples int, "
    "source string",
    "drug_signatures": "compound string, moa string, approval_status string, brand_name string, cell_line string, "
    "is_neuronal boolean, gene_symbol string, zscore double, dose_um double, timepoint_h int, source string",
    "drug_cells": "drug string, moa string, cell_line_id string, cluster string, canonical_smiles string, "
    "pubchem_cid string, sample string, barcode string",
    "records": "record_id string, source_key string, gene_symbol string, gene_key string, disease string, drug string, title string, "
    "summary string, payload variant, ingested_at timestamp, source_updated_at timestamp, api_version string",
    "query_log": "query_id string, timestamp timestamp, user_email string, species_focus string, query_text string, "
    "response_text string, tools_used string",
}

# Raw names of the canonical columns, by preference.
EFFECT_NAMES = {
    "de_gene": ("de_gene", "names"),
    "log2fc": ("log2fc", "logfoldchanges"),
    "pvalue_adj": ("pvalue_adj", "pvals_adj"),
    "n_cells_ko": ("n_cells_ko", "n_pert_matched"),
    "n_cells_ctrl": ("n_cells_ctrl", "n_ctrl_matched"),
}
DRUG_CELL_NAMES = {
    "drug": ("drug", "perturbation", "pert_iname", "compound"),
    "moa": ("moa", "moa-fine", "moa_id", "mechanism_of_action", "target"),
    "cell_line_id": ("cell_line_id", "cell_line", "cell_id", "line"),
    "cluster": ("leiden", "cluster", "seurat_clusters", "cluster_id", "plate"),
    "barcode": ("barcode", "BARCODE_SUB_LIB_ID"),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def align_to_schema(
    df: DataFrame, target: StructType | str, candidates: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Columns of the target in its order and types: renamed from a candidate, or added as typed NULLs."""
    target = schema(target) if isinstance(target, str) else target
    out = []
    for field in target.fields:
        names = (candidates or {}).get(field.name, (field.name,))
        found = next((n for n in names if n in df.columns), None)
        source = F.lit(None) if found is None else F.col(f"`{found}`")
        same = found is not None and df.schema[found].dataType == field.dataType
        out.append((source if same else source.cast(field.dataType)).alias(field.name))
    return df.select(*out)
