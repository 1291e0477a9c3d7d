"""Drug signature, receptor and drug-cell queries with their checking SQL."""

from pyspark.sql import functions as F

from ..operators import pharmacology as op
from . import query


@query("q10_drug_perturbations", """
SELECT compound, moa, cell_line, is_neuronal, gene_symbol, zscore, dose_um, timepoint_h FROM v_signatures
WHERE upper(compound) = 'RED WIDGET' AND upper(gene_symbol) = 'BRAND#4' AND is_neuronal
ORDER BY abs(zscore) DESC, 1, 2, 3, 4, 5, 6, 7, 8 LIMIT 50""")
def _(t):
    return op.drug_perturbations(t("v_signatures"), compound="Red Widget", gene_symbol="brand#4", neuronal_only=True)


@query("q10_drug_perturbations_cell_line", """
SELECT compound, moa, cell_line, is_neuronal, gene_symbol, zscore, dose_um, timepoint_h FROM v_signatures
WHERE upper(cell_line) = 'SUPPLIER#000000003' ORDER BY abs(zscore) DESC, 1, 2, 3, 4, 5, 6, 7, 8 LIMIT 500""")
def _(t):
    return op.drug_perturbations(t("v_signatures"), cell_line="supplier#000000003", limit=500)


ACTIVITY = "molecule_name, molecule_id, target_gene, target_alias, standard_type, standard_value, pchembl_value"


@query("q11_receptor_pharmacology", f"""
SELECT {ACTIVITY} FROM v_activities
WHERE contains(lower(molecule_name), 'widget') AND (upper(target_alias) = 'OX1R' OR upper(target_gene) = 'OX1R')
  AND upper(standard_type) = 'KI'
ORDER BY pchembl_value DESC NULLS LAST, 1, 2, 3, 4, 5, 6, 7 LIMIT 50""")
def _(t):
    return op.receptor_pharmacology(t("v_activities"), compound="Widget", target="ox1r", assay_type="ki")


@query("q11_receptor_pharmacology_default", f"""
SELECT {ACTIVITY} FROM v_activities WHERE molecule_name IS NOT NULL AND molecule_name <> ''
ORDER BY pchembl_value DESC NULLS LAST, 1, 2, 3, 4, 5, 6, 7 LIMIT 50""")
def _(t):
    return op.receptor_pharmacology(t("v_activities"))


@query("q14_list_drugs", """
SELECT drug, moa, count(*) AS n_cells, count(DISTINCT cell_line_id) AS n_cell_lines FROM v_drug_cells
WHERE drug IS NOT NULL AND contains(lower(drug), 'ring') AND contains(lower(cell_line_id), '0')
GROUP BY drug, moa ORDER BY n_cells DESC, 1, 2, 4 LIMIT 50""")
def _(t):
    return op.list_drugs(t("v_drug_cells"), "RING", "0")


@query("q15_drug_clusters", """
SELECT drug, cell_line_id, moa, cluster, count(*) AS n_cells FROM v_drug_cells
WHERE contains(lower(drug), 'ring') GROUP BY ALL
ORDER BY drug ASC NULLS FIRST, n_cells DESC, cell_line_id, moa, cluster LIMIT 100""")
def _(t):
    return op.drug_clusters(t("v_drug_cells"), "Ring", limit=100)


@query("q16_moa_distribution", """
SELECT moa, count(DISTINCT drug) AS n_drugs, count(*) AS n_cells, count(DISTINCT cell_line_id) AS n_cell_lines
FROM v_drug_cells WHERE moa IS NOT NULL GROUP BY moa ORDER BY n_drugs DESC, moa LIMIT 50""")
def _(t):
    return op.moa_distribution(t("v_drug_cells"))


@query("q16_moa_distribution_known", """
SELECT moa, count(DISTINCT drug) AS n_drugs, count(*) AS n_cells, count(DISTINCT cell_line_id) AS n_cell_lines
FROM v_drug_cells WHERE moa IS NOT NULL AND moa <> 'unknown' AND contains(lower(moa), 'o')
GROUP BY moa ORDER BY n_drugs DESC, moa LIMIT 20""")
def _(t):
    return op.moa_distribution(t("v_drug_cells"), "O", 20, drop_unknown=True)


# Sketched counts have no exact SQL counterpart: checked against the exact form in the tests.
@query("q16_moa_distribution_approx")
def _(t):
    return op.moa_distribution_approx(t("v_drug_cells"))


def allele_table(t):
    """Products offered per gene, from the parts catalogue."""
    return t("part").select(
        F.col("p_brand").alias("gene_symbol"),
        F.when(F.col("p_size") % 2 == 0, "es_cell").otherwise("mice").alias("product_type"),
        F.concat(F.col("p_brand"), F.lit("<tm"), F.col("p_size").cast("string"), F.lit(">")).alias("allele"),
        F.col("p_type").alias("center"),
    )


@query("q35_allele_products", """
SELECT p_brand AS gene_symbol, 'es_cell' AS product_type, p_brand || '<tm' || CAST(p_size AS VARCHAR) || '>' AS allele,
       p_type AS center FROM part WHERE p_brand = 'Brand#5' AND p_size % 2 = 0""")
def _(t):
    return op.allele_products(allele_table(t), "Brand#5", "es_cell")


@query("q35_allele_products_fallback", """
SELECT p_brand AS gene_symbol, 'mice' AS product_type, p_brand || '<tm' || CAST(p_size AS VARCHAR) || '>' AS allele,
       p_type AS center FROM part WHERE p_brand = 'Brand#5' AND p_size % 2 <> 0""")
def _(t):
    return op.allele_products(allele_table(t), "Brand#5", "plasmid")
