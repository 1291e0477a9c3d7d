"""Every registered query against its checking SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from quillomics import catalog
from tests.conftest import SF_DIR
from tools.check import compare, connect

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
# Results that may legitimately be empty on the smallest tables.
MAY_BE_EMPTY = {
    "q08_compare_cross_species", "q10_drug_perturbations", "q11_receptor_pharmacology", "q17c_constraint",
    "q17d_pathways", "q17e_mutations", "q17e_proteins", "q17e_tests", "q17a_associations", "q17b_variants",
    "q21_titled_variants", "q24_clinical_evidence", "q26_genetic_tests", "q28_phenotype_associations",
    "q29_protein_function", "q30_reactome_pathways", "q41_genetic_test_check", "q41_pathway_check",
    "q41_association_check", "q06_screen_hits", "q33_phenotype_hits", "j08_not_loaded", "j11_resolve_strict",
    "q35_allele_products", "q35_allele_products_fallback", "q22_target_associations", "q32_search_source",
    "q01_knockout_effects", "v14_effects_per_cell_type",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name not in ORACLES:
        assert df.count() > 0
        return
    n, problem = compare(con, df, ORACLES[name])
    assert problem is None
    assert n > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_sketches_lack_checking_sql():
    assert sorted(set(QUERIES) - set(ORACLES)) == ["a11_profile_distinct", "q16_moa_distribution_approx"]
