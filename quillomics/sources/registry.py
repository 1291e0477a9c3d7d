"""Source registry: which record sources exist and which of their fields may be searched."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LITERATURE, EXPRESSION, GENETICS = "literature", "expression", "genetics"
PATHWAYS, DRUGGABILITY = "pathways", "druggability"
HIGH, MEDIUM, LOW = "high", "medium", "low"
REST, BULK, GRAPHQL = "rest_api", "bulk_download", "graphql"


@dataclass(frozen=True)
class Source:
    key: str
    name: str
    source_type: str
    priority: str
    ingest_method: str
    searchable_fields: tuple[str, ...]
    partition_cols: tuple[str, ...] = field(default=())
    incremental: bool = True

    @property
    def target_table(self) -> str:
        return f"src_{self.key}"


# The known sources, by type.
SOURCES: tuple[Source, ...] = (
    Source("pubmed", "PubMed", LITERATURE, HIGH, REST, ("gene_symbol", "disease", "drug", "pmid")),
    Source("clinicaltrials", "ClinicalTrials.gov", LITERATURE, HIGH, REST,
           ("condition", "intervention", "sponsor", "nct_id")),
    Source("clinvar", "ClinVar", LITERATURE, HIGH, REST,
           ("gene_symbol", "variant", "condition", "clinical_significance")),
    Source("openfda", "OpenFDA", LITERATURE, HIGH, REST,
           ("drug_name", "reaction", "indication", "application_number")),
    Source("semantic_scholar", "Semantic Scholar", LITERATURE, HIGH, REST,
           ("query", "paper_id", "author", "fields_of_study")),
    Source("civic", "CIViC", GENETICS, HIGH, REST, ("gene", "variant", "disease", "therapy", "evidence_level")),
    Source("cbioportal", "cBioPortal", GENETICS, HIGH, REST, ("gene", "study_id", "cancer_type", "mutation_type")),
    Source("ema", "EMA", LITERATURE, HIGH, REST,
           ("drug_name", "active_substance", "therapeutic_area", "authorisation_status")),
    Source("ncbi_gtr", "NCBI Genetic Testing Registry", GENETICS, HIGH, REST,
           ("gene", "condition", "test_name", "lab_name")),
    Source("medlineplus", "MedlinePlus", LITERATURE, HIGH, REST, ("disease", "gene", "symptom")),
    Source("pharmgkb", "PharmGKB / CPIC", LITERATURE, HIGH, REST, ("gene", "drug", "variant", "phenotype")),
    Source("uniprot", "UniProt", EXPRESSION, HIGH, REST,
           ("gene", "protein_name", "organism", "function", "subcellular_location")),
    Source("human_protein_atlas", "Human Protein Atlas", EXPRESSION, HIGH, REST,
           ("gene", "tissue", "cell_type", "cancer_type")),
    Source("monarch", "Monarch Initiative", EXPRESSION, HIGH, REST,
           ("gene", "disease", "phenotype", "model_organism")),
    Source("gnomad", "gnomAD", GENETICS, HIGH, REST, ("gene", "variant", "region", "population")),
    Source("seer", "SEER Explorer", GENETICS, HIGH, BULK, ("cancer_site", "stage", "age_group", "year")),
    Source("reactome", "Reactome", PATHWAYS, HIGH, REST, ("gene", "pathway_name", "pathway_id", "species")),
    Source("kegg", "KEGG", PATHWAYS, HIGH, REST, ("gene", "pathway_id", "compound", "disease")),
    Source("opentargets", "OpenTargets", DRUGGABILITY, HIGH, GRAPHQL, ("gene", "disease", "drug", "tractability")),
    Source("ddinter", "DDInter", DRUGGABILITY, MEDIUM, REST, ("drug_a", "drug_b", "severity", "mechanism")),
    Source("who_ivd", "WHO Prequalified IVD", LITERATURE, MEDIUM, REST,
           ("disease", "product_name", "manufacturer")),
)

BY_KEY = {s.key: s for s in SOURCES}


def get(key: str) -> Source:
    if key not in BY_KEY:
        raise ValueError(f"unknown source: {key}")
    return BY_KEY[key]


def find(source_type: str | None = None, priority: str | None = None) -> list[Source]:
    return [
        s
        for s in SOURCES
        if (source_type is None or s.source_type == source_type) and (priority is None or s.priority == priority)
    ]


def target_tables(catalog: str, schema: str) -> dict[str, str]:
    return {s.key: f"{catalog}.{schema}.{s.target_table}" for s in SOURCES}


REGISTRY_SCHEMA = (
    "key string, name string, source_type string, priority string, ingest_method string, "
    "searchable_fields array<string>, target_table string, incremental boolean"
)


def as_dataframe(spark: SparkSession) -> DataFrame:
    """The registry as a small dimension table (one row per source)."""
    rows = [
        (s.key, s.name, s.source_type, s.priority, s.ingest_method, list(s.searchable_fields), s.target_table,
         s.incremental)
        for s in SOURCES
    ]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)
