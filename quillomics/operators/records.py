"""Queries over source records: common columns plus a VARIANT payload.

A frame may hold one source or several; ``of_source`` narrows it. Filters on
``gene_symbol`` compare ``gene_key`` when the table carries that normalised
column, so the comparison reaches the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as V
from ..functions import predicates as P
from ..functions import ranking as R
from ..sources import registry

CONSTRAINT_TITLE = "Constraint"
TRACTABILITY_TITLE = "Tractability"


def of_source(records: DataFrame, key: str) -> DataFrame:
    registry.get(key)
    return records.filter(F.col("source_key") == key)


def gene_key(records: DataFrame) -> Column:
    return F.col("gene_key") if "gene_key" in records.columns else F.upper("gene_symbol")


def is_gene(records: DataFrame, gene_symbol: str) -> Column | None:
    return gene_key(records) == gene_symbol.strip().upper() if gene_symbol else None


def is_constraint() -> Column:
    return F.col("title").contains(CONSTRAINT_TITLE)


def is_variant() -> Column:
    """Not a constraint record. A missing title is neither, as with NOT LIKE."""
    return ~F.col("title").contains(CONSTRAINT_TITLE)


def score() -> Column:
    return V.field(V.SCORE, "double")


def therapeutic_area() -> Column:
    return V.first_field(V.THERAPEUTIC_AREA_PATHS)


def significance() -> Column:
    return V.field("clinical_significance")


# Sections of a gene profile: projections, orders and caps by source.


def association_columns() -> list[Column]:
    return [F.col("disease"), score().alias("association_score"), therapeutic_area().alias("therapeutic_area")]


def variant_columns() -> list[Column]:
    return [
        F.col("title"),
        significance().alias("clinical_significance"),
        V.field("hgvsp").alias("protein_change"),
        V.field("major_consequence").alias("consequence"),
        V.field("pos", "int").alias("position"),
        V.field("gnomad.exome.ac", "int").alias("exome_ac"),
        V.field("gnomad.exome.an", "int").alias("exome_an"),
        V.field("gold_stars", "int").alias("review_stars"),
    ]


def constraint_columns() -> list[Column]:
    return [*V.constraint(*V.CONSTRAINT_FIELDS), V.field("gene_name").alias("full_gene_name")]


def pathway_columns() -> list[Column]:
    return [
        F.col("title"), F.col("summary"),
        V.field("pathway_id").alias("pathway_id"), V.field("pathway_name").alias("pathway_name"),
    ]


def mutation_columns() -> list[Column]:
    return [
        F.col("title"), F.col("disease"), F.col("summary"),
        V.field("mutation_type").alias("mutation_type"),
        V.field("protein_change").alias("protein_change"),
        V.field("cancer_study").alias("cancer_study"),
    ]


def protein_columns() -> list[Column]:
    return [
        F.col("title"), F.col("summary"),
        V.field("protein_name").alias("protein_name"),
        V.field("function").alias("function_desc"),
        V.first_field(V.LOCATION_PATHS).alias("location"),
    ]


def test_columns() -> list[Column]:
    return [
        F.col("title"), F.col("summary"), F.col("disease"),
        V.field("test_type").alias("test_type"),
        V.first_field(V.LAB_PATHS).alias("lab_name"),
    ]


def associations(records: DataFrame, gene_symbol: str, limit: int | None = 20) -> DataFrame:
    rows = P.where(records, is_gene(records, gene_symbol)).select(*association_columns())
    return R.top_k(rows, limit, F.col("association_score").desc_nulls_last())


def reviewed_variants(records: DataFrame, gene_symbol: str, limit: int | None = 50) -> DataFrame:
    rows = P.where(records, is_gene(records, gene_symbol), is_variant()).select(*variant_columns())
    return R.top_k(rows, limit, F.col("review_stars").desc_nulls_last())


def constraint_row(records: DataFrame, gene_symbol: str) -> DataFrame:
    rows = P.where(records, is_gene(records, gene_symbol), is_constraint()).select(*constraint_columns())
    return R.top_k(rows, 1)


def pathways(records: DataFrame, gene_symbol: str) -> DataFrame:
    rows = P.where(records, is_gene(records, gene_symbol)).select(*pathway_columns())
    return rows.orderBy(F.col("title").asc_nulls_first(), *R.tie_break(rows))


def mutations(records: DataFrame, gene_symbol: str, limit: int | None = 20) -> DataFrame:
    return R.top_k(P.where(records, is_gene(records, gene_symbol)).select(*mutation_columns()), limit)


def proteins(records: DataFrame, gene_symbol: str, limit: int | None = 5) -> DataFrame:
    return R.top_k(P.where(records, is_gene(records, gene_symbol)).select(*protein_columns()), limit)


def tests(records: DataFrame, gene_symbol: str, limit: int | None = 20) -> DataFrame:
    return R.top_k(P.where(records, is_gene(records, gene_symbol)).select(*test_columns()), limit)


def disease_landscape(records: DataFrame, disease_filter: str = "", limit: int | None = 200) -> DataFrame:
    """Highest-scoring gene-disease pairs overall."""
    rows = P.where(records, P.has_text_ignore_case("disease", disease_filter)).select(
        "gene_symbol", "disease", score().alias("score"), therapeutic_area().alias("therapeutic_area")
    )
    return R.top_k(rows, limit, F.col("score").desc_nulls_last())


def disease_landscape_per_gene(records: DataFrame, disease_filter: str = "", limit: int | None = 15) -> DataFrame:
    """Highest-scoring diseases of every gene."""
    rows = P.where(records, P.has_text_ignore_case("disease", disease_filter)).select(
        "gene_symbol", "disease", score().alias("score"), therapeutic_area().alias("therapeutic_area")
    )
    return R.top_n_per_group(rows, ["gene_symbol"], limit, F.col("score").desc_nulls_last())


def variant_counts(records: DataFrame, gene_symbol: str = "") -> DataFrame:
    """Variants by gene and clinical significance."""
    return (
        P.where(records, is_variant(), is_gene(records, gene_symbol))
        .groupBy("gene_symbol", significance().alias("clinical_significance"))
        .agg(F.count(F.lit(1)).alias("variant_count"))
    )


def constraint_table(records: DataFrame, gene_symbol: str = "") -> DataFrame:
    rows = P.where(records, is_constraint(), is_gene(records, gene_symbol)).select(
        "gene_symbol", *V.constraint("pLI", "oe_lof", "oe_lof_upper", "mis_z", "lof_z")
    )
    return rows.orderBy(F.col("pLI").desc_nulls_last(), *R.tie_break(rows))


def constraint_scores(records: DataFrame, gene_symbol: str = "", limit: int | None = 20) -> DataFrame:
    columns = [
        F.col("gene_symbol"), F.col("title"), *V.constraint("pLI"),
        V.field("constraint.oe_lof_upper", "double").alias("LOEUF"), *V.constraint("mis_z", "obs_lof", "exp_lof"),
    ]
    rows = P.where(records, is_gene(records, gene_symbol), is_constraint()).select(*columns)
    return R.top_k(rows, limit, F.col("pLI").desc_nulls_last())


def _listing(records: DataFrame, columns: list[str], limit: int | None, *conditions, order=()) -> DataFrame:
    return R.top_k(P.where(records, *conditions).select(*columns), limit, *order)


def titled_variants(records: DataFrame, gene_symbol: str = "", significance_text: str = "", limit: int | None = 20):
    return _listing(
        records, ["gene_symbol", "title"], limit,
        is_variant(), is_gene(records, gene_symbol), P.has_text_ignore_case("title", significance_text),
    )


def target_associations(
    records: DataFrame, gene_symbol: str = "", disease: str = "", limit: int | None = 20, by_score: bool = False
) -> DataFrame:
    """Associations with a disease, ordered by title as text, or by the stored score."""
    rows = P.where(
        records, F.col("disease").isNotNull(), is_gene(records, gene_symbol), P.has_text_ignore_case("disease", disease)
    )
    columns = ["gene_symbol", "disease", "title", "summary"]
    if by_score:
        scored = rows.select(*columns, score().alias("score"))
        return R.top_k(scored, limit, F.col("score").desc_nulls_last())
    return R.top_k(rows.select(*columns), limit, F.col("title").desc_nulls_last())


def tractability(records: DataFrame, gene_symbol: str = "", limit: int | None = 20) -> DataFrame:
    return _listing(
        records, ["gene_symbol", "title", "summary"], limit,
        F.col("title").contains(TRACTABILITY_TITLE), is_gene(records, gene_symbol),
    )


def clinical_evidence(records: DataFrame, gene_symbol: str = "", disease: str = "", limit: int | None = 20) -> DataFrame:
    return _listing(
        records, ["gene_symbol", "disease", "drug", "title", "summary"], limit,
        is_gene(records, gene_symbol), P.has_text_ignore_case("disease", disease),
    )


def cancer_mutations(records: DataFrame, gene_symbol: str = "", cancer_type: str = "", limit: int | None = 20) -> DataFrame:
    return _listing(
        records, ["gene_symbol", "disease", "title", "summary"], limit,
        is_gene(records, gene_symbol), P.has_text_ignore_case("disease", cancer_type),
    )


def phenotype_associations(records: DataFrame, gene_symbol: str = "", disease: str = "", limit: int | None = 20) -> DataFrame:
    """The disease text may sit in either column, but always within the asked gene."""
    return _listing(
        records, ["gene_symbol", "disease", "title", "summary"], limit,
        is_gene(records, gene_symbol), P.any_has_text(["disease", "title"], disease),
    )


def titled(records: DataFrame, gene_symbol: str = "", title_text: str = "", limit: int | None = 20) -> DataFrame:
    """Gene, title and summary, narrowed by title text: tests, proteins, tissues and pathways."""
    return _listing(
        records, ["gene_symbol", "title", "summary"], limit,
        is_gene(records, gene_symbol), P.has_text_ignore_case("title", title_text),
    )


SEARCH_COLUMNS = ("gene_symbol", "disease", "drug", "title", "summary")


# Searchable fields that are written under a common column.
FIELD_COLUMNS = {"gene": "gene_symbol", "condition": "disease", "drug_name": "drug", "therapy": "drug", "intervention": "drug"}


def searched(records: DataFrame, name: str) -> Column:
    """The text that a searchable field stands for."""
    column = FIELD_COLUMNS.get(name, name)
    return F.col(column) if column in records.columns else V.field(name)


def search(records: DataFrame, source_key: str, text: str, limit: int | None = 20, **filters: str) -> DataFrame:
    """Free-text search in one source, newest first, narrowed by the source's searchable fields."""
    rows = _matches(records, [source_key], text, **filters).drop("source_key")
    return R.top_k(rows, limit, F.col("source_updated_at").desc_nulls_last())


def search_sources(
    records: DataFrame, source_keys: list[str], text: str, limit: int | None = 20, **filters: str
) -> DataFrame:
    """The newest matches of each given source, in one job."""
    rows = _matches(records, source_keys, text, **filters)
    return R.top_n_per_group(rows, ["source_key"], limit, F.col("source_updated_at").desc_nulls_last())


def _matches(records: DataFrame, source_keys: list[str], text: str, **filters: str) -> DataFrame:
    """Records of the sources that hold the text.

    A filter names a searchable field of every source searched: a column of the records, or a field of the payload. Any
    other name is an error.
    """
    matches = []
    for key in source_keys:
        source = registry.get(key)
        unknown = sorted(name for name, value in filters.items() if value and name not in source.searchable_fields)
        if unknown:
            raise ValueError(f"{key} cannot be searched by {', '.join(unknown)}; fields: {', '.join(source.searchable_fields)}")
        extra = [P.has_text_ignore_case(searched(records, name), value) for name, value in filters.items() if value]
        matches.append(P.all_of(F.col("source_key") == key, *extra))
    return P.where(records, P.any_has_text(SEARCH_COLUMNS, text), P.any_of(matches)).select(
        "source_key", "record_id", *SEARCH_COLUMNS, "payload", "source_updated_at"
    )


def source_coverage(records: DataFrame) -> DataFrame:
    """Rows, distinct diseases and distinct drugs by source and gene."""
    per_pair = records.groupBy("source_key", "gene_symbol", "disease", "drug").agg(F.count(F.lit(1)).alias("_c"))
    return per_pair.groupBy("source_key", "gene_symbol").agg(
        F.sum("_c").alias("n_records"),
        F.countDistinct("disease").alias("n_diseases"),
        F.countDistinct("drug").alias("n_drugs"),
    )


def mutation_landscape(records: DataFrame) -> DataFrame:
    """Mutations and mutated samples by gene, with the most frequent mutation."""
    rows = records.select(
        "gene_symbol",
        V.field("sample_count", "int").alias("n"),
        V.field("mutation_type").alias("mutation_type"),
        V.field("protein_change").alias("protein_change"),
    )
    best = F.max(
        F.struct(F.coalesce("n", F.lit(-1)).alias("n"), "mutation_type", "protein_change")
    ).alias("_best")
    return (
        rows.groupBy("gene_symbol")
        .agg(F.count(F.lit(1)).alias("unique_mutations"), F.sum("n").alias("total_samples_mutated"), best)
        .select(
            "gene_symbol", "unique_mutations", "total_samples_mutated",
            F.col("_best.mutation_type").alias("top_mutation_type"),
            F.col("_best.protein_change").alias("top_protein_change"),
        )
    )


def high_score_pairs(records: DataFrame, minimum: float = 0.5, limit: int | None = 30) -> DataFrame:
    rows = records.select(
        "gene_symbol", "disease", score().alias("score"), therapeutic_area().alias("therapeutic_area")
    ).filter(F.col("score") >= minimum)
    return R.top_k(rows, limit, F.col("score").desc())


def query_history(log: DataFrame, limit: int | None = 50) -> DataFrame:
    """Latest entries of the query log."""
    columns = [
        c
        for c in ("query_id", "timestamp", "user_email", "species_focus", "query_text", "response_text")
        if c in log.columns
    ]
    return R.top_k(log.select(*columns), limit, F.col("timestamp").desc_nulls_last())
