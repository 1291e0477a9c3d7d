"""Profiles over six record sources, for one gene or for all genes in a single job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..operators import records as Q


@dataclass(frozen=True)
class Section:
    """One part of a profile: which records it shows."""

    name: str
    source_key: str
    extra: Column | None = None


#: Records shown per section. A cap that is None shows all.
CAPS = {"associations": 20, "variants": 50, "constraint": 1, "pathways": None, "mutations": 20, "proteins": 5, "tests": 20}
Caps = Mapping[str, int | None]


def sections() -> list[Section]:
    # Sections and their sources.
    return [
        Section("associations", "opentargets"),
        Section("variants", "gnomad", Q.is_variant()),
        Section("constraint", "gnomad", Q.is_constraint()),
        Section("pathways", "kegg"),
        Section("mutations", "cbioportal"),
        Section("proteins", "uniprot"),
        Section("tests", "ncbi_gtr"),
    ]


COUNTED = ("associations", "variants", "pathways", "mutations", "proteins", "tests")
SHOWN = ("title", "disease", "summary")


def _caps(caps: Caps | None) -> dict[str, int | None]:
    return CAPS | dict(caps or {})


def _section_of() -> Column:
    """Section of a record, NULL when no section wants it."""
    chain = None
    for s in sections():
        hit = F.col("source_key") == s.source_key
        if s.extra is not None:
            hit = hit & s.extra
        chain = F.when(hit, s.name) if chain is None else chain.when(hit, s.name)
    return chain


FIELDS = {
    "associations": Q.association_columns, "variants": Q.variant_columns, "constraint": Q.constraint_columns,
    "pathways": Q.pathway_columns, "mutations": Q.mutation_columns, "proteins": Q.protein_columns, "tests": Q.test_columns,
}


def _tagged(records: DataFrame, payload: bool = False) -> DataFrame:
    """Rows with their gene and section; a text column that the records do not have is null."""
    texts = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in SHOWN]
    return records.select(
        Q.gene_key(records).alias("gene"),
        _section_of().alias("section"),
        "record_id", *texts,
        Q.score().alias("_score"),
        Q.V.field("gold_stars", "int").alias("_stars"),
        *["payload"] * payload,
    ).filter(F.col("section").isNotNull() & F.col("gene").isNotNull())


def _ranked(tagged: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """The best records of every section but pathways, with their rank.

    One window over (gene, section) ranks all sections, so six queries per gene
    become one job for all genes.
    """
    lead = F.when(F.col("section") == "associations", F.col("_score")).when(
        F.col("section") == "variants", F.col("_stars").cast("double")
    )
    keeps = {name: n for name, n in caps.items() if name != "pathways"}
    largest = None if None in keeps.values() else max(keeps.values())
    keep = F.lit(None).cast("int")
    for name, n in keeps.items():
        keep = F.when(F.col("section") == name, F.lit(n)).otherwise(keep)
    ranked = R.top_n_per_group(tagged.filter(F.col("section") != "pathways"), ["gene", "section"], largest, lead.desc_nulls_last(), rank_as="rank")
    return ranked.filter(F.coalesce(F.col("rank") <= keep, F.lit(True))).drop("_score", "_stars")


def capped_rows(records: DataFrame, caps: Caps | None = None) -> DataFrame:
    """The best records of every ranked section of every gene; ``caps`` replaces some of CAPS."""
    return _ranked(_tagged(records), _caps(caps))


def section_rows(records: DataFrame, caps: Caps | None = None) -> DataFrame:
    """Every record a profile shows. Pathways have no cap and are not ranked."""
    pathways = _tagged(records).filter(F.col("section") == "pathways").drop("_score", "_stars")
    return capped_rows(records, caps).unionByName(pathways.withColumn("rank", F.lit(None).cast("int")))


def coverage(records: DataFrame, capped: bool = True, caps: Caps | None = None) -> DataFrame:
    """Records per section of each gene, sources with data and total.

    Capped counts stop at the section's cap; the true totals do not. Both come
    from one count per (gene, section), without ranking any row.
    """
    counts = (
        records.select(Q.gene_key(records).alias("gene"), _section_of().alias("section"))
        .filter(F.col("section").isin(*COUNTED) & F.col("gene").isNotNull())
        .groupBy("gene", "section")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if capped:
        limit = F.lit(None).cast("bigint")
        for name in COUNTED:
            limit = F.when(F.col("section") == name, F.lit(_caps(caps)[name]).cast("bigint")).otherwise(limit)
        counts = counts.withColumn("n", F.least("n", limit))
    return counts.groupBy("gene").agg(
        *[
            F.coalesce(F.max(F.when(F.col("section") == name, F.col("n"))), F.lit(0).cast("bigint")).alias(f"n_{name}")
            for name in COUNTED
        ],
        F.count(F.lit(1)).alias("total_sources_with_data"),
        F.sum("n").alias("total_records"),
    )


def profile(records: DataFrame, caps: Caps | None = None) -> DataFrame:
    """One row per gene: its coverage and, per section, the records shown with all their fields.

    Needs record_id, source_key, gene_symbol and payload; title, disease and summary are null where the records have no
    such column. Pathways have no cap and come in the order of their titles, the other sections by rank. Fields are
    read from the payloads of the records that are kept only. ``caps`` replaces some of CAPS; None shows all.
    """
    tagged = _tagged(records, payload=True)
    kept = _ranked(tagged, _caps(caps))
    pathways = tagged.filter(F.col("section") == "pathways").drop("_score", "_stars")
    rows = kept.unionByName(pathways.withColumn("rank", F.lit(0)))
    lists = rows.groupBy("gene").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("rank", *_entry(tagged, columns()))))).alias(name)
        for name, columns in FIELDS.items()
    ])
    return coverage(records, caps=caps).join(lists, "gene", "left")


def _entry(tagged: DataFrame, columns: list[Column]) -> list[Column]:
    """Fields of a list entry; title and record_id come first, so that entries of equal rank follow them."""
    named = dict(zip(tagged.select(*columns).columns, columns, strict=True)) | {"record_id": F.col("record_id")}
    return [named[n] for n in sorted(named, key=lambda n: (n != "title", n != "record_id"))]
