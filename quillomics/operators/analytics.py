"""Numbers behind the charts: volcano, selectivity, constraint, score and count summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import scalars as S
from . import aggregates as G
from . import records as Q


def volcano(effects: DataFrame) -> DataFrame:
    """Effect size against -log10 p, without zero p-values."""
    return effects.filter(F.col("pvalue_adj") > 0).withColumns({
        "neg_log10_p": F.round(S.neg_log10("pvalue_adj"), 6),
        "significant": (F.col("pvalue_adj") < 0.05) & (F.abs("log2fc") > 0.5),
    })


def effect_matrix(effects: DataFrame, n_genes: int = 10) -> DataFrame:
    """Effects of the leading genes by cell type, with marker sizes."""
    return G.of_top_keys(effects, "affected_gene", "log2fc", n_genes).select(
        "affected_gene", "cell_type", "log2fc", (F.abs("log2fc") * 8).alias("marker_size")
    )


def is_potent() -> Column:
    """A potency is given: neither missing nor zero."""
    return F.col("pchembl_value").isNotNull() & (F.col("pchembl_value") != 0)


# Names of the two receptors.
RECEPTOR_1 = ("OX1R", "HCRTR1")
RECEPTOR_2 = ("OX2R", "HCRTR2")


def selectivity_pairs(activities: DataFrame, *order: str) -> DataFrame:
    """First value of each compound at both receptors, their ratio, and the equipotent bound.

    Both receptors are picked in one grouping; there is no self-join.
    """
    position = F.struct(*order)
    at_1 = F.col("target_alias").isin(*RECEPTOR_1)
    at_2 = F.col("target_alias").isin(*RECEPTOR_2)
    pairs = (
        activities.filter(is_potent() & (at_1 | at_2))
        .groupBy("molecule_name")
        .agg(
            F.min_by("standard_value", F.when(at_1, position)).alias("value_1"),
            F.min_by("standard_value", F.when(at_2, position)).alias("value_2"),
            F.count_if(at_1).alias("_n1"),
            F.count_if(at_2).alias("_n2"),
        )
        .filter((F.col("_n1") > 0) & (F.col("_n2") > 0))
        .drop("_n1", "_n2")
    )
    top = pairs.agg(F.max(F.greatest("value_1", "value_2")) * 1.5).scalar()
    return pairs.withColumns({
        "ratio": F.round(F.try_divide("value_1", "value_2"), 6),
        "equipotent_bound": top,
    })


def selectivity_join(activities: DataFrame, *order: str) -> DataFrame:
    """The same pairs as two filtered frames joined on the compound."""
    potent = activities.filter(is_potent())
    sides = [
        G.representative(potent.filter(F.col("target_alias").isin(*names)), ["molecule_name"], ["standard_value"], *order)
        .withColumnRenamed("standard_value", f"value_{i}")
        for i, names in ((1, RECEPTOR_1), (2, RECEPTOR_2))
    ]
    return sides[0].join(sides[1], "molecule_name")


def potency_ranking(activities: DataFrame) -> DataFrame:
    labelled = activities.filter(is_potent()).select(
        F.format_string("%s (%s)", "molecule_name", "target_alias").alias("label"), "standard_value", "pchembl_value"
    )
    return labelled.orderBy(F.col("pchembl_value").asc(), *R.tie_break(labelled))


def constraint_radar(constraints: DataFrame) -> DataFrame:
    """Constraint metrics on a 0 to 1 scale; missing and zero values take their neutral default."""
    pli, oe_lof, oe_mis = S.or_default("pLI", 0.0), S.or_default("oe_lof", 1.0), S.or_default("oe_mis", 1.0)
    mis_z, lof_z = S.or_default("mis_z", 0.0), S.or_default("lof_z", 0.0)
    return constraints.select(
        "gene_symbol",
        pli.alias("lof_intolerance"),
        F.round(F.greatest(F.lit(0.0), 1 - oe_lof), 6).alias("lof_constraint"),
        F.round(F.greatest(F.lit(0.0), 1 - oe_mis), 6).alias("missense_constraint"),
        F.round(S.clamp((mis_z + 2) / 6, 0.0, 1.0), 6).alias("missense_z"),
        F.round(S.clamp((lof_z + 2) / 6, 0.0, 1.0), 6).alias("lof_z_scaled"),
    )


PLI_INTOLERANT, LOEUF_CONSTRAINED = 0.9, 0.35


def constraint_scatter(constraints: DataFrame) -> DataFrame:
    pli, loeuf = S.or_default("pLI", 0.0), S.or_default("oe_lof_upper", 1.0)
    return constraints.select(
        "gene_symbol",
        pli.alias("pli"),
        loeuf.alias("loeuf"),
        S.clamp(F.abs(S.or_default("mis_z", 0.0)) * 10, 8.0, 30.0).alias("marker_size"),
        (pli > PLI_INTOLERANT).alias("lof_intolerant"),
        (loeuf < LOEUF_CONSTRAINED).alias("constrained"),
    )


def evidence_levels(records: DataFrame) -> DataFrame:
    level = F.coalesce(S.first_match("title", r"Level\s+(\w)"), F.lit("?"))
    return records.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def title_scores(records: DataFrame) -> DataFrame:
    """Scores written in titles, lowest first."""
    rows = records.select(
        "gene_symbol", "disease", F.left("disease", F.lit(40)).alias("label"),
        S.first_match("title", r"score:\s*([\d.]+)").try_cast("double").alias("score"),
    ).filter(F.col("score").isNotNull() & (F.col("disease") != ""))
    return rows.orderBy(F.col("score").asc(), *R.tie_break(rows))


# Significance classes, most specific first.
SIGNIFICANCE_CLASSES = ("Likely pathogenic", "Pathogenic", "Uncertain significance", "Likely benign", "Benign")


def significance_class(value: Column) -> Column:
    chain = F.when(F.lower(value).contains(SIGNIFICANCE_CLASSES[0].lower()), SIGNIFICANCE_CLASSES[0])
    for name in SIGNIFICANCE_CLASSES[1:]:
        chain = chain.when(F.lower(value).contains(name.lower()), name)
    return chain.otherwise("Other")


def significance_counts(records: DataFrame) -> DataFrame:
    """Variants by class of their recorded significance."""
    return (
        records.filter(Q.is_variant())
        .groupBy(significance_class(F.coalesce(Q.significance(), F.lit(""))).alias("significance"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def significance_by_gene(records: DataFrame) -> DataFrame:
    """Variants by gene and recorded significance, 'Unknown' where none is given."""
    label = F.coalesce(F.nullif(Q.significance(), F.lit("")), F.lit("Unknown"))
    return (
        records.filter(Q.is_variant())
        .groupBy("gene_symbol", label.alias("significance"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def disease_counts(records: DataFrame, k: int | None = 15) -> DataFrame:
    """Records per disease by its full name; only the label is cut."""
    name = F.coalesce(F.nullif("disease", F.lit("")), F.lit("Unknown"))
    counts = records.groupBy(name.alias("disease")).agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(counts, k, F.col("n").desc()).withColumn("label", F.left("disease", F.lit(35)))


def test_kind(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("sequencing"), "Sequencing")
        .when(low.contains("panel"), "Gene Panel")
        .when(low.contains("deletion") | low.contains("dup"), "Del/Dup")
        .otherwise("Other")
    )


def test_kinds(records: DataFrame, text: str = "title") -> DataFrame:
    return records.groupBy(test_kind(F.col(text)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Detection levels.
TISSUE_LEVELS = {"Not detected": 0, "Low": 1, "Medium": 2, "High": 3}


def tissue_levels(records: DataFrame) -> DataFrame:
    """Tissue with the measured expression (nTPM) of the payload, or the detection level of the title.

    Titles end in a word ('GENE in tissue: High') or in the measured value; the word gives ``level``, 0 without one.
    """
    title = F.col("title")
    word = F.trim(F.split_part(title, F.lit(":"), F.lit(-1)))
    code = F.lit(0)
    for name, value in TISSUE_LEVELS.items():
        code = F.when(word == name, F.lit(value)).otherwise(code)
    tissue = F.trim(F.split_part(F.split_part(title, F.lit(" in "), F.lit(2)), F.lit(":"), F.lit(1)))
    return records.filter(title.contains(" in ") & title.contains(":")).select(
        "gene_symbol", tissue.alias("tissue"), code.alias("level"), Q.V.field("nTPM", "double").alias("n_tpm"),
    )


def tissue_ranking(levels: DataFrame) -> DataFrame:
    """Tissues of ``tissue_levels``, most expressed first: by measured value, then by level."""
    return levels.orderBy(
        F.col("n_tpm").desc_nulls_last(), F.col("level").desc(), F.col("tissue").desc(), "gene_symbol"
    )


def modality_counts(tractability: DataFrame) -> DataFrame:
    """Targets per modality with at least one true assessment; reads the payload, not the title."""
    entries = Q.V.field("tractability", "array<struct<modality string, label string, value boolean>>")
    true_ones = F.array_distinct(
        F.transform(F.filter(entries, lambda e: e["value"]), lambda e: e["modality"])
    )
    return (
        tractability.select(F.explode(true_ones).alias("modality"))
        .groupBy("modality")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def risk_ranking(risk_genes: DataFrame, k: int = 25) -> DataFrame:
    rows = risk_genes.select("gene", "fdr", F.round(S.neg_log10("fdr"), 6).alias("neg_log10_fdr"))
    best = R.top_k(rows, k, F.col("fdr").asc_nulls_last())
    return best.orderBy(F.col("neg_log10_fdr").asc(), *R.tie_break(best))


def effects_per_cell_type(mouse_effects: DataFrame, k: int | None = 15) -> DataFrame:
    best = R.top_k(mouse_effects.select("cell_type", "n_sig_effects"), k, F.col("n_sig_effects").desc())
    return best.orderBy(F.col("n_sig_effects").asc(), "cell_type")


def phenotype_bars(screen_rows: DataFrame) -> DataFrame:
    """Screen scores under short labels, lowest first."""
    label = F.format_string(
        "%s (%s)",
        F.left(F.coalesce("screen_name", F.lit("")), F.lit(25)),
        F.coalesce("phenotype_name", F.lit("")),
    )
    rows = screen_rows.select("screen_name", "phenotype_name", label.alias("label"), "phenotype_score")
    return rows.orderBy(F.col("phenotype_score").asc_nulls_last(), "label", "screen_name", "phenotype_name")


def association_bars(records: DataFrame, n: int = 10) -> DataFrame:
    """Top diseases of every gene, lowest first, with a colour number per therapeutic area.

    Colours follow the first appearance of an area; at most n rows per gene reach
    the windows that number them.
    """
    rows = records.select(
        Q.gene_key(records).alias("gene"),
        F.col("disease"),
        Q.score().alias("_score"),
        Q.therapeutic_area().alias("therapeutic_area"),
    )
    best = R.top_n_per_group(rows, ["gene"], n, F.col("_score").desc_nulls_last(), rank_as="_rank")
    per_area = Window.partitionBy("gene", "therapeutic_area")
    first_seen = F.min(-F.col("_rank")).over(per_area)
    numbered = best.withColumn("_first", first_seen).withColumn(
        "colour", F.dense_rank().over(Window.partitionBy("gene").orderBy("_first"))
    )
    return numbered.select(
        "gene",
        F.coalesce("disease", F.lit("Unknown")).alias("disease"),
        F.left(F.coalesce("disease", F.lit("Unknown")), F.lit(40)).alias("label"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
        "therapeutic_area",
        "colour",
    )


def region_name(name: str = "tissue") -> Column:
    return F.replace(F.col(name), F.lit("Brain - "), F.lit(""))


def expression_matrix(baseline: DataFrame, first_gene: str) -> DataFrame:
    """Genes against the regions of the first gene."""
    values = baseline.select("gene_symbol", region_name().alias("region"), "median_tpm")
    return G.entity_matrix(values, "gene_symbol", "region", "median_tpm", first_gene)


def largest(counts: DataFrame, value: str, k: int = 20) -> DataFrame:
    """The k largest bars, ascending."""
    best = R.top_k(counts, k, F.col(value).desc_nulls_last())
    return best.orderBy(F.col(value).asc(), *R.tie_break(best))


def perturbation_heatmap(signatures: DataFrame, n_genes: int = 15) -> DataFrame:
    """Mean z-score of every compound on the most moved genes."""
    cells = G.mean_matrix(signatures, "gene_symbol", "compound", "zscore", n_genes)
    return cells.withColumn("mean_value", F.round("mean_value", 2))


def score_heatmap(landscape: DataFrame, n_diseases: int = 12) -> DataFrame:
    """Scores of the leading diseases for every gene."""
    cells = G.first_match_matrix(landscape, "disease", "gene_symbol", "score", n_diseases)
    return cells.withColumn("label", F.left("disease", F.lit(35)))
