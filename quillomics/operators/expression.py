"""Expression queries and lookups by symbol or vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import ranking as R
from ..functions import stats

EXPRESSION_KEYS = ["gene_symbol", "cohort", "tissue"]


def baseline_expression(baseline: DataFrame, gene_symbol: str, tissue: str = "") -> DataFrame:
    """Median expression of one gene over tissues, highest first."""
    rows = P.where(
        baseline, P.equals_key(baseline, "gene_symbol", gene_symbol), P.has_text_ignore_case("tissue", tissue)
    )
    return rows.orderBy(F.col("median_tpm").desc_nulls_last(), *R.tie_break(rows))


def expression_summary(
    expression: DataFrame, gene_symbol: str = "", cohort: str = "", tissue: str = "", approximate: bool = False
) -> DataFrame:
    """Samples, mean, median and standard deviation by gene, cohort and tissue.

    The median is exact by default and stays exact for groups of any size; the
    approximate form trades that for a single pass.
    """
    rows = P.where(
        expression,
        P.equals_key(expression, "gene_symbol", gene_symbol),
        P.equals_key(expression, "cohort", cohort),
        P.has_text_ignore_case("tissue", tissue),
    )
    measures = [
        F.count(F.lit(1)).alias("n_samples"),
        F.round(F.avg("tpm"), 4).alias("mean_tpm"),
        F.round(F.stddev_samp("tpm"), 4).alias("std_tpm"),
    ]
    if approximate:
        median = F.round(F.percentile_approx("tpm", 0.5), 4).alias("median_tpm")
        return rows.groupBy(*EXPRESSION_KEYS).agg(*measures, median)
    summary = stats.exact_median(rows, EXPRESSION_KEYS, "tpm", "median_tpm", *measures)
    return summary.select(
        *EXPRESSION_KEYS, "n_samples", "mean_tpm", F.round("median_tpm", 4).alias("median_tpm"), "std_tpm"
    )


def human_expression(expression: DataFrame, gene_symbol: str, cohort: str = "", tissue: str = "") -> DataFrame:
    summary = expression_summary(expression, gene_symbol, cohort, tissue)
    return summary.orderBy(F.col("mean_tpm").desc_nulls_last(), *EXPRESSION_KEYS)


def orthologs(pairs: DataFrame, genes: DataFrame, direction: str = "mouse_to_human") -> DataFrame:
    """One-to-one partners of a set of genes, in either direction, ignoring case."""
    if direction == "human_to_mouse":
        source, partner = "human_symbol", "mouse_symbol"
    else:
        source, partner = "mouse_symbol", "human_symbol"
    keyed = pairs.select(
        F.upper(source).alias("gene_key"),
        F.col(source).alias("query_gene"),
        F.col(partner).alias("ortholog"),
        "support_count",
        "category",
    )
    wanted = genes.select(F.upper("gene").alias("gene_key")).distinct()
    return keyed.join(wanted, "gene_key").drop("gene_key").withColumn("direction", F.lit(direction))


def cosine(vector: str, query: Column) -> Column:
    """Cosine similarity of two arrays, evaluated per row without Python."""

    def dot(a, b):
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    v = F.col(vector)
    return dot(v, query) / (F.sqrt(dot(v, v)) * F.sqrt(dot(query, query)))


def nearest(
    items: DataFrame, query: Column | Sequence[float], limit: int | None = 5, item_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k most similar items to one query vector: one scan, k rows kept per task, no pairs formed."""
    if not isinstance(query, Column):
        query = F.lit([float(x) for x in query])
    # The query becomes a column first: a scalar subquery may not sit inside a lambda.
    paired = items.select(item_id, vector, query.alias("_query"))
    scored = paired.select(item_id, F.round(cosine(vector, F.col("_query")), 6).alias("similarity"))
    return R.top_k(scored, limit, F.col("similarity").desc_nulls_last())


#: Query vectors scored in one scan; larger batches take a scan per block of so many.
BATCH = 256


def _blocks(queries: DataFrame, query_id: str, vector: str, block: int) -> list[Column]:
    """The query vectors with their lengths, as arrays of at most ``block`` entries, each a scalar of one row."""
    n = queries.count()
    entry = F.struct(F.col(query_id).alias("id"), F.col(vector).alias("v"), F.sqrt(_dot(F.col(vector), F.col(vector))).alias("norm"))
    if n <= block:
        return [queries.agg(F.collect_list(entry)).scalar()]
    shares = -(-n // block)
    # Ids are spread by hash; a share is a bounded batch whatever their number.
    share = F.pmod(F.xxhash64(query_id), F.lit(shares))
    return [queries.filter(share == i).agg(F.collect_list(entry)).scalar() for i in range(shares)]


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def nearest_batch(
    items: DataFrame, queries: DataFrame, limit: int = 5, item_id: str = "vec_id", vector: str = "embedding",
    query_id: str = "query_id", query_vector: str = "embedding", block: int = BATCH,
) -> DataFrame:
    """The ``limit`` most similar items to each of a batch of query vectors: query_id, item id, similarity and rank.

    One scan of the items scores all query vectors of a block (``block`` of them on average, held as one value by every
    task); each task keeps ``limit`` items per query before anything is shuffled. Vectors that are null, of length zero
    or of another number of components have a null similarity and come last.
    """
    found = None
    for wanted in _blocks(queries, query_id, query_vector, block):
        rows = items.select(item_id, vector, _dot(F.col(vector), F.col(vector)).alias("_square"), wanted.alias("_queries"))
        rows = rows.select(item_id, vector, F.sqrt("_square").alias("_norm"), F.explode("_queries").alias("_q"))
        score = F.try_divide(_dot(F.col(vector), F.col("_q.v")), F.col("_norm") * F.col("_q.norm"))
        scored = rows.select(F.col("_q.id").alias(query_id), item_id, F.round(score, 6).alias("similarity"))
        best = R.top_n_per_group(scored, [query_id], limit, F.col("similarity").desc_nulls_last(), rank_as="rank")
        found = best if found is None else found.unionByName(best)
    return found
