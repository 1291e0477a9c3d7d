"""Rollups, first-row picks, pivots in long form and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as R


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key under an explicit order."""
    return R.first_per_key(df, keys, *order)


def keep_first_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return R.top_n_per_group(df, keys, n, *order)


def representative(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], *order: str) -> DataFrame:
    """Distinct keys with the attributes of their first row; combined map-side."""
    first = F.min(F.struct(*order, *attributes)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{a}").alias(a) for a in attributes])


def top_abs_per_group(df: DataFrame, keys: Sequence[str], value: str, n: int = 200, spread: int = R.SPREAD) -> DataFrame:
    """The n largest absolute values of each group, merged in two steps so that a large group is spread."""
    return R.top_n_per_group(df, keys, n, R.abs_desc(value), spread=spread)


def top_abs_ascending(df: DataFrame, value: str, k: int = 20) -> DataFrame:
    """The k largest absolute values, shown in ascending order."""
    best = R.top_k(df, k, R.abs_desc(value))
    return best.orderBy(F.col(value).asc_nulls_last(), *R.tie_break(best))


def top_keys(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n keys with the largest absolute value."""
    peaks = df.groupBy(key).agg(F.max(F.abs(value)).alias("peak"))
    return R.top_k(peaks, n, F.col("peak").desc_nulls_last())


def of_top_keys(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Rows of the top keys."""
    return df.join(top_keys(df, key, value, n).select(key), key, "left_semi")


def _cells(df: DataFrame, column: str, entry: Column, keys: Column, wanted: str) -> DataFrame:
    """One row per (column, wanted key): the key list is a small array, so the grid needs no cross join.

    ``entry`` is a (key, value) struct; each column value gathers only the listed keys.
    """
    listed = df.withColumn("_keys", keys)
    chosen = F.when(F.array_contains("_keys", F.col(wanted)), entry)
    rows = listed.groupBy(column).agg(
        F.any_value("_keys").alias("_keys"), F.map_from_entries(F.collect_list(chosen)).alias("_m")
    )
    return rows.select(column, "_m", F.posexplode("_keys").alias("_position", wanted))


def mean_matrix(df: DataFrame, row: str, column: str, value: str, n: int) -> DataFrame:
    """Mean of every (top row key, column) cell in long form, 0 where a cell is empty.

    The columns are those of the n leading keys, one row each; every one of them is paired with the n keys, which are all
    that is held as one value, and the cells are joined to the pairs. A null column is no cell.
    """
    cells = df.groupBy(row, column).agg(F.avg(value).alias("_mean"), F.max(F.abs(value)).alias("_peak"))
    tops = R.top_k(cells.groupBy(row).agg(F.max("_peak").alias("_peak")), n, F.col("_peak").desc_nulls_last())
    leading = tops.agg(F.collect_list(F.struct(row)).alias("_keys")).scalar()
    listed = cells.filter(F.col(column).isNotNull()).select(row, column, "_mean", leading.alias("_keys"))
    listed = listed.filter(F.array_contains("_keys", F.struct(row)))
    grid = listed.groupBy(column).agg(F.any_value("_keys").alias("_keys")).select(column, F.explode("_keys").alias("_key")).select(F.col(f"_key.{row}").alias("_row"), F.col(column).alias("_column"))
    cells = listed.select(row, column, "_mean")
    found = grid.join(cells, F.col("_row").eqNullSafe(F.col(row)) & (F.col("_column") == F.col(column)), "left")
    return found.select(F.col("_row").alias(row), F.col("_column").alias(column), F.coalesce("_mean", F.lit(0.0)).alias("mean_value"))


def mean_pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Wide form for a given, bounded list of columns."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value)).fillna(0)


#: Keys of a grid that are held as one value, and parts that the pairing of entities with them is dealt to.
KEY_BLOCK, PARTS = 1024, 16


def entity_matrix(df: DataFrame, entity: str, key: str, value: str, first_entity: str) -> DataFrame:
    """Value of every entity on the keys of one entity, 0 where missing; of repeated cells the largest value.

    The keys are cut into blocks of about KEY_BLOCK; every entity meets every block by an equality join in PARTS parts,
    and the cells are joined to the pairs, so no task holds more than a block of keys.
    """
    cells = df.groupBy(entity, key).agg(F.max(value).alias(value))
    keys = cells.filter((F.col(entity) == first_entity) & F.col(key).isNotNull()).select(key)
    blocks = keys.agg((F.floor(F.count(F.lit(1)) / KEY_BLOCK) + 1).cast("bigint")).scalar()
    held = keys.withColumn("_blocks", blocks).groupBy(F.pmod(F.xxhash64(key), F.col("_blocks")).alias("_block")).agg(F.collect_list(key).alias("_keys"))
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    entities = cells.select(F.col(entity).alias("_entity")).distinct().withColumn("_blocks", blocks)
    part = F.pmod(F.xxhash64("_entity"), F.lit(PARTS)).cast("int")
    entities = entities.select("_entity", part.alias("_part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"))
    grid = entities.join(held, ["_block", "_part"]).select("_entity", F.explode("_keys").alias("_key"))
    found = grid.join(cells, F.col("_entity").eqNullSafe(F.col(entity)) & (F.col("_key") == F.col(key)), "left")
    return found.select(F.col("_entity").alias(entity), F.col("_key").alias(key), F.coalesce(F.col(value), F.lit(0.0)).alias(value))


def first_match_matrix(df: DataFrame, row: str, column: str, value: str, n_rows: int = 12) -> DataFrame:
    """Best value of every (leading row, column) cell, 0 where missing.

    Leading rows are the first distinct ones when the table is read by value.
    """
    cells = df.groupBy(row, column).agg(F.max(value).alias("_v"))
    leading = cells.filter(F.col(row) != "").groupBy(row).agg(F.max("_v").alias("_lead"))
    top = R.top_k(leading, n_rows, F.col("_lead").desc_nulls_last())
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.coalesce("_lead", F.lit(0.0))).alias("o"), F.col(row).alias("r")))
    )
    rows = top.agg(F.transform(ordered, lambda s: s["r"])).scalar()
    grid = _cells(cells, column, F.struct(row, "_v"), rows, row)
    return grid.select(
        row, column, (F.col("_position") + 1).alias("row_rank"),
        F.coalesce(F.col("_m")[F.col(row)], F.lit(0.0)).alias(value),
    )


def to_long(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide scores to (name, value) rows without the missing ones."""
    return df.unpivot(list(ids), list(measures), name, value).filter(F.col(value).isNotNull())


def explode_pairs(df: DataFrame, ids: Sequence[str], names: str, values: str) -> DataFrame:
    """Parallel arrays to one row per position."""
    zipped = F.explode(F.arrays_zip(F.col(names).alias("name"), F.col(values).alias("value")))
    return df.select(*ids, zipped.alias("_p")).select(*ids, F.col("_p.name").alias(names), F.col("_p.value").alias(values))


def vocabulary(df: DataFrame, array: Column, out: str = "token") -> DataFrame:
    """Distinct entries of an array column over all rows."""
    return df.select(F.explode(array).alias(out)).distinct()


def coverage_shares(df: DataFrame, entity: str, source: str) -> DataFrame:
    """Records per source and their share of the entity's records."""
    counts = df.groupBy(entity, source).agg(F.count(F.lit(1)).alias("n_records"))
    total = F.sum("n_records").over(Window.partitionBy(entity))
    return counts.withColumn("share", F.round(F.col("n_records") / total, 6))


def mutation_rollup(mutations: DataFrame, per_gene: int | None = None) -> DataFrame:
    """Samples and cancer types per (gene, mutation type, protein change): all, or the most frequent of each gene.

    Counting by study first keeps one hot mutation spread over studies and leaves
    only distinct studies to be listed.
    """
    keys = ["gene_symbol", "mutation_type", "protein_change"]
    per_study = (
        mutations.select(
            "gene_symbol",
            F.coalesce(F.nullif("mutation_type", F.lit("")), F.lit("Unknown")).alias("mutation_type"),
            F.coalesce("protein_change", F.lit("")).alias("protein_change"),
            "cancer_type",
        )
        .groupBy(*keys, "cancer_type")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    rolled = per_study.groupBy(*keys).agg(
        F.sum("_c").alias("sample_count"), F.array_sort(F.collect_list("cancer_type")).alias("cancer_types")
    )
    titled = rolled.withColumns({
        "disease": F.array_join(F.slice("cancer_types", 1, 3), "; "),
        "title": F.coalesce(F.nullif("protein_change", F.lit("")), F.col("mutation_type")),
    })
    return R.top_n_per_group(titled, ["gene_symbol"], per_gene, F.col("sample_count").desc())


def labels_by_modality(entries: Column) -> Column:
    """Map of modality to the labels whose value is true, built inside the row."""
    true_ones = F.filter(entries, lambda e: e["value"])
    modalities = F.array_sort(F.array_distinct(F.transform(true_ones, lambda e: e["modality"])))
    return F.map_from_entries(
        F.transform(
            modalities,
            lambda m: F.struct(
                m,
                F.transform(F.filter(true_ones, lambda e: e["modality"] == m), lambda e: e["label"]),
            ),
        )
    )


def last_by_modality(entries: Column) -> Column:
    """Map of modality to its last listed value, built inside the row."""
    modalities = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["modality"])))
    return F.map_from_entries(
        F.transform(
            modalities,
            lambda m: F.struct(m, F.element_at(F.filter(entries, lambda e: e["modality"] == m), -1)["value"]),
        )
    )
