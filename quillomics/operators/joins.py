"""Lookups, membership, anti-joins and entity resolution.

No side is broadcast by hint: the optimizer broadcasts a lookup only under its
size threshold (statically, or at run time from measured sizes) and otherwise
sort-merges, with oversized key partitions split by adaptive skew handling.
``salted`` spreads hot keys explicitly where adaptive splitting cannot help.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R


def lookup(facts: DataFrame, dim: DataFrame, on: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Inner lookup, or a left lookup when defaults for missing partners are given."""
    if defaults is None:
        return facts.join(dim, list(on), "inner")
    joined = facts.join(dim, list(on), "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def lookup_or_key(facts: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Left lookup that falls back to the key itself."""
    return facts.join(dim.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.col(key)))


def salted(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", buckets: int = 16) -> DataFrame:
    """Join with every key of ``facts`` spread over several buckets; ``dim`` holds one row per key.

    Each dim row is copied once per bucket, so a key holding a third of the facts
    is handled by ``buckets`` tasks. Only inner and left joins keep their meaning.
    The optimizer's estimate leaves the copies out, so they are never broadcast:
    the driver would gather ``buckets`` times what it takes for small.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted joins are inner or left")
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(buckets)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return spread.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def annotate_by_name(
    facts: DataFrame, annotations: DataFrame, fact_name: str, order: Sequence[Column], default: str = ""
) -> DataFrame:
    """Attach a mechanism by drug name, ignoring case; the last annotation of a name wins.

    The annotation's columns are found by the words in their names.
    """
    name_col = first_column(annotations, ("drug", "compound", "name"))
    value_col = first_column(annotations, ("moa", "mechanism", "target"))
    keyed = annotations.select(
        F.lower(name_col).alias("_key"), F.col(value_col).alias("annotation"), F.struct(*order).alias("_order")
    ).filter(F.col("_key").isNotNull())
    last = keyed.groupBy("_key").agg(F.max_by("annotation", "_order").alias("annotation"))
    joined = facts.withColumn("_key", F.lower(fact_name)).join(last, "_key", "left").drop("_key")
    return joined.withColumn("annotation", F.coalesce("annotation", F.lit(default)))


def first_column(df: DataFrame, words: Sequence[str]) -> str:
    for name in df.columns:
        if any(w in name.lower() for w in words):
            return name
    raise ValueError(f"no column named like {', '.join(words)}")


def flag_member(facts: DataFrame, members: DataFrame, key: str, out: str = "is_member") -> DataFrame:
    """True where the key occurs among the members."""
    marks = members.select(key).distinct().withColumn(out, F.lit(True))
    return facts.join(marks, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def not_loaded(batch: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target does not hold yet."""
    return batch.join(loaded.select(key).distinct(), key, "left_anti")


def not_among(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Anti join in which two missing keys count as equal."""
    seen = others.select(F.col(key).alias("_seen")).distinct()
    return rows.join(seen, rows[key].eqNullSafe(F.col("_seen")), "left_anti")


def name_set_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of both name sets, their intersection and their union, from one grouping."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.sum("l").alias("n_left"),
        F.sum("r").alias("n_right"),
        F.sum(F.col("l") * F.col("r")).alias("n_both"),
        F.count(F.lit(1)).alias("n_union"),
    )


def resolve(candidates: DataFrame, preferred_entity: str = "target", strict: bool = False) -> DataFrame:
    """Pick one candidate per query from (query, rank, candidate_id, name, entity).

    An exact name match wins, ignoring case; then the first hit of the preferred
    kind; then the first hit. Strict: only a top hit whose name matches.
    """
    exact = F.upper("name") == F.upper("query")
    if strict:
        top = R.first_per_key(candidates, ["query"], F.col("rank").asc())
        return top.filter(exact).withColumn("match", F.lit("exact"))
    match = F.when(exact, 0).when(F.col("entity") == preferred_entity, 1).otherwise(2)
    best = R.first_per_key(candidates.withColumn("_m", match), ["query"], F.col("_m").asc(), F.col("rank").asc())
    names = F.array(F.lit("exact"), F.lit("preferred"), F.lit("first"))
    return best.withColumn("match", names[F.col("_m")]).drop("_m")


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames with different columns; absent ones become NULL, types are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
