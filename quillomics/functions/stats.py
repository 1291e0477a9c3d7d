"""Exact order statistics that keep working when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", *measures: Column
) -> DataFrame:
    """Exact (interpolated) median of ``value`` per group, with further aggregates of the same rows.

    Two reads. The first takes a mergeable quantile sketch with the other measures; its rank error has a sure bound, so
    the middle ranks lie between two of its quantiles. The second counts the values between them, equal ones together,
    and all smaller ones in one number per task; larger ones are left out. Only the counted values, about one row in a
    thousand of a large group, are then put in order.
    """
    keys = list(keys)
    margin = 4.0 / SKETCH_ACCURACY
    number = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(
        *measures,
        F.percentile_approx(number, [0.5 - margin, 0.5 + margin], SKETCH_ACCURACY).alias("_b"),
        F.count(number).alias("_n"),
    )
    others = [c for c in stats.columns if c not in (*keys, "_b")]
    aliases = [f"_k{i}" for i in range(len(keys))]
    renamed = [F.col(k).alias(a) for k, a in zip(keys, aliases, strict=True)]
    brackets = stats.select(*renamed, *others, F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    rows = df.select(*keys, number.alias("_v")).filter(F.col("_v").isNotNull())
    same = [rows[k].eqNullSafe(brackets[a]) for k, a in zip(keys, aliases, strict=True)]
    # The measures go along, and a group without values stays, so nothing is joined to the groups again.
    inside = rows.join(brackets, [*same, F.col("_v") <= F.col("_hi")], "right")
    # What lies below the bracket is one null value, which comes first.
    inside = inside.groupBy(*aliases, *others, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_w")).agg(F.count("_v").alias("_c"))
    order = Window.partitionBy(*aliases).orderBy(F.col("_w").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_last", F.sum("_c").over(order)).withColumn("_first", F.col("_last") - F.col("_c"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_first") <= position) & (position < F.col("_last")), F.col("_w")))

    medians = ranked.groupBy(*aliases, *others).agg(((at(low) + at(high)) / 2).alias(out))
    return medians.select(*[F.col(a).alias(k) for k, a in zip(keys, aliases, strict=True)], *[c for c in others if c != "_n"], out)
