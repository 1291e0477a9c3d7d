"""Centroid clustering of vectors of whole numbers, in column expressions only.

Every component becomes the floor of a multiple of it, so distances, sums and centroids are exact. The centroids of a
round are literal arrays in the plan: their number and length are arguments, and nothing else goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import stored

#: Up to this absolute value all distances of 64 components fit a long; beyond it decimals are used.
PLAIN = 1 << 27
#: Components beyond this absolute value count as it.
MOST = 1 << 58
WIDE = "decimal(38,0)"


def is_whole(vector: Column) -> Column:
    """A vector without null, NaN or infinite components; false for null."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    def number(x: Column) -> Column:
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * F.lit(float(scale)))))

    return F.transform(vector, number)


def kept_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and parts (array<bigint>) of the rows whose vector has ``dims`` finite components."""
    v = F.col("embedding")
    return vectors.filter(is_whole(v) & (F.size(v) == dims)).select("vec_id", whole_numbers(v, scale).alias("v"))


def _literal(centroid: list[int], kind: str) -> Column:
    """A constant array; the optimizer folds it from one string, so that a plan holds one literal per centroid."""
    return F.split(F.lit(",".join(map(str, centroid))), ",").cast(f"array<{kind}>")


def nearest(vector: Column, centroids: list[list[int]], kind: str = "bigint") -> Column:
    """distance (squared) and cluster of the nearest centroid, ties to the smaller number, as a struct."""
    def distance(centroid: list[int]) -> Column:
        squares = F.zip_with((vector if kind == "bigint" else vector.cast(f"array<{kind}>")), _literal(centroid, kind), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast(kind), lambda acc, x: (acc + x).cast(kind))

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def first_centroids(kept: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order; repeated ids follow their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r[0] for r in kept.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()]


def improved(kept: DataFrame, centroids: list[list[int]], kind: str) -> list[list[int]]:
    """Centroids moved to the floor of the mean of their vectors; those without vectors stay.

    One partial sum per centroid, component and task is shuffled; one row per centroid reaches the driver.
    """
    dims = len(centroids[0])
    placed = kept.select("v", nearest(F.col("v"), centroids, kind)["cluster"].alias("cluster"))
    sums = [F.sum(F.get("v", F.lit(i)).cast(WIDE if kind == WIDE else "bigint")).alias(f"s{i}") for i in range(dims)]
    found = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()}
    return [[int(found[c][f"s{i}"]) // found[c]["n"] for i in range(dims)] if c in found else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """The nearest of k centroids of every kept vector after ``rounds`` rounds of moving them.

    Reads vec_id and embedding; other columns, whatever their names, are not read. Returns vec_id, cluster int, distance
    long (squared), cluster_inertia and inertia long, centroid_sha256 (of the components, joined by commas). A row with
    a null vector, another number of components, or a null, NaN or infinite one gives no row; a null vec_id is kept and
    starts a centroid only after all others. Repeated rows are vectors of their own. Fewer than k vectors give fewer
    centroids, none an empty result. Components beyond 2^58 / scale count as that; a distance that fits no long is null.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    most = kept.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    kind = "bigint" if most * most * dims <= PLAIN * PLAIN * 64 else WIDE
    for _ in range(rounds):
        centroids = improved(kept, centroids, kind)
    at = nearest(F.col("v"), centroids, kind)
    placed = stored(kept.select("vec_id", at.alias("at")).select("vec_id", "at.cluster", "at.distance"), "clusters")
    inertia = {r[0]: r[1] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast(WIDE))).collect()}

    def by_cluster(values: list, kind: str) -> Column:
        return F.get(F.lit(values).cast(f"array<{kind}>"), F.col("cluster"))

    def fitting(x: int) -> int | None:
        return int(x) if x < 1 << 63 else None

    names = [F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids]
    return placed.select(
        "vec_id", "cluster", F.col("distance").try_cast("bigint").alias("distance"),
        by_cluster([fitting(inertia.get(c, 0)) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(fitting(sum(inertia.values()))).cast("bigint").alias("inertia"),
        F.get(F.array(*names), F.col("cluster")).alias("centroid_sha256"),
    )
