"""Substring search through an index of trigrams.

Every run of three characters of a record's searched text leads to the record. A text is found by intersecting the
records of its rarest trigrams and looking for it in those alone, so a search reads a few partitions of the index and
the candidates instead of all texts. The result is that of looking everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..operators import records as Q
from ..sources.tables import RECORD_KEYS, write_partitioned

GRAM = 3
#: Partitions of the index; fixed when it is written.
BUCKETS = 64
#: Trigrams of a text that are looked up, the rarest ones.
LOOKED_UP = 4


def grams_of(text: str) -> list[str]:
    """Distinct trigrams of a text in lower case."""
    low = text.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


def _trigrams(text: Column) -> Column:
    """Trigrams of a text in lower case; none for texts under three characters, and for null.

    One pass: three characters are looked at, one is taken. Characters are code points, as in ``grams_of``.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build(records: DataFrame, path: str, columns: Sequence[str] = Q.SEARCH_COLUMNS, buckets: int = BUCKETS) -> None:
    """Writes the index of the records' columns: postings (gram to record keys) and the number of records of each gram.

    Postings are partitioned by bucket and sorted by gram, so a lookup reads one partition per gram and few row groups of
    it. A gram of very many records is written by several tasks. Records may repeat; keys are listed once per gram.
    """
    grams = F.array_distinct(F.concat(*[_trigrams(F.col(c)) for c in columns]))
    postings = records.select(*RECORD_KEYS, F.explode(grams).alias("gram")).distinct().withColumn("bucket", bucket_of(F.col("gram"), buckets))
    ordered = postings.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = records.sparkSession.read.parquet(f"{path}/postings")
    counts = stored.groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("n_records"))
    write_partitioned(counts, f"{path}/counts", "bucket")


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _rows(self, table: str, grams: Sequence[str]) -> DataFrame:
        """Rows of the grams; bucket numbers are worked out first, so that only their partitions are listed."""
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket_of(F.col("gram"), self.buckets)).distinct()
        places = sorted(r[0] for r in asked.collect())  # at most one per gram
        schema = {"postings": "record_id string, source_key string, gram string, bucket int", "counts": "gram string, n_records long, bucket int"}
        rows = self.spark.read.schema(schema[table]).parquet(f"{self.path}/{table}")
        return rows.filter(F.col("bucket").isin(places) & F.col("gram").isin(list(grams)))

    def candidates(self, text: str) -> DataFrame | None:
        """Keys of the records that hold the text's rarest trigrams; None for texts of less than three characters."""
        grams = grams_of(text)
        if not grams:
            return None
        found = {r["gram"]: r["n_records"] for r in self._rows("counts", grams).groupBy("gram").agg(F.sum("n_records").alias("n_records")).collect()}
        rarest = sorted(grams, key=lambda g: (found.get(g, 0), g))[:LOOKED_UP]
        rows = self._rows("postings", rarest)
        return rows.groupBy(*RECORD_KEYS).agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(rarest)).drop("_n")


def search_sources(
    records: DataFrame, index: Index, source_keys: list[str], text: str, limit: int | None = 20, **filters: str
) -> DataFrame:
    """As ``records.search_sources``, by the index: the newest matches of each given source.

    ``records`` are those that were indexed. Without text, and for texts of less than three characters, all of them are
    read.
    """
    candidates = index.candidates(text) if text else None
    if candidates is not None:
        # Keys may be null in a record; such a record is found like others.
        keys = candidates.withColumnsRenamed({k: f"_{k}" for k in RECORD_KEYS})
        same = [records[k].eqNullSafe(keys[f"_{k}"]) for k in RECORD_KEYS]
        records = records.join(keys, same, "left_semi")
    rows = Q._matches(records, source_keys, text, **filters)
    return R.top_n_per_group(rows, ["source_key"], limit, F.col("source_updated_at").desc_nulls_last())
