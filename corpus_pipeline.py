"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination and packing over ``documents``.

Each stage reads what the stage before it wrote. All but the last return the columns of ``documents``. SQL cannot
express the n-gram filter, the fingerprints or the packing, so there is no checking SQL; tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillomics.llm import catalog, decontaminate, language, names, packing, passages, simhash
from quillomics.session import scratch_path

#: A text of which less than this share of n-grams belongs to its best language is in none of them.
LEAST_LANGUAGE_SCORE = 0.5
ORACLE_SQL = None


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(fn):
    """A stage on the columns of documents. Any other column of its table comes through as it is, whatever its name."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, names_back = names.only(docs, COLUMNS)
        return fn(spark, docs, sf_dir).withColumnsRenamed(names_back)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a learned language: drops null texts, texts without letters and odd ones.

    Repeated rows are judged one by one; nulls in other columns do not matter. An empty table stays empty.
    """
    found = language.identify(docs, language.learn(docs))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The one with the smallest doc_id stays, a null one last; of repeated rows one stays. Null texts count as empty, and
    empty texts are copies of each other. An empty table stays empty.
    """
    return simhash.distinct_documents(docs)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of recurring passages. A changed text is its kept words joined by spaces; one that lost all
    its words goes. n_chars follows the text. Null, empty and short texts stay as they are; repeated rows recur in each
    other. An empty table stays empty."""
    found = passages.remove_repeats(docs)
    found = found.withColumn("text", F.when(F.col("changed"), F.col("kept")).otherwise(F.col("text")))
    found = found.filter(~(F.col("changed") & (F.col("n_removed") == F.col("n_words"))))
    found = found.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null texts, and items that are null or have no words, match nothing. Repeated rows stay or go together. An empty
    table of either kind drops nothing.
    """
    items = catalog.table(spark, sf_dir, "benchmark")
    return decontaminate.drop_contaminated(docs, items)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 1024.

    A null text has only its end id; repeated rows have pieces of their own; equal pieces take places in the order of
    doc_id. Other columns are not read. An empty table gives no rows.
    """
    return packing.pack(docs, catalog.tokenizer_file(), 1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
