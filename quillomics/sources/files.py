"""File scans: columnar, delimited, JSON and flat text, with discovery and profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import EFFECT_NAMES, align_to_schema


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the named columns only; one distributed read for any number of shards."""
    return spark.read.parquet(path).select(*columns)


def significant_effects(raw: DataFrame, cut: float = 0.05) -> DataFrame:
    """Effects under a p-value cut in canonical names; the cut reaches the file scan."""
    renamed = {old: new for new, (_, old) in EFFECT_NAMES.items() if old in raw.columns}
    return raw.withColumnsRenamed(renamed).filter(F.col("pvalue_adj") < cut)


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row["value"] if row else ""


def sniff_separator(line: str) -> str:
    return "\t" if "\t" in line else ","


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | str, sep: str | None = None, header: bool = True
) -> DataFrame:
    """Delimited text with a declared schema; the separator is taken from the first line when not given."""
    sep = sep or sniff_separator(first_line(spark, path))
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes below a folder; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", F.col("length").alias("n_bytes"))


def table_of(path: str | Column = "path") -> Column:
    """Table a file belongs to, whether the table is one file or a folder of files."""
    return F.regexp_extract(path, r"/([^/]+?)\.parquet(/|$)", 1)


# Words that mark a data file as something other than cell rows.
SIDE_FILE_WORDS = ("var", "obs", "vocab", "gene", "drug_annot", "annot", "metadata")


def classify_files(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Kind of each file: the first whose pattern matches its path, else 'other'."""
    kind = F.lit("other")
    for label, pattern in reversed(list(kinds.items())):
        kind = F.when(F.col("path").rlike(pattern), label).otherwise(kind)
    return files.withColumn("kind", kind)


def cell_shards(files: DataFrame) -> DataFrame:
    """Data files that hold cell rows, in path order: side files are recognised by words in their path."""
    path = F.lower("path")
    side = F.lit(False)
    for word in SIDE_FILE_WORDS:
        side = side | path.contains(word)
    return files.filter(path.endswith(".parquet") & ~side).orderBy("path")


def every_nth(files: DataFrame, n: int) -> DataFrame:
    """Every n-th file in path order, the sampling used before a full sweep. File lists are small."""
    position = F.row_number().over(Window.orderBy("path")) - 1
    return files.withColumn("_i", position).filter(F.col("_i") % n == 0).drop("_i")


def load_sheets(
    spark: SparkSession, paths: Sequence[str], target: StructType, candidates: dict[str, Sequence[str]], key: str
) -> DataFrame:
    """Sheets landed as delimited files, with the file each row came from.

    Sheets sharing a header are read together. A sheet without the key column is
    no data sheet and is skipped.
    """
    by_header: dict[str, list[str]] = {}
    for path in paths:
        by_header.setdefault(first_line(spark, path), []).append(path)
    frames = []
    for header, group in by_header.items():
        sep = sniff_separator(header)
        names = [h.strip() for h in header.split(sep)]
        if not any(n in names for n in candidates.get(key, (key,))):
            continue
        text = StructType()
        for name in names:
            text = text.add(name, "string")
        sheet = spark.read.csv(group, schema=text, sep=sep, header=True)
        file_name = F.col("_metadata.file_name")
        aligned = align_to_schema(sheet.withColumn("_file", file_name), target.add("_file", "string"), candidates)
        target = StructType([f for f in target.fields if f.name != "_file"])
        frames.append(aligned.withColumnRenamed("_file", "source_file"))
    if not frames:
        raise ValueError(f"no sheet has a column {key}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, as text in ``raw`` and VARIANT in ``doc`` (NULL when unreadable)."""
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    return files.withColumn("doc", F.try_parse_json("raw"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.withColumn("doc", F.try_parse_json("raw"))


def vocabulary_names(docs: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Names in a vocabulary document, which is a list of names or an object keyed by name."""
    entries = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    name = F.coalesce(F.col("key"), F.try_variant_get("value", F.lit("$"), "string"))
    return entries.select(*ids, name.alias("name"))


def split_fields(lines: DataFrame, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """Delimited lines (column ``value``) to named, trimmed columns."""
    parts = F.split("value", sep)
    return lines.filter(F.size(parts) >= len(names)).select(
        *[F.trim(F.get(parts, i)).alias(n) for i, n in enumerate(names)]
    )


def pathway_links(lines: DataFrame, organism: str = "hsa") -> DataFrame:
    """Gene to pathway links of one organism, without the path prefix."""
    links = split_fields(lines, ["kegg_gene_id", "pathway_id"])
    return links.filter(F.col("pathway_id").contains(f":{organism}")).withColumn(
        "pathway_id", F.replace("pathway_id", F.lit("path:"), F.lit(""))
    )


def gene_ids(lines: DataFrame, organism: str = "hsa") -> DataFrame:
    """Gene ids with the symbols listed first in their description."""
    rows = split_fields(lines, ["kegg_gene_id", "description"]).filter(F.col("kegg_gene_id").startswith(f"{organism}:"))
    head = F.split_part(F.split_part(F.upper("description"), F.lit(" "), F.lit(1)), F.lit(";"), F.lit(1))
    return rows.select("kegg_gene_id", F.explode(F.split(head, ",")).alias("gene_symbol"))


RECORD_END = "///\n"


def read_flat_records(spark: SparkSession, path: str) -> DataFrame:
    """Keyword files cut at their record marks, one record per row in ``value``."""
    return spark.read.text(path, lineSep=RECORD_END).filter(F.trim("value") != "")


def flat_fields(value: Column) -> Column:
    """Map of keyword to text for one record; indented lines continue the keyword above.

    A continuation is glued to its keyword first, then every remaining line is one field.
    """
    glued = F.regexp_replace(F.trim(value), r"\n[ \t]+", " ")
    lines = F.filter(F.split(glued, "\n"), lambda line: F.trim(line) != "")
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, r"^(\S+)", 1).alias("key"),
            F.trim(F.regexp_extract(line, r"^\S+\s+(.*)$", 1)).alias("value"),
        ),
    )
    # A repeated keyword keeps its last text.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))
    )


def profile(df: DataFrame, distinct: bool = False, metadata_below: int = 200, sample_length: int = 60) -> DataFrame:
    """Type, missing values and a sample value per column, from a single aggregation.

    ``distinct`` adds a sketched distinct count, which marks columns with fewer
    than ``metadata_below`` values as metadata. Samples show ``sample_length`` characters.
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        parts = [
            F.lit(name).alias("column"),
            F.lit(df.schema[name].dataType.simpleString()).alias("type"),
            F.count_if(c.isNull()).alias("n_null"),
            F.min(F.left(c.cast("string"), F.lit(sample_length))).alias("sample"),
        ]
        if distinct:
            parts.append(F.approx_count_distinct(c, 0.02).alias("n_distinct"))
        aggregates.append(F.struct(*parts).alias(f"_c{i}"))
    one = df.agg(*aggregates)
    rows = one.select("_rows", F.explode(F.array(*[F.col(f"_c{i}") for i in range(len(df.columns))])).alias("p"))
    out = rows.select("p.*", F.col("_rows").alias("n_rows"))
    return out.withColumn("is_metadata", F.col("n_distinct") < metadata_below) if distinct else out


#: Items of a sketch of quantiles, and bits of a sketch of distinct values (relative error about 1 %).
QUANTILE_ITEMS, DISTINCT_BITS = 400, 14
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def profile_sketches(df: DataFrame) -> DataFrame:
    """One row per column: column, type, n_rows, n_null, least, greatest (as text), and mergeable sketches of its distinct
    values (hll) and, for numbers, of its quantiles (kll). To be stored for each snapshot or batch of shards; one pass."""
    parts = []
    for name in df.columns:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType.simpleString()
        number = kind in NUMERIC or kind.startswith("decimal")
        parts.append(F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("type"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"),
            *[(f(c.cast("double")) if number else F.lit(None).cast("double")).alias(side) for side, f in (("least", F.min), ("greatest", F.max))],
            F.hll_sketch_agg(c.cast("string"), F.lit(DISTINCT_BITS)).alias("hll"),
            (F.kll_sketch_agg_double(c.cast("double"), F.lit(QUANTILE_ITEMS)) if number else F.lit(None).cast("binary")).alias("kll"),
        ).alias(f"_c{len(parts)}"))
    one = df.agg(*parts)
    return one.select(F.explode(F.array(*[F.col(f"_c{i}") for i in range(len(parts))])).alias("p")).select("p.*")


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all rows that the stored sketches were taken of, without reading those rows: column, type, n_rows,
    n_null, least, greatest, n_distinct and median, the last two estimated (errors about 1 % of the number and the rank).
    """
    merged = sketches.groupBy("column", "type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"), F.collect_list("kll").alias("_kll"),
    )
    # Sketches of a column are few, one per snapshot, and small; those of no values give no quantile.
    kept = F.filter("_kll", lambda s: F.kll_sketch_get_n_double(s) > 0)
    both = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda acc, s: F.kll_sketch_merge_double(acc, s))
    median = F.when(F.size(kept) > 0, F.kll_sketch_get_quantile_double(both, F.lit(0.5)))
    return merged.withColumn("median", median).drop("_kll")
