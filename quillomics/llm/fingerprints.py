"""SimHash fingerprints of documents, their likeness, and tables that find all fingerprints within a Hamming radius.

Column expressions only. The distinct words and word pairs of a text vote with their weights on 128 signed bits. Votes
are counted four bits at a time in the quarters of a long, in sums over exploded terms, so that a document's votes are
added up in its own task. A fingerprint is two longs, shown as 32 hex digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import stored

BLANKS = r"[\x20\x09-\x0D]+"
#: Votes of a distinct word and of a distinct pair of neighbouring words.
WEIGHTS = (1, 1)
HALF = 64
_LANES = 1 | 1 << 16 | 1 << 32 | 1 << 48
#: Votes that fit a quarter of a long.
LANE = (1 << 15) - 1
#: Ranges of ids for each shuffle partition, and ranges of hashes that rows without an id are dealt to.
RANGES = 4
UNNAMED = 256
#: Fingerprints under one table key beyond which the key is refined.
CROWDED = 64


def _terms(rows: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """For every text column arrays of the hashes of its distinct words and word pairs, in steps that each name their
    result, so that none is computed twice. A text without words has one word, the empty one."""
    places = range(len(texts))
    blank = F.array(F.lit(""))
    words = [F.filter(F.split(F.coalesce(F.col(f"`{t}`"), F.lit("")), BLANKS), lambda w: w != "") for t in texts]
    out = rows.select(*keys, *[w.alias(f"__w{i}") for i, w in enumerate(words)])
    full = [F.when(F.size(f"__w{i}") > 0, F.col(f"__w{i}")).otherwise(blank) for i in places]
    out = out.select(*keys, *[F.transform(w, lambda x: F.xxhash64(x)).alias(f"__w{i}") for i, w in enumerate(full)])

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b))

    out = out.select(*keys, *[F.array_distinct(f"__w{i}").alias(f"__w{i}") for i in places], *[pairs(F.col(f"__w{i}")).alias(f"__p{i}") for i in places])
    names = [f"__{kind}{i}" for i in places for kind in "wp"]
    return out.select(*keys, *[(F.array_distinct(c) if c[2] == "p" else F.col(c)).alias(c) for c in names]), names


def fingerprints(rows: DataFrame, keys: Sequence[str], texts: Sequence[str], weights: tuple[int, int] = WEIGHTS) -> DataFrame:
    """For every row and each of its text columns: the key columns, kind (the text's place), high and low (64 bits each).

    The keys must identify a row. A null text counts as empty. Votes of a run of terms are added up in the four quarters
    of a long, where they cannot overflow; the runs of a text are put together at the end.
    """
    held, names = _terms(rows, keys, texts)
    ends, at = [], F.lit(0)
    for name in names:
        at = at + F.size(name)
        ends.append(at)
    held = held.select(*keys, F.concat(*names).alias("__terms"), *[e.alias(f"__to{i}") for i, e in enumerate(ends)])
    held = held.select(*keys, *[f"__to{i}" for i in range(len(names))], F.posexplode_outer("__terms").alias("__at", "__h"))
    kind, weight = F.lit(len(texts) - 1), F.lit(weights[1])
    for i in reversed(range(len(names) - 1)):
        kind = F.when(F.col("__at") < F.col(f"__to{i}"), i // 2).otherwise(kind)
        weight = F.when(F.col("__at") < F.col(f"__to{i}"), weights[i % 2]).otherwise(weight)
    run = F.shiftright("__at", (LANE // max(weights)).bit_length() - 1)
    votes = held.select(*keys, kind.alias("kind"), run.alias("__run"), weight.cast("long").alias("__w"), "__h", F.xxhash64("__h", F.lit(1)).alias("__h2"))
    sums = [F.expr(f"sum((shiftright({h}, {k}) & {_LANES}L) * __w)").alias(f"{h}_{k}") for h in ("__h", "__h2") for k in range(16)]
    counted = votes.groupBy(*keys, "kind", "__run").agg(F.sum("__w").alias("__all"), *sums)

    def unpacked(sums: Column) -> Column:
        return F.flatten(F.transform(sums, lambda x: F.array(*[F.shiftrightunsigned(x, 16 * j).bitwiseAND(F.lit(0xFFFF)) for j in range(4)])))

    lanes = F.array(*[F.col(f"{h}_{k}") for h in ("__h", "__h2") for k in range(16)])
    counted = counted.select(*keys, "kind", "__all", lanes.alias("__lanes")).groupBy(*keys, "kind").agg(
        F.sum("__all").alias("__all"), F.collect_list("__lanes").alias("__lanes"),
    )
    votes = F.aggregate("__lanes", F.array_repeat(F.lit(0).cast("long"), 2 * HALF), lambda acc, x: F.zip_with(acc, unpacked(x), lambda a, b: a + b))

    def bits(begin: int) -> Column:
        """Element 4 k + j of a half counts the votes for bit k + 16 j."""
        def shifted(x: Column, i: Column) -> Column:
            return F.call_function("shiftleft", (x * 2 > F.col("__all")).cast("long"), F.shiftright(i, 2) + i.bitwiseAND(3) * 16)

        return F.aggregate(F.transform(F.slice("__votes", begin, HALF), shifted), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    counted = counted.select(*keys, "kind", "__all", votes.alias("__votes"))
    return counted.select(*keys, "kind", bits(1).alias("high"), bits(1 + HALF).alias("low"))


def hex_digits(high: str, low: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (high, low)]))


def apart(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def likeness(differing: Column) -> Column:
    """Estimated cosine similarity of the weighted terms, 0 to 1: fingerprints of unlike texts differ in half their bits."""
    return F.greatest(F.lit(0.0), F.cos(differing * F.lit(3.141592653589793 / (2 * HALF))))


def beside_next(docs: DataFrame) -> DataFrame:
    """Every row's doc_id and text (null: empty), with __id, and the text and __id of the next row by descending doc_id.

    After the last row comes the first. Rows of one id follow a hash of their text, rows without an id come last. Ids are
    cut into ranges as a sort would; the first row of each range is copied into the range before it, so that the texts
    are shuffled once and no task holds more than a range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("__id"), "doc_id", text.alias("text"), F.xxhash64(text).alias("__hash"))
    ids = docs.select(F.col("doc_id").cast("double").alias("id")).filter("id IS NOT NULL")
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row per range: no more than a sort by the same key would send to the driver for its own limits.
    least = ids.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("range")).agg(F.min("id").alias("id")).collect()
    splits = [-float("inf"), *sorted(r["id"] for r in least)[1:], float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="__key", outputCol="__range", handleInvalid="keep")
        rows = ranged.transform(rows.withColumn("__key", F.col("doc_id").cast("double"))).drop("__key")
    else:
        rows = rows.withColumn("__range", F.lit(0.0))
    # Descending: ranges of the largest ids first, rows without an id last, by ranges of their hashes.
    named = F.lit(len(splits) - 2) - F.col("__range").cast("long")
    unnamed = F.lit(len(splits) - 1) + F.lit(UNNAMED // 2 - 1) - F.shiftright("__hash", 56)
    rows = rows.withColumn("__range", F.when(F.col("doc_id").isNotNull(), named).otherwise(unnamed))
    first = rows.groupBy("__range").agg(F.max(F.struct("doc_id", "__hash")).alias("key")).collect()  # one row per range
    first = sorted((r["__range"], r["key"]["doc_id"], r["key"]["__hash"]) for r in first)
    before = {r[0]: first[i - 1][0] for i, r in enumerate(first)}
    size = max(before, default=0) + 1
    heads = {r: (i, h) for r, i, h in first}

    def by_range(values: list) -> Column:
        return F.get(F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",", -1), F.col("__range").cast("int")).try_cast("long")

    leads = F.col("doc_id").eqNullSafe(by_range([heads.get(r, (None, None))[0] for r in range(size)])) & (
        F.col("__hash") == by_range([heads.get(r, (None, None))[1] for r in range(size)])
    )
    to = F.array(F.struct(F.col("__range").alias("range"), F.lit(False).alias("copy")))
    copied = F.struct(by_range([before.get(r) for r in range(size)]).alias("range"), F.lit(True).alias("copy"))
    rows = rows.withColumn("__to", F.explode(F.when(leads, F.concat(to, F.array(copied))).otherwise(to)))
    order = Window.partitionBy("__to.range").orderBy("__to.copy", F.col("doc_id").desc_nulls_last(), F.col("__hash").desc())
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "__next": F.lead("__id").over(order)})
    return rows.filter(~F.col("__to.copy")).select("__id", "doc_id", "text", "next_text", "__next")


def block_masks(blocks: int) -> list[tuple[int, int]]:
    """Masks (high, low) of the 128 bits cut into equal blocks."""
    at = [2 * HALF * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(at, at[1:], strict=False)]
    return [(m >> HALF, m & ((1 << HALF) - 1)) for m in masks]


def _masked(mask: tuple[int, int], high: str = "high", low: str = "low") -> list[Column]:
    signed = [m - (1 << 64) if m >> 63 else m for m in mask]
    return [F.col(c).bitwiseAND(F.lit(m).cast("long")) for c, m in zip((high, low), signed, strict=True)]


def near(prints: DataFrame, radius: int = 3, agree: int = 2) -> DataFrame:
    """Pairs of distinct fingerprints within ``radius`` bits: high, low, other_high, other_low, bits; each pair once.

    Permuted block tables: of ``radius`` + ``agree`` blocks of bits some ``agree`` are alike in such a pair, so each choice
    of them gives a table in which fingerprints alike in these blocks meet. Under a key with many fingerprints they meet
    only if one of ``radius`` + 1 pieces of the other bits is alike too, which loses no pair.
    """
    distinct = stored(prints.select("high", "low").filter("high IS NOT NULL AND low IS NOT NULL").distinct(), "fingerprints")
    blocks = block_masks(radius + agree)

    def united(masks) -> tuple[int, int]:
        return tuple(sum(m[i] for m in masks) for i in (0, 1))

    choices = [united(c) for c in combinations(blocks, agree)]
    tables = F.array(*[F.xxhash64(F.lit(t), *_masked(m)) for t, m in enumerate(choices)])
    keyed = distinct.select("high", "low", F.posexplode_outer(tables).alias("table", "key"))
    crowded = stored(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "table-keys")
    # Keys of a single fingerprint go; the others know how many share them.
    keyed = stored(keyed.join(crowded, ["table", "key"]), "table-rows")
    # Pieces are dealt out round-robin over the bits, so that each holds bits outside the agreed blocks.
    pieces = radius + 1
    piece_masks = [united([m for i, m in enumerate(block_masks(8 * pieces)) if i % pieces == p]) for p in range(pieces)]
    finer = F.array(*[F.xxhash64("key", F.lit(p), *_masked(m)) for p, m in enumerate(piece_masks)])
    keyed = keyed.select("high", "low", "table", F.explode(F.when(F.col("n") > CROWDED, finer).otherwise(F.array("key"))).alias("key"))
    left, right = keyed.alias("a"), keyed.alias("b")
    bits = apart(F.col("a.high"), F.col("a.low"), F.col("b.high"), F.col("b.low"))
    order = F.struct("a.high", "a.low") < F.struct("b.high", "b.low")
    met = left.join(right, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & order & (bits <= radius))
    return met.select(
        F.col("a.high").alias("high"), F.col("a.low").alias("low"), F.col("b.high").alias("other_high"), F.col("b.low").alias("other_low"), bits.alias("bits"),
    ).distinct()


def likenesses(docs: DataFrame, radius: int = 3, weights: tuple[int, int] = WEIGHTS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The edited text is the text with its last third (rounded down) replaced by as many first characters of the next
    document's text, or all of it. Reads doc_id and text; other columns, whatever their names, are not read. Returns
    doc_id, n_chars long, edited_sha256, fingerprint and edited_fingerprint (32 hex digits), near_edited and near_next
    (double: likeness to the edited text's and the next document's), n_near long (other fingerprints within ``radius``
    bits of its own). A null text counts as empty, as a text of no words does: both have the fingerprint of the empty
    word. Rows of one doc_id follow a hash of their text, rows without come last; repeated rows give a row each. The only
    document is its own next. An empty table gives no rows.
    """
    rows = beside_next(docs)
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("__id", "__next", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["__id", "__next", "doc_id", "n_chars", "edited_sha256"]
    prints = stored(fingerprints(rows, keys, ["text", "edited"], weights), "document-fingerprints")
    own = prints.filter("kind = 0").drop("kind")
    changed = prints.filter("kind = 1").select(F.col("__id").alias("__id1"), F.col("high").alias("__high1"), F.col("low").alias("__low1"))
    following = own.select(F.col("__id").alias("__id2"), F.col("high").alias("__high2"), F.col("low").alias("__low2"))
    pairs = near(own, radius)
    both = pairs.select("high", "low").unionByName(pairs.select(F.col("other_high").alias("high"), F.col("other_low").alias("low")))
    counts = both.groupBy(F.col("high").alias("__high3"), F.col("low").alias("__low3")).agg(F.count("*").alias("n_near"))
    found = own.join(changed, F.col("__id") == F.col("__id1")).join(following, F.col("__next") == F.col("__id2"))
    found = found.join(counts, (F.col("high") == F.col("__high3")) & (F.col("low") == F.col("__low3")), "left")

    def like(suffix: str) -> Column:
        return likeness(apart(F.col("high"), F.col("low"), F.col(f"__high{suffix}"), F.col(f"__low{suffix}")))

    return found.select(
        "doc_id", "n_chars", "edited_sha256", hex_digits("high", "low").alias("fingerprint"), hex_digits("__high1", "__low1").alias("edited_fingerprint"),
        like("1").alias("near_edited"), like("2").alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
