"""Quality rules by distribution divergence.

A document's character classes and its common words are compared with those of its language by Jensen-Shannon
distance. The references come from all documents: shares of character classes, and the most frequent words with their
shares, per language. Short documents are not judged by a distance they cannot support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import stored

#: Separators of words: space and the controls 0x09 to 0x0D.
BLANK = r"[\x20\x09-\x0D]+"
#: Character classes counted one after another, each in what the earlier ones left; the rest is the last class.
CLASSES = (r"[a-z]+", r"[\x20\x09-\x0D]+", r"[\u0080-\x{10FFFF}]+", r"[.,;:!?'\"()-]+", r"[A-Z]+", r"[0-9]+")
SYMBOLS = "#*$%&|<>"
#: Key of the reference over all documents, which those without a language are compared with.
ALL = "*"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares, each summing to 1."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that a list of words holds twice or more, the first one included.

    Windows are told apart by 64-bit hashes of their words. Only lists with a repeat are sorted.
    """
    def covered(hashes: Column) -> Column:
        def repeats(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.array_sort(F.transform(hit, lambda i: F.get(s, i)["p"]))

        starts = F.transform(F.array(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))), repeats)[0]
        first = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            starts, first,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    # Each list is bound once, as the one element of an array, so that it is not computed per use.
    def found(h: Column) -> Column:
        n = F.size(h) - 4
        windows = F.arrays_zip(*[F.slice(h, F.lit(k + 1), n).alias(f"w{k}") for k in range(5)])
        five = F.transform(F.array(F.transform(windows, lambda w: F.xxhash64(w))), lambda five: F.when(
            F.size(F.array_distinct(five)) == F.size(five), F.lit(0),
        ).otherwise(covered(five)))
        return five[0]

    found = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), found)[0]
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(found).cast("long")


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, __lang, __has_text, __words, __class (counts) and the base counts of every whole text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", _key(F.col("lang")).alias("__lang"), text.alias("__text"), F.col("text").isNotNull().alias("__has_text"))
    rest, columns = "__text", []
    for i, pattern in enumerate(CLASSES):
        rows = rows.withColumn(f"__rest{i}", F.regexp_replace(rest, pattern, ""))
        columns.append(F.length(rest) - F.length(f"__rest{i}"))
        rest = f"__rest{i}"
    columns.append(F.length(rest))
    symbols = F.length(F.regexp_replace(rest, f"[^{SYMBOLS}]+", ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "__lang", "__has_text", words_of(F.col("__text")).alias("__words"),
        F.array(*[c.cast("double") for c in columns]).alias("__class"),
        (F.length("__text") - columns[1]).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    return rows.select("*", F.size("__words").cast("long").alias("n_words"), repeated_words(F.col("__words")).alias("n_repeat_words"))


def _key(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(ALL))


def _with_all(sums: DataFrame, *keys: str) -> DataFrame:
    """The rows by language, and their sums over all languages."""
    totals = [F.sum(c).alias(c) for c in sums.columns if c not in ("__lang", *keys)]
    every = sums.groupBy(F.lit(ALL).alias("__lang"), *keys).agg(*totals)
    return sums.filter(F.col("__lang") != ALL).unionByName(every)


def word_references(docs: DataFrame, common_words: int = 24) -> DataFrame:
    """Per language, and over all documents (key ``*``): the ``common_words`` most frequent words and their shares.

    Words are lower-cased and split at blanks; the last share is that of all other words. Ties in frequency follow the
    word. Documents without language count in the reference over all. Counts are combined before they are shuffled.
    """
    rows = docs.filter("text IS NOT NULL").select(_key(F.col("lang")).alias("__lang"), F.col("text").alias("__text"))
    # The outer form, as the plain one would split each text a second time to see whether it has words.
    words = rows.select("__lang", F.explode_outer(words_of(F.lower("__text"))).alias("word")).filter("word IS NOT NULL")
    found = stored(words.groupBy("__lang", "word").count(), "word-counts")
    totals = _with_all(found.groupBy("__lang").agg(F.sum("count").alias("total")))
    # The leading words of each language are kept per task first (max_by-like heap), so no language meets in one task whole.
    top = _with_all(found, "word")
    top = top.withColumn("__part", F.pmod(F.xxhash64("word"), F.lit(64)))
    for keys in (["__lang", "__part"], ["__lang"]):
        top = top.withColumn("__rank", F.expr(
            f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY count DESC, word)",
        )).filter(F.col("__rank") <= common_words)
    top = top.groupBy("__lang").agg(F.sort_array(F.collect_list(F.struct("__rank", "word", "count"))).alias("top"))
    shares = F.concat(
        F.transform("top", lambda t: t["count"] / F.col("total")),
        F.array(1.0 - F.aggregate("top", F.lit(0.0), lambda s, t: s + t["count"] / F.col("total"))),
    )
    return top.join(totals, "__lang").select("__lang", F.transform("top", lambda t: t["word"]).alias("ref_words"), shares.alias("ref_shares"))


def class_references(rows: DataFrame) -> DataFrame:
    """Per language of rows (__lang, __class), and over all (key ``*``): shares of the character classes."""
    each = [F.sum(F.get("__class", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums = _with_all(rows.groupBy("__lang").agg(*each))
    c = F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)])
    return sums.select("__lang", F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, y: s + y)).alias("ref_class"))


def judge(
    docs: DataFrame, *, common_words: int = 24, max_class_distance: float = 0.25, max_word_distance: float = 0.5,
    min_chars: int = 200, min_words: int = 50,
) -> DataFrame:
    """Per document the base counts, both distances and the verdict ``kept``.

    ``base_failed``: under 10 words, or over 20 % of the words repeated. A document that passes is dropped if its class
    distance exceeds the limit and it has at least ``min_chars`` characters, or its word distance does and it has at
    least ``min_words`` words. A document without a language is compared with the reference over all documents. Distances
    are null for documents without words. Null text counts as empty.
    Repeated rows are judged one by one; columns other than doc_id, text and lang are not read. An empty table gives
    no rows.
    """
    words = stored(word_references(docs, common_words), "word-references")
    rows = base_features(docs).join(words, "__lang", "left")

    # Each list and line is bound once, as the one element of an array, so that it is not computed per use.
    def line(longest: Column) -> Column:
        """The words, lower-cased, without those longer than any reference word: lower case is never shorter."""
        return F.concat(F.lit(" "), F.lower(F.array_join(F.filter("__words", lambda w: F.length(w) <= longest), "  ")), F.lit(" "))

    def counted(line: Column) -> Column:
        left = lambda w: F.octet_length(F.replace(line, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
        return F.transform("ref_words", lambda w: (F.octet_length(line) - left(w)) / (F.octet_length(w) + 2))

    longest = F.array_max(F.transform("ref_words", lambda w: F.length(w)))
    found = F.transform(F.array(longest), lambda m: F.transform(F.array(line(m)), counted)[0])[0]
    # Each text is worked on once: what is compared with the classes of all is stored, without the text.
    rows = stored(rows.withColumn("__found", found).drop("__words", "ref_words"), "base-features")
    refs = stored(class_references(rows.filter("__has_text")), "class-references")
    rows = rows.join(refs, "__lang", "left")
    rest = F.col("n_words") - F.aggregate("__found", F.lit(0.0), lambda s, x: s + x)
    enough = (F.col("n_words") > 0) & F.col("ref_shares").isNotNull()
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.aggregate("__class", F.lit(0.0), lambda s, x: s + x).alias("__chars"),
        F.when(enough, distance(_shares(F.col("__class")), F.col("ref_class"))).alias("class_distance"),
        F.when(enough, distance(_shares(F.concat("__found", F.array(rest))), F.col("ref_shares"))).alias("word_distance"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    odd = ((F.col("class_distance") > max_class_distance) & (F.col("__chars") >= min_chars)) | (
        (F.col("word_distance") > max_word_distance) & (F.col("n_words") >= min_words)
    )
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).drop("__chars")
