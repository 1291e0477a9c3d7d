"""URL filtering by mined association rules and a list of fixed host and path rules.

Token combinations of labelled URLs are mined with FP-growth; rules "these tokens -> bad" that pass support, confidence
and lift are matched against all URLs through an inverted index from each rule's rarest token. Fixed rules go first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import stored

BAD = "label=bad"


def host_of(url: Column) -> Column:
    """Text after the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels and suffixes, path words, file ending and query keys; digits become 0."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffix = F.concat(F.lit("s="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))
    scheme = F.concat(F.lit("x="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    words = F.filter(F.split(F.regexp_replace(F.lower(path_of(url)), r"\d+", "0"), r"[^\p{L}0]+"), lambda w: w != "")
    keys = F.regexp_extract_all(F.lower(url), F.lit(r"[?&]([^=&#]+)="), 1)

    def marked(kind: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.concat(F.lit(kind), t))

    parts = [marked("h=", labels), marked("p=", words), marked("q=", keys), F.array(scheme, suffix)]
    return F.coalesce(F.filter(F.array_distinct(F.concat(*parts)), lambda t: ~t.isin("h=", "s=", "x=")), F.array())


def mine(
    labelled: DataFrame, min_support: float = 0.002, min_rows: int = 20, min_confidence: float = 0.5, min_lift: float = 1.5,
) -> DataFrame:
    """Rules from rows (url, bad boolean): tokens array<string>, key string (its rarest token), confidence, lift, support.

    All labelled rows count; a rule needs the larger of ``min_support`` (a share) and ``min_rows``. Rows with a null url or label are left out. A rule is dropped if one with fewer of its
    tokens has at least its confidence. No labelled rows, or none that is bad, give no rules.
    """
    spark = labelled.sparkSession
    empty = "tokens array<string>, key string, confidence double, lift double, support double"
    rows = labelled.filter("url IS NOT NULL AND bad IS NOT NULL").select(
        F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array())).alias("items"),
    )
    rows = stored(rows, "url-items")
    total, bad = rows.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    if not bad or min_rows > total:
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / total), minConfidence=min_confidence).fit(rows)
    rules = (
        model.associationRules.filter(F.array_contains("consequent", BAD) & (F.col("lift") >= min_lift))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")
    )
    # A rule is looked up among its subsets of all sizes but its own, by equality.
    subsets = F.aggregate(
        "tokens", F.array(F.array().cast("array<string>")),
        lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(t)))),
    )
    smaller = rules.select(F.col("tokens").alias("subset"), F.col("confidence").alias("found"))
    covered = (
        rules.withColumn("subset", F.explode(subsets)).filter(F.size("subset") < F.size("tokens"))
        .join(smaller, "subset").filter(F.col("found") >= F.col("confidence")).select("tokens").distinct()
    )
    rules = rules.join(covered, "tokens", "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (
        rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token")
        .groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    )
    return rules.join(rarest, "tokens").select("tokens", "key", "confidence", "lift", "support")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct url that some rule fits: url, n_rules, confidence (the highest) and tokens of that rule."""
    found = urls.select("url").distinct().withColumn("__tokens", tokens_of(F.col("url")))
    index = rules.select(F.col("key").alias("__key"), "tokens", "confidence")
    return (
        found.withColumn("__key", F.explode("__tokens")).join(index, "__key")
        .filter(F.size(F.array_except("tokens", "__tokens")) == 0)
        .groupBy("url").agg(
            F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"),
            F.max(F.struct("confidence", "tokens"))["tokens"].alias("tokens"),
        )
    )


def judge(
    pages: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str, str]], *,
    min_support: float = 0.002, min_rows: int = 20, min_confidence: float = 0.5, min_lift: float = 1.5, salt: int = 16,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, confidence and n_rules of the mined rules that fit.

    ``fixed`` holds (verdict, host, path): it fits its host and all subdomains if the path starts with its path, and the
    longest one that fits decides. Other pages are blocked if a mined rule fits, else allowed. Null URLs, and those
    without ://, have an empty host and path and are allowed. Repeated pages each give a row; other columns of
    ``pages`` are not read. A url that many pages share is joined in ``salt`` parts.
    """
    rules = mine(labelled, min_support, min_rows, min_confidence, min_lift)
    hits = matches(pages, rules).select(F.col("url").alias("__url"), "confidence", "n_rules")
    hits = hits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    rows = pages.select("page_id", "url", F.pmod(F.xxhash64("page_id"), F.lit(salt)).cast("int").alias("__salt"))
    rows = rows.join(hits.withColumnRenamed("__salt", "__salt2"), F.expr("url = __url AND __salt = __salt2"), "left")
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "confidence", "n_rules")

    rule, verdict = F.lit(None).cast("string"), F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    for kind, host, path in sorted(fixed, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "confidence", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
