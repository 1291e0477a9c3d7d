"""Runnable queries of this package: ``QUERIES`` by name, and ``ORACLES`` where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import centroids, codebooks, decontaminate, divergence, fingerprints, hilbert, language, packing, passages, perspectives, records, simhash, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


ROTATE_SQL = """
WITH m AS (
  SELECT conv_id, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, coalesce(text, '')) - 1 AS place
  FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role IS DISTINCT FROM 'system'),
p AS (
  SELECT m.conv_id, s.speaker, m.place // 64 AS chunk, m.place, m.role IS NOT DISTINCT FROM s.speaker AS mine,
    '<|im_start|>' || CASE WHEN m.role = 'system' THEN 'system' WHEN m.role IS NOT DISTINCT FROM s.speaker THEN 'assistant'
      ELSE 'user name=' || translate(replace(coalesce(m.role, 'unknown'), '<|im_', '<| im_'), chr(10) || chr(13), '  ') END
      || chr(10) || m.text || '<|im_end|>' || chr(10) AS piece
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY place) - length(piece) AS begun FROM p
)
SELECT conv_id, speaker, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_messages, count(*) FILTER (WHERE mine) AS n_trained,
  string_agg(piece, '' ORDER BY place) AS rendered,
  coalesce(string_agg((CAST(begun AS BIGINT) + 22) || '-' || (CAST(begun AS BIGINT) + length(piece) - 1), ',' ORDER BY place) FILTER (WHERE mine), '') AS spans,
  string_agg(CASE WHEN mine THEN '1' ELSE '0' END, '' ORDER BY place) AS masks
FROM o GROUP BY conv_id, speaker, chunk
"""


@query("op1_perspective_rotation", ROTATE_SQL)
def op1(spark, sf_dir):
    seen = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    masks = F.array_join(F.transform("masks", lambda m: m.cast("string")), "")
    return seen.withColumns({"spans": spans, "masks": masks})


@query("op6_distribution_divergence")
def op6(spark, sf_dir):
    return divergence.judge(table(spark, sf_dir, "documents"))


@query("op8_hilbert_shards")
def op8(spark, sf_dir):
    placed = hilbert.shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


#: Fixed host and path rules of the query: verdict, host, path.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@query("op10_association_rules")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", bad.alias("bad"))
    return urls.judge(pages, labelled, URL_RULES)


@query("op4_language_bitmask")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rest = language.remainder(F.col("doc_id"))
    found = language.identify(docs, language.learn(docs.filter(rest != 0)), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


CONTAMINATION_SQL = """
WITH w AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), s AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS length, array_to_string(words[k + 1:k + least(10, len(words))], ' ') AS win
  FROM (SELECT *, unnest(range(0, greatest(len(words) - 9, 1))) AS k FROM i WHERE len(words) > 0)
), d AS (
  SELECT row, n.length, k, array_to_string(words[k + 1:k + n.length], ' ') AS win
  FROM (SELECT DISTINCT length FROM s) n, LATERAL (SELECT row, words, unnest(range(0, len(words) - n.length + 1)) AS k FROM w WHERE len(words) >= n.length)
), h AS (SELECT d.row, d.k, d.length, s.item_id FROM d JOIN s ON d.win = s.win AND d.length = s.length),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + length)) AS p FROM h) GROUP BY row),
t AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (row) LEFT JOIN t USING (row)
"""


@query("op5_prefix_set_join", CONTAMINATION_SQL)
def op5(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_token_records")
def op7(spark, sf_dir):
    path = scratch_path(spark, "token-records")
    records.write_records(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=0)
    return records.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "n_bytes")


@query("op9_best_two_fit")
def op9(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), 1024, end_id=2)


@query("op2_simhash_pivots")
def op2(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


REPEATS_SQL = """
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), x AS (
  SELECT row, k, md5(array_to_string(words[k + 1:k + 35], ' ')) AS win
  FROM (SELECT row, words, unnest(range(0, len(words) - 34)) AS k FROM w WHERE len(words) >= 35)
), c AS (
  SELECT DISTINCT row, unnest(range(k + 1, k + 36)) AS place FROM x WHERE win IN (SELECT win FROM x GROUP BY win HAVING count(*) > 1)
), p AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
k AS (SELECT row, string_agg(word, ' ' ORDER BY place) AS kept FROM p ANTI JOIN c USING (row, place) GROUP BY row),
n AS (SELECT row, count(*) AS n_removed FROM c GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (row) LEFT JOIN k USING (row)
"""


@query("op3_phrase_automata", REPEATS_SQL)
def op3(spark, sf_dir):
    found = passages.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def _rounds_sql(points: str, start: str, keys: str, rounds: int) -> str:
    """Rounds of Lloyd's iteration over x (r, keys, i, x) and e0 (keys, c, i, y): e1 ... and the last places p."""
    on = f"{keys}, i" if keys else "i"
    lead = f"{keys}, " if keys else ""
    steps = [points, start]
    for k in range(rounds + 1):
        steps.append(f"""p{k} AS MATERIALIZED (
  SELECT r, {lead}min({{'d': d, 'c': c}}) AS m FROM (SELECT r, {lead}c, sum((x - y) * (x - y)) AS d FROM x JOIN e{k} USING ({on}) GROUP BY r, {lead}c)
  GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""e{k + 1} AS MATERIALIZED (
  SELECT {lead}c, i, CAST(coalesce((s - ((s % n) + n) % n) // n, y) AS BIGINT) AS y
  FROM e{k} LEFT JOIN (SELECT {lead}m.c AS c, i, sum(x) AS s, count(*) AS n FROM p{k} JOIN x USING (r{', ' + keys if keys else ''}) GROUP BY ALL)
  USING ({lead}c, i)
)""")
    return ",\n".join(steps)


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

CODES_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_FINITE}
),
{_rounds_sql(
    "x AS MATERIALIZED (SELECT r, t * 4 // len(v) AS p, t % (len(v) // 4) AS i, v[t + 1] AS x FROM (SELECT r, v, unnest(range(len(v))) AS t FROM k))",
    "e0 AS MATERIALIZED (SELECT p, r - 1 AS c, i, x AS y FROM x WHERE r <= 256)", "p", 4)},
s AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, c, i)) AS codebooks_sha256 FROM e4),
o AS (SELECT r, string_agg(printf('%02x', m.c), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM p4 GROUP BY r)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN o USING (r), s
"""


@query("op11_dual_tree_codes", CODES_SQL)
def op11(spark, sf_dir):
    return codebooks.compress(table(spark, sf_dir, "embeddings"), parts=4, size=256, rounds=4, scale=1024)


CLUSTERS_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_FINITE} AND len(embedding) = 64
),
{_rounds_sql(
    "x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM k)",
    """e0 AS MATERIALIZED (
  SELECT c, i, x AS y FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM k) USING (r) WHERE c < 16
)""", "", 3)},
s AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM e3 GROUP BY c)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM k JOIN p3 USING (r) JOIN s ON s.c = m.c
"""


@query("op12_literal_centroids", CLUSTERS_SQL)
def op12(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


@query("op13_simhash_fingerprints")
def op13(spark, sf_dir):
    return fingerprints.likenesses(table(spark, sf_dir, "documents"))
