"""Joins and set operations with their checking SQL."""

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import joins as op
from . import query


@query("j01_target_summary_join", """
SELECT gene_target, count(*) AS n_cells_targeted, count(DISTINCT batch) AS n_guides FROM v_cell_metadata
WHERE gene_target IS NOT NULL AND gene_target <> 'non-targeting' GROUP BY 1""")
def _(t):
    """The two aggregates as two groupings joined on the target."""
    cells = t("v_cell_metadata").filter(P.is_target())
    counts = cells.groupBy("gene_target").agg(F.count(F.lit(1)).alias("n_cells_targeted"))
    guides = cells.groupBy("gene_target").agg(F.countDistinct("batch").alias("n_guides"))
    return counts.join(guides, "gene_target", "left")


@query("j03_inner_lookup", """
SELECT o_orderkey, n_name FROM orders JOIN nation ON o_orderkey % 30 = n_nationkey""")
def _(t):
    dim = t("nation").select(F.col("n_nationkey").cast("bigint").alias("region_id"), "n_name")
    facts = t("orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("region_id"))
    return op.lookup(facts, dim, ["region_id"]).drop("region_id")


@query("j04_left_lookup_default", """
SELECT molecule_name, target_alias, standard_value, coalesce(s.p_type, 'unknown') AS selectivity_class
FROM v_activities LEFT JOIN (SELECT 'M' || CAST(p_partkey AS VARCHAR) AS m, p_type FROM part WHERE p_size > 10) s ON molecule_id = m""")
def _(t):
    known = t("part").filter("p_size > 10").select(
        F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("molecule_id"),
        F.col("p_type").alias("selectivity_class"),
    )
    joined = op.lookup(t("v_activities"), known, ["molecule_id"], {"selectivity_class": "unknown"})
    return joined.select("molecule_name", "target_alias", "standard_value", "selectivity_class")


@query("j05_lookup_or_key", """
SELECT CAST(l_partkey AS VARCHAR) AS pathway_id, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS pathway_name
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey""")
def _(t):
    names = t("part").filter("p_size < 25").select(
        F.col("p_partkey").cast("string").alias("pathway_id"), F.col("p_name").alias("pathway_name")
    )
    links = t("lineitem").select(F.col("l_partkey").cast("string").alias("pathway_id"))
    return op.lookup_or_key(links, names, "pathway_id", "pathway_name")


@query("j06_annotate_by_name", """
WITH a AS (SELECT lower(p_name) AS k, arg_max(p_type, p_partkey) AS annotation FROM part WHERE p_size > 3 GROUP BY 1)
SELECT drug, cell_line_id, cluster, coalesce(annotation, '') AS annotation, count(*) AS n
FROM v_drug_cells LEFT JOIN a ON lower(drug) = k GROUP BY ALL""")
def _(t):
    annotations = t("part").filter("p_size > 3").select(
        F.upper("p_name").alias("compound_label"), F.col("p_type").alias("mechanism"), "p_partkey"
    )
    annotated = op.annotate_by_name(t("v_drug_cells"), annotations, "drug", [F.col("p_partkey")])
    return annotated.groupBy("drug", "cell_line_id", "cluster", "annotation").agg(F.count(F.lit(1)).alias("n"))


@query("j07_flag_member", """
SELECT p_partkey, p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) AS is_panel_gene FROM part""")
def _(t):
    parts = t("part")
    panel = parts.filter("p_size = 50").select("p_brand")
    return op.flag_member(parts, panel, "p_brand", "is_panel_gene").select("p_partkey", "is_panel_gene")


@query("j08_not_loaded", """
SELECT DISTINCT screen_name FROM v_screens
WHERE screen_name NOT IN (SELECT screen_name FROM v_screens WHERE phenotype_name IN ('5-LOW', '1-URGENT'))""")
def _(t):
    screens = t("v_screens")
    loaded = screens.filter("phenotype_name IN ('5-LOW', '1-URGENT')")
    return op.not_loaded(screens, loaded, "screen_name").select("screen_name").distinct()


@query("j09_not_among_null_safe", """
SELECT event_id, disease FROM v_records r WHERE source_key <> 'click'
  AND NOT EXISTS (SELECT 1 FROM v_records p WHERE p.source_key = 'click' AND p.gene_symbol = 'GENE1' AND p.disease IS NOT DISTINCT FROM r.disease)""")
def _(t):
    rows = t("v_records").select("event_id", "source_key", "gene_symbol", "disease")
    seen = rows.filter("source_key = 'click' AND gene_symbol = 'GENE1'")
    return op.not_among(rows.filter("source_key <> 'click'"), seen, "disease").select("event_id", "disease")


@query("j10_name_set_counts", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'),
     b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right,
       (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_union""")
def _(t):
    items = t("lineitem")
    a = items.filter("l_returnflag = 'A'").select("l_partkey")
    return op.name_set_counts(a, items.filter("l_returnflag = 'R'").select("l_partkey"), "l_partkey")


def candidates(t):
    """Search hits per brand: some are named after it, some are of the preferred kind."""
    return t("part").select(
        F.col("p_brand").alias("query"),
        F.col("p_partkey").alias("rank"),
        F.concat(F.lit("ID"), F.col("p_partkey").cast("string")).alias("candidate_id"),
        F.when(F.expr("p_size % 5 = 2 AND p_brand <= 'Brand#18'"), F.lower("p_brand")).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_type") == "ECONOMY", "target").otherwise("disease").alias("entity"),
    )


CANDIDATE_SQL = """
WITH c AS (SELECT p_brand AS query, p_partkey AS rank, 'ID' || CAST(p_partkey AS VARCHAR) AS candidate_id,
  CASE WHEN p_size % 5 = 2 AND p_brand <= 'Brand#18' THEN lower(p_brand) ELSE p_name END AS name,
  CASE WHEN p_type = 'ECONOMY' THEN 'target' ELSE 'disease' END AS entity FROM part)
"""


@query("j11_resolve", CANDIDATE_SQL + """
SELECT query, rank, candidate_id, name, entity, match FROM (
  SELECT *, CASE WHEN upper(name) = upper(query) THEN 'exact' WHEN entity = 'target' THEN 'preferred' ELSE 'first' END AS match,
    row_number() OVER (PARTITION BY query ORDER BY CASE WHEN upper(name) = upper(query) THEN 0 WHEN entity = 'target' THEN 1 ELSE 2 END, rank) AS rn
  FROM c) WHERE rn = 1""")
def _(t):
    return op.resolve(candidates(t))


@query("j11_resolve_strict", CANDIDATE_SQL + """
SELECT query, rank, candidate_id, name, entity, 'exact' AS match FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS rn FROM c) WHERE rn = 1 AND upper(name) = upper(query)""")
def _(t):
    return op.resolve(candidates(t), strict=True)


@query("j12_concat", """
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def _(t):
    customers = t("customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    suppliers = t("supplier").selectExpr("s_suppkey AS key", "s_acctbal AS balance", "s_name AS name")
    return op.concat([customers, suppliers])


@query("j03_salted_lookup", """
SELECT l_orderkey, l_linenumber, l_extendedprice, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    facts = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_partkey").alias("p_partkey"))
    return op.salted(facts, t("part").select("p_partkey", "p_brand"), ["p_partkey"]).drop("p_partkey")
