"""Validation projections, batched panel forms and scalar functions with their checking SQL."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import payload as V
from ..functions import predicates as P
from ..functions import ranking as R
from ..functions import scalars as S
from ..operators import pharmacology, records
from . import query
from .records import AREA, SCORE, num, src


@query("q41_top_drugs", """
SELECT drug, moa, count(*) AS n_cells, count(DISTINCT cell_line_id) AS n_cell_lines FROM v_drug_cells WHERE drug IS NOT NULL
GROUP BY drug, moa ORDER BY n_cells DESC, 1, 2, 4 LIMIT 20""")
def _(t):
    return pharmacology.list_drugs(t("v_drug_cells"), limit=20)


@query("q41_effect_check", """
SELECT de_gene, group_name, round(log2fc, 3) AS log2fc, round(pvalue_adj, 6) AS padj, n_cells_ko, n_cells_ctrl FROM (
  SELECT *, abs(log2fc) AS a FROM v_diff_expr WHERE gene_target = 'Brand#8' AND pvalue_adj < 0.05E0)
ORDER BY a DESC, de_gene, group_name, round(log2fc, 3), padj, n_cells_ko, n_cells_ctrl LIMIT 20""")
def _(t):
    hits = t("v_diff_expr").filter((F.col("gene_target") == "Brand#8") & (F.col("pvalue_adj") < 0.05))
    shown = hits.select(
        "de_gene", "group_name", F.round("log2fc", 3).alias("log2fc"), F.round("pvalue_adj", 6).alias("padj"),
        "n_cells_ko", "n_cells_ctrl", F.abs("log2fc").alias("_size"),
    )
    return R.top_k(shown, 20, F.col("_size").desc()).drop("_size")


@query("q41_risk_gene_check", """
SELECT gene, chromosome, fdr, ASD72 FROM (SELECT *, TRY_CAST(nullif(FDR_TADA_ASD, 'nan') AS DOUBLE) AS fdr FROM v_ndd_genes)
WHERE fdr IS NOT NULL ORDER BY fdr, gene, chromosome, ASD72 LIMIT 20""")
def _(t):
    rows = t("v_ndd_genes").select("gene", "chromosome", S.parse_double("FDR_TADA_ASD").alias("fdr"), "ASD72")
    return R.top_k(rows.filter("fdr IS NOT NULL"), 20, F.col("fdr").asc())


@query("q41_association_check", f"""
SELECT gene_symbol, disease, {SCORE} AS ot_score, {AREA} AS therapeutic_area FROM v_sources
WHERE source_key = 'opentargets' AND upper(gene_symbol) = 'GENE3' ORDER BY ot_score DESC NULLS LAST, 1, 2, 3, 4 LIMIT 20""")
def _(t):
    frame = src(t, "opentargets")
    rows = frame.filter(records.is_gene(frame, "gene3")).select(
        "gene_symbol", "disease", records.score().alias("ot_score"), records.therapeutic_area().alias("therapeutic_area")
    )
    return R.top_k(rows, 20, F.col("ot_score").desc_nulls_last())


@query("q41_genetic_test_check", """
SELECT gene_symbol, title, payload->>'$.test_type' AS test_type, coalesce(payload->>'$.lab_name', payload->>'$.offerer') AS lab_name,
  left(disease, 100) AS condition FROM v_sources WHERE source_key = 'ncbi_gtr' AND upper(gene_symbol) = 'GENE3'
ORDER BY title NULLS FIRST, 1, 2, 3, 4, 5 LIMIT 15""")
def _(t):
    frame = src(t, "ncbi_gtr")
    rows = frame.filter(records.is_gene(frame, "GENE3")).select(
        "gene_symbol", "title", V.field("test_type").alias("test_type"), V.first_field(V.LAB_PATHS).alias("lab_name"),
        F.left("disease", F.lit(100)).alias("condition"),
    )
    return R.top_k(rows, 15, F.col("title").asc_nulls_first())


@query("q41_protein_check", """
SELECT gene_symbol, payload->>'$.protein_name' AS protein, left(payload->>'$.function', 120) AS function_snippet,
  coalesce(payload->>'$.subcellular_location', payload->>'$.locations[0]') AS location FROM v_sources WHERE source_key = 'uniprot'""")
def _(t):
    return src(t, "uniprot").select(
        "gene_symbol", V.field("protein_name").alias("protein"), F.left(V.field("function"), F.lit(120)).alias("function_snippet"),
        V.first_field(V.LOCATION_PATHS).alias("location"),
    )


@query("q41_pathway_check", """
SELECT gene_symbol, payload->>'$.pathway_id' AS pathway_id, payload->>'$.pathway_name' AS pathway_name FROM v_sources
WHERE source_key = 'kegg' AND upper(gene_symbol) = 'GENE3'""")
def _(t):
    frame = src(t, "kegg")
    return frame.filter(records.is_gene(frame, "GENE3")).select(
        "gene_symbol", V.field("pathway_id").alias("pathway_id"), V.field("pathway_name").alias("pathway_name")
    )


@query("q20_constraint_of_panel", f"""
SELECT gene_symbol, {num('constraint.pLI')} AS pLI, {num('constraint.oe_lof')} AS oe_lof, {num('constraint.oe_lof_upper')} AS oe_lof_upper,
  {num('constraint.mis_z')} AS mis_z, {num('constraint.lof_z')} AS lof_z
FROM v_sources WHERE source_key = 'gnomad' AND title LIKE '%Constraint%' AND upper(gene_symbol) IN ('GENE1', 'GENE2', 'GENE3')""")
def _(t):
    frame = src(t, "gnomad")
    return records.constraint_table(frame.filter(records.gene_key(frame).isin("GENE1", "GENE2", "GENE3")))


@query("f01_equality", "SELECT count(*) AS n FROM v_screens WHERE upper(gene) = 'NATION_7' AND cell_type = 'BUILDING'")
def _(t):
    rows = P.where(t("v_screens"), P.equals_ignore_case("gene", "nation_7"), P.equals("cell_type", "BUILDING"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("f02_substring", """
SELECT count(*) AS n_any_case, CAST(count_if(contains(text, 'the')) AS BIGINT) AS n_exact FROM documents WHERE contains(lower(text), 'the')""")
def _(t):
    rows = P.where(t("documents"), P.has_text_ignore_case("text", "THE"))
    return rows.agg(F.count(F.lit(1)).alias("n_any_case"), F.count_if(P.has_text("text", "the")).alias("n_exact"))


@query("f03_any_column", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'en') OR contains(lower(lang), 'en') OR contains(lower(source), 'en')""")
def _(t):
    return P.where(t("documents"), P.any_has_text(["text", "lang", "source"], "EN")).select("doc_id")


@query("f05_threshold_flag_in", """
SELECT count(*) AS n FROM v_signatures WHERE abs(zscore) >= 1 AND is_neuronal AND moa IN ('ECONOMY', 'PROMO')""")
def _(t):
    rows = P.where(t("v_signatures"), F.abs("zscore") >= 1, F.col("is_neuronal"), F.col("moa").isin("ECONOMY", "PROMO"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("f06_dynamic_filters", "SELECT count(*) AS n FROM v_activities WHERE standard_type = 'Ki'")
def _(t):
    """Filters that are not given drop out of the conjunction."""
    rows = P.where(t("v_activities"), P.has_text("molecule_name", ""), P.equals("standard_type", "Ki"), P.any_of([]))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("f07_arithmetic", """
SELECT l_orderkey, l_linenumber, least(1E0, greatest(0E0, (l_discount * 50 - 1) / 4)) AS clamped, round(-log10(greatest(l_tax, 1e-300)), 6) AS neg_log,
  CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio FROM lineitem""")
def _(t):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", S.clamp((F.col("l_discount") * 50 - 1) / 4, 0.0, 1.0).alias("clamped"),
        F.round(S.neg_log10("l_tax"), 6).alias("neg_log"), S.safe_ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio"),
    )


@query("f09_extract_and_split", r"""
SELECT page_id, nullif(regexp_extract(url, '//([^/]+)', 1), '') AS host, split_part(url, '/', -1) AS tail FROM pages""")
def _(t):
    return t("pages").select(
        "page_id", S.first_match("url", "//([^/]+)").alias("host"), F.split_part("url", F.lit("/"), F.lit(-1)).alias("tail")
    )


@query("f10_defaults", """
SELECT event_id, coalesce(nullif(disease, ''), nullif(title, ''), 'Unknown') AS label, coalesce(nullif(event_id % 4, 0), 9) AS number FROM v_records""")
def _(t):
    return t("v_records").select(
        "event_id", F.coalesce(F.nullif("disease", F.lit("")), S.or_default("title", "Unknown")).alias("label"),
        S.or_default(F.col("event_id") % 4, 9).alias("number"),
    )


@query("f11_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"event_type":"' || event_type || '"}' AS built FROM events""")
def _(t):
    return t("events").select(
        "event_id", F.try_variant_get(F.parse_json("props"), F.lit("$.k"), "int").alias("k"), F.to_json(F.struct("event_type")).alias("built")
    )


@query("f12_arrays", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(a))[1:5], '|') AS first_sorted, array_to_string(a[1:3], ' ') AS first_three,
  coalesce(a[7], 'none') AS seventh FROM w""")
def _(t):
    words = F.split("text", " ")
    return t("documents").select(
        "doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 5), "|").alias("first_sorted"),
        F.array_join(F.slice(words, 1, 3), " ").alias("first_three"), F.coalesce(F.get(words, 6), F.lit("none")).alias("seventh"),
    )


@query("f13_maps", """
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (
  SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 5 GROUP BY 1""")
def _(t):
    counts = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    frequent = F.array_sort(F.map_entries(F.map_filter("m", lambda _, n: n > 5)))
    text = F.array_join(F.transform(frequent, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return maps.select("user_id", text.alias("counts")).filter(F.col("counts") != "")


@query("f15_case_classes", """
SELECT CASE WHEN log2fc > 1 THEN 'up' WHEN log2fc < -1 THEN 'down' ELSE 'flat' END AS direction, count(*) AS n FROM v_diff_expr GROUP BY 1""")
def _(t):
    direction = F.when(F.col("log2fc") > 1, "up").when(F.col("log2fc") < -1, "down").otherwise("flat")
    return t("v_diff_expr").groupBy(direction.alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("f17_order_keys", """
SELECT drug, moa, n FROM (SELECT drug, moa, count(*) AS n FROM v_drug_cells GROUP BY 1, 2)
ORDER BY drug ASC NULLS FIRST, n DESC, moa ASC NULLS LAST LIMIT 40""")
def _(t):
    counts = t("v_drug_cells").groupBy("drug", "moa").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("drug").asc_nulls_first(), F.col("n").desc(), F.col("moa").asc_nulls_last()).limit(40)


@query("f18_text_cut", """
SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS shown FROM conversations""")
def _(t):
    """Display form of a text; the stored text stays whole."""
    return t("conversations").select("conv_id", "turn", S.cut("text", 300, "...").alias("shown"))


@query("f03_reduced_or", """
SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#1' OR p_brand = 'Brand#2' OR p_size = 7""")
def _(t):
    conditions = [F.col("p_brand") == "Brand#1", F.col("p_brand") == "Brand#2", F.col("p_size") == 7]
    return t("part").filter(reduce(lambda a, b: a | b, conditions)).agg(F.count(F.lit(1)).alias("n"))
