"""Source-record queries with their checking SQL."""

from pyspark.sql import functions as F

from ..operators import records as op
from ..plans import gene_profile
from ..session import scratch_path
from . import query

AREA = "coalesce(payload->>'$.disease.therapeuticAreas[0].name', payload->>'$.therapeuticAreas[0].name')"
SCORE = "CAST(payload->>'$.score' AS DOUBLE)"


def num(path, kind="DOUBLE"):
    return f"CAST(payload->>'$.{path}' AS {kind})"


def src(t, key):
    return op.of_source(t("v_sources"), key)


GENE7 = "upper(gene_symbol) = 'GENE7'"


@query("q17a_associations", f"""
SELECT disease, {SCORE} AS association_score, {AREA} AS therapeutic_area FROM v_sources
WHERE source_key = 'opentargets' AND {GENE7} ORDER BY association_score DESC NULLS LAST, 1, 2, 3 LIMIT 20""")
def _(t):
    return op.associations(src(t, "opentargets"), "gene7")


VARIANT_SQL = f"""title, payload->>'$.clinical_significance' AS clinical_significance, payload->>'$.hgvsp' AS protein_change,
  payload->>'$.major_consequence' AS consequence, {num('pos', 'INT')} AS position, {num('gnomad.exome.ac', 'INT')} AS exome_ac,
  {num('gnomad.exome.an', 'INT')} AS exome_an, {num('gold_stars', 'INT')} AS review_stars"""


@query("q17b_variants", f"""
SELECT {VARIANT_SQL} FROM v_sources WHERE source_key = 'gnomad' AND {GENE7} AND title NOT LIKE '%Constraint%'
ORDER BY review_stars DESC NULLS LAST, 1, 2, 3, 4, 5, 6, 7 LIMIT 50""")
def _(t):
    return op.reviewed_variants(src(t, "gnomad"), "Gene7")


CONSTRAINT_SQL = ", ".join(
    f"{num('constraint.' + n, 'INT' if n.startswith('obs') else 'DOUBLE')} AS {n}"
    for n in ("pLI", "oe_lof", "oe_lof_upper", "oe_mis", "mis_z", "lof_z", "obs_lof", "exp_lof", "obs_mis", "exp_mis")
)


@query("q17c_constraint", f"""
SELECT {CONSTRAINT_SQL}, payload->>'$.gene_name' AS full_gene_name FROM v_sources
WHERE source_key = 'gnomad' AND {GENE7} AND title LIKE '%Constraint%' ORDER BY ALL LIMIT 1""")
def _(t):
    return op.constraint_row(src(t, "gnomad"), "GENE7")


@query("q17d_pathways", f"""
SELECT title, summary, payload->>'$.pathway_id' AS pathway_id, payload->>'$.pathway_name' AS pathway_name
FROM v_sources WHERE source_key = 'kegg' AND {GENE7}""")
def _(t):
    return op.pathways(src(t, "kegg"), "GENE7")


@query("q17e_mutations", f"""
SELECT title, disease, summary, payload->>'$.mutation_type' AS mutation_type, payload->>'$.protein_change' AS protein_change,
       payload->>'$.cancer_study' AS cancer_study
FROM v_sources WHERE source_key = 'cbioportal' AND {GENE7} ORDER BY ALL LIMIT 20""")
def _(t):
    return op.mutations(src(t, "cbioportal"), "GENE7")


@query("q17e_proteins", f"""
SELECT title, summary, payload->>'$.protein_name' AS protein_name, payload->>'$.function' AS function_desc,
       coalesce(payload->>'$.subcellular_location', payload->>'$.locations[0]') AS location
FROM v_sources WHERE source_key = 'uniprot' AND {GENE7} ORDER BY ALL LIMIT 5""")
def _(t):
    return op.proteins(src(t, "uniprot"), "GENE7")


@query("q17e_tests", f"""
SELECT title, summary, disease, payload->>'$.test_type' AS test_type,
       coalesce(payload->>'$.lab_name', payload->>'$.offerer') AS lab_name
FROM v_sources WHERE source_key = 'ncbi_gtr' AND {GENE7} ORDER BY ALL LIMIT 20""")
def _(t):
    return op.tests(src(t, "ncbi_gtr"), "GENE7")


SECTION_SQL = """CASE WHEN source_key = 'opentargets' THEN 'associations'
  WHEN source_key = 'gnomad' AND title NOT LIKE '%Constraint%' THEN 'variants'
  WHEN source_key = 'gnomad' AND title LIKE '%Constraint%' THEN 'constraint'
  WHEN source_key = 'kegg' THEN 'pathways' WHEN source_key = 'cbioportal' THEN 'mutations'
  WHEN source_key = 'uniprot' THEN 'proteins' WHEN source_key = 'ncbi_gtr' THEN 'tests' END"""

CAP_SQL = """CASE section WHEN 'associations' THEN 20 WHEN 'variants' THEN 50 WHEN 'constraint' THEN 1
  WHEN 'mutations' THEN 20 WHEN 'proteins' THEN 5 WHEN 'tests' THEN 20 ELSE 2147483647 END"""

RANKED_SQL = f"""
tagged AS (SELECT upper(gene_symbol) AS gene, {SECTION_SQL} AS section, record_id, title, disease, summary,
    {SCORE} AS s, {num('gold_stars', 'INT')} AS stars FROM v_sources),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gene, section ORDER BY
    CASE section WHEN 'associations' THEN s WHEN 'variants' THEN stars END DESC NULLS LAST,
    record_id, title, disease, summary, s, stars) AS rank FROM tagged WHERE section IS NOT NULL)"""


@query("q17_gene_profile_sections", f"""
WITH {RANKED_SQL}
SELECT gene, section, record_id, title, disease, summary,
       CAST(CASE WHEN section <> 'pathways' THEN rank END AS INTEGER) AS rank
FROM ranked WHERE rank <= {CAP_SQL}""")
def _(t):
    return gene_profile.section_rows(t("v_sources"))


def coverage_sql(n):
    names = gene_profile.COUNTED
    columns = ", ".join(f"CAST(coalesce(max(CASE WHEN section = '{s}' THEN n END), 0) AS BIGINT) AS n_{s}" for s in names)
    return f"""
WITH per AS (SELECT gene, section, {n} AS n FROM (SELECT upper(gene_symbol) AS gene, {SECTION_SQL} AS section FROM v_sources)
    WHERE section IN {names} GROUP BY gene, section)
SELECT gene, {columns}, count(*) AS total_sources_with_data, CAST(sum(n) AS BIGINT) AS total_records FROM per GROUP BY gene"""


@query("q17f_coverage_capped", coverage_sql(f"least(count(*), {CAP_SQL})"))
def _(t):
    return gene_profile.coverage(t("v_sources"))


@query("q17f_coverage_totals", coverage_sql("count(*)"))
def _(t):
    return gene_profile.coverage(t("v_sources"), capped=False)


# Every field of every section, as one text per entry; missing fields show as '~'.
PROFILE_FIELDS = {
    "associations": {"disease": "disease", "association_score": SCORE, "therapeutic_area": AREA},
    "variants": {
        "title": "title", "clinical_significance": "payload->>'$.clinical_significance'", "protein_change": "payload->>'$.hgvsp'",
        "consequence": "payload->>'$.major_consequence'", "position": num("pos", "INT"), "exome_ac": num("gnomad.exome.ac", "INT"),
        "exome_an": num("gnomad.exome.an", "INT"), "review_stars": num("gold_stars", "INT"),
    },
    "constraint": {
        **{n: num("constraint." + n, "INT" if n.startswith("obs") else "DOUBLE") for n in op.V.CONSTRAINT_FIELDS},
        "full_gene_name": "payload->>'$.gene_name'",
    },
    "pathways": {"title": "title", "summary": "summary", "pathway_id": "payload->>'$.pathway_id'", "pathway_name": "payload->>'$.pathway_name'"},
    "mutations": {
        "title": "title", "disease": "disease", "summary": "summary", "mutation_type": "payload->>'$.mutation_type'",
        "protein_change": "payload->>'$.protein_change'", "cancer_study": "payload->>'$.cancer_study'",
    },
    "proteins": {
        "title": "title", "summary": "summary", "protein_name": "payload->>'$.protein_name'", "function_desc": "payload->>'$.function'",
        "location": "coalesce(payload->>'$.subcellular_location', payload->>'$.locations[0]')",
    },
    "tests": {
        "title": "title", "summary": "summary", "disease": "disease", "test_type": "payload->>'$.test_type'",
        "lab_name": "coalesce(payload->>'$.lab_name', payload->>'$.labname', payload->>'$.offerer')",
    },
}
REAL = {"association_score", "pLI", "oe_lof", "oe_lof_upper", "oe_mis", "mis_z", "lof_z", "exp_lof", "exp_mis"}


def entry_sql(section):
    shown = lambda name, e: f"CAST(CAST(round(({e}) * 1000) AS BIGINT) AS VARCHAR)" if name in REAL else f"CAST({e} AS VARCHAR)"
    parts = [f"coalesce({shown(name, e)}, '~')" for name, e in PROFILE_FIELDS[section].items()]
    return f"concat_ws('|', record_id, {', '.join(parts)})"


PROFILE_LISTS = ", ".join(
    f"string_agg({entry_sql(s)}, chr(10) ORDER BY {'title NULLS FIRST, ' + entry_sql(s) if s == 'pathways' else 'rank'}) FILTER (section = '{s}') AS {s}"
    for s in PROFILE_FIELDS
)


@query("q17_gene_profile", f"""
WITH tagged AS (SELECT upper(gene_symbol) AS gene, {SECTION_SQL} AS section, record_id, title, disease, summary, payload,
    {SCORE} AS s, {num('gold_stars', 'INT')} AS stars FROM v_sources),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gene, section ORDER BY
    CASE section WHEN 'associations' THEN s WHEN 'variants' THEN stars END DESC NULLS LAST,
    record_id, title, disease, summary, s, stars) AS rank FROM tagged WHERE section IS NOT NULL)
SELECT gene, {PROFILE_LISTS} FROM ranked WHERE rank <= {CAP_SQL} GROUP BY gene""")
def _(t):
    def entry(section):
        def text(e):
            def one(name):
                value = F.round(e[name] * 1000).cast("bigint") if name in REAL else e[name]
                return F.coalesce(value.cast("string"), F.lit("~"))

            return F.concat_ws("|", e["record_id"], *[one(name) for name in PROFILE_FIELDS[section]])

        return F.nullif(F.array_join(F.transform(section, text), "\n"), F.lit("")).alias(section)

    return gene_profile.profile(t("v_sources")).select("gene", *[entry(s) for s in PROFILE_FIELDS])


LANDSCAPE = f"gene_symbol, disease, {SCORE} AS score, {AREA} AS therapeutic_area"


@query("q18_disease_landscape", f"""
SELECT {LANDSCAPE} FROM v_sources WHERE source_key = 'opentargets' AND contains(lower(disease), 'disease 1')
ORDER BY score DESC NULLS LAST, 1, 2, 3, 4 LIMIT 75""")
def _(t):
    return op.disease_landscape(src(t, "opentargets"), "DISEASE 1", limit=75)


@query("q18_disease_landscape_per_gene", f"""
SELECT gene_symbol, disease, score, therapeutic_area FROM (
  SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY score DESC NULLS LAST, disease, therapeutic_area) AS rn
  FROM (SELECT {LANDSCAPE} FROM v_sources WHERE source_key = 'opentargets')) WHERE rn <= 15""")
def _(t):
    return op.disease_landscape_per_gene(src(t, "opentargets"))


@query("q19_variant_counts", """
SELECT gene_symbol, payload->>'$.clinical_significance' AS clinical_significance, count(*) AS variant_count
FROM v_sources WHERE source_key = 'gnomad' AND title NOT LIKE '%Constraint%' GROUP BY 1, 2""")
def _(t):
    return op.variant_counts(src(t, "gnomad"))


@query("q19_variant_counts_all_records", """
SELECT gene_symbol, payload->>'$.clinical_significance' AS clinical_significance, count(*) AS variant_count
FROM v_records WHERE title NOT LIKE '%Constraint%' GROUP BY 1, 2""")
def _(t):
    return op.variant_counts(t("v_records"))


@query("q19_constraint_table", f"""
SELECT gene_symbol, {num('constraint.pLI')} AS pLI, {num('constraint.oe_lof')} AS oe_lof,
       {num('constraint.oe_lof_upper')} AS oe_lof_upper, {num('constraint.mis_z')} AS mis_z, {num('constraint.lof_z')} AS lof_z
FROM v_sources WHERE source_key = 'gnomad' AND title LIKE '%Constraint%'""")
def _(t):
    return op.constraint_table(src(t, "gnomad"))


@query("q20_constraint_scores", f"""
SELECT gene_symbol, title, {num('constraint.pLI')} AS pLI, {num('constraint.oe_lof_upper')} AS LOEUF,
       {num('constraint.mis_z')} AS mis_z, {num('constraint.obs_lof', 'INT')} AS obs_lof, {num('constraint.exp_lof')} AS exp_lof
FROM v_sources WHERE source_key = 'gnomad' AND title LIKE '%Constraint%'
ORDER BY pLI DESC NULLS LAST, 1, 2, 3, 4, 5, 6, 7 LIMIT 20""")
def _(t):
    return op.constraint_scores(src(t, "gnomad"))


@query("q21_titled_variants", """
SELECT gene_symbol, title FROM v_sources WHERE source_key = 'gnomad' AND title NOT LIKE '%Constraint%'
  AND upper(gene_symbol) = 'GENE3' AND contains(lower(title), 'click') ORDER BY 1, 2 LIMIT 20""")
def _(t):
    return op.titled_variants(src(t, "gnomad"), "gene3", "CLICK")


@query("q22_target_associations", """
SELECT gene_symbol, disease, title, summary FROM v_sources WHERE source_key = 'opentargets' AND disease IS NOT NULL
  AND upper(gene_symbol) = 'GENE5' AND contains(lower(disease), 'disease') ORDER BY title DESC NULLS LAST, 1, 2, 4 LIMIT 20""")
def _(t):
    return op.target_associations(src(t, "opentargets"), "gene5", "Disease")


@query("q22_target_associations_by_score", f"""
SELECT gene_symbol, disease, title, summary, {SCORE} AS score FROM v_sources WHERE source_key = 'opentargets'
  AND disease IS NOT NULL ORDER BY score DESC NULLS LAST, 1, 2, 3, 4 LIMIT 20""")
def _(t):
    return op.target_associations(src(t, "opentargets"), by_score=True)


LISTED = "SELECT gene_symbol, title, summary FROM v_sources WHERE source_key = '{}' AND {} ORDER BY 1, 2, 3 LIMIT {}"


@query("q23_tractability", LISTED.format("opentargets", "title LIKE '%Tractability%'", 20))
def _(t):
    return op.tractability(src(t, "opentargets"))


@query("q24_clinical_evidence", """
SELECT gene_symbol, disease, drug, title, summary FROM v_sources WHERE source_key = 'civic'
  AND upper(gene_symbol) = 'GENE2' AND contains(lower(disease), 'disease 3') ORDER BY 1, 2, 3, 4, 5 LIMIT 20""")
def _(t):
    return op.clinical_evidence(src(t, "civic"), "gene2", "Disease 3")


@query("q25_cancer_mutations", """
SELECT gene_symbol, disease, title, summary FROM v_sources WHERE source_key = 'cbioportal'
  AND contains(lower(disease), 'disease 2') ORDER BY 1, 2, 3, 4 LIMIT 20""")
def _(t):
    return op.cancer_mutations(src(t, "cbioportal"), cancer_type="DISEASE 2")


@query("q26_genetic_tests", LISTED.format("ncbi_gtr", "upper(gene_symbol) = 'GENE4'", 20))
def _(t):
    return op.titled(src(t, "ncbi_gtr"), "GENE4")


@query("q27_protein_expression", LISTED.format("human_protein_atlas", "contains(lower(title), 'tissue 1')", 20))
def _(t):
    return op.titled(src(t, "human_protein_atlas"), title_text="Tissue 1")


@query("q28_phenotype_associations", """
SELECT gene_symbol, disease, title, summary FROM v_sources WHERE source_key = 'monarch'
  AND upper(gene_symbol) = 'GENE6' AND (contains(lower(disease), 'disease 1') OR contains(lower(title), 'disease 1'))
ORDER BY 1, 2, 3, 4 LIMIT 20""")
def _(t):
    return op.phenotype_associations(src(t, "monarch"), "GENE6", "Disease 1")


@query("q29_protein_function", LISTED.format("uniprot", "upper(gene_symbol) = 'GENE8'", 10))
def _(t):
    return op.titled(src(t, "uniprot"), "GENE8", limit=10)


@query("q30_reactome_pathways", LISTED.format("reactome", "upper(gene_symbol) = 'GENE9' AND contains(lower(title), 'view')", 20))
def _(t):
    return op.titled(src(t, "reactome"), "GENE9", "VIEW")


@query("q31_kegg_pathways", LISTED.format("kegg", "contains(lower(title), 'record')", 20))
def _(t):
    return op.titled(src(t, "kegg"), title_text="record")


SEARCHED = "(" + " OR ".join(f"contains(lower({c}), 'disease 2')" for c in op.SEARCH_COLUMNS) + ")"


@query("q32_search_source", f"""
SELECT record_id, gene_symbol, disease, drug, title, summary, {SCORE} AS score, source_updated_at FROM v_sources
WHERE source_key = 'opentargets' AND {SEARCHED.replace('disease 2', 'disease 1')} AND contains(lower(drug), 'drug 1')
ORDER BY source_updated_at DESC NULLS LAST, 1, 2, 3, 4, 5, 6 LIMIT 20""")
def _(t):
    found = op.search(t("v_sources"), "opentargets", "Disease 1", drug="Drug 1")
    return found.withColumn("score", op.score()).drop("payload")


@query("q32_search_payload_field", f"""
SELECT record_id, gene_symbol, disease, drug, title, summary, source_updated_at FROM v_sources
WHERE source_key = 'kegg' AND {SEARCHED} AND contains(lower(payload->>'$.pathway_id'), '1') AND contains(lower(gene_symbol), 'gene1')
ORDER BY source_updated_at DESC NULLS LAST, 1, 2, 3, 4, 5, 6 LIMIT 500""")
def _(t):
    return op.search(t("v_sources"), "kegg", "disease 2", limit=500, pathway_id="1", gene="GENE1").drop("payload")


@query("q32_search_all_sources", f"""
SELECT source_key, record_id, gene_symbol, disease, drug, title, summary, source_updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY source_updated_at DESC NULLS LAST, record_id, gene_symbol,
    disease, drug, title, summary) AS rn FROM v_sources WHERE {SEARCHED}) WHERE rn <= 10""")
def _(t):
    from ..sources import registry

    keys = [s.key for s in registry.SOURCES]
    return op.search_sources(t("v_sources"), keys, "disease 2", 10).drop("payload")


@query("q32_search_indexed", f"""
SELECT source_key, record_id, gene_symbol, disease, drug, title, summary, source_updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY source_updated_at DESC NULLS LAST, record_id, gene_symbol,
    disease, drug, title, summary) AS rn FROM v_sources WHERE {SEARCHED}) WHERE rn <= 10""")
def _(t):
    """The same search through an index of trigrams over all sources."""
    from ..plans import search_index
    from ..sources import registry

    path = scratch_path(t.spark, "trigrams")
    search_index.build(t("v_sources"), path)
    index = search_index.Index(t.spark, path)
    return search_index.search_sources(t("v_sources"), index, [s.key for s in registry.SOURCES], "disease 2", 10).drop("payload")


@query("q37_query_history", """
SELECT query_id, timestamp, user_email, query_text FROM (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS timestamp FROM v_query_log)
ORDER BY timestamp DESC, query_id, user_email, query_text LIMIT 50""")
def _(t):
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    return op.query_history(t("v_query_log").withColumn("timestamp", start))


@query("q38_source_coverage", """
SELECT source_key, gene_symbol, count(*) AS n_records, count(DISTINCT disease) AS n_diseases, count(DISTINCT drug) AS n_drugs
FROM v_sources GROUP BY source_key, gene_symbol""")
def _(t):
    return op.source_coverage(t("v_sources"))


@query("q39_mutation_landscape", f"""
WITH m AS (SELECT gene_symbol, {num('sample_count', 'INT')} AS n, payload->>'$.mutation_type' AS mt,
             payload->>'$.protein_change' AS pc FROM v_sources WHERE source_key = 'cbioportal'),
 r AS (SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY n DESC NULLS LAST, mt DESC, pc DESC) AS rn FROM m)
SELECT gene_symbol, count(*) AS unique_mutations, CAST(sum(n) AS BIGINT) AS total_samples_mutated,
       max(CASE WHEN rn = 1 THEN mt END) AS top_mutation_type, max(CASE WHEN rn = 1 THEN pc END) AS top_protein_change
FROM r GROUP BY gene_symbol""")
def _(t):
    return op.mutation_landscape(src(t, "cbioportal"))


@query("q40_high_score_pairs", f"""
SELECT {LANDSCAPE} FROM v_sources WHERE source_key = 'opentargets' AND {SCORE} >= 0.5
ORDER BY score DESC, 1, 2, 3, 4 LIMIT 30""")
def _(t):
    return op.high_score_pairs(src(t, "opentargets"))
