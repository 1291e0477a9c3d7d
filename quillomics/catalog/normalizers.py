"""Document normalisers over JSON documents that Spark derives from the given tables."""

from pyspark.sql import functions as F

from ..functions import payload as V
from ..functions import scalars as S
from ..operators import aggregates, analytics
from ..plans import landing, normalize
from ..sources import files, registry
from . import query

COMMON = ["record_id", "source_key", "gene_symbol", "disease", "drug", "title", "summary"]


def docs(t, table, expression, *keep):
    """One JSON document per row of a table."""
    return t(table).selectExpr(*keep, f"to_json(named_struct({expression})) AS raw")


def shown(records, **fields):
    return records.select(*COMMON, *[V.field(path, kind).alias(name) for name, (path, kind) in fields.items()])


TARGET_DOC = """
'target', named_struct('id', concat('ENS', p_partkey), 'approvedSymbol', concat('G', p_size),
  'associatedDiseases', named_struct('rows', transform(filter(sequence(1, 2), i -> i <= p_size % 3), i -> named_struct(
     'score', (100 + (p_partkey * 7 + i) % 900) / 1000D,
     'disease', named_struct('id', concat('D', i), 'name', if((p_partkey + i) % 5 = 0, null, concat('Disease ', i)),
       'therapeuticAreas', if(p_partkey % 2 = 0, array(named_struct('id', 'T1', 'name', concat('Area ', p_size % 4)),
          named_struct('id', 'T2', 'name', 'Area X')), array()))))),
  'drugAndClinicalCandidates', named_struct('rows', if(p_partkey % 4 = 0, array(named_struct(
     'maxClinicalStage', if(p_size % 2 = 0, 'PHASE_3', null),
     'drug', named_struct('id', concat('DR', p_size), 'name', p_name, 'drugType', if(p_size % 5 = 0, null, 'Small molecule'),
        'maximumClinicalStage', if(p_size % 3 = 0, null, 'APPROVAL')),
     'diseases', array(named_struct('disease', named_struct('id', 'D1', 'name', p_type)),
        named_struct('disease', named_struct('id', 'D2', 'name', 'Other'))))), null)),
  'tractability', if(p_partkey % 3 = 0, array(
     named_struct('modality', 'SM', 'label', 'Approved', 'value', true),
     named_struct('modality', 'AB', 'label', 'Clinical', 'value', p_size % 2 = 0),
     named_struct('modality', 'SM', 'label', 'Pocket', 'value', false)), null))
"""


def target_docs(t):
    return docs(t, "part", TARGET_DOC)


@query("n02_target_records", """
WITH a AS (SELECT *, unnest(range(1, 1 + p_size % 3)) AS i FROM part),
 b AS (SELECT *, printf('%.3f', (100 + (p_partkey * 7 + i) % 900) / 1000.0) AS s,
         CASE WHEN (p_partkey + i) % 5 <> 0 THEN 'Disease ' || i END AS dis FROM a),
 d AS (SELECT *, coalesce(CASE WHEN p_size % 2 = 0 THEN 'PHASE_3' END, CASE WHEN p_size % 3 <> 0 THEN 'APPROVAL' END) AS stage
       FROM part WHERE p_partkey % 4 = 0)
SELECT 'ENS' || p_partkey || '_D' || i AS record_id, 'opentargets' AS source_key, 'G' || p_size AS gene_symbol, dis AS disease,
  CAST(NULL AS VARCHAR) AS drug, 'G' || p_size || ' ↔ ' || coalesce(dis, 'None') || ' (score: ' || s || ')' AS title,
  'OpenTargets association score ' || s || '. Therapeutic areas: ' ||
    CASE WHEN p_partkey % 2 = 0 THEN 'Area ' || (p_size % 4) || ', Area X' ELSE '' END AS summary,
  (100 + (p_partkey * 7 + i) % 900) / 1000.0E0 AS score FROM b
UNION ALL
SELECT 'ENS' || p_partkey || '_DR' || p_size, 'opentargets', 'G' || p_size, p_type, p_name,
  p_name || ' → G' || p_size || ' (Phase ' || coalesce(stage, '?') || ')',
  'Drug type: ' || CASE WHEN p_size % 5 = 0 THEN 'None' ELSE 'Small molecule' END || '. Max clinical stage: ' ||
    coalesce(stage, 'None') || '. Diseases: ' || p_type || ', Other.', NULL FROM d
UNION ALL
SELECT 'ENS' || p_partkey || '_tractability', 'opentargets', 'G' || p_size, NULL, NULL, 'G' || p_size || ' Druggability/Tractability',
  'Tractability: {"AB":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ',"SM":false}', NULL
FROM part WHERE p_partkey % 3 = 0""")
def _(t):
    return shown(normalize.target_records(target_docs(t)), score=("score", "double"))


@query("v12_modality_counts", """
SELECT 'SM' AS modality, count(*) AS n FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'AB', count(*) FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 = 0""")
def _(t):
    records = normalize.target_records(target_docs(t))
    return analytics.modality_counts(records.filter(F.col("title").contains("Tractability")))


@query("g10_labels_by_modality", """
SELECT 'ENS' || p_partkey AS target_id, CASE WHEN p_size % 2 = 0 THEN '{"AB":["Clinical"],"SM":["Approved"]}' ELSE '{"SM":["Approved"]}' END AS labels,
  '{"AB":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ',"SM":false}' AS last_values FROM part WHERE p_partkey % 3 = 0""")
def _(t):
    parsed = normalize.readable(target_docs(t), normalize.TARGET_SCHEMA)
    rows = parsed.filter(F.col("d.target.tractability").isNotNull())
    return rows.select(
        F.col("d.target.id").alias("target_id"),
        F.to_json(aggregates.labels_by_modality(F.col("d.target.tractability"))).alias("labels"),
        F.to_json(aggregates.last_by_modality(F.col("d.target.tractability"))).alias("last_values"),
    )


VARIANT_DOC = """
'gene', named_struct('symbol', concat('g', p_size), 'gene_id', concat('ENSG', p_partkey), 'chrom', cast(p_size % 23 as string),
  'start', p_partkey * 10, 'stop', p_partkey * 10 + 500, 'strand', '+', 'name', p_name,
  'gnomad_constraint', if(p_partkey % 2 = 0, named_struct('pLI', (p_size % 11) / 10D, 'oe_lof_upper', if(p_size % 4 = 0, null, p_size / 100D),
     'mis_z', if(p_size % 5 = 0, null, p_size / 8D), 'obs_lof', p_size, 'exp_lof', p_size + 0.5D), null),
  'clinvar_variants', transform(filter(sequence(1, 3), i -> i <= p_size % 4), i -> named_struct(
     'variant_id', concat('1-', p_partkey, '-', i), 'clinvar_variation_id', if(i = 2, null, concat('CV', p_partkey, i)),
     'clinical_significance', if(i = 3, null, 'Pathogenic'), 'major_consequence', 'missense_variant',
     'hgvsp', if(i = 1, 'p.A1T', ''), 'hgvsc', if(i = 2, 'c.5A>G', null), 'review_status', 'single', 'gold_stars', i,
     'in_gnomad', i = 1,
     'gnomad', named_struct('exome', if(i = 2, null, named_struct('ac', p_size % 3, 'an', 1000)),
        'genome', named_struct('ac', 1, 'an', 20000)))),
  'variants', transform(sequence(1, 3), i -> named_struct('variant_id', concat('2-', p_partkey, '-', i),
     'consequence', if(i = 1, 'stop_gained', 'synonymous_variant'), 'lof', if(i = 2, 'HC', null), 'lof_filter', if(p_size % 2 = 0, '', 'END_TRUNC'),
     'exome', named_struct('ac', p_size % 2, 'af', (p_size % 2) / 4D, 'homozygote_count', p_size,
        'populations', array(named_struct('id', 'afr', 'af', 0.25D), named_struct('id', 'nfe', 'af', 0D))),
     'genome', named_struct('ac', 7, 'af', 0.5D, 'homozygote_count', 2))))
"""


def variant_docs(t):
    return docs(t, "part", VARIANT_DOC)


@query("n03_variant_records", """
WITH c AS (SELECT *, (p_size % 11) / 10.0E0 AS pli FROM part WHERE p_partkey % 2 = 0),
 v AS (SELECT *, unnest(range(1, 1 + p_size % 4)) AS i FROM part),
 w AS (SELECT *, CASE WHEN i <> 2 AND p_size % 3 > 0 THEN (p_size % 3) / 1000.0E0 ELSE 1 / 20000.0E0 END AS af,
         CASE i WHEN 1 THEN 'p.A1T' WHEN 2 THEN 'c.5A>G' ELSE '1-' || p_partkey || '-' || i END AS nm,
         CASE WHEN i = 3 THEN 'unknown' ELSE 'Pathogenic' END AS sig FROM v),
 l AS (SELECT *, unnest([1, 2]) AS i FROM part)
SELECT 'ENSG' || p_partkey || '_constraint' AS record_id, 'gnomad' AS source_key, 'G' || p_size AS gene_symbol, CAST(NULL AS VARCHAR) AS disease, CAST(NULL AS VARCHAR) AS drug,
  'G' || p_size || ' Gene Constraint (gnomAD v4)' AS title,
  'pLI=' || printf('%.4f', pli) || ' (' || CASE WHEN pli > 0.9E0 THEN 'highly intolerant to LoF (haploinsufficient)'
      WHEN pli > 0.5E0 THEN 'moderately constrained' ELSE 'tolerant to LoF' END || '). ' ||
    CASE WHEN p_size % 4 <> 0 THEN 'LOEUF=' || printf('%.3f', p_size / 100.0E0 + 1e-9) || '. ' ELSE '' END ||
    CASE WHEN p_size % 5 <> 0 THEN 'mis_z=' || printf('%.2f', p_size / 8.0E0 + 1e-9) || '. ' ELSE '' END ||
    'obs/exp LoF: ' || p_size || '/' || printf('%.1f', p_size + 0.5E0) || '. Location: chr' || (p_size % 23) || ':' ||
    (p_partkey * 10) || '-' || (p_partkey * 10 + 500) AS summary FROM c
UNION ALL
SELECT 'ENSG' || p_partkey || '_clinvar_' || CASE WHEN i = 2 THEN '1-' || p_partkey || '-2' ELSE 'CV' || p_partkey || i END, 'gnomad',
  'G' || p_size, NULL, NULL, 'G' || p_size || ' ' || nm || ' — ' || sig,
  'ClinVar: ' || sig || ' (single, ' || i || ' stars). Consequence: missense_variant. gnomAD AF: ' || printf('%.6f', af) ||
    CASE WHEN af < 0.0001E0 THEN ' (ultra-rare)' WHEN af < 0.001E0 THEN ' (rare)' WHEN af > 0.01E0 THEN ' (common)' ELSE '' END ||
    '. In gnomAD: ' || CASE WHEN i = 1 THEN 'Yes' ELSE 'No' END FROM w
UNION ALL
SELECT 'ENSG' || p_partkey || '_plof_2-' || p_partkey || '-' || i, 'gnomad', 'G' || p_size, NULL, NULL,
  'G' || p_size || ' pLoF: 2-' || p_partkey || '-' || i || ' (' || CASE i WHEN 1 THEN 'stop_gained' ELSE 'synonymous_variant' END || ')',
  'Predicted LoF (' || CASE i WHEN 2 THEN 'HC' ELSE '' END || '): ' || CASE i WHEN 1 THEN 'stop_gained' ELSE 'synonymous_variant' END ||
    '. AF=' || CASE p_size % 2 WHEN 1 THEN '0.250000' ELSE '0.500000' END || ', AC=' || CASE p_size % 2 WHEN 1 THEN '1' ELSE '7' END ||
    ', Hom=' || (p_size + 2) || '. Filter: ' || CASE p_size % 2 WHEN 0 THEN 'PASS' ELSE 'END_TRUNC' END || '. Pops: {"afr":0.25}' FROM l""")
def _(t):
    return normalize.variant_records(variant_docs(t)).select(*COMMON)


@query("n04_frequency_and_constraint_labels", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN f <= 0 THEN '' WHEN f < 0.0001E0 THEN ' (ultra-rare)' WHEN f < 0.001E0 THEN ' (rare)' WHEN f > 0.01E0 THEN ' (common)' ELSE '' END AS af_label,
  CASE WHEN q > 0.9E0 THEN 'highly intolerant to LoF (haploinsufficient)' WHEN q > 0.5E0 THEN 'moderately constrained' ELSE 'tolerant to LoF' END AS pli_label
FROM (SELECT l_orderkey, l_linenumber, l_discount / l_extendedprice * 100 AS f, l_quantity / 50 AS q FROM lineitem)""")
def _(t):
    frequency = F.col("l_discount") / F.col("l_extendedprice") * 100
    return t("lineitem").select(
        "l_orderkey", "l_linenumber",
        normalize.frequency_label(frequency).alias("af_label"),
        normalize.pli_label(F.col("l_quantity") / 50).alias("pli_label"),
    )


@query("n01_common_record", """
SELECT CAST(event_id AS VARCHAR) AS record_id, 'pubmed' AS source_key, upper(event_type) AS gene_symbol, upper(event_type) AS gene_key,
  value AS score, true AS has_ingested_at, true AS no_version FROM events""")
def _(t):
    entry = normalize.record(F.col("event_id"), payload=F.struct(F.col("value").alias("score")), gene=F.upper("event_type"))
    records = normalize.stamp(normalize.emit(t("events"), "pubmed", entry))
    return records.select(
        "record_id", "source_key", "gene_symbol", "gene_key", V.field("score", "double").alias("score"),
        F.col("ingested_at").isNotNull().alias("has_ingested_at"), F.col("api_version").isNull().alias("no_version"),
    )


@query("n01_quarantine", """
SELECT event_id % 7 = 0 AS broken, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    raw = t("events").select(F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.col("props")).alias("raw"))
    bad = normalize.quarantine(raw, "k int").agg(F.lit(True).alias("broken"), F.count(F.lit(1)).alias("n"))
    good = normalize.readable(raw, "k int").agg(F.lit(False).alias("broken"), F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad)


FLAT_TEXT = """concat('ENTRY       hsa', p_partkey, ' Pathway\n',
  'NAME        ', p_name, ' - Homo sapiens (human)\n', if(p_size % 2 = 0, concat('DESCRIPTION ', p_type, ' first line\n            second line\n'), ''),
  'CLASS       Signaling; ', p_brand, '\nGENE        1  A\n            2  B\n')"""


@query("a07_flat_records", """
SELECT p_partkey, 'hsa' || p_partkey || ' Pathway' AS entry, p_name || ' - Homo sapiens (human)' AS name,
  CASE WHEN p_size % 2 = 0 THEN p_type || ' first line second line' END AS description, 'Signaling; ' || p_brand AS class,
  '1  A 2  B' AS gene FROM part""")
def _(t):
    rows = t("part").selectExpr("p_partkey", f"{FLAT_TEXT} AS value").withColumn("f", files.flat_fields(F.col("value")))
    return rows.select(
        "p_partkey", F.col("f")["ENTRY"].alias("entry"), F.col("f")["NAME"].alias("name"),
        F.col("f")["DESCRIPTION"].alias("description"), F.col("f")["CLASS"].alias("class"), F.col("f")["GENE"].alias("gene"),
    )


@query("n05_pathway_records", """
SELECT 'kegg_hsa' || p_partkey || '_' || upper(p_brand) AS record_id, 'kegg' AS source_key, upper(p_brand) AS gene_symbol, CAST(NULL AS VARCHAR) AS disease,
  CAST(NULL AS VARCHAR) AS drug, upper(p_brand) || ' in ' || p_name || ' (hsa' || p_partkey || ')' AS title,
  'Pathway: ' || p_name || '. Class: Signaling; ' || p_brand || '.' ||
    CASE WHEN p_size % 2 = 0 THEN ' Description: ' || p_type || ' first line second line' ELSE '' END AS summary,
  p_name AS pathway_name FROM part""")
def _(t):
    memberships = t("part").selectExpr(
        "upper(p_brand) AS gene_symbol", "concat('hsa', p_partkey) AS pathway_id", "'hsa:1' AS kegg_gene_id", f"{FLAT_TEXT} AS value"
    ).withColumn("entry", files.flat_fields(F.col("value")))
    return shown(normalize.pathway_records(memberships), pathway_name=("pathway_name", "string"))


def link_lines(t):
    return t("lineitem").selectExpr(
        "concat('hsa:', l_suppkey, '\t path:', if(l_linenumber % 2 = 0, 'hsa', 'mmu'), '0', l_partkey) AS value"
    )


@query("a06_pathway_links", """
SELECT 'hsa:' || l_suppkey AS kegg_gene_id, 'hsa0' || l_partkey AS pathway_id FROM lineitem WHERE l_linenumber % 2 = 0""")
def _(t):
    return files.pathway_links(link_lines(t))


@query("a06_gene_ids", """
SELECT 'hsa:' || p_partkey AS kegg_gene_id, unnest([upper(replace(p_name, ' ', '_')), 'ALT' || p_size]) AS gene_symbol FROM part WHERE p_size % 3 <> 0""")
def _(t):
    lines = t("part").selectExpr(
        "concat(if(p_size % 3 = 0, 'mmu:', 'hsa:'), p_partkey, '\t', replace(p_name, ' ', '_'), ',Alt', p_size, '; a protein, found') AS value"
    )
    return files.gene_ids(lines)


@query("n05_pathway_link_records", """
WITH k AS (SELECT 'G' || (l_suppkey % 7) AS gene_symbol, 'hsa0' || l_partkey AS pathway_id, count(DISTINCT l_suppkey) AS n_genes
           FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
 n AS (SELECT 'hsa0' || p_partkey AS pathway_id, p_name FROM part WHERE p_size > 10)
SELECT 'kegg_' || k.pathway_id || '_' || gene_symbol AS record_id, 'kegg' AS source_key, gene_symbol, CAST(NULL AS VARCHAR) AS disease,
  CAST(NULL AS VARCHAR) AS drug, coalesce(p_name, k.pathway_id) AS title,
  'KEGG pathway ' || k.pathway_id || ': ' || coalesce(p_name, k.pathway_id) AS summary, n_genes
FROM k LEFT JOIN n ON n.pathway_id = k.pathway_id""")
def _(t):
    links = files.pathway_links(link_lines(t)).withColumn(
        "gene_symbol", F.concat(F.lit("G"), (F.substring("kegg_gene_id", 5, 20).cast("bigint") % 7).cast("string"))
    )
    names = t("part").filter("p_size > 10").selectExpr(
        "concat('hsa0', p_partkey) AS pathway_id", "concat(p_name, ' - Homo sapiens (human)') AS pathway_name"
    )
    records = normalize.pathway_link_records(links, names)
    ids = F.from_json(F.to_json(V.field("kegg_gene_ids", "variant")), "array<string>")
    return records.select(*COMMON, F.size(ids).cast("bigint").alias("n_genes"))


def mutation_docs(t):
    """One document per gene and study; every line is a mutation."""
    rows = t("lineitem").selectExpr(
        "concat('G', l_suppkey % 5) AS gene_symbol", "concat('study_', l_partkey % 4) AS study_id",
        "named_struct('o', l_orderkey, 'l', l_linenumber, 'p', l_partkey, 's', l_extendedprice, 'mutationType', if(l_returnflag = 'N', null, l_returnflag), "
        "'mutationStatus', if(l_linestatus = 'O', 'SOMATIC', ''), 'sampleId', concat('S', l_orderkey % 200), "
        "'proteinChange', if(l_linenumber = 1, null, concat('R', l_partkey, 'H'))) AS m",
    )
    # The documents themselves stand for API responses: one per (gene, study, order).
    grouped = rows.groupBy("gene_symbol", "study_id", F.col("m.o").alias("o")).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return grouped.select(
        F.to_json(F.struct(
            "gene_symbol", "study_id", F.concat("study_id", F.lit("_mutations")).alias("profile_id"),
            F.expr("named_struct('entrezGeneId', 100, 'chromosome', '7', 'type', 'protein-coding')").alias("gene_meta"),
            F.col("ms").alias("mutations"),
        )).alias("raw")
    )


MUTATION_ROWS = """
m AS (SELECT 'G' || (l_suppkey % 5) AS gene_symbol, 'study_' || (l_partkey % 4) AS study_id,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag WHEN l_linestatus = 'O' THEN 'SOMATIC' ELSE 'Unknown' END AS mt,
  'S' || (l_orderkey % 200) AS sample_id, l_linenumber <> 1 AS named FROM lineitem)"""


@query("n06_gene_info_records", """
SELECT DISTINCT 'cbio_gene_100' AS record_id, 'cbioportal' AS source_key, 'G' || (l_suppkey % 5) AS gene_symbol, CAST(NULL AS VARCHAR) AS disease, CAST(NULL AS VARCHAR) AS drug,
  'G' || (l_suppkey % 5) || ' — cBioPortal Gene Entry' AS title, 'Entrez: 100 | Chr: 7  | Type: protein-coding' AS summary FROM lineitem""")
def _(t):
    return normalize.gene_info_records(mutation_docs(t)).select(*COMMON)


@query("g09_study_summary", f"""
WITH {MUTATION_ROWS},
 c AS (SELECT gene_symbol, study_id, mt, count(*) AS n FROM m GROUP BY 1, 2, 3),
 s AS (SELECT gene_symbol, study_id, count(*) AS n_mutations, count(DISTINCT sample_id) AS n_samples_affected, CAST(count_if(named) AS BIGINT) AS n_changes_kept FROM m GROUP BY 1, 2)
SELECT 'cbio_' || gene_symbol || '_' || study_id AS record_id, gene_symbol,
  gene_symbol || ' somatic mutations in ' || study_id || ' — ' || n_mutations || ' events, ' || n_samples_affected || ' samples' AS title,
  n_mutations, n_samples_affected, (SELECT count(*) FROM c WHERE c.gene_symbol = s.gene_symbol AND c.study_id = s.study_id) AS n_types,
  (SELECT max(n) FROM c WHERE c.gene_symbol = s.gene_symbol AND c.study_id = s.study_id) AS n_dominant,
  n_changes_kept
FROM s""")
def _(t):
    records = normalize.study_records(normalize.mutation_rows(mutation_docs(t)))
    types = F.from_json(F.to_json(V.field("mutation_types", "variant")), "map<string, bigint>")
    changes = F.from_json(F.to_json(V.field("top_protein_changes", "variant")), "array<string>")
    return records.select(
        "record_id", "gene_symbol", "title", V.field("n_mutations", "bigint").alias("n_mutations"),
        V.field("n_samples_affected", "bigint").alias("n_samples_affected"),
        F.size(types).cast("bigint").alias("n_types"), F.array_max(F.map_values(types)).alias("n_dominant"),
        F.size(changes).cast("bigint").alias("n_changes_kept"),
    )


@query("n06_rollup_records", """
WITH m AS (SELECT upper(gene_symbol) AS g, payload->>'$.mutation_type' AS mt, payload->>'$.protein_change' AS pc,
             payload->>'$.cancer_study' AS ct FROM v_sources WHERE source_key = 'cbioportal'),
 r AS (SELECT g, mt, pc, count(*) AS n, list_sort(list(DISTINCT ct)) AS cts FROM m GROUP BY 1, 2, 3),
 k AS (SELECT * FROM r)
SELECT 'cbio_' || g || '_' || mt || '_' || pc AS record_id, 'cbioportal' AS source_key, g AS gene_symbol,
  array_to_string(cts[1:3], '; ') AS disease, CAST(NULL AS VARCHAR) AS drug, pc AS title, mt || ' (' || n || ' samples, TCGA Pan-Cancer)' AS summary,
  CAST(n AS BIGINT) AS sample_count FROM k""")
def _(t):
    from .aggregates import mutation_events

    records = normalize.rollup_records(aggregates.mutation_rollup(mutation_events(t)))
    return shown(records, sample_count=("sample_count", "bigint"))


PROTEIN_DOC = """
'gene_symbol', concat('g', p_size), 'results', array(named_struct('primaryAccession', concat('P', p_partkey),
  'proteinDescription', if(p_size % 7 = 0, null, named_struct('recommendedName', named_struct('fullName', named_struct('value', p_name)))),
  'organism', named_struct('scientificName', 'Homo sapiens'), 'sequence', named_struct('length', p_partkey + 50),
  'keywords', array(named_struct('name', p_type, 'value', null), named_struct('name', null, 'value', 'Membrane')),
  'comments', array(
    named_struct('commentType', 'FUNCTION', 'texts', if(p_size % 5 = 0, null, array(named_struct('value', repeat(concat(p_type, ' '), 60)), named_struct('value', 'two'))),
       'subcellularLocations', null, 'disease', null),
    named_struct('commentType', 'SUBCELLULAR LOCATION', 'texts', null, 'subcellularLocations', array(named_struct('location', named_struct('value', 'Membrane')),
       named_struct('location', named_struct('value', '')), named_struct('location', named_struct('value', p_brand))), 'disease', null),
    named_struct('commentType', 'DISEASE', 'texts', null, 'subcellularLocations', null, 'disease', if(p_size % 2 = 0, named_struct('diseaseId', 'Alpha disease'), null)),
    named_struct('commentType', 'DISEASE', 'texts', null, 'subcellularLocations', null, 'disease', if(p_size % 4 = 0, named_struct('diseaseId', 'Beta disease'), null)))))
"""


@query("n07_protein_records", """
SELECT 'uniprot_P' || p_partkey AS record_id, 'uniprot' AS source_key, 'G' || p_size AS gene_symbol,
  CASE WHEN p_size % 4 = 0 THEN 'Alpha disease; Beta disease' WHEN p_size % 2 = 0 THEN 'Alpha disease' END AS disease, CAST(NULL AS VARCHAR) AS drug,
  'G' || p_size || ' (P' || p_partkey || ') — ' || CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS title,
  'Function: ' || CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE left(repeat(p_type || ' ', 60), 300) END || '. Location: Membrane, ' || p_brand ||
    '. Diseases: ' || CASE WHEN p_size % 4 = 0 THEN 'Alpha disease, Beta disease' WHEN p_size % 2 = 0 THEN 'Alpha disease' ELSE 'none' END ||
    '. Length: ' || (p_partkey + 50) || ' aa' AS summary,
  'Membrane; ' || p_brand AS location, p_type || ', Membrane' AS keywords FROM part""")
def _(t):
    records = normalize.protein_records(docs(t, "part", PROTEIN_DOC))
    return shown(records, location=("subcellular_location", "string"), keywords=("keywords", "string"))


TEST_DOC = """
'uid', cast(p_partkey as string), '_query_gene', concat('Q', p_size), 'testname', concat(' ', p_name, ' '),
'accession', if(p_size % 3 = 0, null, concat('GTR', p_partkey, '.1')), 'testtype', if(p_size % 2 = 0, 'Clinical', ''),
'analytes', if(p_size % 4 = 0, array(), array(named_struct('analytetype', 'Protein', 'name', 'X'), named_struct('analytetype', 'Gene', 'name', p_brand),
   named_struct('analytetype', 'Gene', 'name', 'SECOND'))),
'conditionlist', if(p_size % 5 = 0, null, array(named_struct('name', p_type), named_struct('name', ''), named_struct('name', 'Cond B'))),
'conditionname', if(p_size % 10 = 0, 'Plain condition', null),
'offerer', if(p_size % 6 = 0, null, 'Lab One'), 'labname', if(p_size % 12 = 0, 'Lab Two', null), 'country', if(p_size % 2 = 0, 'United States', null),
'offererlocation', named_struct('city', 'Boston ', 'state', if(p_size % 3 = 0, '', 'MA'), 'country', 'USA'),
'method', array(named_struct('name', 'Sequencing'), named_struct('name', 'Deletion')), 'testpurpose', array('Screening', 'Diagnosis')
"""


@query("n08_test_records", """
WITH p AS (SELECT *, CASE WHEN p_size % 5 <> 0 THEN p_type || ', Cond B' WHEN p_size % 10 = 0 THEN 'Plain condition' ELSE 'Not specified' END AS conds,
  CASE WHEN p_size % 6 <> 0 THEN 'Lab One' WHEN p_size % 12 = 0 THEN 'Lab Two' ELSE 'Not specified' END AS lab,
  CASE WHEN p_size % 3 = 0 THEN 'GTR' || p_partkey ELSE 'GTR' || p_partkey || '.1' END AS acc FROM part)
SELECT 'gtr_' || p_partkey AS record_id, 'ncbi_gtr' AS source_key, CASE WHEN p_size % 4 = 0 THEN 'Q' || p_size ELSE p_brand END AS gene_symbol,
  CASE WHEN p_size % 5 <> 0 THEN p_type WHEN p_size % 10 = 0 THEN 'Plain condition' END AS disease, CAST(NULL AS VARCHAR) AS drug,
  p_name || ' [' || acc || ']' AS title,
  'Test: ' || p_name || ' | Gene(s): ' || CASE WHEN p_size % 4 = 0 THEN 'Q' || p_size ELSE p_brand || ', SECOND' END || ' | Conditions: ' || conds ||
   ' | Method: Sequencing; Deletion | Type: ' || CASE WHEN p_size % 2 = 0 THEN 'Clinical' ELSE 'Not specified' END || ' | Lab: ' || lab ||
   ' (Boston' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ', MA' END || CASE WHEN p_size % 2 = 0 THEN ', United States)' ELSE ', USA)' END AS summary,
  'Screening; Diagnosis' AS test_purpose FROM p""")
def _(t):
    return shown(normalize.test_records(docs(t, "part", TEST_DOC)), test_purpose=("test_purpose", "string"))


EVIDENCE_DOC = """
'gene', named_struct('name', concat('G', p_size), 'variants', named_struct('nodes', transform(filter(sequence(1, 2), i -> i <= 1 + p_size % 2), i -> named_struct(
  'id', p_partkey * 10 + i, 'name', concat('V', i), 'variantTypes', array(named_struct('name', 'missense'), named_struct('name', p_type)),
  'singleVariantMolecularProfile', if(p_size % 5 = 0, null, named_struct('molecularProfileScore', p_size + 0.5D, 'evidenceItems', named_struct('nodes', array(
     named_struct('id', p_partkey * 100 + i, 'evidenceLevel', if(p_size % 3 = 0, null, 'B'), 'evidenceType', 'PREDICTIVE', 'significance', 'SENSITIVITY',
       'description', repeat('d', 250), 'disease', if(p_size % 2 = 0, named_struct('name', p_brand), null),
       'therapies', if(p_size % 4 = 0, array(), array(named_struct('name', 'Drug A'), named_struct('name', p_name)))))))))))
)
"""


@query("n09_evidence_records", """
WITH v AS (SELECT *, unnest(range(1, 2 + p_size % 2)) AS i FROM part),
 e AS (SELECT *, CASE WHEN p_size % 4 <> 0 THEN 'Drug A, ' || p_name END AS th, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS dis FROM v WHERE p_size % 5 <> 0)
SELECT 'civic_variant_' || (p_partkey * 10 + i) AS record_id, 'civic' AS source_key, 'G' || p_size AS gene_symbol, CAST(NULL AS VARCHAR) AS disease, CAST(NULL AS VARCHAR) AS drug,
  'G' || p_size || ' V' || i AS title, 'Variant types: missense, ' || p_type || '. MP score: ' ||
   CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE p_size || '.5' END AS summary FROM v
UNION ALL
SELECT 'civic_evidence_' || (p_partkey * 100 + i), 'civic', 'G' || p_size, dis, th,
  'G' || p_size || ' V' || i || ' — Level ' || CASE WHEN p_size % 3 = 0 THEN '?' ELSE 'B' END || ' (PREDICTIVE)',
  'SENSITIVITY. Disease: ' || dis || '. Therapies: ' || coalesce(th, 'none') || '. ' || repeat('d', 200) FROM e""")
def _(t):
    return normalize.evidence_records(docs(t, "part", EVIDENCE_DOC)).select(*COMMON)


ASSOCIATION_DOC = """
'gene_symbol', concat('g', p_size), 'gene_id', concat('HGNC:', p_partkey),
'phenotypes', array(named_struct('id', if(p_size % 3 = 0, null, 'a1'), 'object', concat('HP:', p_size), 'object_label', p_name, 'category', 'pheno', 'primary_knowledge_source', 'hpo')),
'associations', array(
  named_struct('id', 'a1', 'object', 'MONDO:1', 'object_label', 'One', 'category', 'c1', 'primary_knowledge_source', 's1'),
  named_struct('id', null, 'object', 'MONDO:2', 'object_label', null, 'category', null, 'primary_knowledge_source', null))
"""


@query("n10_phenotype_records", """
SELECT 'monarch_HGNC:' || p_partkey || '_pheno_HP:' || p_size AS record_id, 'monarch' AS source_key, 'G' || p_size AS gene_symbol, CAST(NULL AS VARCHAR) AS disease,
  CAST(NULL AS VARCHAR) AS drug, 'G' || p_size || ' → ' || p_name || ' (phenotype)' AS title,
  'Phenotype association: ' || p_name || '. ID: HP:' || p_size || '. Source: hpo' AS summary FROM part
UNION ALL
SELECT 'monarch_HGNC:' || p_partkey || '_MONDO:1', 'monarch', 'G' || p_size, 'One', NULL, 'G' || p_size || ' ↔ One',
  'Disease association. Category: c1. Source: s1' FROM part WHERE p_size % 3 = 0
UNION ALL
SELECT 'monarch_HGNC:' || p_partkey || '_MONDO:2', 'monarch', 'G' || p_size, 'MONDO:2', NULL, 'G' || p_size || ' ↔ MONDO:2',
  'Disease association. Category: . Source: N/A' FROM part WHERE p_size % 3 <> 0""")
def _(t):
    return normalize.phenotype_records(docs(t, "part", ASSOCIATION_DOC)).select(*COMMON)


REACTOME_DOC = """
'gene_symbol', concat('g', p_size), 'pathways', array(named_struct('stId', if(p_size % 2 = 0, concat('R-HSA-', p_partkey), null), 'dbId', cast(p_partkey as string),
  'displayName', p_name, 'speciesName', 'Homo sapiens', 'schemaClass', if(p_size % 3 = 0, null, 'TopLevel'),
  'compartment', transform(filter(sequence(1, 4), i -> i <= p_size % 5), i -> named_struct('displayName', concat('c', i)))))
"""


@query("n11_reactome_records", """
WITH p AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'R-HSA-' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part)
SELECT 'reactome_' || id || '_G' || p_size AS record_id, 'reactome' AS source_key, 'G' || p_size AS gene_symbol, CAST(NULL AS VARCHAR) AS disease, CAST(NULL AS VARCHAR) AS drug,
  'G' || p_size || ' in ' || p_name AS title, 'Pathway: ' || p_name || ' (' || id || '). Species: Homo sapiens. Compartment: ' ||
   CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'c1' WHEN 2 THEN 'c1, c2' ELSE 'c1, c2, c3' END || '. Category: ' ||
   CASE WHEN p_size % 3 = 0 THEN 'Pathway' ELSE 'TopLevel' END AS summary FROM p""")
def _(t):
    return normalize.reactome_records(docs(t, "part", REACTOME_DOC)).select(*COMMON)


ATLAS_DOC = """
'gene_symbol', concat('g', p_partkey), 'Gene', concat('G', p_partkey), 'Gene description', p_name, 'Protein class', array('Enzymes', p_type),
'Chromosome', cast(p_size as string), 'Antibody', if(p_size % 2 = 0, 'HPA1', null),
'RNA tissue specific nTPM', map('brain', concat(p_size, '.5'), 'liver', '1.0'), 'RNA tissue specificity', 'Tissue enriched',
'Subcellular main location', array('Nucleus', 'Cytosol')
"""


@query("n12_atlas_records", """
SELECT 'hpa_G' || p_partkey || '_summary' AS record_id, 'human_protein_atlas' AS source_key, 'G' || p_partkey AS gene_symbol, CAST(NULL AS VARCHAR) AS disease,
  CAST(NULL AS VARCHAR) AS drug, 'G' || p_partkey || ' — Human Protein Atlas' AS title, 'Name: ' || p_name || '. Protein class: Enzymes, ' || p_type ||
  '. Chromosome: ' || p_size || '. Antibody: ' || CASE WHEN p_size % 2 = 0 THEN 'HPA1' ELSE 'N/A' END AS summary FROM part
UNION ALL
SELECT 'hpa_G' || p_partkey || '_tissue_' || tn, 'human_protein_atlas', 'G' || p_partkey, NULL, NULL, 'G' || p_partkey || ' in ' || tn || ': ' || tv || ' nTPM',
  'Tissue: ' || tn || '. RNA expression: ' || tv || ' nTPM. Specificity: Tissue enriched'
FROM (SELECT p_partkey, 'brain' AS tn, p_size || '.5' AS tv FROM part UNION ALL SELECT p_partkey, 'liver', '1.0' FROM part)
UNION ALL
SELECT 'hpa_G' || p_partkey || '_loc_' || loc, 'human_protein_atlas', 'G' || p_partkey, NULL, NULL, 'G' || p_partkey || ' localization: ' || loc,
  'Subcellular location: ' || loc || '. Main locations: Nucleus, Cytosol'
FROM (SELECT p_partkey, 'Nucleus' AS loc FROM part UNION ALL SELECT p_partkey, p_brand FROM part)""")
def _(t):
    body = docs(t, "part", ATLAS_DOC, "p_brand")
    # Locations come both as text and as objects, so the list is spliced in as JSON text.
    places = F.concat(F.lit(',"Subcellular location":["Nucleus",{"location":"'), F.col("p_brand"), F.lit('"}]}'))
    raw = F.concat(F.regexp_replace("raw", r"\}$", ""), places)
    return normalize.atlas_records(body.select(raw.alias("raw"))).select(*COMMON)


@query("v12_tissue_levels_measured", """
SELECT 'G' || p_partkey AS gene_symbol, tn AS tissue, CAST(0 AS INTEGER) AS level, CAST(tv AS DOUBLE) AS n_tpm
FROM (SELECT p_partkey, 'brain' AS tn, p_size || '.5' AS tv FROM part UNION ALL SELECT p_partkey, 'liver', '1.0' FROM part)""")
def _(t):
    from ..operators import analytics

    return analytics.tissue_ranking(analytics.tissue_levels(normalize.atlas_records(docs(t, "part", ATLAS_DOC, "p_brand"))))


@query("n13_receptor_activities", """
WITH c AS (SELECT 'M' || CAST(p_partkey AS VARCHAR) AS m, p_brand, p_type, p_size FROM part WHERE p_size > 25)
SELECT molecule_id, molecule_name, target_gene, target_alias, standard_type, standard_value, 'nM' AS standard_units, pchembl_value,
  repeat(molecule_name || ' ', 40) AS assay_description, coalesce(p_brand, '') AS compound_brand, coalesce(p_type, '') AS compound_company,
  CASE WHEN p_brand IS NULL THEN 'unknown' ELSE 'DORA' END AS selectivity_class, p_size AS year_approved, 'ChEMBL' AS source
FROM v_activities LEFT JOIN c ON m = molecule_id
UNION ALL
SELECT * FROM (VALUES
  ('CHEMBL1083659', 'SUVOREXANT', 'HCRTR1', 'OX1R', 'Ki', 0.55, 'nM', 9.26), ('CHEMBL1083659', 'SUVOREXANT', 'HCRTR2', 'OX2R', 'Ki', 0.35, 'nM', 9.46),
  ('CHEMBL3989847', 'LEMBOREXANT', 'HCRTR1', 'OX1R', 'Ki', 6.1, 'nM', 8.21), ('CHEMBL3989847', 'LEMBOREXANT', 'HCRTR2', 'OX2R', 'Ki', 2.6, 'nM', 8.59),
  ('CHEMBL4297437', 'DARIDOREXANT', 'HCRTR1', 'OX1R', 'Ki', 7.0, 'nM', 8.15), ('CHEMBL4297437', 'DARIDOREXANT', 'HCRTR2', 'OX2R', 'Ki', 0.47, 'nM', 9.33)) v,
 (VALUES ('Curated from published literature', '', '', 'DORA', CAST(NULL AS INTEGER), 'ChEMBL_curated')) w""")
def _(t):
    raw = t("v_activities").select(
        "molecule_id", "molecule_name", "target_gene", "target_alias", "standard_type",
        F.col("standard_value").cast("string").alias("standard_value"), F.lit("nM").alias("standard_units"),
        F.coalesce(F.col("pchembl_value").cast("string"), F.lit("")).alias("pchembl_value"),
        F.repeat(F.concat("molecule_name", F.lit(" ")), F.lit(40)).alias("assay_description"),
    )
    compounds = t("part").filter("p_size > 25").selectExpr(
        "concat('M', p_partkey) AS molecule_id", "p_brand AS compound_brand", "p_type AS compound_company",
        "'DORA' AS selectivity_class", "p_size AS year_approved",
    )
    curated = t.spark.createDataFrame(landing.CURATED_BINDING, landing.CURATED_SCHEMA)
    return landing.receptor_activities(raw, compounds, curated)


SCREEN_NAME_SQL = """
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Glutamatergic Neuron' WHEN 'MACHINERY' THEN 'Glutamatergic-Neuron' WHEN 'HOUSEHOLD' THEN 'iTF-Microglia'
    WHEN 'AUTOMOBILE' THEN 'T Cell' ELSE 'Organoid' END"""


def named_screens(t):
    """Screen names put together from customer segments and order priorities."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.selectExpr(
        "o_orderkey", "o_totalprice", "o_orderstatus", "c_name",
        f"concat({SCREEN_NAME_SQL}, if(o_orderkey % 4 = 0, '-PSAP KO', ''), if(o_orderkey % 3 = 0, '', concat('-', o_orderpriority)), "
        "if(o_orderkey % 2 = 0, '-CRISPRi', '-CRISPRa')) AS screen_name",
    )


SCREEN_PARTS = f"""
s AS (SELECT *, {SCREEN_NAME_SQL} AS ct FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT *, ct || CASE WHEN o_orderkey % 4 = 0 THEN '-PSAP KO' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-' || o_orderpriority END ||
   CASE WHEN o_orderkey % 2 = 0 THEN '-CRISPRi' ELSE '-CRISPRa' END AS screen_name,
  CASE WHEN ct = 'Organoid' THEN 'unknown' ELSE replace(ct, '-', ' ') END AS cell_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'CRISPRi' ELSE 'CRISPRa' END AS crispr_mode,
  CASE WHEN o_orderkey % 4 = 0 THEN 'PSAP KO' ELSE 'WT' END AS genotype,
  CASE WHEN ct = 'Organoid' THEN 'Organoid' ELSE '' END ||
    CASE WHEN ct = 'Organoid' AND o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN '--' ELSE '-' END ELSE '' END ||
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS ph FROM s)"""


@query("n15_screen_names", f"""
WITH {SCREEN_PARTS}
SELECT o_orderkey, screen_name, cell_type, genotype, crispr_mode, coalesce(nullif(ph, ''), 'Survival') AS phenotype_name FROM p""")
def _(t):
    parsed = landing.screen_attributes(named_screens(t))
    return parsed.select("o_orderkey", "screen_name", "cell_type", "genotype", "crispr_mode", "phenotype_name")


@query("n14_unify_screens", f"""
WITH {SCREEN_PARTS}
SELECT screen_name, c_name AS gene, cell_type, genotype, crispr_mode, coalesce(nullif(ph, ''), 'Survival') AS phenotype_name,
  o_totalprice AS phenotype_score, CAST(NULL AS DOUBLE) AS pvalue, CAST(NULL AS DOUBLE) AS gene_score,
  CASE WHEN o_orderstatus = 'O' THEN 'none' ELSE o_orderstatus END AS hit_class, 'human' AS species, 'crisprbrain.org' AS source
FROM p WHERE o_orderkey % 11 <> 0
UNION ALL
SELECT 'Sheet ' || p_type, p_name, 'Glutamatergic Neuron', 'WT', 'CRISPRi', 'Sheet ' || p_type, p_retailprice, p_size / 100.0E0, NULL, p_brand, 'human', 'crisprbrain.org'
FROM part""")
def _(t):
    first = named_screens(t).select(
        "screen_name", F.when(F.col("o_orderkey") % 11 == 0, "nan").otherwise(F.concat(F.lit(" "), "c_name")).alias("Gene"),
        F.col("o_totalprice").cast("string").alias("Phenotype"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.col("o_orderstatus"), F.lit(" "))).alias("Hit Class"),
    )
    second = t("part").select(
        F.concat(F.lit("Sheet "), "p_type").alias("screen_name"), F.col("p_name").alias("gene"),
        F.col("p_retailprice").alias("score"), (F.col("p_size") / 100).alias("p_value"), F.col("p_brand").alias("hit_class"),
    )
    return landing.unify_screens(first).unionByName(landing.unify_screens(second))


def landed_cells(t):
    return t("v_cell_metadata").select(
        F.col("cell_barcode").alias("cell_id"), "gene_target", "predicted_class", "predicted_subclass", "neuron_type",
        "region_level1", "region_level2", "passes_qc", "batch", (F.col("region_level2").cast("double") * 10).alias("num_rna_umi"),
    )


@query("n16_cell_atlas", """
SELECT cell_barcode, gene_target, predicted_class AS cell_type, region_level1 AS region, CAST(NULL AS DOUBLE) AS umap_1, CAST(NULL AS DOUBLE) AS umap_2,
  CAST(region_level2 AS INTEGER) * 10 AS n_counts, batch FROM v_cell_metadata""")
def _(t):
    return landing.cell_tables(landed_cells(t))[0]


@query("n16_cell_metadata", "SELECT * FROM v_cell_metadata")
def _(t):
    return landing.cell_tables(landed_cells(t))[1]


@query("n17_flag_filter", """
SELECT item, flag FROM (SELECT l_orderkey AS item, CASE l_linenumber WHEN 1 THEN 'True' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN 'YES' ELSE 'false' END AS flag
  FROM lineitem) WHERE lower(flag) IN ('true', '1', 'yes')""")
def _(t):
    from ..functions import predicates as P

    rows = t("lineitem").selectExpr(
        "l_orderkey AS item", "CASE l_linenumber WHEN 1 THEN 'True' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN 'YES' ELSE 'false' END AS flag"
    )
    return rows.filter(P.is_flagged("flag"))


@query("n18_null_texts", """
SELECT nullif(gene, 'None') AS gene, nullif(FDR_TADA_ASD, 'nan') AS FDR_TADA_ASD, ASD72 FROM v_ndd_genes""")
def _(t):
    return normalize.null_texts(t("v_ndd_genes").select("gene", "FDR_TADA_ASD", "ASD72"))


@query("n19_cast_void", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS note FROM customer")
def _(t):
    return normalize.cast_void(t("customer").select("c_custkey", F.lit(None).alias("note")))


@query("n20_registry_join", """
SELECT source_key, CASE source_key WHEN 'opentargets' THEN 'druggability' WHEN 'kegg' THEN 'pathways' WHEN 'reactome' THEN 'pathways'
   WHEN 'uniprot' THEN 'expression' WHEN 'human_protein_atlas' THEN 'expression' WHEN 'monarch' THEN 'expression' ELSE 'genetics' END AS source_type,
  'high' AS priority, 'src_' || source_key AS target_table, count(*) AS n FROM v_sources GROUP BY source_key""")
def _(t):
    counts = t("v_sources").groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    sources = registry.as_dataframe(t.spark).filter("priority = 'high'")
    named = sources.select(F.col("key").alias("source_key"), "source_type", "priority", "target_table")
    return counts.join(named, "source_key")


@query("n21_flatten_expression", """
SELECT 'G' || p_partkey AS gene_symbol, n_name AS tissue, 'T' || n_nationkey AS tissue_id, p_size + n_nationkey * 1.0E0 AS median_tpm,
  n_regionkey AS n_samples, 'GTEx_v8' AS source
FROM part JOIN nation ON n_nationkey IN (p_size % 25, (p_size + 1) % 25)""")
def _(t):
    genes = t("part").selectExpr(
        "concat('G', p_partkey) AS gene_symbol",
        "map(concat('T', p_size % 25), cast(p_size + p_size % 25 as double), concat('T', (p_size + 1) % 25), cast(p_size + (p_size + 1) % 25 as double), "
        "'unknown', 0D) AS tissue_tpm",
    )
    regions = t("nation").selectExpr("concat('T', n_nationkey) AS tissue_id", "n_name AS tissue", "n_regionkey AS n_samples")
    return landing.flatten_expression(genes, regions)


@query("f08_capitalize_and_cut", """
SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title_case,
  CASE WHEN length(c_name) > 12 THEN left(c_name, 12) || '...' ELSE c_name END AS short_name FROM customer""")
def _(t):
    return t("customer").select(
        "c_custkey", S.capitalize("c_mktsegment").alias("title_case"), S.cut("c_name", 12, "...").alias("short_name")
    )


@query("f14_parse_numbers", """
SELECT gene, TRY_CAST(nullif(FDR_TADA_ASD, 'nan') AS DOUBLE) AS fdr, TRY_CAST(gene AS DOUBLE) AS no_number FROM v_ndd_genes""")
def _(t):
    return t("v_ndd_genes").select(
        "gene", S.parse_double("FDR_TADA_ASD").alias("fdr"), S.parse_double("gene").alias("no_number")
    )


@query("f16_times", """
SELECT event_id, date_trunc('minute', ts) AS minute, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events""")
def _(t):
    return t("events").select(
        "event_id", S.utc_minute("ts").alias("minute"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown")
    )
