"""Domain-shaped views over the star-schema test tables.

The SQL is portable: the same text defines the view for Spark and for the
checking engine, so both sides of a comparison read identical rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the test tables.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(TABLE_SCHEMAS)

VIEWS = {
    "v_diff_expr": """
SELECT p_brand AS gene_target, p_name AS de_gene, p_type AS group_name,
       (l_extendedprice - 38000E0) / 10000E0 AS log2fc,
       (l_quantity - 1E0) / 98E0 AS pvalue_adj,
       CAST(l_quantity AS INT) AS n_cells_ko, l_linenumber AS n_cells_ctrl
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_cell_metadata": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS cell_barcode,
       CASE WHEN l_partkey % 10 = 0 THEN 'non-targeting' WHEN l_partkey % 13 = 0 THEN NULL ELSE p_brand END AS gene_target,
       p_type AS predicted_class, p_name AS predicted_subclass, l_returnflag AS neuron_type,
       l_linestatus AS region_level1, CAST(l_linenumber AS STRING) AS region_level2,
       l_quantity > 5E0 AS passes_qc, CAST(l_suppkey AS STRING) AS batch
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_screens": """
SELECT c_mktsegment || '-' || o_orderpriority || '-CRISPRi' AS screen_name, n_name AS gene,
       c_mktsegment AS cell_type, CASE WHEN n_regionkey = 0 THEN 'PSAP KO' ELSE 'WT' END AS genotype,
       CASE WHEN n_regionkey < 3 THEN 'CRISPRi' ELSE 'CRISPRa' END AS crispr_mode,
       o_orderpriority AS phenotype_name,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_totalprice - 100000E0) / 50000E0 END AS phenotype_score,
       (o_orderkey % 1000) / 1000E0 AS pvalue,
       CASE o_orderstatus WHEN 'O' THEN 'none' WHEN 'F' THEN 'negative hit' ELSE 'positive hit' END AS hit_class
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_ndd_genes": """
SELECT p_name || '-' || CAST(p_partkey AS STRING) AS gene, CAST(p_partkey AS STRING) AS gene_id, p_brand AS chromosome,
       CASE WHEN p_partkey % 11 = 0 THEN 'nan' WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS STRING) || 'e-2' END AS FDR_TADA_ASD,
       CAST(p_size AS STRING) || 'e-3' AS p_TADA_ASD, p_size % 2 AS ASD72
FROM part""",
    "v_expression": """
SELECT upper(event_type) AS gene_symbol, CASE WHEN user_id % 2 = 0 THEN 'ROSMAP' ELSE 'BioFINDER' END AS cohort,
       'Brain - region ' || CAST(user_id % 13 AS STRING) AS tissue, event_id AS sample_id, value AS tpm
FROM events""",
    "v_drug_cells": """
SELECT CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE p_name END AS drug,
       CASE WHEN p_size = 1 THEN 'unknown' WHEN p_size = 2 THEN NULL ELSE p_type END AS moa,
       s_name AS cell_line_id, p_brand AS cluster
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_signatures": """
SELECT p_name AS compound, p_type AS moa, s_name AS cell_line, s_nationkey < 10 AS is_neuronal, p_brand AS gene_symbol,
       (l_extendedprice - 38000E0) / 20000E0 AS zscore, l_quantity AS dose_um, l_linenumber AS timepoint_h
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_activities": """
SELECT upper(p_name) AS molecule_name, 'M' || CAST(p_partkey AS STRING) AS molecule_id,
       CASE l_returnflag WHEN 'A' THEN 'OX1R' WHEN 'R' THEN 'OX2R' ELSE 'OTHER' END AS target_alias,
       CASE l_returnflag WHEN 'A' THEN 'HCRTR1' WHEN 'R' THEN 'HCRTR2' ELSE 'OTHER' END AS target_gene,
       CASE l_linestatus WHEN 'O' THEN 'Ki' ELSE 'IC50' END AS standard_type, l_extendedprice / 1000E0 AS standard_value,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 4E0 + l_quantity / 10E0 END AS pchembl_value, l_orderkey, l_linenumber
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_records": """
SELECT CAST(event_id % 6000 AS STRING) AS record_id, event_type AS source_key,
       'GENE' || CAST(user_id % 25 AS STRING) AS gene_symbol,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'Disease ' || CAST(event_id % 40 AS STRING) END AS disease,
       CASE WHEN event_type = 'signup' THEN 'GENE' || CAST(user_id % 25 AS STRING) || ' Gene Constraint'
            WHEN event_id % 15 = 0 THEN NULL ELSE event_type || ' record (score: 0.' || CAST(100 + event_id % 900 AS STRING) || ')' END AS title,
       '{"score":0.' || CAST(100 + event_id % 900 AS STRING) || ',"clinical_significance":"' ||
         CASE event_id % 5 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic' WHEN 2 THEN 'Uncertain significance' WHEN 3 THEN 'Likely benign' ELSE 'Benign' END ||
         '","constraint":{"pLI":0.' || CAST(100 + event_id % 800 AS STRING) || ',"oe_lof":0.' || CAST(200 + event_id % 700 AS STRING) ||
         '},"disease":{"therapeuticAreas":[{"id":"T' || CAST(event_id % 7 AS STRING) || '","name":"Area ' || CAST(event_id % 7 AS STRING) || '"}]}}' AS payload,
       ts AS source_updated_at, event_id
FROM events""",
    # One row per event, spread over ten sources, with the payload paths each of them reads.
    "v_sources": """
SELECT event_id,
       CASE event_id % 10 WHEN 0 THEN 'opentargets' WHEN 1 THEN 'gnomad' WHEN 2 THEN 'kegg' WHEN 3 THEN 'cbioportal'
            WHEN 4 THEN 'uniprot' WHEN 5 THEN 'ncbi_gtr' WHEN 6 THEN 'civic' WHEN 7 THEN 'human_protein_atlas'
            WHEN 8 THEN 'monarch' ELSE 'reactome' END AS source_key,
       CAST(event_id % 6000 AS STRING) AS record_id,
       'Gene' || CAST(user_id % 25 AS STRING) AS gene_symbol,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'Disease ' || CAST(event_id % 40 AS STRING) END AS disease,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Drug ' || CAST(event_id % 12 AS STRING) END AS drug,
       CASE WHEN event_id % 17 = 0 THEN NULL
            WHEN event_id % 10 = 1 AND event_id % 3 = 0 THEN 'Gene' || CAST(user_id % 25 AS STRING) || ' Gene Constraint'
            WHEN event_id % 10 = 0 AND event_id % 3 = 0 THEN 'Gene' || CAST(user_id % 25 AS STRING) || ' Druggability/Tractability'
            WHEN event_id % 10 = 6 THEN 'Gene' || CAST(user_id % 25 AS STRING) || ' V' || CAST(event_id % 30 AS STRING) ||
                 CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' - Level B (Predictive)' WHEN 2 THEN ' - Level C (Prognostic)' ELSE ' - Level A (Predictive)' END
            WHEN event_id % 10 = 7 THEN 'Gene' || CAST(user_id % 25 AS STRING) || ' in tissue ' || CAST(event_id % 20 AS STRING) || ': ' ||
                 CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Not detected' END
            WHEN event_id % 10 = 5 THEN CASE event_id % 6 WHEN 0 THEN 'Exome sequencing' WHEN 1 THEN 'Epilepsy panel' WHEN 3 THEN 'Deletion scan' ELSE 'Targeted assay' END
            ELSE event_type || ' record (score: 0.' || CAST(100 + event_id % 900 AS STRING) || ')' END AS title,
       'Summary of ' || event_type || ' ' || CAST(event_id % 50 AS STRING) AS summary,
       '{"score":0.' || CAST(100 + event_id % 900 AS STRING) ||
         CASE WHEN event_id % 11 = 0 THEN '' ELSE ',"clinical_significance":"' ||
           CASE event_id % 5 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic' WHEN 2 THEN 'Uncertain significance' WHEN 3 THEN 'Likely benign' ELSE 'Benign' END || '"' END ||
         CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"gold_stars":' || CAST(event_id % 5 AS STRING) END ||
         ',"hgvsp":"p.A' || CAST(event_id % 300 AS STRING) || 'T","major_consequence":"missense_variant","pos":' || CAST(event_id AS STRING) ||
         ',"gnomad":{"exome":{"ac":' || CAST(event_id % 13 AS STRING) || ',"an":' || CAST(1000 + event_id % 50 AS STRING) || '}}' ||
         ',"constraint":{"pLI":0.' || CAST(100 + event_id % 800 AS STRING) || ',"oe_lof":0.' || CAST(200 + event_id % 700 AS STRING) ||
         ',"oe_lof_upper":0.' || CAST(300 + event_id % 600 AS STRING) || ',"oe_mis":0.' || CAST(400 + event_id % 500 AS STRING) ||
         CASE WHEN event_id % 13 = 0 THEN '' ELSE ',"mis_z":' || CAST(event_id % 8 - 3 AS STRING) || '.25' END ||
         ',"lof_z":' || CAST(event_id % 6 AS STRING) || '.5,"obs_lof":' || CAST(event_id % 40 AS STRING) || ',"exp_lof":' || CAST(event_id % 30 AS STRING) ||
         '.75,"obs_mis":' || CAST(event_id % 90 AS STRING) || ',"exp_mis":' || CAST(event_id % 80 AS STRING) || '.5},"gene_name":"name ' || CAST(user_id % 25 AS STRING) ||
         '","pathway_id":"hsa0' || CAST(1000 + event_id % 60 AS STRING) || '","pathway_name":"Pathway ' || CAST(event_id % 60 AS STRING) ||
         '","mutation_type":"' || CASE event_id % 3 WHEN 0 THEN 'Missense' WHEN 1 THEN 'Nonsense' ELSE 'Frameshift' END ||
         '","protein_change":"R' || CAST(event_id % 70 AS STRING) || 'H","cancer_study":"Study ' || CAST(event_id % 8 AS STRING) ||
         '","sample_count":' || CAST(event_id % 21 AS STRING) || ',"protein_name":"Protein ' || CAST(user_id % 25 AS STRING) ||
         '","function":"binds ' || event_type || '"' ||
         CASE WHEN event_id % 2 = 0 THEN ',"subcellular_location":"Membrane"' ELSE ',"locations":["Nucleus","Cytosol"]' END ||
         ',"test_type":"Clinical"' ||
         CASE WHEN event_id % 4 < 2 THEN ',"lab_name":"Lab ' ELSE ',"offerer":"Org ' END || CAST(event_id % 9 AS STRING) || '"' ||
         CASE WHEN event_id % 20 = 0 THEN ',"therapeuticAreas":[{"name":"Top area ' ELSE ',"disease":{"therapeuticAreas":[{"name":"Area ' END ||
         CAST(event_id % 7 AS STRING) || '"}]' || CASE WHEN event_id % 20 = 0 THEN '' ELSE '}' END || '}' AS payload,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE ts END AS source_updated_at
FROM events""",
    "v_query_log": """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS query_id, conv_id, turn, role AS user_email, text AS query_text
FROM conversations WHERE role <> 'assistant'""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table under its declared schema, so no file is opened while planning."""
    return spark.read.schema(TABLE_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def names_in(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view as a DataFrame. JSON payload text is parsed into VARIANT.

    Tables are passed by value, so no view name of the session is taken.
    """
    escaped = VIEWS[view].replace("{", "{{").replace("}", "}}")
    sql = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", escaped)
    df = spark.sql(sql, **{name: read(spark, sf_dir, name) for name in names_in(sql, TABLES)})
    if "payload" in df.columns:
        df = df.withColumn("payload", F.parse_json("payload"))
    return df


def with_views(sql: str) -> str:
    """Prefix a checking query with the definitions of the views it names."""
    used = names_in(sql, VIEWS)
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]}\n)" for v in used)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
