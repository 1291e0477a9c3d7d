import json

import pytest
from pyspark.sql import functions as F

from quillomics.functions.payload import field
from quillomics.plans import landing, normalize
from quillomics.sources import files, registry, schemas
from tests.conftest import rows

# name -> cell type, genotype, mode, phenotype
SCREENS = {
    "Glutamatergic Neuron-CellRox-CRISPRi": ("Glutamatergic Neuron", "WT", "CRISPRi", "CellRox"),
    "Glutamatergic Neuron-Day-14-Survival-CRISPRi": ("Glutamatergic Neuron", "WT", "CRISPRi", "Day-14-Survival"),
    "Glutamatergic Neuron-Halo-TDP-43-CRISPRi": ("Glutamatergic Neuron", "WT", "CRISPRi", "Halo-TDP-43"),
    "Glutamatergic Neuron-PSAP KO-Survival-CRISPRa": ("Glutamatergic Neuron", "PSAP KO", "CRISPRa", "Survival"),
    "Glutamatergic-Neuron-DAKO-CRISPRi-Retest": ("Glutamatergic Neuron", "WT", "CRISPRi", "DAKO--Retest"),
    "Glutamatergic-Neuron-WT-T22-CRISPRi-Retest": ("Glutamatergic Neuron", "WT", "CRISPRi", "T22--Retest"),
    "HSPC-CD34-CRISPRn": ("HSPC", "WT", "CRISPRn", "CD34"),
    "T Cell-CFSE-CRISPRn": ("T Cell", "WT", "CRISPRn", "CFSE"),
    "iAstrocyte-VCAM1-ITC-CRISPRi": ("iAstrocyte", "WT", "CRISPRi", "VCAM1-ITC"),
    "iTF-Microglia-Immune Activation-CRISPRi": ("iTF Microglia", "WT", "CRISPRi", "Immune Activation"),
    "iTF-Microglia-Lipid-rich-BODIPY-TF-library": ("iTF Microglia", "WT", "unknown", "Lipid-rich-BODIPY-TF-library"),
    "iPSC-CRISPRi": ("iPSC", "WT", "CRISPRi", "Survival"),
}


def test_screen_names(spark):
    df = spark.createDataFrame([(n,) for n in SCREENS], "screen_name string")
    got = {r["screen_name"]: (r["cell_type"], r["genotype"], r["crispr_mode"], r["phenotype_name"])
           for r in landing.screen_attributes(df).collect()}
    assert got == SCREENS


def test_flat_records_from_file(spark, tmp_path):
    path = tmp_path / "pathways.txt"
    path.write_text(
        "ENTRY       hsa05010          Pathway\nNAME        Alzheimer disease - Homo sapiens (human)\n"
        "DESCRIPTION First line\n            second line.\nCLASS       Human Diseases\n///\n"
        "ENTRY       hsa04330\nNAME        Notch\n///\n"
    )
    got = files.read_flat_records(spark, str(path)).select(files.flat_fields(F.col("value")).alias("f")).collect()
    assert [r["f"].get("NAME") for r in got] == ["Alzheimer disease - Homo sapiens (human)", "Notch"]
    assert got[0]["f"]["DESCRIPTION"] == "First line second line."


def docs(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "raw string")


def test_broken_documents_are_set_aside(spark):
    frame = docs(spark, {"gene_symbol": "app", "pathways": [{"stId": "R1", "displayName": "P"}]}, "{not json", "", '{"pathways": 3}', "3")
    assert normalize.reactome_records(frame).count() == 1
    # A document with a field of another type is read without that field, which is listed.
    assert normalize.readable(frame, normalize.REACTOME_SCHEMA).count() == 2
    assert normalize.quarantine(frame, normalize.REACTOME_SCHEMA).count() == 3
    assert sorted(r.path for r in normalize.mistyped(frame, normalize.REACTOME_SCHEMA).collect()) == ["$", "$.pathways"]
    assert normalize.atlas_records(docs(spark, "{oops")).count() == 0
    assert normalize.test_records(docs(spark, "{oops")).count() == 0


def test_documents_with_missing_parts(spark):
    assert normalize.target_records(docs(spark, {"target": {"id": "E1", "approvedSymbol": "APP"}})).count() == 0
    assert normalize.variant_records(docs(spark, {"gene": {"symbol": "app", "gene_id": "E1"}})).count() == 0
    assert normalize.evidence_records(docs(spark, {"gene": {"name": "APP", "variants": None}})).count() == 0
    row = normalize.protein_records(docs(spark, {"gene_symbol": "app", "results": [{"primaryAccession": "P1"}]})).first()
    assert row["title"] == "APP (P1) — " and row["disease"] is None
    assert row["summary"] == "Function: N/A. Location: . Diseases: none. Length: ? aa"


def test_constraint_summary_keeps_every_part(spark):
    body = {"gene": {"symbol": "app", "gene_id": "E1", "chrom": "21", "start": 5, "stop": 9,
                     "gnomad_constraint": {"pLI": 0.95, "oe_lof_upper": 0.2, "mis_z": 1.5, "obs_lof": 3, "exp_lof": 20.25}}}
    row = normalize.variant_records(docs(spark, body)).first()
    assert row["summary"] == (
        "pLI=0.9500 (highly intolerant to LoF (haploinsufficient)). LOEUF=0.200. mis_z=1.50. "
        "obs/exp LoF: 3/20.3. Location: chr21:5-9"
    )


def test_study_summary(spark):
    body = {"gene_symbol": "APP", "study_id": "s1", "profile_id": "s1_mutations", "gene_meta": {"entrezGeneId": 351},
            "mutations": [
                {"mutationType": "Nonsense", "sampleId": "a", "proteinChange": "R1*"},
                {"mutationType": "Missense", "sampleId": "a", "proteinChange": "A2T"},
                {"mutationStatus": "SOMATIC", "sampleId": "b"},
                {"mutationType": "Missense", "sampleId": "", "proteinChange": "G3D"},
                {"mutationType": "Nonsense", "sampleId": "c", "proteinChange": "Q4*"}]}
    records = normalize.study_records(normalize.mutation_rows(docs(spark, body)), changes_shown=2, changes_kept=3, sample_rows=2)
    row = records.select("title", "summary", F.to_json("payload").alias("p")).first()
    payload = json.loads(row["p"])
    assert row["title"] == "APP somatic mutations in s1 — 5 events, 3 samples"
    # Two kinds are equally frequent; the one met first dominates.
    assert "Dominant type: Nonsense" in row["summary"] and row["summary"].endswith("Top protein changes: R1*, A2T")
    assert payload["mutation_types"] == {"Missense": 2, "Nonsense": 2, "SOMATIC": 1}
    assert payload["top_protein_changes"] == ["R1*", "A2T", "G3D"]
    assert [m["sample_id"] for m in payload["mutations_sample"]] == ["a", "a"]


def test_mutation_documents_are_parsed_once(spark):
    """Whatever reads the mutations afterwards; those without a study are left out."""
    bodies = [{"gene_symbol": "APP", "study_id": s, "mutations": [{"sampleId": "a", "proteinChange": "R1H"}, None]} for s in ("s1", None)]
    found = normalize.mutation_rows(docs(spark, *bodies))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1
    assert [(r["study_id"], r["position"], r["protein_change"]) for r in found.collect()] == [("s1", 0, "R1H")]
    records = normalize.study_records(found)
    assert "posexplode" not in records._jdf.queryExecution().optimizedPlan().toString()
    assert [r["title"] for r in records.collect()] == ["APP somatic mutations in s1 — 1 events, 1 samples"]


def test_large_studies_are_not_gathered(spark):
    """Their lists are written piece by piece, and are the same as those of a study among others."""
    large = [{"mutationType": "Missense", "sampleId": f"s{i % 3}", "proteinChange": f'R{i % 5}"H' if i % 4 else None} for i in range(40)]
    bodies = [{"gene_symbol": "APP", "study_id": s, "mutations": m} for s, m in (("big", large), ("big", large[:7]), ("one", [{"sampleId": ""}]), ("none", []))]
    found = normalize.mutation_rows(docs(spark, *bodies))
    records = normalize.study_records(found)
    assert "collect_list" not in records._jdf.queryExecution().optimizedPlan().toString()
    got = {r["record_id"]: json.loads(r["p"]) for r in records.select("record_id", F.to_json("payload").alias("p")).collect()}
    assert set(got) == {"cbio_APP_big", "cbio_APP_one"}
    assert got["cbio_APP_one"]["mutations_sample"] == [{"position": 0, "mutation_type": "Unknown"}] and got["cbio_APP_one"]["top_protein_changes"] == []
    expected = sorted([*enumerate(large), *enumerate(large[:7])], key=lambda x: x[0])
    assert [(m["position"], m["sample_id"], m.get("protein_change")) for m in got["cbio_APP_big"]["mutations_sample"]] == [
        (i, m["sampleId"], m["proteinChange"]) for i, m in expected]
    assert got["cbio_APP_big"]["top_protein_changes"] == [m["proteinChange"] for _, m in expected if m["proteinChange"]]

    def rows_of(df):
        return sorted(map(str, df.withColumn("payload", F.to_json("payload")).collect()))

    for kept in ({}, {"changes_kept": 3, "sample_rows": 2}):
        alone = normalize.study_records(found, alone_from=40, **kept)
        assert rows_of(alone) == rows_of(normalize.study_records(found, **kept))
        folders = [f.split("alone=")[1].split("/")[0] for f in alone.inputFiles()]
        assert sum(f != "0" for f in folders) == 1 and "0" in folders


def test_test_records_accept_lists_and_text(spark):
    listed = {"uid": "1", "_query_gene": "APP", "testname": "T", "conditionlist": [{"name": "A"}, {"name": "B"}], "method": [{"name": "Seq"}]}
    plain = {"uid": "2", "_query_gene": "APP", "testname": "T", "conditionname": "Plain", "method": "Sequencing"}
    got = {r["record_id"]: (r["disease"], r["m"], r["gene_symbol"])
           for r in normalize.test_records(docs(spark, listed, plain)).select("*", field("method").alias("m")).collect()}
    assert got == {"gtr_1": ("A", "Seq", "APP"), "gtr_2": ("Plain", "Sequencing", "APP")}


def test_align_to_schema(spark):
    df = spark.createDataFrame([("d", "m", 3)], "perturbation string, `moa-fine` string, plate int")
    out = schemas.align_to_schema(df, "drug_cells", schemas.DRUG_CELL_NAMES)
    assert out.schema == schemas.schema("drug_cells")
    assert tuple(out.first())[:4] == ("d", "m", None, "3")


def test_vocabulary_of_list_and_object(spark):
    df = spark.createDataFrame([(1, '["A","B"]'), (2, '{"C":1,"D":2}')], "i int, raw string").withColumn("doc", F.parse_json("raw"))
    assert rows(files.vocabulary_names(df, ["i"])) == [(1, "A"), (1, "B"), (2, "C"), (2, "D")]


def test_sheets_without_the_key_column_are_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Gene,Phenotype\nAPP,1.5\n")
    (tmp_path / "b.tsv").write_text("gene\tscore\tother\nTAU\t2\tx\n")
    (tmp_path / "c.csv").write_text("sgRNA,seq\ns1,ACGT\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.tsv", "c.csv")]
    target = schemas.StructType.fromDDL("gene string, phenotype_score double")
    got = files.load_sheets(spark, paths, target, landing.SCREEN_COLUMNS, "gene")
    assert rows(got) == [("APP", 1.5, "a.csv"), ("TAU", 2.0, "b.tsv")]


def test_registry(spark):
    assert len(registry.SOURCES) == 21 and len(registry.BY_KEY) == 21
    assert len(registry.find(priority="medium")) == 2
    assert [s.key for s in registry.find("pathways")] == ["reactome", "kegg"]
    assert registry.as_dataframe(spark).count() == 21
    assert registry.target_tables("c", "s")["kegg"] == "c.s.src_kegg"


def test_one_wrong_field_loses_nothing_else(spark):
    variants = [{"variant_id": f"v{i}", "gold_stars": i, "clinical_significance": "Benign"} for i in range(50)]
    variants.append({"variant_id": "odd", "gold_stars": "three", "clinical_significance": ["x"]})
    body = {"gene": {"symbol": "APP", "gene_id": "g1", "clinvar_variants": variants, "start": 5}}
    records = normalize.variant_records(docs(spark, body)).collect()
    assert len(records) == 51 and "g1_clinvar_odd" in {r.record_id for r in records}
    found = normalize.mistyped(docs(spark, body), normalize.VARIANT_SCHEMA).collect()
    assert [r.path for r in found] == ["$.gene.clinvar_variants[50].gold_stars"]
    assert normalize.quarantine(docs(spark, body), normalize.VARIANT_SCHEMA).count() == 0
    broken = spark.createDataFrame([('{"gene": ',), ("7",)], "raw string")
    assert normalize.quarantine(broken, normalize.VARIANT_SCHEMA).count() == 2


@pytest.mark.parametrize("conditions", [["A", "B"], [{"name": "A"}, {"name": "B"}], '[{"name": "A"}, {"name": "B"}]'])
def test_conditions_of_any_shape(spark, conditions):
    for body in ({"conditionlist": conditions}, {"conditionname": conditions}, {"conditionlist": [], "conditionname": conditions}):
        body |= {"uid": "1", "title": "Panel", "gtid": "GTR9", "testpurpose": "Diagnosis", "method": ["m1", {"name": "m2"}]}
        row = normalize.test_records(docs(spark, body)).selectExpr("title", "disease", "to_json(payload) AS p").first()
        assert (row.title, row.disease) == ("Panel [GTR9]", "A")
        payload = json.loads(row.p)
        assert payload["conditions"] == ["A", "B"] and payload["test_purpose"] == "Diagnosis" and payload["method"] == "m1; m2"
    row = normalize.test_records(docs(spark, {"uid": "2", "conditionname": "Plain text"})).first()
    assert row["disease"] == "Plain text"
