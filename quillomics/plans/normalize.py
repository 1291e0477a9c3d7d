"""Raw source documents to common source records.

Each function takes a frame of landed documents (JSON text in ``raw``, one API
response per row) and emits the common columns. A document is parsed once into
typed columns; the entries of all its record kinds are exploded together, and
titles and summaries are then plain column expressions. Nothing is shuffled.
A field of another type than expected is missing in its record; the rest of the
record and of the document stays, and ``mistyped`` lists the field. Only text that
is no JSON object goes to ``quarantine`` whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StructType, VariantType

from ..functions import payload as V
from ..functions import scalars as S
from ..operators import aggregates as G
from ..operators import joins
from ..session import scratch_path

NONE = "None"


def parsed(docs: DataFrame, schema: str) -> DataFrame:
    """Documents with their body in ``d``, which is NULL for an unreadable one.

    Every field is cast by itself, so one of another type is NULL and the others stay.
    """
    return docs.withColumn("d", F.try_variant_get(F.try_parse_json("raw"), "$", schema.strip()))


def _unread(value: Column, kind: DataType, path: str) -> list[Column]:
    """Paths of fields that are given but do not read as ``kind``: one text or NULL per field."""
    given = value.isNotNull() & ~F.is_variant_null(value)
    if isinstance(kind, VariantType):
        return []
    simple = "array<variant>" if isinstance(kind, ArrayType) else "struct<>" if isinstance(kind, StructType) else kind.simpleString()
    if isinstance(kind, StructType):
        wrong = given & ~F.schema_of_variant(value).startswith("OBJECT")
        inner = [p for f in kind.fields for p in _unread(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType, f"{path}.{f.name}")]
        return [F.when(wrong, path), *inner]
    if not isinstance(kind, ArrayType):
        return [F.when(given & F.try_variant_get(value, "$", simple).isNull(), path)]
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    found = F.when(given & ~is_list, path)
    entries = F.when(is_list, F.try_variant_get(value, "$", simple))

    def of_entry(entry: Column, i: Column) -> Column:
        parts = _unread(entry, kind.elementType, "")
        return F.transform(F.array_compact(F.array(*parts) if parts else F.array().cast("array<string>")), lambda p: F.concat(F.lit(path), F.lit("["), i.cast("string"), F.lit("]"), p))

    return [found, F.array_join(F.flatten(F.transform(entries, of_entry)), "\n")]


def mistyped(docs: DataFrame, schema: str) -> DataFrame:
    """The documents' columns and ``path``: a row per field that is given but was not read, as ``$.a.b[3].c``."""
    body = F.try_parse_json("raw")
    paths = F.filter(F.split(F.concat_ws("\n", *_unread(body, StructType.fromDDL(schema), "$")), "\n"), lambda p: p != "")
    return docs.select("*", F.explode(paths).alias("path"))


def readable(docs: DataFrame, schema: str) -> DataFrame:
    """Only the documents that can be read."""
    return parsed(docs, schema).filter(F.col("d").isNotNull())


def quarantine(docs: DataFrame, schema: str) -> DataFrame:
    """Only the documents that cannot be read: exactly those ``readable`` leaves out."""
    return parsed(docs, schema).filter(F.col("d").isNull()).drop("d")


def text(*parts) -> Column:
    """Concatenate text; a missing part reads as nothing."""
    return F.concat_ws("", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def shown(value: Column, missing: str = NONE) -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def items(array: Column) -> Column:
    """The array without missing entries, empty when there is none."""
    return F.filter(F.coalesce(array, F.array()), lambda e: e.isNotNull())


def joined(array: Column, separator: str = ", ") -> Column:
    return F.array_join(array, separator)


def record(record_id, title=None, summary=None, payload=None, disease=None, drug=None, gene=None) -> dict[str, Column]:
    """The parts of one record kind; absent parts are typed NULLs."""

    def string(value):
        return (F.lit(None) if value is None else value).cast("string")

    return {
        "record_id": string(record_id),
        "gene_symbol": string(gene),
        "disease": string(disease),
        "drug": string(drug),
        "title": string(title),
        "summary": string(summary),
        "payload": F.lit("{}") if payload is None else F.coalesce(F.to_json(payload), F.lit("{}")),
    }


def emit(
    docs: DataFrame, source_key: str, *kinds: dict[str, Column], kind: Column | None = None, payload: Column | None = None
) -> DataFrame:
    """Common columns from rows that each hold one record; ``kind`` numbers the kind of a row.

    ``payload`` is a VARIANT that stands for the payloads of the kinds.
    """

    def part(name: str) -> Column:
        out = kinds[0][name]
        for number, parts in enumerate(kinds[1:], start=1):
            out = F.when(kind == number, parts[name]).otherwise(out)
        return out.alias(name)

    names = ("gene_symbol", "disease", "drug", "title", "summary")
    return docs.select(
        part("record_id"), F.lit(source_key).alias("source_key"), *[part(n) for n in names],
        (F.parse_json(part("payload")) if payload is None else payload).alias("payload"),
    )


def emit_entries(
    docs: DataFrame, source_key: str, heads: dict[str, Column], *kinds: tuple[Column, Callable[[Column], dict[str, Column]]]
) -> DataFrame:
    """Explode the entries of several record kinds at once.

    ``heads`` are the document's own fields that its records show; only they
    travel with an entry, not the document. Each kind is an array and a function
    from an entry to its record.
    """

    def tagged(number: int, array: Column) -> Column:
        def entry(e: Column) -> Column:
            slots = [(e if i == number else F.lit(None)).alias(f"e{i}") for i in range(len(kinds))]
            return F.struct(F.lit(number).alias("kind"), *slots)

        return F.transform(array, entry)

    entries = F.concat(*[tagged(i, array) for i, (array, _) in enumerate(kinds)])
    rows = docs.select(*[c.alias(n) for n, c in heads.items()], entries.alias("_entries"))
    # An outer explode: the inner one adds a size filter below it that would parse each document again.
    rows = rows.select(*heads, F.explode_outer("_entries").alias("_e")).filter(F.col("_e").isNotNull()).select(*heads, "_e.*")
    return emit(rows, source_key, *[build(F.col(f"e{i}")) for i, (_, build) in enumerate(kinds)], kind=F.col("kind"))


def stamp(records: DataFrame) -> DataFrame:
    """Complete common records with ingestion metadata and the normalised gene key."""
    return records.withColumns({
        "ingested_at": F.current_timestamp(),
        "source_updated_at": F.lit(None).cast("timestamp"),
        "api_version": F.lit(None).cast("string"),
        "gene_key": F.upper("gene_symbol"),
    })


def cast_void(df: DataFrame) -> DataFrame:
    """Columns without a type (all NULL) become text."""
    voids = [f.name for f in df.schema.fields if isinstance(f.dataType, NullType)]
    return df.withColumns({name: F.col(name).cast("string") for name in voids}) if voids else df


def null_texts(df: DataFrame) -> DataFrame:
    """'None' and 'nan' in text columns become NULL."""
    names = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({name: S.null_text_to_null(name) for name in names})


# ---- target associations, drugs and tractability

TARGET_SCHEMA = """
target struct<id string, approvedSymbol string,
  associatedDiseases struct<rows array<struct<score double,
    disease struct<id string, name string, therapeuticAreas array<struct<id string, name string>>>>>>,
  drugAndClinicalCandidates struct<rows array<struct<maxClinicalStage string,
    drug struct<id string, name string, drugType string, maximumClinicalStage string>,
    diseases array<struct<disease struct<id string, name string>>>>>>,
  tractability array<struct<modality string, label string, value boolean>>>
"""


def target_records(docs: DataFrame) -> DataFrame:
    t = F.col("d.target")
    gene, target_id = F.col("gene"), F.col("target_id")

    def association(a: Column) -> dict[str, Column]:
        score = F.format_string("%.3f", F.coalesce(a["score"], F.lit(0.0)))
        areas = joined(items(a["disease"]["therapeuticAreas"])["name"])
        return record(
            text(target_id, "_", a["disease"]["id"]),
            text(gene, " ↔ ", shown(a["disease"]["name"]), " (score: ", score, ")"),
            text("OpenTargets association score ", score, ". Therapeutic areas: ", areas),
            a,
            disease=a["disease"]["name"],
            gene=gene,
        )

    def candidate(c: Column) -> dict[str, Column]:
        stage = F.coalesce(F.nullif(c["maxClinicalStage"], F.lit("")), c["drug"]["maximumClinicalStage"])
        listed = F.filter(items(c["diseases"]), lambda x: x["disease"].isNotNull())
        names = joined(F.transform(listed, lambda x: F.coalesce(x["disease"]["name"], F.lit(""))))
        return record(
            text(target_id, "_", F.coalesce(c["drug"]["id"], F.lit("unknown"))),
            text(shown(c["drug"]["name"]), " → ", gene, " (Phase ", F.coalesce(F.nullif(stage, F.lit("")), F.lit("?")), ")"),
            text("Drug type: ", shown(c["drug"]["drugType"]), ". Max clinical stage: ", shown(stage),
                 ". Diseases: ", F.coalesce(F.nullif(names, F.lit("")), F.lit("unknown")), "."),
            c,
            disease=F.get(c["diseases"], 0)["disease"]["name"],
            drug=c["drug"]["name"],
            gene=gene,
        )

    def tractability(assessed: Column) -> dict[str, Column]:
        return record(
            text(target_id, "_tractability"),
            text(gene, " Druggability/Tractability"),
            text("Tractability: ", F.to_json(G.last_by_modality(assessed))),
            F.struct(
                assessed.alias("tractability"),
                target_id.alias("target_id"),
                G.labels_by_modality(assessed).alias("modalities"),
            ),
            gene=gene,
        )

    return emit_entries(
        parsed(docs, TARGET_SCHEMA), "opentargets", {"gene": t["approvedSymbol"], "target_id": t["id"]},
        (items(t["associatedDiseases"]["rows"]), association),
        (items(t["drugAndClinicalCandidates"]["rows"]), candidate),
        (F.filter(F.array(items(t["tractability"])), lambda x: F.size(x) > 0), tractability),
    )


# ---- constraint, clinical and loss-of-function variants

VARIANT_SCHEMA = """
gene struct<symbol string, gene_id string, chrom string, start bigint, stop bigint, strand string, name string,
  gnomad_constraint struct<pLI double, oe_lof double, oe_lof_upper double, oe_mis double, mis_z double, lof_z double,
    obs_lof int, exp_lof double, obs_mis int, exp_mis double>,
  clinvar_variants array<struct<variant_id string, clinvar_variation_id string, clinical_significance string,
    major_consequence string, hgvsc string, hgvsp string, review_status string, gold_stars int, in_gnomad boolean, pos bigint,
    gnomad struct<exome struct<ac bigint, an bigint>, genome struct<ac bigint, an bigint>>>>,
  variants array<struct<variant_id string, consequence string, lof string, lof_filter string, lof_flags string,
    hgvsc string, hgvsp string,
    exome struct<ac bigint, an bigint, af double, homozygote_count bigint, populations array<struct<id string, af double>>>,
    genome struct<ac bigint, an bigint, af double, homozygote_count bigint, populations array<struct<id string, af double>>>>>>
"""

# Consequences that count as loss of function without a high-confidence flag.
LOF_CONSEQUENCES = ("frameshift_variant", "stop_gained", "splice_acceptor_variant", "splice_donor_variant")


def pli_label(pli: Column) -> Column:
    return (
        F.when(pli > 0.9, "highly intolerant to LoF (haploinsufficient)")
        .when(pli > 0.5, "moderately constrained")
        .otherwise("tolerant to LoF")
    )


def frequency_label(af: Column) -> Column:
    """Rarest class first; a zero frequency has none."""
    return (
        F.when(af <= 0, "").when(af < 0.0001, " (ultra-rare)").when(af < 0.001, " (rare)")
        .when(af > 0.01, " (common)").otherwise("")
    )


def is_lof(v: Column) -> Column:
    return F.coalesce(v["lof"] == "HC", F.lit(False)) | F.coalesce(v["consequence"].isin(*LOF_CONSEQUENCES), F.lit(False))


def frequency(counts: Column) -> Column:
    """Allele count over number, NULL when either is missing or zero."""
    return F.when((counts["ac"] > 0) & (counts["an"] > 0), counts["ac"] / counts["an"])


def nonzero(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def variant_records(docs: DataFrame) -> DataFrame:
    g = F.col("d.gene")
    symbol, gene_id = F.col("symbol"), F.col("gene_id")
    number = F.format_string
    place = ("chrom", "start", "stop", "strand")

    def constraint(c: Column) -> dict[str, Column]:
        pli = F.coalesce(c["pLI"], F.lit(0.0))
        return record(
            text(gene_id, "_constraint"),
            text(symbol, " Gene Constraint (gnomAD v4)"),
            text(
                "pLI=", number("%.4f", pli), " (", pli_label(pli), "). ",
                F.when(nonzero(c["oe_lof_upper"]).isNotNull(), text("LOEUF=", number("%.3f", c["oe_lof_upper"]), ". ")),
                F.when(nonzero(c["mis_z"]).isNotNull(), text("mis_z=", number("%.2f", c["mis_z"]), ". ")),
                "obs/exp LoF: ", shown(c["obs_lof"], "?"), "/",
                F.coalesce(F.when(c["exp_lof"].isNotNull(), number("%.1f", c["exp_lof"])), F.lit("?")),
                ". Location: chr", shown(F.col("chrom"), "?"), ":", shown(F.col("start"), "?"), "-", shown(F.col("stop"), "?"),
            ),
            F.struct(c.alias("constraint"), "gene_id", *place, "gene_name"),
            gene=symbol,
        )

    def clinical(v: Column) -> dict[str, Column]:
        sig = F.coalesce(v["clinical_significance"], F.lit("unknown"))
        variant_id = F.coalesce(v["variant_id"], F.lit("unknown"))
        name = F.coalesce(F.nullif(v["hgvsp"], F.lit("")), F.nullif(v["hgvsc"], F.lit("")), variant_id)
        af = F.coalesce(frequency(v["gnomad"]["exome"]), frequency(v["gnomad"]["genome"]), F.lit(0.0))
        return record(
            text(gene_id, "_clinvar_", F.coalesce(v["clinvar_variation_id"], variant_id)),
            text(symbol, " ", name, " — ", sig),
            text(
                "ClinVar: ", sig, " (", v["review_status"], ", ", F.coalesce(v["gold_stars"], F.lit(0)), " stars). Consequence: ",
                v["major_consequence"], ". gnomAD AF: ", number("%.6f", af), frequency_label(af), ". In gnomAD: ",
                F.when(v["in_gnomad"], "Yes").otherwise("No"),
            ),
            v,
            gene=symbol,
        )

    def lof(v: Column) -> dict[str, Column]:
        ex, ge = v["exome"], v["genome"]
        af = F.coalesce(nonzero(ex["af"]), nonzero(ge["af"]), F.lit(0.0))
        ac = F.coalesce(nonzero(ex["ac"]), nonzero(ge["ac"]), F.lit(0))
        zero = F.lit(0).cast("bigint")
        hom = F.coalesce(ex["homozygote_count"], zero) + F.coalesce(ge["homozygote_count"], zero)
        listed = F.when(F.size(items(ex["populations"])) > 0, ex["populations"]).otherwise(ge["populations"])
        present = F.filter(items(listed), lambda p: p["af"] > 0)
        pops = F.map_from_entries(F.transform(present, lambda p: F.struct(p["id"], p["af"])))
        return record(
            text(gene_id, "_plof_", F.coalesce(v["variant_id"], F.lit("unknown"))),
            text(symbol, " pLoF: ", F.coalesce(v["variant_id"], F.lit("unknown")), " (", v["consequence"], ")"),
            text(
                "Predicted LoF (", v["lof"], "): ", v["consequence"], ". AF=", number("%.6f", af), ", AC=", ac, ", Hom=", hom,
                ". Filter: ", F.coalesce(F.nullif(v["lof_filter"], F.lit("")), F.lit("PASS")), ". Pops: ",
                F.when(F.size(present) > 0, F.to_json(pops)).otherwise("rare across all"),
            ),
            F.struct(
                v["variant_id"].alias("variant_id"), v["consequence"].alias("consequence"), v["lof"].alias("lof"),
                v["lof_filter"].alias("lof_filter"), v["lof_flags"].alias("lof_flags"), v["hgvsc"].alias("hgvsc"),
                v["hgvsp"].alias("hgvsp"), ex["af"].alias("exome_af"), ex["ac"].alias("exome_ac"),
                ge["af"].alias("genome_af"), ge["ac"].alias("genome_ac"), hom.alias("homozygote_count"),
                pops.alias("populations"),
            ),
            gene=symbol,
        )

    heads = {
        "symbol": F.upper(F.coalesce(g["symbol"], F.lit(""))), "gene_id": F.coalesce(g["gene_id"], F.lit("")),
        **{name: g[name] for name in place}, "gene_name": g["name"],
    }
    return emit_entries(
        parsed(docs, VARIANT_SCHEMA), "gnomad", heads,
        (items(F.array(g["gnomad_constraint"])), constraint),
        (items(g["clinvar_variants"]), clinical),
        (F.filter(items(g["variants"]), is_lof), lof),
    )


# ---- pathways

HUMAN_SUFFIX = " - Homo sapiens (human)"


def without_suffix(name: Column) -> Column:
    return F.trim(F.replace(name, F.lit(HUMAN_SUFFIX), F.lit("")))


def pathway_records(memberships: DataFrame) -> DataFrame:
    """From (gene_symbol, pathway_id, kegg_gene_id, entry), entry being a parsed flat record."""
    name = without_suffix(F.coalesce(F.col("entry")["NAME"], F.lit("unknown")))
    kind = F.coalesce(F.col("entry")["CLASS"], F.lit(""))
    description = F.coalesce(F.col("entry")["DESCRIPTION"], F.lit(""))
    gene, pathway = F.col("gene_symbol"), F.col("pathway_id")
    entry = record(
        text("kegg_", pathway, "_", gene),
        text(gene, " in ", name, " (", pathway, ")"),
        text("Pathway: ", name, ". Class: ", kind, ".",
             F.when(description != "", text(" Description: ", F.left(description, F.lit(200))))),
        F.struct(pathway.alias("pathway_id"), name.alias("pathway_name"), kind.alias("class"), description.alias("description"),
                 F.col("kegg_gene_id")),
        gene=gene,
    )
    return emit(memberships, "kegg", entry)


def pathway_link_records(links: DataFrame, names: DataFrame) -> DataFrame:
    """From gene-pathway links and a pathway name list; a pathway without a name shows its id."""
    once = links.groupBy("gene_symbol", "pathway_id").agg(F.array_sort(F.collect_set("kegg_gene_id")).alias("kegg_gene_ids"))
    known = names.select("pathway_id", without_suffix(F.col("pathway_name")).alias("pathway_name"))
    named = joins.lookup_or_key(once, known, "pathway_id", "pathway_name")
    entry = record(
        text("kegg_", F.col("pathway_id"), "_", F.col("gene_symbol")),
        F.col("pathway_name"),
        text("KEGG pathway ", F.col("pathway_id"), ": ", F.col("pathway_name")),
        F.struct("pathway_id", "pathway_name", "kegg_gene_ids"),
        gene=F.col("gene_symbol"),
    )
    return emit(named, "kegg", entry)


REACTOME_SCHEMA = """
gene_symbol string, pathways array<struct<stId string, dbId string, displayName string, name string, speciesName string,
  schemaClass string, compartment array<struct<displayName string>>>>
"""


def reactome_records(docs: DataFrame) -> DataFrame:
    gene = F.col("gene")

    def pathway(p: Column) -> dict[str, Column]:
        pathway_id = F.coalesce(p["stId"], p["dbId"], F.lit(""))
        name = F.coalesce(p["displayName"], p["name"], F.lit("unknown"))
        places = F.transform(F.slice(items(p["compartment"]), 1, 3), lambda c: F.coalesce(c["displayName"], F.lit("")))
        return record(
            text("reactome_", pathway_id, "_", gene),
            text(gene, " in ", name),
            text("Pathway: ", name, " (", pathway_id, "). Species: ", p["speciesName"], ". Compartment: ", joined(places),
                 ". Category: ", F.coalesce(p["schemaClass"], F.lit("Pathway"))),
            F.struct(pathway_id.alias("pathway_id"), name.alias("pathway_name"), p["speciesName"].alias("species"),
                     p["schemaClass"].alias("schema_class")),
            gene=gene,
        )

    heads = {"gene": F.upper(F.col("d.gene_symbol"))}
    return emit_entries(parsed(docs, REACTOME_SCHEMA), "reactome", heads, (items(F.col("d.pathways")), pathway))


# ---- somatic mutations

MUTATION_SCHEMA = """
gene_symbol string, study_id string, profile_id string,
gene_meta struct<entrezGeneId bigint, chromosome string, cytoband string, type string>,
mutations array<struct<mutationType string, mutationStatus string, sampleId string, proteinChange string>>
"""


def gene_info_records(docs: DataFrame) -> DataFrame:
    """One entry per gene, whatever its number of studies."""
    d = readable(docs, MUTATION_SCHEMA)
    genes = d.groupBy(F.col("d.gene_symbol").alias("gene")).agg(F.min(F.col("d.gene_meta")).alias("m"))
    m = F.col("m")
    entry = record(
        text("cbio_gene_", F.coalesce(m["entrezGeneId"].cast("string"), F.col("gene"))),
        text(F.col("gene"), " — cBioPortal Gene Entry"),
        text("Entrez: ", shown(m["entrezGeneId"]), " | Chr: ", shown(m["chromosome"], "?"), " ", m["cytoband"],
             " | Type: ", shown(m["type"], "unknown")),
        m,
        gene=F.col("gene"),
    )
    return emit(genes, "cbioportal", entry)


def mutation_rows(docs: DataFrame) -> DataFrame:
    """Single mutations with their position in the response."""
    d = parsed(docs, MUTATION_SCHEMA)
    rows = d.select(
        F.col("d.gene_symbol").alias("gene_symbol"),
        F.col("d.study_id").alias("study_id"),
        F.col("d.profile_id").alias("profile_id"),
        F.col("d.gene_meta.entrezGeneId").alias("entrez_id"),
        # Without a study nothing is exploded: a filter on the study would move below and parse every document again.
        F.posexplode_outer(F.when(F.col("d.study_id").isNotNull(), items(F.col("d.mutations")))).alias("position", "m"),
    ).filter(F.col("m").isNotNull())
    kind = F.coalesce(F.nullif("m.mutationType", F.lit("")), F.nullif("m.mutationStatus", F.lit("")), F.lit("Unknown"))
    return rows.select(
        "gene_symbol", "study_id", "profile_id", "entrez_id", "position", kind.alias("mutation_type"),
        F.nullif("m.sampleId", F.lit("")).alias("sample_id"), F.nullif("m.proteinChange", F.lit("")).alias("protein_change"),
    )


# What a study's document consists of, in this order: the head, its changes, the next list's head, its mutations, the end.
HEAD, CHANGE, NEXT, ROW, END = range(5)
ENTRY = ["position", "mutation_type", "sample_id", "protein_change"]
STUDY_DOCUMENT = "record_id string, gene_symbol string, title string, summary string, payload variant, alone bigint"


def study_documents(
    mutations: DataFrame, studies: DataFrame, keys: list[str], changes_kept: int | None, sample_rows: int | None
) -> DataFrame:
    """The JSON documents of studies, written from sorted pieces and read as rows whose payload is a VARIANT.

    ``mutations`` say in ``kinds`` which lists they belong to; ``studies`` have the opened document in ``head``, their
    own ``number``, and one above 0 in ``alone`` if they get a file of their own. No task gathers a list: pieces are
    sorted, which may spill, and written one after the other. A file of one study is parsed while it is read, so its
    text is never held as a whole; the other documents are lines.
    """
    spark = mutations.sparkSession
    heads = studies.withColumn("kinds", F.array(F.lit(HEAD), F.lit(NEXT), F.lit(END)))
    pieces = mutations.join(studies.drop("head"), keys).unionByName(heads, allowMissingColumns=True).drop(*keys)
    # One task writes a study. Equal mutations are told apart, so that the order is the same whoever sorts.
    pieces = pieces.repartition("number").withColumn("kind", F.explode("kinds")).withColumn("tie", F.monotonically_increasing_id())
    group, order = ["alone", "number", "kind"], [*ENTRY, "tie"]
    pieces = pieces.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    for kind, n in ((CHANGE, changes_kept), (ROW, sample_rows)):
        if n is not None:
            pieces = pieces.filter((F.col("kind") != kind) | (F.col("rank") <= n))
    comma = F.when(F.col("rank") > 1, ",").otherwise("")
    change = F.to_json(F.array("protein_change"))
    piece = (
        F.when(F.col("kind") == CHANGE, F.concat(comma, change.substr(F.lit(2), F.length(change) - 2)))
        .when(F.col("kind") == ROW, F.concat(comma, F.to_json(F.struct(*ENTRY))))
        .when(F.col("kind") == HEAD, F.concat("head", F.lit(',"top_protein_changes":[')))
        .when(F.col("kind") == NEXT, F.lit('],"mutations_sample":['))
        .otherwise(F.lit("]}}\n"))
    )
    stored = scratch_path(spark, "studies")
    # The window's own order: nothing is sorted again, and the writer keeps it.
    pieces.sortWithinPartitions(*group, *order).select(piece.alias("value"), "alone").write.partitionBy("alone").text(
        stored, compression="gzip", lineSep=" "
    )

    def read(whole_files: bool) -> DataFrame:
        # A payload above the greatest size of a VARIANT is an error, not a missing one.
        return spark.read.json(stored, STUDY_DOCUMENT, multiLine=whole_files, mode="FAILFAST")

    return read(False).filter("alone = 0").unionAll(read(True).filter("alone > 0"))


def study_records(
    rows: DataFrame, changes_shown: int = 10, changes_kept: int | None = None, sample_rows: int | None = None,
    alone_from: int = 100_000,
) -> DataFrame:
    """One summary per gene and study.

    Counts come from pre-aggregated types and samples. The payload lists all
    changes and mutation rows of a study, or the first ones if numbers are given;
    then they are cut before they are listed, so a study holding most mutations
    never meets in one task. The summary names the first ``changes_shown``.
    The mutations are stored in the scratch folder first: types, samples and lists
    each read them, and documents are parsed once. So are the payloads, those of studies
    of ``alone_from`` mutations or more in files of their own (see ``study_documents``).
    """
    keys = ["gene_symbol", "study_id"]
    spark = rows.sparkSession
    stored = scratch_path(spark, "mutations")
    rows.write.parquet(stored)
    rows = spark.read.parquet(stored)
    # One shuffle of the mutations serves the type counts and the sample counts.
    per_sample = rows.groupBy(*keys, "mutation_type", "sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("p"), F.min("profile_id").alias("profile_id"),
        F.min("entrez_id").alias("entrez_id"),
    )
    types = (
        per_sample.groupBy(*keys, "mutation_type")
        .agg(F.sum("n").alias("n"), F.min("p").alias("p"), F.min("profile_id").alias("profile_id"),
             F.min("entrez_id").alias("entrez_id"))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_mutations"),
            F.max_by("mutation_type", F.struct("n", -F.col("p"), "mutation_type")).alias("dominant"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("mutation_type", "n")))).alias("mutation_types"),
            F.min("profile_id").alias("molecular_profile_id"),
            F.min("entrez_id").alias("entrez_id"),
        )
    )
    samples = per_sample.groupBy(*keys).agg(F.countDistinct("sample_id").alias("n_samples_affected"))
    gene, study = F.col("gene_symbol"), F.col("study_id")
    entry = record(
        text("cbio_", gene, "_", study),
        text(gene, " somatic mutations in ", study, " — ", F.col("n_mutations"), " events, ", F.col("n_samples_affected"), " samples"),
        text("Gene: ", gene, " | Study: ", study, " | Mutations: ", F.col("n_mutations"), " | Samples: ", F.col("n_samples_affected"),
             " | Dominant type: ", F.col("dominant"), " | Types: ", F.to_json("mutation_types"), " | Top protein changes: "),
        gene=gene,
    )
    payload = F.struct("gene_symbol", "entrez_id", "study_id", "molecular_profile_id", "n_mutations", "n_samples_affected", "mutation_types")
    shown_first = [entry[name].alias(name) for name in ("record_id", "gene_symbol", "title", "summary")]
    document = F.to_json(F.struct(*shown_first, payload.alias("payload")))
    stored = scratch_path(spark, "heads")
    types.join(samples, keys).select(
        *keys,
        document.substr(F.lit(1), F.length(document) - 2).alias("head"),
        F.monotonically_increasing_id().alias("number"), (F.col("n_mutations") >= alone_from).alias("large"),
    ).select(
        *keys, "head", "number", F.when(F.col("large"), F.col("number") + 1).otherwise(0).alias("alone")
    ).write.parquet(stored)
    # Both lists come from one ranking: each mutation competes as a row and, if it names one, as a change. Uncut, it travels once.
    kinds = F.array_compact(F.array(F.when(F.col("protein_change").isNotNull(), CHANGE), F.lit(ROW)))
    cut = None if None in (changes_kept, sample_rows) else max(changes_kept, sample_rows)
    shares = F.array(kinds) if cut is None else F.transform(kinds, lambda kind: F.array(kind))
    first = G.keep_first_n(
        rows.select(*keys, *ENTRY, F.explode(shares).alias("kinds")), [*keys, "kinds"], cut, F.col("position").asc(),
    )
    documents = study_documents(first, spark.read.parquet(stored), keys, changes_kept, sample_rows)
    changes = F.array(*[V.field(f"top_protein_changes[{i}]") for i in range(changes_shown)])
    entry = record(F.col("record_id"), F.col("title"), text(F.col("summary"), joined(changes)), gene=F.col("gene_symbol"))
    return emit(documents, "cbioportal", entry, payload=F.col("payload"))


def rollup_records(rolled: DataFrame) -> DataFrame:
    """Records of a mutation rollup: one per gene, type and protein change."""
    entry = record(
        text("cbio_", F.col("gene_symbol"), "_", F.col("mutation_type"), "_", F.col("protein_change")),
        F.col("title"),
        text(F.col("mutation_type"), " (", F.col("sample_count"), " samples, TCGA Pan-Cancer)"),
        F.struct("mutation_type", "protein_change", F.lit("TCGA PanCancer Atlas 2018").alias("cancer_study"), "sample_count", "cancer_types"),
        disease=F.col("disease"),
        gene=F.col("gene_symbol"),
    )
    return emit(rolled, "cbioportal", entry)


# ---- proteins

PROTEIN_SCHEMA = """
gene_symbol string, results array<struct<primaryAccession string,
  proteinDescription struct<recommendedName struct<fullName struct<value string>>>,
  organism struct<scientificName string>, sequence struct<length bigint>,
  keywords array<struct<name string, value string>>,
  comments array<struct<commentType string, texts array<struct<value string>>,
    subcellularLocations array<struct<location struct<value string>>>, disease struct<diseaseId string>>>>>
"""


def protein_records(docs: DataFrame) -> DataFrame:
    gene = F.col("gene")

    def protein(e: Column) -> dict[str, Column]:
        comments = items(e["comments"])

        def of_kind(kind: str) -> Column:
            return F.filter(comments, lambda c: c["commentType"] == kind)

        def nested(kind: str, inner) -> Column:
            return F.flatten(F.transform(of_kind(kind), inner))

        accession = F.coalesce(e["primaryAccession"], F.lit(""))
        name = F.coalesce(e["proteinDescription"]["recommendedName"]["fullName"]["value"], F.lit(""))
        functions = nested("FUNCTION", lambda c: F.transform(items(c["texts"]), lambda x: F.coalesce(x["value"], F.lit(""))))
        places = F.filter(
            nested("SUBCELLULAR LOCATION", lambda c: F.transform(items(c["subcellularLocations"]), lambda x: x["location"]["value"])),
            lambda v: v != "",
        )
        diseases = F.filter(F.transform(of_kind("DISEASE"), lambda c: c["disease"]["diseaseId"]), lambda v: v != "")
        keywords = joined(F.transform(items(e["keywords"]), lambda k: F.coalesce(F.nullif(k["name"], F.lit("")), k["value"], F.lit(""))))
        first = F.get(functions, 0)
        return record(
            text("uniprot_", accession),
            text(gene, " (", accession, ") — ", name),
            text("Function: ", F.coalesce(F.left(first, F.lit(300)), F.lit("N/A")), ". Location: ",
                 joined(F.slice(places, 1, 5)), ". Diseases: ",
                 F.coalesce(F.nullif(joined(F.slice(diseases, 1, 5)), F.lit("")), F.lit("none")), ". Length: ",
                 shown(e["sequence"]["length"], "?"), " aa"),
            F.struct(
                accession.alias("accession"), name.alias("protein_name"), first.alias("function"),
                functions.alias("functions"), joined(places, "; ").alias("subcellular_location"),
                places.alias("locations"), diseases.alias("diseases"), e["sequence"]["length"].alias("length"),
                F.coalesce(e["organism"]["scientificName"], F.lit("")).alias("organism"), keywords.alias("keywords"),
            ),
            disease=F.nullif(joined(F.slice(diseases, 1, 3), "; "), F.lit("")),
            gene=gene,
        )

    heads = {"gene": F.upper(F.col("d.gene_symbol"))}
    return emit_entries(parsed(docs, PROTEIN_SCHEMA), "uniprot", heads, (items(F.col("d.results")), protein))


# ---- genetic tests

TEST_SCHEMA = """
uid string, _query_gene string, testname string, accession string, testtype string,
analytes array<struct<analytetype string, name string>>, conditionlist variant, conditionname variant, title string, gtid string,
offerer string, labname string, country string, orderurl string,
offererlocation struct<city string, state string, country string>,
method variant, testpurpose variant, analyticalvalidity string, clinicalutility string, raw_summary variant
"""


def stripped(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def named(value: Column) -> Column:
    """Names in a field that is one text, a list of texts, a list of named objects, or such a list written as text."""
    written = F.try_variant_get(value, "$", "string")
    value = F.when(F.schema_of_variant(value) == "STRING", F.coalesce(F.when(written.startswith("["), F.try_parse_json(written)), value)).otherwise(value)
    entries = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    kind = F.schema_of_variant
    one = lambda e: F.when(kind(e).startswith("OBJECT"), F.try_variant_get(e, "$.name", "string")).otherwise(F.try_variant_get(e, "$", "string"))
    names = F.transform(entries, lambda e: stripped(F.when(~F.is_variant_null(e), one(e))))
    return F.filter(names, lambda n: n != "")


def test_records(docs: DataFrame) -> DataFrame:
    """Conditions, methods and purposes may be plain text, a list of texts or a list of named objects."""
    t = F.col("d")
    query_gene = F.coalesce(t["_query_gene"], F.lit(""))
    name = stripped(F.coalesce(F.nullif(t["testname"], F.lit("")), t["title"]))
    accession = stripped(F.coalesce(F.nullif(t["accession"], F.lit("")), F.nullif(t["gtid"], F.lit("")), text("GTR", t["uid"])))
    kind = stripped(t["testtype"])

    def names(array: Column) -> Column:
        return F.filter(F.transform(items(array), lambda x: x["name"]), lambda n: n != "")

    genes = names(F.filter(items(t["analytes"]), lambda a: a["analytetype"] == "Gene"))
    none = F.array().cast("array<string>")
    method = joined(F.coalesce(named(t["method"]), none), "; ")
    listed = F.coalesce(named(t["conditionlist"]), none)
    conditions = F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(named(t["conditionname"]), none))
    lab = stripped(F.coalesce(F.nullif(t["offerer"], F.lit("")), t["labname"]))
    place = t["offererlocation"]
    country = stripped(F.coalesce(F.nullif(t["country"], F.lit("")), place["country"]))
    location = joined(F.filter(F.array(stripped(place["city"]), stripped(place["state"]), country), lambda p: p != ""))

    def given(value: Column, missing: str = "Not specified") -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(missing))

    entry = record(
        text("gtr_", t["uid"]),
        text(name, " [", accession, "]"),
        text("Test: ", given(name, "N/A"), " | Gene(s): ", F.coalesce(F.nullif(joined(genes), F.lit("")), query_gene),
             " | Conditions: ", given(joined(F.slice(conditions, 1, 3))), " | Method: ", given(method),
             " | Type: ", given(kind), " | Lab: ", given(lab), F.when(location != "", text(" (", location, ")"))),
        F.struct(
            t["uid"].alias("gtr_id"), accession.alias("accession"), name.alias("test_name"), kind.alias("test_type"),
            joined(F.coalesce(named(t["testpurpose"]), none), "; ").alias("test_purpose"), genes.alias("genes_tested"),
            conditions.alias("conditions"), method.alias("method"), lab.alias("lab_name"), country.alias("lab_country"),
            stripped(place["state"]).alias("lab_state"), stripped(place["city"]).alias("lab_city"),
            F.coalesce(t["orderurl"], F.lit("")).alias("order_url"),
            F.coalesce(t["analyticalvalidity"], F.lit("")).alias("analytical_validity"),
            F.coalesce(t["clinicalutility"], F.lit("")).alias("clinical_utility"), t["raw_summary"].alias("raw_summary"),
        ),
        disease=F.get(conditions, 0),
        gene=F.coalesce(F.get(genes, 0), query_gene),
    )
    return emit(readable(docs, TEST_SCHEMA), "ncbi_gtr", entry)


# ---- clinical evidence

EVIDENCE_SCHEMA = """
gene struct<name string, variants struct<nodes array<struct<id bigint, name string, variantTypes array<struct<name string>>,
  singleVariantMolecularProfile struct<molecularProfileScore double, evidenceItems struct<nodes array<struct<id bigint,
    evidenceLevel string, evidenceType string, significance string, description string, disease struct<name string>,
    therapies array<struct<name string>>>>>>>>>>
"""


def evidence_records(docs: DataFrame) -> DataFrame:
    """Variants and the evidence nested under each of them."""
    gene = F.col("gene")

    def variant(v: Column) -> dict[str, Column]:
        return record(
            text("civic_variant_", v["id"]),
            text(gene, " ", v["name"]),
            text("Variant types: ", joined(items(v["variantTypes"])["name"]), ". MP score: ",
                 shown(v["singleVariantMolecularProfile"]["molecularProfileScore"], "N/A")),
            v,
            gene=gene,
        )

    def evidence(pair: Column) -> dict[str, Column]:
        e = pair["item"]
        disease = F.coalesce(e["disease"]["name"], F.lit(""))
        therapies = F.nullif(joined(items(e["therapies"])["name"]), F.lit(""))
        return record(
            text("civic_evidence_", e["id"]),
            text(gene, " ", pair["variant"], " — Level ", shown(e["evidenceLevel"], "?"), " (", e["evidenceType"], ")"),
            text(e["significance"], ". Disease: ", disease, ". Therapies: ", shown(therapies, "none"), ". ",
                 F.left(F.coalesce(e["description"], F.lit("")), F.lit(200))),
            e,
            disease=disease,
            drug=therapies,
            gene=gene,
        )

    nodes = items(F.col("d.gene.variants.nodes"))
    nested = F.flatten(
        F.transform(
            nodes,
            lambda v: F.transform(
                items(v["singleVariantMolecularProfile"]["evidenceItems"]["nodes"]),
                lambda e: F.struct(v["name"].alias("variant"), e.alias("item")),
            ),
        )
    )
    heads = {"gene": F.col("d.gene.name")}
    return emit_entries(parsed(docs, EVIDENCE_SCHEMA), "civic", heads, (nodes, variant), (nested, evidence))


# ---- phenotype and disease associations

ASSOCIATION_SCHEMA = """
gene_symbol string, gene_id string,
phenotypes array<struct<id string, object string, object_label string, category string, primary_knowledge_source string>>,
associations array<struct<id string, object string, object_label string, category string, primary_knowledge_source string>>
"""


def phenotype_records(docs: DataFrame) -> DataFrame:
    """Phenotypes, then the other associations whose id is no phenotype's (missing ids are equal)."""
    d = F.col("d")
    gene, gene_id = F.col("gene"), F.col("gene_id")

    def label(a: Column) -> Column:
        return F.coalesce(a["object_label"], a["object"], F.lit(""))

    def source(a: Column) -> Column:
        return shown(a["primary_knowledge_source"], "N/A")

    def phenotype(a: Column) -> dict[str, Column]:
        return record(
            text("monarch_", gene_id, "_pheno_", a["object"]),
            text(gene, " → ", label(a), " (phenotype)"),
            text("Phenotype association: ", label(a), ". ID: ", a["object"], ". Source: ", source(a)),
            a,
            gene=gene,
        )

    def association(a: Column) -> dict[str, Column]:
        return record(
            text("monarch_", gene_id, "_", a["object"]),
            text(gene, " ↔ ", label(a)),
            text("Disease association. Category: ", a["category"], ". Source: ", source(a)),
            a,
            disease=label(a),
            gene=gene,
        )

    phenotypes = items(d["phenotypes"])
    others = F.filter(
        items(d["associations"]), lambda a: ~F.exists(phenotypes, lambda p: p["id"].eqNullSafe(a["id"]))
    )
    heads = {"gene": F.upper(d["gene_symbol"]), "gene_id": d["gene_id"]}
    return emit_entries(parsed(docs, ASSOCIATION_SCHEMA), "monarch", heads, (phenotypes, phenotype), (others, association))


# ---- protein atlas

ATLAS_SCHEMA = """
gene_symbol string, Gene string, `Gene description` string, `Protein class` array<string>, Chromosome string, Antibody string,
`Molecular function` array<string>, `Biological process` array<string>, `Disease involvement` array<string>,
`RNA tissue specific nTPM` map<string, string>, `RNA tissue specificity` string, `Subcellular location` array<string>,
`Subcellular main location` array<string>
"""

# Keys kept in the summary payload.
ATLAS_KEPT = (
    "Gene", "Gene description", "Protein class", "Chromosome", "Molecular function", "Biological process",
    "Disease involvement",
)


def atlas_records(docs: DataFrame) -> DataFrame:
    """A summary, one record per tissue and one per location (text or object)."""
    d = F.col("d")
    gene = F.col("gene")

    def summary(k: Column) -> dict[str, Column]:
        return record(
            text("hpa_", gene, "_summary"),
            text(gene, " — Human Protein Atlas"),
            text("Name: ", k["Gene description"], ". Protein class: ", joined(items(k["Protein class"])), ". Chromosome: ",
                 k["Chromosome"], ". Antibody: ", shown(F.col("antibody"), "N/A")),
            k,
            gene=gene,
        )

    def tissue(e: Column) -> dict[str, Column]:
        return record(
            text("hpa_", gene, "_tissue_", e["key"]),
            text(gene, " in ", e["key"], ": ", e["value"], " nTPM"),
            text("Tissue: ", e["key"], ". RNA expression: ", e["value"], " nTPM. Specificity: ",
                 shown(F.col("specificity"), "N/A")),
            F.struct(e["key"].alias("tissue"), e["value"].alias("nTPM")),
            gene=gene,
        )

    def place(raw: Column) -> dict[str, Column]:
        named = F.coalesce(F.get_json_object(raw, "$.location"), F.get_json_object(raw, "$.Location"), F.lit("unknown"))
        name = F.when(raw.startswith("{"), named).otherwise(raw)
        return record(
            text("hpa_", gene, "_loc_", name),
            text(gene, " localization: ", name),
            text("Subcellular location: ", name, ". Main locations: ", joined(items(F.col("main_locations")))),
            F.struct(name.alias("location")),
            gene=gene,
        )

    heads = {
        "gene": F.upper(d["gene_symbol"]), "antibody": d["Antibody"], "specificity": d["RNA tissue specificity"],
        "main_locations": d["Subcellular main location"],
    }
    kept = F.when(d.isNotNull(), F.struct(*[d[k].alias(k) for k in ATLAS_KEPT]))
    tissues = F.map_entries(F.coalesce(d["RNA tissue specific nTPM"], F.create_map().cast("map<string,string>")))
    return emit_entries(
        parsed(docs, ATLAS_SCHEMA), "human_protein_atlas", heads,
        (items(F.array(kept)), summary), (tissues, tissue), (items(d["Subcellular location"]), place),
    )
