"""Case builders of the effect track: answers of public services to case rows.

Each builder takes answers as text (query, text), reads them by a stated schema
and gives one row a record; what a source can prove at all is a table of fixed
labels, so a builder is a projection. Records without an id are left out, ids
run in the order of the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.keys import union_all, with_order
from lectern.operators.projections import envelope
from lectern.operators.ordering import positions

NO_EFFECT = "no_known_human_effect_evidence"
# What a record of each source can show (evidence level, direction, claim status, safety status, evidence type).
PROOF = {
    "dailymed": ("approved_human_indication", "positive", "supported", "known_acceptable_under_approved_use", "official_label_reference"),
    "clinicaltrials": ("human_clinical_evidence", "not_reported", "plausible_but_unproven", "insufficient_safety_data", "clinical_trial_record"),
    "gene_ontology": ("mechanistic_pathway_or_similarity_hypothesis", "not_applicable", "plausible_but_unproven", "insufficient_safety_data", "ontology_reference"),
    "reactome": ("mechanistic_pathway_or_similarity_hypothesis", "not_applicable", "plausible_but_unproven", "insufficient_safety_data", "pathway_reference"),
    "negative_query": ("unsupported_contradicted_or_unsafe_claim", "not_applicable", "insufficient_information", "insufficient_safety_data", "negative_source_query"),
}
# Public pages of the records.
PAGES = {
    "dailymed": "https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid=%s",
    "clinicaltrials": "https://clinicaltrials.gov/study/%s",
    "gene_ontology": "https://www.ebi.ac.uk/QuickGO/term/%s",
    "reactome": "https://reactome.org/content/detail/%s",
}
CLAIMS = {
    "dailymed": "An official label supports an approved indication.",
    "clinicaltrials": "A trial is on record; its outcome can't be inferred without results.",
    "gene_ontology": "An ontology term gives context of a pathway or mechanism only.",
    "reactome": "A pathway gives context only.",
    "negative_query": "No source record supports a claim for this sequence.",
}
LABELS = "data array<struct<setid:string,spl_version:string,title:string>>"
STUDIES = "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string>,statusModule:struct<overallStatus:string>,designModule:struct<phases:array<string>>>,hasResults:boolean>>"
TERMS = "numberOfHits int, results array<struct<id:string,name:string>>"
PATHWAYS = "results array<struct<entries:array<struct<stId:string,dbId:string,name:string>>>>"
REFERENCE_ONLY = "SOURCE_REFERENCE_ONLY"


def _rows(source: str, found: DataFrame, **own: Column) -> DataFrame:
    """Case rows of ``found`` (ord, source_id, group, family, n and what ``own`` needs)."""
    level, direction, claim, safety, kind = PROOF[source]
    fields = {
        "track": F.lit("human_effect"),
        "source_database": F.lit("clinicaltrials" if source == "negative_query" else source),
        "source_url": F.format_string(PAGES[source], "source_id") if source in PAGES else F.lit(None).cast("string"),
        "release_mode": F.lit("source_reference_only"),
        "qc_status": F.lit("source_checked"),
        "sequence": F.lit(REFERENCE_ONLY),
        "claim_text": F.lit(CLAIMS[source]),
        "category": F.lit(NO_EFFECT),
        "evidence_level": F.lit(level),
        "evidence_direction": F.lit(direction),
        "claim_status": F.lit(claim),
        "safety_status": F.lit(safety),
        "source_evidence_type": F.lit(kind),
        "source_result_count": F.col("n").cast("int"),
        "trial_status": F.lit(None).cast("string"),
        "trial_phase": F.lit(None).cast("string"),
        "trial_has_results": F.lit(None).cast("boolean"),
        "mechanism_support": F.lit(None).cast("string"),
        "leakage_group": F.struct(F.col("group").alias("peptide_cluster"), F.col("family").alias("target_family")),
        **own,
    }
    return found.where("source_id is not null and source_id <> ''").select("ord", "source_id", *[c.alias(n) for n, c in fields.items()])


def _answers(answers: DataFrame, schema: str) -> DataFrame:
    return with_order(answers).select("ord", "query", F.from_json("text", schema).alias("a"))


def label_cases(answers: DataFrame, categories: DataFrame) -> DataFrame:
    """First label of each drug (answers to its name as query); ``categories`` (query, category) says what it treats."""
    first = _answers(answers, LABELS).withColumn("r", F.get("a.data", F.lit(0))).join(categories, "query")
    found = first.select(F.struct("ord", F.lit(0).alias("at")).alias("ord"), F.col("r.setid").alias("source_id"), F.col("query").alias("group"), F.col("category").alias("family"), F.size("a.data").alias("n"))
    return _rows("dailymed", found, category=F.col("family"))


def _exploded(answers: DataFrame, schema: str, items: Column) -> DataFrame:
    return _answers(answers, schema).select("ord", "a", F.posexplode(items).alias("at", "r")).withColumn("ord", F.struct("ord", "at"))


def trial_cases(answers: DataFrame) -> DataFrame:
    """Each trial; a direction is inconclusive where results are posted, else not reported."""
    rows = _exploded(answers, STUDIES, F.col("a.studies"))
    p = "r.protocolSection"
    found = rows.select("ord", F.col(f"{p}.identificationModule.nctId").alias("source_id"), F.col(f"{p}.identificationModule.nctId").alias("group"), F.lit("clinical_trial_record").alias("family"), F.size("a.studies").alias("n"), F.coalesce("r.hasResults", F.lit(False)).alias("results"), F.col(f"{p}.statusModule.overallStatus").alias("state"), F.col(f"{p}.designModule.phases").alias("phases"))
    return _rows("clinicaltrials", found, evidence_direction=F.when(F.col("results"), "inconclusive").otherwise("not_reported"), trial_status=F.col("state"), trial_phase=F.nullif(F.array_join("phases", ";"), F.lit("")), trial_has_results=F.col("results"))


def term_cases(answers: DataFrame) -> DataFrame:
    """Each ontology term: context only."""
    found = _exploded(answers, TERMS, F.col("a.results")).select("ord", F.col("r.id").alias("source_id"), F.col("r.id").alias("group"), F.lit("go_peptide_context").alias("family"), F.col("a.numberOfHits").alias("n"))
    return _rows("gene_ontology", found, mechanism_support=F.lit("pathway_or_ontology_context_only"))


def pathway_cases(answers: DataFrame) -> DataFrame:
    """Each entry of each result: context only; an entry without a stable id goes by its database id."""
    entries = F.flatten(F.transform("a.results", lambda r: F.coalesce(r["entries"], F.array().cast("array<struct<stId:string,dbId:string,name:string>>"))))
    ident = F.coalesce(F.nullif(F.col("r.stId"), F.lit("")), F.col("r.dbId"))
    found = _exploded(answers, PATHWAYS, entries).select("ord", ident.alias("source_id"), ident.alias("group"), F.lit("reactome_peptide_context").alias("family"), F.size(entries).alias("n"))
    return _rows("reactome", found, mechanism_support=F.lit("pathway_or_ontology_context_only"))


def negative_cases(spark: SparkSession, n: int, hits: DataFrame | None = None) -> DataFrame:
    """Made-up sequences that no source knows; ``hits`` (sequence, n) are the results that a query still had."""
    rows = spark.range(n).select(F.struct("id", F.lit(0).alias("at")).alias("ord"), F.format_string("negative_query_%03d", F.col("id").cast("int")).alias("source_id"), F.format_string("UNKNOWN%03dPEPTIDE", F.col("id").cast("int")).alias("group"), F.lit("unsupported_query").alias("family"))
    rows = rows.withColumn("n", F.lit(0)) if hits is None else rows.join(hits.select(F.col("sequence").alias("group"), "n"), "group", "left").na.fill(0, ["n"])
    return _rows("negative_query", rows, sequence=F.col("group"))


def numbered(rows: DataFrame, prefix: str = "CASE-HFX", start: int = 0) -> DataFrame:
    """Rows with running ids, splits in turn and source hashes; ``ord`` gives the order."""
    at = positions(rows, ["ord", "source_id"], "_at").withColumn("_at", F.col("_at") + start)
    return envelope(at.withColumn("benchmark_id", F.format_string(f"{prefix}-%05d", (F.col("_at") + 1).cast("int"))), "_at").drop("_at", "ord")


def effect_cases(least: int, spare: DataFrame, *builders: DataFrame) -> DataFrame:
    """The builders' rows in order; where they are fewer than ``least``, ``spare`` (negative queries) makes up for the rest."""
    placed = lambda i, df: positions(df, ["ord", "source_id"], "_nth").withColumn("ord", F.struct(F.lit(i).alias("builder"), F.col("_nth").alias("at")))
    have = union_all(*[placed(i, b).drop("_nth") for i, b in enumerate(builders)])
    lacking = max(0, least - union_all(*[b.select("source_id").limit(least) for b in builders]).limit(least).count()) if builders else least  # no more than ``least`` are counted
    more = placed(len(builders), spare).where(F.col("_nth") < lacking).drop("_nth")
    return numbered(union_all(have, more))
