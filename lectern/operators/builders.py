"""Baselines, case builders and model selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.mersenne import Stream
from lectern.functions.numbers import model_price
from lectern.functions.text import clean_sequence, joined_lower, number_in_markup
from lectern.operators.evidence import UNSUPPORTED
from lectern.operators.keys import first_by, union_all, with_order
from lectern.operators.large_panels import first_rows
from lectern.operators.ordering import positions, running

SEED = 13
NONE = "no_known_human_effect_evidence"
# The rule baseline by source (category, level, direction, status, safety, abstains), and the name tests of model families.
RULES = {
    "dailymed": ("endocrine_hormonal", "approved_human_indication", "positive", "supported", "known_acceptable_under_approved_use", False),
    "clinicaltrials": (NONE, "human_clinical_evidence", "not_reported", "plausible_but_unproven", "insufficient_safety_data", True),
    "reactome": (NONE, "mechanistic_pathway_or_similarity_hypothesis", "not_applicable", "plausible_but_unproven", "insufficient_safety_data", True),
    "gene_ontology": (NONE, "mechanistic_pathway_or_similarity_hypothesis", "not_applicable", "plausible_but_unproven", "insufficient_safety_data", True),
    "opentargets": (NONE, "mechanistic_pathway_or_similarity_hypothesis", "not_applicable", "plausible_but_unproven", "insufficient_safety_data", True),
}
OTHER = (NONE, "unsupported_contradicted_or_unsafe_claim", "not_applicable", "insufficient_information", "insufficient_safety_data", True)
FIELDS = ("category", "evidence_level", "evidence_direction", "claim_status", "safety_status", "abstained")
#: family: (id prefixes, one of these words, all of these words, strength by word in order, strength else)
FAMILIES = {
    "openai": (("openai/",), ("gpt", "o3", "o4", "o5"), (), (("pro", 4), ("chat", 3), ("mini", 1), ("nano", 1)), 2),
    "anthropic": (("anthropic/",), ("sonnet", "opus", "claude"), (), (("sonnet", 4), ("opus", 3)), 2),
    "google": (("google/",), (), ("gemini", "pro"), (("preview", 3), ("pro", 4)), 1),
    "deepseek": (("deepseek/",), (), (), (("pro", 4), ("r1", 3)), 2),
    "xai": ((), (), ("grok",), (("multi-agent", 2),), 4),
    "qwen": (("qwen/",), (), (), (("max", 4), ("plus", 3), ("flash", 1)), 2),
    "llama": (("meta-llama/",), ("instruct", "maverick", "scout"), (), (("maverick", 4), ("scout", 3)), 2),
    "mistral": (("mistralai/",), (), (), (("medium", 4), ("large", 3), ("small", 2)), 1),
}
NOT_CHAT = (" vl", "-vl", "guard", "safeguard", "moderation", "embedding", "rerank", "router", "build", "code router")
UNSTABLE = ("preview", "beta", "experimental")


def _base(model: str) -> list[Column]:
    return [F.concat_ws(":", F.col("benchmark_id"), F.lit(model)).alias("prediction_id"), F.col("benchmark_id"), F.col("track"), F.lit(model).alias("model_name")]


def seeded_scores(cases: DataFrame, seed: int = SEED) -> DataFrame:
    """(benchmark_id, scores): one number an item from one seeded stream (Mersenne Twister) that runs through the cases in their order.

    How many items lie before a case is a running sum over fixed bounds; a task
    jumps to its first case's place in the stream and draws on from there. A
    case without items, or with null ones, has an empty list and moves nothing.
    """
    rows = with_order(cases).select("ord", "benchmark_id", F.transform("items", lambda i: i["item_id"]).alias("ids"))
    placed = running(rows, ["ord"], "start", F.coalesce(F.size("ids"), F.lit(0))).select("benchmark_id", "ids", "start")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(seed)
        for b in batches:
            ids, start = b.column(1), b.column(2).to_numpy()
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
            items, at = ids.flatten(), np.append(0, np.cumsum(sizes))
            breaks = [0, *(np.flatnonzero(start[1:] != start[:-1] + sizes[:-1]) + 1).tolist(), len(start)]
            drawn = np.concatenate([np.zeros(0), *[stream.draw(int(start[i]), int(at[j] - at[i])) for i, j in zip(breaks, breaks[1:], strict=False) if at[j] > at[i]]])
            rank = np.arange(len(items)) - np.repeat(at[:-1], sizes) + 1
            scores = pa.StructArray.from_arrays([items, pa.array(drawn), pa.array(rank.astype(np.int32))], ["item_id", "score", "rank"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), scores)], ["benchmark_id", "scores"])

    return placed.mapInArrow(draw, "benchmark_id string, scores array<struct<item_id:string,score:double,rank:int>>")


def baseline(cases: DataFrame, track: str, model: str = "weak_seeded_baseline", seed: int = SEED) -> DataFrame:
    """Predictions without a model: gold coordinates, the first contact, seeded scores, or rules by source; a model named an oracle copies the labels, abstaining where nothing is supported."""
    from lectern.operators.leaderboard import is_oracle_name

    if track == "structure":
        return cases.select(*_base(model), F.col("gold_coordinates").alias("coordinates"), F.lit(0.5).alias("confidence"))
    if track == "pose":
        return cases.select(*_base(model), F.slice("native_contacts", 1, 1).alias("predicted_contacts"), F.slice("binding_site_residues", 1, 1).alias("binding_site_residues"), "orientation_label", F.lit(0.0).alias("clash_score"))
    if track == "binding_rank":
        return seeded_scores(cases, seed).withColumn("track", F.lit("binding_rank")).select(*_base(model), "scores")
    oracle = is_oracle_name(F.lit(model))
    abstains = F.col("claim_status").isin(*UNSUPPORTED)
    copied = {"category": F.when(abstains, NONE).otherwise(F.col("category")), "evidence_level": F.col("evidence_level"), "evidence_direction": F.col("evidence_direction"), "claim_status": F.when(abstains, "insufficient_information").otherwise(F.col("claim_status")), "safety_status": F.when(abstains, "insufficient_safety_data").otherwise(F.col("safety_status")), "abstained": abstains}
    source = F.lower("source_database")
    own = []
    for i, f in enumerate(FIELDS):
        rule = F.lit(OTHER[i])
        for name, values in RULES.items():
            rule = F.when(source == name, F.lit(values[i])).otherwise(rule)
        own.append(F.when(oracle, copied[f]).otherwise(rule).alias(f))
    return cases.select(*_base(model), *own, F.array("source_id").alias("rationale_source_ids"))


def fallback(cases: DataFrame, track: str, model: str) -> DataFrame:
    """What stands in when a provider fails: the baselines, empty for poses and structures."""
    if track == "pose":
        return baseline(cases, track, model).withColumn("predicted_contacts", F.slice("predicted_contacts", 1, 0)).withColumn("binding_site_residues", F.slice("binding_site_residues", 1, 0)).withColumn("orientation_label", F.lit(None).cast("string"))
    if track == "structure":
        return baseline(cases, track, model).withColumn("coordinates", F.slice("coordinates", 1, 0)).withColumn("confidence", F.lit(0.01))
    return baseline(cases, track, model)


def panels(rows: DataFrame, least: int = 5, most: int = 10) -> DataFrame:
    """Assay rows (allele, assay, sequence, measure, ord) as ranking panels: one row a sequence, at least ``least``, the first ``most`` in order.

    Ranks are by value, equal values share the better rank; normalised rank is 1 for the strongest and 0 for the last place.
    """
    clean = rows.withColumn("sequence", clean_sequence(F.col("sequence"))).withColumn("measured_value", number_in_markup(F.col("measure").cast("string"))).where("sequence <> '' and measured_value is not null")
    one = first_by(clean, ["allele", "assay", "sequence"])
    sizes = one.groupBy("allele", "assay").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    few = first_rows(one, ["allele", "assay"], [F.col("ord")], most, "place").join(sizes, ["allele", "assay"])
    w = Window.partitionBy("allele", "assay")  # at most ``most`` rows from here on
    ranked = few.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("rank", F.rank().over(w.orderBy("measured_value")))
    return ranked.withColumn("normalized_rank", 1 - (F.col("rank") - 1) / F.greatest(F.col("size") - 1, F.lit(1))).select("allele", "assay", "sequence", "measured_value", "rank", "normalized_rank", "place")


def structure_cases(entities: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """Short peptides of entries (pdb_id, entity_id, chains, asym_chains, kind, sequence, ord): one row an entry, entity and chain, with running ids."""
    chain = F.coalesce(F.try_element_at("chains", F.lit(1)), F.try_element_at("asym_chains", F.lit(1)))
    seq = clean_sequence(F.col("sequence"))
    short = entities.where(F.lower("kind").contains("polypeptide(l)")).withColumn("chain_id", chain).withColumn("sequence", seq).where(F.length("sequence").between(least, most))
    one = first_by(short, ["pdb_id", "entity_id", "chain_id"])
    return positions(one, ["ord"], "at").withColumn("benchmark_id", F.format_string("CASE-STRUCT-%05d", (F.col("at") + 1).cast("int"))).drop("at")


def pose_pairs(entities: DataFrame, peptides: int = 2, targets: int = 1) -> DataFrame:
    """Peptide and target pairs of an entry: the first two peptides of 5 to 50 residues with the first target of 60 or more."""
    sized = entities.withColumn("length", F.length(clean_sequence(F.col("sequence"))))
    pack = lambda lo, hi: F.filter(F.array_sort(F.collect_list(F.struct("ord", "entity_id", "length"))), lambda e: e["length"].between(lo, hi))
    entry = sized.groupBy("pdb_id").agg(F.slice(pack(5, 50), 1, peptides).alias("p"), F.slice(pack(60, 1 << 30), 1, targets).alias("t"))
    return entry.select("pdb_id", F.explode("p").alias("peptide"), "t").select("pdb_id", "peptide", F.explode("t").alias("target")).select("pdb_id", F.col("peptide.entity_id").alias("peptide_entity"), F.col("target.entity_id").alias("target_entity"), F.col("peptide.length").alias("peptide_length"), F.col("target.length").alias("target_length"))


def negative_queries(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    """Made-up names for which no evidence can exist."""
    return spark.range(start, start + n).select(F.format_string("UNKNOWN%03dPEPTIDE", F.col("id").cast("int")).alias("name"), F.lit("unsupported").alias("claim_status"))


def union_until(n: int, *builders: DataFrame) -> DataFrame:
    """The builders' rows in order, each in its own, the first ``n``."""
    return union_all(*[with_order(b, "_at").withColumn("_builder", F.lit(i)) for i, b in enumerate(builders)]).orderBy("_builder", "_at").limit(n).drop("_builder", "_at")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def candidates(models: DataFrame) -> DataFrame:
    """Models (id, name, description, created, context_length, output_modalities, supported_parameters, prompt_price, completion_price) that can be chosen: named explicitly, current, and chatting in text."""
    text, low = joined_lower(F.col("id"), F.col("name"), F.col("description")), F.lower("id")
    alias = text.contains("deprecated") | low.contains("latest") | low.startswith("~") | text.contains("auto-router") | low.endswith("/auto")
    out = F.transform(F.coalesce("output_modalities", F.array().cast("array<string>")), F.lower)
    chats = (F.size(out) == 0) | (F.array_contains(out, "text") & ~F.arrays_overlap(out, F.array(F.lit("image"), F.lit("audio"), F.lit("video"))))
    return models.where(~alias & chats & ~_any(text, NOT_CHAT))


def families(models: DataFrame) -> DataFrame:
    """(family, strength, model columns): each candidate with every family that its id and name fit."""
    text, low = joined_lower(F.col("id"), F.col("name")), F.lower("id")
    tests = []
    for family, (prefixes, some, every, strengths, else_) in FAMILIES.items():
        fits = F.lit(not prefixes)
        for p in prefixes:
            fits = fits | low.startswith(p)
        if family == "mistral":
            fits = fits | text.contains("mistral")
        if some:
            fits = fits & _any(text, some)
        for w in every:
            fits = fits & text.contains(w)
        strength = F.lit(else_)
        for word, value in reversed(strengths):
            strength = F.when(text.contains(word), value).otherwise(strength)
        tests.append(F.when(fits, F.struct(F.lit(family).alias("family"), strength.alias("strength"))))
    return candidates(models).withColumn("_f", F.explode(F.array_compact(F.array(*tests)))).select("_f.*", *models.columns)


def select_models(models: DataFrame, most: int = 10) -> DataFrame:
    """The best model of each family (stable, strong, new, structured, long context) and the cheapest of the rest."""
    text = joined_lower(F.col("id"), F.col("name"), F.col("description"))
    structured = F.coalesce(F.array_contains("supported_parameters", "response_format"), F.lit(False))
    order = F.struct(~_any(text, UNSTABLE), F.col("strength"), F.coalesce("created", F.lit(0)), structured, F.coalesce("context_length", F.lit(0)), F.col("id"))
    chosen = families(models).groupBy("family").agg(F.max_by(F.struct("id", "name", "created", "context_length"), order).alias("m")).select("family", "m.*").dropDuplicates(["id"])
    price = model_price(F.col("prompt_price"), F.col("completion_price"))
    rest = candidates(models).join(chosen.select("id"), "id", "left_anti").where((price >= 0) & ~F.lower("id").endswith(":free"))
    small = rest.orderBy(price, F.coalesce("context_length", F.lit(0)).desc(), F.coalesce("created", F.lit(0)).desc(), "id").limit(1).select(F.lit("small_fast").alias("family"), "id", "name", "created", "context_length")
    return chosen.unionByName(small).limit(most)
