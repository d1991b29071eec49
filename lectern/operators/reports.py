"""Free-form reports of a model: put into the template's shape, noted, and checked against it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import clean_strings, confidence_word
from lectern.operators.predictions import MOST_CONTACTS, clean_contacts
from lectern.schemas import DOMAINS

# The report's template. A list is empty by default, a section has its fields' defaults.
TEMPLATE: dict[str, str | list | dict[str, str | list]] = {
    "developability": dict.fromkeys(("stability_risk", "solubility_risk", "toxicity_risk", "hemolysis_risk", "cytotoxicity_risk", "synthesis_complexity"), "unknown"),
    "functional_assay_estimate": {"categories": [], "confidence": "low", "evidence_basis": "insufficient_information"},
    "human_effect_estimate": {"category": "no_known_human_effect_evidence", "claim_status": "insufficient_information", "confidence": "low", "evidence_direction": "not_applicable", "evidence_level": "unsupported_contradicted_or_unsafe_claim"},
    "known_source_backed_facts": [],
    "missing_evidence": [],
    "overall_confidence": "low",
    "pose_contact_assessment": {"status": "not_assessed", "confidence": "low", "interface_residues": [], "predicted_contacts": [], "notes": ""},
    "recommended_next_assays": [],
    "structure_source_reference": {"status": "not_applicable", "confidence": "low", "notes": ""},
    "target_binding": {"status": "not_assessed", "confidence": "low", "relative_rank": [], "assay_awareness": ""},
    "unsupported_claims": [],
}
POSE = "pose_contact_assessment"
CONTACTS = "array<struct<target_residue:string,peptide_residue:string,distance_angstrom:double>>"
KINDS = {str: ("STRING", "str"), list: ("ARRAY", "list"), dict: ("OBJECT", "dict")}

#: What is asked of a model for each track; words of closed domains are listed.
ASKED = {
    "human_effect": "Give category, evidence_level, evidence_direction, claim_status, safety_status, abstained and rationale_source_ids for every input.",
    "binding_rank": "Give one prediction a panel with a score for each item in its scores; a higher score means stronger binding.",
    "pose": "Give predicted_contacts as objects of target_residue and peptide_residue, labelled <chain>:<residue>, with distance_angstrom if known; an empty list if nothing can be inferred.",
    "structure": "Give coordinates only where they can be inferred; else an empty list and a calibrated confidence.",
}
LISTED = {"human_effect": ("category", "evidence_level", "evidence_direction", "claim_status", "safety_status")}
ONLY_JSON = "Answer with one JSON object between <json> and </json> and nothing else."


def instructions(track: str) -> str:
    """Text of what is asked, with the domains' words."""
    words = [f"{name}: {', '.join(DOMAINS[name])}." for name in LISTED.get(track, ())]
    return " ".join([ASKED[track], *words])


def with_contract(messages: Column, track: str | None = None) -> Column:
    """Chat messages with the output contract behind the last one."""
    text = ONLY_JSON if track is None else f"{instructions(track)} {ONLY_JSON}"
    last = F.element_at(messages, -1)
    return F.concat(F.slice(messages, 1, F.size(messages) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["content"], F.lit(f"\n{text}")).alias("content"))))


def _at(payload: str, path: str) -> Column:
    return F.try_variant_get(payload, f"$.{path}", "variant")


def _is(value: Column, kind: type) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(KINDS[kind][0]), F.lit(False))


def _field(payload: str, path: str, default: str | list, wrapped: Column | None = None, top: str = "") -> Column:
    """A field of a section, by default where it is absent or of another kind."""
    value = _at(payload, path)
    if isinstance(default, list):
        strings = F.filter(F.transform(F.try_variant_get(payload, f"$.{path}", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))), lambda s: s.isNotNull())
        return F.when(_is(value, list), F.coalesce(strings, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    if wrapped is not None:
        text = F.when(wrapped, F.try_variant_get(payload, f"$.{top}", "string")).otherwise(text)
    return F.coalesce(text, F.lit(default))


def normalised(payload: str = "payload") -> Column:
    """Struct of ``report`` (the template's shape) and ``notes`` (what was defaulted or moved) of a VARIANT payload."""
    there = lambda name: _at(payload, name).isNotNull()
    risks = TEMPLATE["developability"]
    loose = F.lit(False)
    for name in risks:
        loose = loose | there(name)
    wrapped = loose & ~_is(_at(payload, "developability"), dict)
    sections, notes = [], [F.when(~_is(F.col(payload), dict), F.lit("non_dict_payload_replaced"))]
    for key, default in TEMPLATE.items():
        absent = F.when(~F.coalesce(there(key), F.lit(False)), F.lit(f"{key}_defaulted"))
        if key == "developability":
            sections.append(F.struct(*[_field(payload, f"{key}.{n}", d, wrapped, n).alias(n) for n, d in default.items()]).alias(key))
            notes.append(F.when(wrapped, F.lit("top_level_developability_wrapped")).otherwise(absent))
            continue
        if key == "overall_confidence":
            section = confidence_word(F.coalesce(_field(payload, key, default), F.lit("")))
        elif key == POSE:
            own = {n: _field(payload, f"{key}.{n}", d) for n, d in default.items()}
            own["confidence"] = confidence_word(own["confidence"])
            own["interface_residues"] = clean_strings(own["interface_residues"])
            own["predicted_contacts"] = clean_contacts(F.try_variant_get(payload, f"$.{key}.predicted_contacts", CONTACTS))
            section = F.struct(*[c.alias(n) for n, c in own.items()])
        elif isinstance(default, dict):
            section = F.struct(*[_field(payload, f"{key}.{n}", d).alias(n) for n, d in default.items()])
        else:
            section = _field(payload, key, default)
        sections.append(section.alias(key))
        notes.append(absent)
    return F.struct(F.struct(*sections).alias("report"), F.array_compact(F.array(*notes)).alias("notes"))


def report_errors(payload: str = "payload") -> Column:
    """Messages for what a VARIANT payload lacks of the template or has of another kind, in the template's order."""

    def check(path: str, kind: type) -> Column:
        value = _at(payload, path)
        return F.when(value.isNull(), F.lit(f"missing:{path}")).when(~_is(value, kind), F.lit(f"type:{path}:{KINDS[kind][1]}"))

    pose = _is(_at(payload, POSE), dict)
    rules = [check(key, type(default)) for key, default in TEMPLATE.items()]
    rules += [F.when(pose, check(f"{POSE}.{n}", type(d))) for n, d in TEMPLATE[POSE].items()]
    contacts = F.try_variant_get(payload, f"$.{POSE}.predicted_contacts", "array<variant>")
    rules.append(F.when(F.size(contacts) > MOST_CONTACTS, F.lit(f"{POSE}.predicted_contacts:too_many")))

    def of_contact(v: Column, i: Column) -> Column:
        where = F.concat(F.lit(f"{POSE}.predicted_contacts."), i.cast("string"))
        fields = F.transform(F.regexp_extract_all(F.schema_of_variant(v), F.lit(r"[<,] ?(\w+):")), lambda x: x)
        extra = F.array_sort(F.array_except(fields, F.array(F.lit("target_residue"), F.lit("peptide_residue"), F.lit("distance_angstrom"))))
        lacks = [F.when(~F.array_contains(fields, n), F.concat(F.lit("missing:"), where, F.lit(f".{n}"))) for n in ("peptide_residue", "target_residue")]
        own = F.array_compact(F.array(F.when(F.size(extra) > 0, F.concat(where, F.lit(":extra_fields:"), F.array_join(extra, ","))), *lacks))
        return F.when(_is(v, dict), own).otherwise(F.array(F.concat(F.lit("type:"), where, F.lit(":dict"))))

    each = F.flatten(F.transform(F.coalesce(contacts, F.array().cast("array<variant>")), of_contact))
    return F.concat(F.array_compact(F.array(*rules)), each)
