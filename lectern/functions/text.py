"""Text functions over columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.functions.braces import balanced_spans, bytes_and_offsets

# What makes a prompt or a document suspect.
ANSWER_MARKERS = ("normalized_rank", "measured_value", "evidence_level", "claim_status", "safety_status", "native_contacts", "gold_coordinates")
SECRET_PATTERNS = (r"tml-[A-Za-z0-9_-]+", r"sk-or-v1-[A-Za-z0-9_-]+", r"hf_[A-Za-z0-9_-]{20,}", r"OPENROUTER_API_KEY\s*=\s*['\"][^'\"]+['\"]", r"TINKER_API_KEY\s*=\s*['\"][^'\"]+['\"]", r"HF_TOKEN\s*=\s*['\"][^'\"]+['\"]")
CONTRADICTORY_PHRASES = ("release candidate with issueers", "issueer", "issueed", "quality check required", "curation required", "license qc required", "required before release", "needs chain-role gates", "needs assay compatibility gates", "needs conservative classification", "scientifically complete", "fully complete", "release-ready")
PROHIBITED_CLAIMS = ("clinically validated", "safe for human use", "predicts human effects", "provides medical advice", "is medical advice", "validates human use")
UNLESS_NEGATED = (("externally checked", "not externally checked"), ("direct human-effect prediction", "not direct human-effect prediction"))
#: Further patterns of our own: what error messages may carry.
MORE_SECRETS = (r"sk-[A-Za-z0-9_-]{16,}", r"hf_[A-Za-z0-9]{16,}", r"(?i:bearer)\s+[A-Za-z0-9._-]{16,}", r"AKIA[A-Z0-9]{12,}", r"(?i:(?:api[_-]?key|token|secret|password))\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{8,}")
# What counts as a loop: pattern, least number of matches, greatest share of different ones; length of a beginning.
CASE_IDS = (r"(?i)(?:struct|pose)-[0-9]{3,}", 12, 0.6)
CODES = (r"[A-Za-z]+-[0-9]+[A-Za-z0-9_:-]*|[A-Z]{3,}[A-Z0-9_:-]*", 40, 0.35)
LOOP = 12
CONFIDENCE = {"high": 0.8, "medium": 0.5, "low": 0.2}


def clean_sequence(c: Column) -> Column:
    """Upper-case letters A-Z only; null gives the empty string."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")


def number_in_markup(c: Column) -> Column:
    """First number of a text with tags and common entities; thousands separators are dropped; null without one."""
    plain = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&plusmn;", "±"), ("&micro;", "µ"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.regexp_extract(F.replace(plain, F.lit(","), F.lit("")), r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def slug(c: Column) -> Column:
    """File-name form of a model id: other characters become one underscore, none at the ends; ``model`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "model").otherwise(s)


def source_name(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), " /", "__")


def split_name(c: Column) -> Column:
    """Lower-cased split; anything but train, dev or test is an error."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("train", "dev", "test"), s).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(c, F.lit("null")))))


def group_id(*parts: Column) -> Column:
    """Non-empty parts joined by ``::``, or ``unknown``."""
    joined = F.concat_ws("::", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(joined == "", "unknown").otherwise(joined)


def provider(c: Column) -> Column:
    """What precedes the first slash, or the whole id."""
    return F.substring_index(c, "/", 1)


def options(c: Column) -> Column:
    """Comma-separated values, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def redact(c: Column, mark: str = "[REDACTED]", patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, mark)
    return c


def has_secret(c: Column, patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def error_message(c: Column, most: int = 300) -> Column:
    """Message without keys or local paths, cut to ``most`` characters; beyond the fixed patterns, keys of ``MORE_SECRETS`` go as well."""
    s = redact(F.coalesce(c, F.lit("")), "[redacted]", (*SECRET_PATTERNS, *MORE_SECRETS))
    return F.left(F.regexp_replace(s, r"/(?:Users|home|root)/[^\s\"']+", "[local-path]"), F.lit(most))


def answer_like(c: Column) -> Column:
    """The text names a gold field."""
    return F.lower(c).rlike("|".join(ANSWER_MARKERS))


def claim_errors(c: Column) -> Column:
    """Array of prohibited phrases found in a release text, those with an allowed negation included only without it."""
    t = F.lower(c)
    plain = [F.when(t.contains(p), F.lit(p)) for p in (*CONTRADICTORY_PHRASES, *PROHIBITED_CLAIMS)]
    negated = [F.when(t.contains(p) & ~t.contains(n), F.lit(p)) for p, n in UNLESS_NEGATED]
    return F.array_compact(F.array(*plain, *negated))


def joined_lower(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def clean_strings(c: Column) -> Column:
    """Trimmed members of an array, empty and null ones left out."""
    return F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def confidence_word(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("high", "medium", "low"), s).otherwise("low")


def confidence_value(c: Column) -> Column:
    """0.8, 0.5 or 0.2 by word, else 0."""
    out = F.lit(0.0)
    for word, value in CONFIDENCE.items():
        out = F.when(F.lower(F.trim(c)) == word, value).otherwise(out)
    return out


def first_reason(*rules: tuple[Column, str | Column]) -> Column:
    """Reason of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r) if isinstance(r, str) else r) for c, r in rules])


def unique_ratio(tokens: Column) -> Column:
    """Distinct share of an array, null if empty."""
    return F.try_divide(F.size(F.array_distinct(tokens)), F.size(tokens))


def stripped(c: Column) -> Column:
    """Text without white space at its ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _crowded(c: Column, pattern: str, least: int, share: float) -> Column:
    """At least ``least`` matches, of which at most ``share`` differ."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return (F.size(found) >= least) & (unique_ratio(found) <= share)


def _starts_over(c: Column) -> Column:
    """The first ``LOOP`` characters come four times and more. A longer beginning can't come oftener, so no other needs a look."""
    return (F.length(c) >= LOOP) & (F.length(c) - F.length(F.replace(c, F.left(c, F.lit(LOOP)), F.lit(""))) >= 4 * LOOP)


def repetition_reason(c: Column | str) -> Column:
    """Why a text counts as a loop, else null."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return first_reason((_crowded(c, *CASE_IDS), "repeated_struct_pose_identifier_loop"), (_crowded(c, *CODES), "mostly_repeated_tokens"), (_starts_over(c), "repeated_substring_loop"))


@F.arrow_udf(BooleanType())
def has_object(texts: pa.Array) -> pa.Array:
    """Some brace opens an object that closes."""
    buf, offs = bytes_and_offsets(texts)
    found = np.zeros(len(offs) - 1, dtype=bool)
    found[balanced_spans(buf, offs)[0]] = True
    return pa.array(found)


def degenerate_reason(c: Column | str) -> Column:
    """Why a model output can't hold a JSON object, else null."""
    t = stripped(F.col(c) if isinstance(c, str) else c)
    tagged, braces, loop = F.lower(t).startswith("<no-"), t.contains("{"), repetition_reason(t)
    return first_reason(
        (t == "", "empty_output"),
        (F.lower(t).startswith("<noinput"), "noinput_output"),
        (loop.isNotNull() & (tagged | ~braces), loop),
        (tagged, "no_prefixed_non_json_output"),
        (~braces, "no_json_object_marker"),
        (~has_object(t), "no_balanced_json_object"),
    )
