"""JSON functions over columns."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lectern.functions import braces

# What precedes an answer.
MARKERS = ("assistantfinal", "<|channel|>final", "final")
OPEN, CLOSE = "<json>", "</json>"


def object_in(c: Column) -> Column:
    """VARIANT of the text, or of what lies from its first to its last brace; null if neither is an object."""
    t = F.trim(c)
    inner = F.substr(t, F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") - F.instr(t, "{") + 2)
    return F.when(is_whole(t), F.try_parse_json(t)).when(is_whole(inner), F.try_parse_json(inner))


def message_content(c: Column) -> Column:
    """Text of the first choice of a chat completion."""
    return F.get_json_object(c, "$.choices[0].message.content")


def record_key(*cols: str, drop: tuple[str, ...] = ("prediction_id",)) -> Column:
    """Canonical JSON of a record without the dropped columns, fields in order of name."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols) if c not in drop]))


def tagged(c: Column) -> Column:
    """What stands between the first tag pair, null without an opening tag."""
    return F.when(c.contains(OPEN), F.substring_index(F.substr(c, F.instr(c, OPEN) + len(OPEN)), CLOSE, 1))


def repaired(c: Column) -> Column:
    """First to last brace with commas before closing brackets removed."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(inner, r",\s*([}\]])", "$1")


@F.arrow_udf(BooleanType())
def is_whole(texts: pa.Array) -> pa.Array:
    """The text is one object from end to end; the parser by itself would pass over what follows the first."""
    return pa.array(braces.whole(texts))


def parses(c: Column, key: str | None = None) -> Column:
    """The text begins with a JSON object, which has ``key`` if given."""
    v = F.try_parse_json(c)
    found = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return found if key is None else found & F.try_variant_get(v, f"$['{key}']", "variant").isNotNull()


_OBJECTS = ArrayType(StructType([StructField("position", IntegerType()), StructField("object", StringType())]))
_VALUES = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())]))


@F.arrow_udf(_OBJECTS)
def balanced_objects(texts: pa.Array) -> pa.Array:
    """(position, object) of every balanced object of a text, outer ones first; explode it for rows."""
    return braces.balanced_objects(texts)


@F.arrow_udf(ArrayType(ArrayType(StructType([StructField("payload", StringType()), StructField("how", StringType())]))))
def _attempts(texts: pa.Array) -> pa.Array:
    """What each member of an array offers as an object: all of it, the balanced objects in it, and its repaired span."""
    each = texts.flatten()
    inner = pc.extract_regex(each, r"(?s)(?P<o>\{.*\})")
    fixed = pc.replace_substring_regex(pc.struct_field(inner, "o"), r",\s*([}\]])", r"\1")
    out = [[{"payload": t, "how": "full_json"}] if w else [] for t, w in zip(each.to_pylist(), braces.whole(each), strict=True)]
    for found, objects, repair, fits in zip(out, braces.balanced_objects(each).to_pylist(), fixed.to_pylist(), braces.whole(fixed), strict=True):
        found += [{"payload": o["object"], "how": "first_balanced_object"} for o in objects]
        if fits:
            found.append({"payload": repair, "how": "local_repair"})
    kind = pa.struct([("payload", pa.string()), ("how", pa.string())])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int32)), pa.array(out, pa.list_(kind)))


def candidates(c: Column) -> Column:
    """Array of (kind, text) in which to look for an answer: behind each marker, then everywhere; what a tag holds before what it stands in."""
    c = F.coalesce(c, F.lit(""))
    tails = [F.when(c.contains(m), F.trim(F.substring_index(c, m, -1))) for m in MARKERS] + [F.trim(c)]
    both = [F.struct(F.lit(kind).alias("kind"), text.alias("text")) for t in tails for kind, text in (("tagged_json", F.trim(tagged(t))), ("raw", t))]
    return F.filter(F.array(*both), lambda x: F.coalesce(F.length(x["text"]), F.lit(0)) > 0)


def extraction(key: str | None = None):
    """Function of a text column: struct of payload and method, the first attempt that gives an object; nulls where none does.

    A candidate is tried whole, then by its balanced objects, then repaired.
    """

    def of(c: Column) -> Column:
        found = candidates(c)
        named = lambda x, tried: F.transform(tried, lambda a: F.struct(a["payload"].alias("payload"), F.concat(x["kind"], F.lit(":"), a["how"]).alias("method")))
        tried = F.flatten(F.zip_with(found, _attempts(F.transform(found, lambda x: x["text"])), named))
        first = F.get(F.filter(tried, lambda a: parses(a["payload"], key)), F.lit(0))
        payload = F.when(first["method"].endswith("local_repair"), F.to_json(F.try_parse_json(first["payload"]))).otherwise(first["payload"])
        return F.struct(payload.alias("payload"), first["method"].alias("method"))

    return of


@F.arrow_udf(_VALUES)
def flattened(texts: pa.Array, keys: pa.Array) -> pa.Array:
    """(key, value) of the scalar values under the named keys at any depth, for records without a schema."""
    out = []
    for text, wanted in zip(texts.to_pylist(), keys.to_pylist(), strict=True):
        names, todo, found = {k.lower() for k in wanted or []}, [(None, json.loads(text))] if text else [], []
        while todo:
            key, value = todo.pop()
            if isinstance(value, (dict, list)):
                todo += value.items() if isinstance(value, dict) else [(key, v) for v in value]
            elif key and key.lower() in names and value is not None and str(value).strip():
                found.append({"key": key, "value": str(value).strip()})
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))
