"""Secret scans: key patterns, and Markov models of random strings against identifiers.

Three base patterns give spans as leftmost non-overlapping matches. Beyond
them, long runs of key characters are scored by two first-order character Markov
models, one of random strings and one of ordinary identifiers, trained from
labelled samples. A run's best part is the stretch of greatest log-likelihood
ratio, drawn out to the next mark on both sides, so that a key inside a longer
path or identifier is judged by itself. With at least ``LEAST_TOKEN`` characters
and a ratio of the model's threshold it is a span of kind ``markov``, unless a
base span overlaps it. Positions are code points.

The threshold comes from labelled samples that the models aren't trained on (one
in ``FOLDS`` by hash): the ``QUANTILE`` of what ordinary ones have there. Both
error rates on them are part of the model.

DataFrame functions only: a match's position is the length of all that precedes
it (what a split by the pattern leaves, and the matches before it), summed in
two levels so that a text of n matches costs n**1.5 at most; a run of n
characters is read once, in time that grows with n.

Defined cases: null text counts as empty; an empty text has no spans, an empty
``spans`` and the digest of the empty string; a ratio that equals the threshold
is found; repeated rows and null ids are scanned row by row; other columns are
ignored, whatever their names, and ``redact`` returns them as they are; very long
texts are scanned whole, in the time said above.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group whose length counts, least length
BASE = {"assign": (r"(?i:(password|passwd|secret|token|api_?key))" + SEPARATED, 2, 8), "access": (r"AKIA[A-Z0-9]{12,}", 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_TOKEN = 20
FOLDS, QUANTILE = 4, 0.999
MARK = "[SECRET]"
_FIRST, _CODES = 43, 80  # the characters of a candidate, + to z
_TRAINED: dict[str, "Model"] = {}

#: Words of the ordinary identifiers among the default samples.
WORDS = "get set user name file path data list item count index value config server client request response error message handler thread session cache buffer stream reader writer parser token event queue table column query result update delete insert select create remove start stop open close connect process memory number string object array length size total average maximum minimum first last next previous current default global local public private static class method function module package import export version release system network address port host domain account password login email phone street city country date time hour minute second month year service manager factory builder adapter provider context scope filter sort order group page link image video audio document".split()


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(sample, random): n hash-made random strings in four alphabets and n identifiers made of common words."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    raw = F.unhex(digest)
    made = F.element_at(F.array(digest, F.base64(raw), F.translate(F.base64(raw), "+/=", "xyz"), F.upper(F.translate(F.base64(raw), "+/=", "QZX"))), (F.col("id") % 4 + 1).cast("int"))
    random = spark.range(n).select(F.substring(made, 1, 40).alias("sample"), F.lit(True).alias("random"))
    pool = F.array(*[F.lit(w) for w in WORDS])
    word = lambda seed: F.element_at(pool, (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(WORDS))) + 1).cast("int"))
    words = F.array(word(1), word(2), word(3), word(4))
    styles = F.array(F.array_join(words, "_"), F.array_join(words, "-"), F.array_join(words, "/"), F.array_join(F.transform(words, F.initcap), ""), F.upper(F.array_join(words, "_")), F.array_join(words, ""), F.concat(F.array_join(words, "_"), F.lit("_"), (F.col("id") % 2100).cast("string")), F.concat(word(1), F.lit("="), word(2), F.lit("/"), word(3), F.lit("="), word(4)))
    plain = spark.range(n).select(F.element_at(styles, (F.col("id") % 8 + 1).cast("int")).alias("sample"), F.lit(False).alias("random"))
    return random.unionByName(plain)


class Model(NamedTuple):
    """What the two Markov models say, and how they did on samples kept aside."""

    ratios: list[float]  # log-likelihood ratio of successive characters a and b, at 80 * (a - 43) + b - 43, to 3 digits
    threshold: float
    found: float  # share of random samples at or above the threshold
    alarms: float  # share of ordinary ones


def train(samples: DataFrame, quantile: float = QUANTILE) -> Model:
    """Both models (add-one smoothed) and the threshold, from labelled samples (sample, random).

    Counted by group; at most 2 * 80**2 counts and two rows come to the driver.
    """
    known = samples.where(F.col("sample").isNotNull() & F.col("random").isNotNull()).select("sample", "random")
    aside = F.pmod(F.xxhash64(F.lit("aside"), "sample"), F.lit(FOLDS)) == 0
    ratios = _ratios(known.where(~aside))
    scored = known.where(aside).select("random", best_part(F.col("sample"), ratios)["ratio"].alias("ratio"))
    limit = scored.where(~F.col("random")).agg(F.percentile("ratio", quantile).alias("t")).first().t
    threshold = max(0.0, limit or 0.0)
    shares = {r.random: r.share for r in scored.groupBy("random").agg(F.avg((F.col("ratio") >= threshold).cast("double")).alias("share")).collect()}
    return Model(ratios, threshold, shares.get(True, 0.0), shares.get(False, 0.0))


def default_model(spark: SparkSession) -> Model:
    """The model of the default samples, trained once an application."""
    app = spark.sparkContext.applicationId
    if app not in _TRAINED:
        _TRAINED[app] = train(default_samples(spark))
    return _TRAINED[app]


def _ratios(samples: DataFrame) -> list[float]:
    chars = F.filter(F.split(F.col("sample"), ""), lambda c: (c != "") & F.ascii(c).between(_FIRST, _FIRST + _CODES - 1))
    codes = samples.select("random", F.transform(chars, lambda c: F.ascii(c) - _FIRST).alias("c"))
    pairs = codes.where(F.size("c") > 1).select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("p")).groupBy("random", "p").agg(F.count(F.lit(1)).alias("n"))
    counts = {True: {}, False: {}}
    for r in pairs.collect():
        counts[r.random][r.p[0] * _CODES + r.p[1]] = r.n
    used = 66  # characters that a candidate can have
    total = {k: [sum(v.get(a * _CODES + b, 0) for b in range(_CODES)) for a in range(_CODES)] for k, v in counts.items()}
    prob = lambda k, at: (counts[k].get(at, 0) + 1) / (total[k][at // _CODES] + used)
    return [round(math.log(prob(True, at) / prob(False, at)), 3) for at in range(_CODES * _CODES)]


def best_part(token: Column, ratios: list[float]) -> Column:
    """(ratio, start, value) of an ASCII token: its stretch of greatest log-likelihood ratio, drawn out to the next marks; start counts from 0."""
    weights = F.lit(np.array(ratios, dtype=np.float64))
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c) - _FIRST)  # split once: a character is then found in constant time
    none = F.struct(F.lit(None).cast("int").alias("code"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(1).alias("since"), F.lit(0.0).alias("best"), F.lit(1).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, code: Column) -> Column:
        now = s["sum"] + F.coalesce(F.get(weights, s["code"] * _CODES + code), F.lit(0.0))
        better, at = now > s["best"], s["at"] + 1
        return F.struct(
            code.alias("code"),
            at.alias("at"),
            F.greatest(now, F.lit(0.0)).alias("sum"),
            F.when(now > 0, s["since"]).otherwise(at).alias("since"),
            F.when(better, now).otherwise(s["best"]).alias("best"),
            F.when(better, s["since"]).otherwise(s["first"]).alias("first"),
            F.when(better, at).otherwise(s["last"]).alias("last"),
        )

    def drawn_out(s: Column) -> Column:
        before = lambda n, pattern: F.length(F.regexp_extract(F.reverse(F.substr(token, F.lit(1), n)), pattern, 0))  # noqa: E731 - anchored at its beginning, so it is read once
        left = before(s["first"] - 1, "^[A-Za-z0-9+]*")
        right = F.length(F.regexp_extract(F.substr(token, s["last"] + 1), "^[A-Za-z0-9+]*", 0))
        marks = F.length(F.regexp_extract(F.substr(token, s["first"]), "^[/=_-]*", 0))
        behind = before(s["last"], "^[/_-]*")
        last = s["last"] + F.when(behind > 0, -behind).otherwise(right)
        first = s["first"] + F.when(marks > 0, marks).otherwise(-left)
        return F.struct(s["best"].alias("ratio"), (first - 1).alias("start"), F.substr(token, first, F.greatest(last - first + 1, F.lit(0))).alias("value"))

    return F.aggregate(codes, none, step, drawn_out)


def _offsets(lengths: Column) -> Column:
    """Exclusive prefix sums of an array, in blocks of its square root."""
    n = F.size(lengths)
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda k: F.aggregate(F.slice(lengths, k * block + 1, block), F.lit(0), lambda s, x: s + x))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    return F.struct(block.alias("block"), before.alias("before"))


def _spans(df: DataFrame, kind: str, pattern: str, group: int, least: int, rank: int) -> DataFrame:
    """Adds column ``kind``: array of (start, rank, end, value) of the pattern's matches that are long enough."""
    df = df.withColumn("m", F.when(F.col("text").rlike(pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("g", F.when(F.size("m") > 0, F.transform(F.split("text", pattern, -1), F.length)))
    df = df.withColumn("t", F.zip_with(F.slice("g", 1, F.size("m")), "m", lambda a, b: a + F.length(b))).withColumn("o", F.when(F.size("m") > 0, _offsets(F.col("t"))))

    def span(m: Column, i: Column) -> Column:
        at = F.floor(i / F.col("o.block")).cast("int")
        here = F.slice("t", at * F.col("o.block") + 1, i - at * F.col("o.block"))
        start = F.element_at("o.before", at + 1) + F.aggregate(here, F.lit(0), lambda s, x: s + x) + F.get("g", i)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), m.alias("value"))

    found = F.filter(F.transform("m", span), lambda s: F.length(F.regexp_extract(s["value"], pattern, group) if group else s["value"]) >= least)
    return df.withColumn(kind, F.coalesce(found, F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>"))).drop("m", "g", "t", "o")


def _scanned(texts: DataFrame, model: Model | None) -> DataFrame:
    """Adds array columns of spans to ``texts``, whose only columns are ``text`` and ``row``."""
    model = default_model(texts.sparkSession) if model is None else model
    df = texts.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        df = _spans(df, kind, pattern, group, least, rank)
    df = _spans(df, "markov", CANDIDATE, 0, LEAST_TOKEN, len(BASE))
    base = F.concat(*BASE)
    parts = F.transform("markov", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), best_part(s["value"], model.ratios).alias("part")))
    likely = F.filter(parts, lambda s: (s["part"]["ratio"] >= model.threshold) & (F.length(s["part"]["value"]) >= LEAST_TOKEN))

    def span(s: Column) -> Column:
        start = s["start"] + s["part"]["start"]
        return F.struct(start.alias("start"), s["rank"].alias("rank"), (start + F.length(s["part"]["value"])).alias("end"), s["part"]["value"].alias("value"))

    odd = F.filter(F.transform(likely, span), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.withColumn("markov", odd).withColumn("found", F.array_sort(F.concat(base, "markov")))


def scan(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """(row, text, the spans (start, rank, end, value) of each base kind and of ``markov``, and ``found`` with all in order); ``row`` is the row of ``docs``."""
    return _scanned(docs.select(F.struct(*[_field(c) for c in docs.columns]).alias("row"), _field(text_col).alias("text")), model)


def _field(name: str) -> Column:
    return F.col(f"`{name}`")


def _listed(spans: Column | str) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*BASE, "markov")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    df = scan(docs.select("doc_id", "text"), model)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("row.doc_id", *counts, F.sha2(_listed(F.array_sort(F.concat(*BASE))), 256).alias("base_sha256"), _listed("found").alias("spans"))


def redact(docs: DataFrame, model: Model | None = None, mark: str = MARK) -> DataFrame:
    """The documents with each found secret, and every other occurrence of the same string, replaced by ``mark``; n_chars follows the text.

    Longer secrets go first, so one that contains another leaves no rest. Texts without secrets stay as they are, null included, and so does every other column.
    """
    values = F.array_sort(F.array_distinct(F.transform("found", lambda s: s["value"])), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.when(F.size("found") == 0, F.col("row.text")).otherwise(F.aggregate(values, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark))))
    df = scan(docs, model).select("row", "found", clean.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.size("found") == 0, F.col("row.n_chars")).otherwise(F.length("clean")).cast("long")} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return df.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
