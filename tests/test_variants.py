"""Fields out of VARIANT values, against the same in plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.functions import variants

GONE = ("secret", "label")


def plain(v, path="$"):
    if isinstance(v, dict):
        out, found = {}, []
        for k in sorted(v):
            if k in GONE:
                found.append(f"{path}.{k}")
                continue
            c, more = plain(v[k], f"{path}.{k}")
            found += more
            if c is not None:
                out[k] = c
        return out, found
    if isinstance(v, list):
        parts = [plain(x, f"{path}[{i}]") for i, x in enumerate(v)]
        return [p[0] for p in parts], [x for p in parts for x in p[1]]
    return v, []


def made(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind >= 7:
        return {rng.choice(["secret", "label", "a", "b", "c", f"k{rng.randrange(400)}"]): made(rng, depth - 1) for _ in range(rng.randrange(6))}
    if kind == 6:
        return [made(rng, depth - 1) for _ in range(rng.randrange(5))]
    return [None, True, rng.randrange(-(10**12), 10**12), rng.random(), "secret", "ü" * rng.randrange(90)][kind]


def test_fields_at_any_depth(spark):
    rng = random.Random(7)
    values = [made(rng, 6) for _ in range(400)]
    values += [{f"k{i}": {"secret": i, "n": [i] * 3} for i in range(700)}, list(range(600)), {"secret": 1}, {}, [], None, "secret", {"label": None, "x": "y" * 70000}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, None)], "i int, j string").select("i", F.parse_json("j").alias("v")).repartition(3)
    got = {r.i: (r.s, r.p) for r in df.select("i", F.to_json(variants.without_fields(F.col("v"), GONE, drop_nulls=True)).alias("s"), variants.field_paths(F.col("v"), GONE).alias("p")).collect()}
    assert got.pop(-1) == (None, None)
    for i, v in enumerate(values):
        want, paths = plain(v)
        assert json.loads(got[i][0]) == want and sorted(got[i][1]) == sorted(paths), v


def test_types_and_nulls_stay(spark):
    v = F.to_variant_object(F.struct(F.lit("1.50").cast("decimal(9,2)").alias("d"), F.to_date(F.lit("2024-01-02")).alias("day"), F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("t"), F.lit(b"ab").alias("b"), F.lit(1.5).cast("float").alias("f"), F.lit(None).cast("int").alias("n"), F.lit("x").alias("secret")))
    row = spark.range(1).select(v.alias("v")).select(F.schema_of_variant(variants.without_fields(F.col("v"), GONE)).alias("s"), F.to_json(variants.without_fields(F.col("v"), GONE)).alias("j")).first()
    assert row.s == "OBJECT<b: BINARY, d: DECIMAL(2,1), day: DATE, f: FLOAT, n: VOID, t: TIMESTAMP>" and json.loads(row.j)["n"] is None


def test_errors_say_where(spark):
    df = spark.createDataFrame([('{"a":[{"b":1},{"label":2}]}',)], "j string").select(F.parse_json("j").alias("v"))
    with pytest.raises(PySparkException, match=r"field at \$\.a\[1\]\.label"):
        df.select(F.to_json(variants.asserted(F.col("v"), GONE))).collect()
    assert df.select(F.to_json(variants.asserted(variants.without_fields(F.col("v"), GONE), GONE)).alias("j")).first().j == '{"a":[{"b":1},{}]}'
