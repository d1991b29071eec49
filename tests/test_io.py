from __future__ import annotations

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lectern import sources
from lectern.operators import leaderboard
from lectern.sinks import files as sinks
from lectern.sources import adapters
from lectern.streaming import logs


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert [(r.a, r.b) for r in sources.read_jsonl(spark, str(p), "a int, b string").orderBy("a").collect()] == [(1, None), (2, "x")]
    p.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        sources.read_jsonl(spark, str(p), "a int").collect()
    assert sources.read_jsonl(spark, str(p), "a int", strict=False).where("a is null").count() == 1


def test_csv_and_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\n")
    r = sources.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert (r.x, r.y) == ("1", "")
    assert sources.read_text(spark, str(tmp_path / "a.csv")).first().text == "x,y\n1,\n"


def test_manifest(spark, tmp_path):
    pytest.importorskip("yaml")
    p = tmp_path / "m.yaml"
    p.write_text("sources:\n- {name: RCSB, bucket: A, url: 'https://x.org'}\n- {name: B, bucket: Z, url: nope}\n")
    m = sources.read_manifest(spark, str(p))
    assert sources.source_by_name(m, "rcsb").first().bucket == "A"
    with pytest.raises(KeyError):
        sources.source_by_name(m, "none")
    from lectern.sources.files import manifest_errors

    assert [len(r.e) for r in m.orderBy("name").select(manifest_errors(m).alias("e")).collect()] == [2, 0]


def test_release_scans(spark, tmp_path):
    for track in ("pose", "structure"):
        (tmp_path / track).mkdir()
    (tmp_path / "predictions").mkdir()
    pose = {"benchmark_id": "p", "track": "pose", "contact_label_status": "computed_contacts", "native_contacts": [{"target_residue": "A:1"}]}
    (tmp_path / "pose" / "cases.jsonl").write_text("\n".join(json.dumps(x) for x in (pose, {**pose, "benchmark_id": "q", "native_contacts": []})))
    (tmp_path / "predictions" / "x.jsonl").write_text('{"a": 1}\n')
    where = str(tmp_path)
    assert sources.read_cases(spark, where, "human_effect").count() == 0
    assert [r.benchmark_id for r in sources.cases_for_track(spark, where, "pose").collect()] == ["p"]
    assert {r.track for r in sources.read_release(spark, where).collect()} == {"pose"}
    from lectern.sources.files import benchmark_records

    assert benchmark_records(spark, where).count() == 2


def test_exports_models_and_rows(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"data": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "e.txt").write_text("one\n\ntwo\n")
    assert [r.record for r in sources.read_export(spark, str(tmp_path / "e.json"), "s").orderBy("source_index").collect()] == ['{"a":1}', '{"a":2}']
    assert [r.record for r in sources.read_export(spark, str(tmp_path / "e.txt"), "s").orderBy("source_index").collect()] == ["one", "two"]
    (tmp_path / "m.json").write_text('{"models": [{"id": "x"}]}')
    assert sources.model_list(spark, str(tmp_path / "m.json")).count() == 1
    assert sources.leaderboard_rows(spark, str(tmp_path / "none.json")).count() == 0
    assert sources.prior_run_counts(spark, str(tmp_path / "none.json")).count() == 0


def test_pdb_atoms(spark, tmp_path):
    line = lambda chain, n, x: f"ATOM      1  CA  ALA {chain}{n:>4}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00"
    (tmp_path / "a.pdb").write_text("\n".join([line("A", 1, 1.5), line(" ", 2, 2.0), "ATOM  broken", "REMARK"]))
    got = {(r.chain, r.residue, r.x) for r in sources.read_pdb_atoms(spark, str(tmp_path / "a.pdb")).collect()}
    assert got == {("A", "A:1", 1.5), ("_", "_:2", 2.0)}


class Canned(adapters._Reader):
    @staticmethod
    def fetch(url, body, timeout):
        if url.endswith("bad"):
            raise OSError("refused")
        return url.upper()


class CannedSource(adapters.HttpJson):
    reader_class = Canned

    @classmethod
    def name(cls):
        return "canned"


def test_adapters(spark):
    from lectern.runtime import ship

    ship(spark)
    frame = spark.createDataFrame([("http://x/1",), ("http://x/bad",)], "u string")

    def fetch(url, body, timeout):
        if url.endswith("bad"):
            raise OSError("refused")
        return url.upper()

    got = {r.u: (r.text, r.error) for r in adapters.fetch_column(frame, "u", fetch).collect()}
    assert got == {"http://x/1": ("HTTP://X/1", None), "http://x/bad": (None, "OSError: refused")}
    assert adapters.trials_url("a b", 3).endswith("query.term=a+b&pageSize=3&format=json") and json.loads(adapters.peptide_search(5))["request_options"]["paginate"]["rows"] == 5
    reader = Canned({"urls": '["http://x/1", "http://x/bad"]'})
    assert [next(reader.read(p))[1] for p in reader.partitions()] == ["HTTP://X/1", None]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", None), (2, "dev", "x")], "b int, split string, a string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"x","b":2,"split":"dev"}', '{"b":1,"split":"train"}']
    assert {(r.split, r.n) for r in sinks.write_splits(df, str(tmp_path / "s")).collect()} == {("train", 1), ("dev", 1)}
    sinks.replace_record(spark.createDataFrame([(2, "dev", "new")], df.schema), str(tmp_path / "j"), "b", str(tmp_path / "k"))
    assert {r.a for r in sources.read_jsonl(spark, str(tmp_path / "k"), df.schema).collect()} == {None, "new"}
    assert len(sinks.write_templates(spark, str(tmp_path / "t"))) == 4 and len(sinks.json_schemas()) == 8


def test_reports_and_packages(spark, tmp_path):
    rows = spark.createDataFrame([("m", "base", 0.5, 1, 1)], "model_id string, mode string, mean_score double, total_cases_attempted int, total_cases_completed int")
    public = leaderboard.public_rows(rows)
    sinks.write_leaderboard(public, str(tmp_path / "lb"))
    assert spark.read.option("header", True).csv(str(tmp_path / "lb" / "leaderboard.csv")).first().model_id == "m"
    assert "| 1 | m | base |" in sinks.leaderboard_report(public) and "<td>m</td>" in sinks.leaderboard_page(public)
    cases = spark.createDataFrame([("pose", "d")], "track string, source_database string")
    assert "| pose | 1 |" in sinks.datasheet(cases) and "| pose | 1 |" in sinks.benchmark_card(cases, "draft")
    none = spark.createDataFrame([], "scope string, message string")
    assert "Passed." in sinks.release_report(none)
    folder = tmp_path / "rel"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    digest = sinks.package(str(folder), str(tmp_path / "r.tgz"), none)
    assert tarfile.open(tmp_path / "r.tgz").getnames() == ["a.txt"] and digest in (tmp_path / "r.tgz.sha256").read_text()
    with pytest.raises(ValueError):
        sinks.package(str(folder), str(tmp_path / "s.tgz"), spark.createDataFrame([("a", "b")], none.schema))


def test_streams(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.mode("overwrite").parquet(str(data / "p"))
    stream = spark.readStream.schema("event_id long, k long, ts timestamp, value double").parquet(str(data / "p"))
    q = logs.latest_results(stream, ["k"], "event_id").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.k, r.event_id) for r in spark.table("latest").collect()} == {(0, 18), (1, 19), (2, 17)}
    q = logs.event_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 20


def test_copies_lose_secrets(tmp_path):
    (tmp_path / "a.txt").write_text("tml-abc_12 rest")
    assert sinks.copy_redacted(str(tmp_path / "a.txt"), str(tmp_path / "b" / "a.txt"))
    assert (tmp_path / "b" / "a.txt").read_text() == "[REDACTED] rest"
    (tmp_path / "w.bin").write_bytes(b"tml-abc_12")
    assert not sinks.copy_redacted(str(tmp_path / "w.bin"), str(tmp_path / "b" / "w.bin"))
