"""Paged searches: what is asked, and that no more is."""

from __future__ import annotations

import json
from urllib import parse

import pytest
from pyspark.sql import functions as F

from lectern.sources import paged


@pytest.fixture
def service(tmp_path):
    """(fetch, requests made so far): 230 hits a term by offset or token; term ``bad`` fails from hit 100 on, ``none`` has no hits."""
    log = str(tmp_path / "asked.txt")

    def fetch(url, body, timeout):
        if body:
            asked = json.loads(body)
            start, rows = asked["request_options"]["paginate"].values()
            term = asked["query"]["parameters"]["value"]
        else:
            q = parse.parse_qs(parse.urlsplit(url).query)
            term, start, rows = q["query.term"][0], int(q.get("pageToken", [0])[0]), int(q["pageSize"][0])
        with open(log, "a") as f:
            f.write(f"{term} {start}\n")
        if term == "bad" and start >= 100:
            raise OSError("gone")
        n = 0 if term == "none" else 230
        hits = [{"identifier": f"{term}{i}"} for i in range(start, min(start + rows, n))]
        return json.dumps({"total_count": n, "result_set": hits, "studies": hits, **({"nextPageToken": start + rows} if start + rows < n else {})})

    def made():
        try:
            return sorted(open(log).read().split("\n")[:-1])
        except FileNotFoundError:
            return []

    return fetch, made


def hits(df):
    return sorted((r.term, r.page, r.ord, json.loads(r.record)["identifier"]) for r in df.collect())  # a sort in Spark would read twice


@pytest.mark.parametrize("kind", ["rcsb_text", "clinicaltrials"])
def test_limits_reach_the_pages(spark, service, kind):
    fetch, made = service
    assert hits(paged.search(spark, kind, ["a", "b"], 120, 50, fetch)) == [(t, i // 50, i, f"{t}{i}") for t in "ab" for i in range(120)]
    assert made() == sorted(f"{t} {s}" for t in "ab" for s in (0, 50, 100))


@pytest.mark.parametrize("kind", ["rcsb_text", "clinicaltrials"])
def test_everything_without_a_limit(spark, service, kind):
    fetch, made = service
    assert len(hits(paged.search(spark, kind, ["a"], None, 100, fetch))) == 230
    assert set(made()) == {"a 0", "a 100", "a 200"}
    assert hits(paged.search(spark, kind, ["none"], 10, 100, fetch)) == [] == hits(paged.search(spark, kind, ["a"], 0, 100, fetch))


def test_filters_of_a_query(spark, service):
    fetch, made = service
    found = paged.search(spark, "rcsb_text", ["a", "b"], 200, 20, fetch).where("term = 'b' and ord <= 24 and ord >= 3 and record like '%4%'")
    assert [h[2] for h in hits(found)] == [4, 14, 24] and made() == ["b 0", "b 20"]
    assert paged.identifiers(found).count() == 3
    assert hits(paged.search(spark, "rcsb_text", ["a"], 5, 20, fetch).where("term = 'b'")) == []


def test_a_failed_page_is_a_row(spark, service):
    rows = paged.search(spark, "rcsb_text", ["bad"], 250, 50, service[0]).groupBy(F.col("error").isNull().alias("fine")).count().collect()
    assert {r.fine: r["count"] for r in rows} == {True: 100, False: 3}
