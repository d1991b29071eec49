"""Searches of public services as a Spark data source that reads no more pages than a query asks for.

A row is a hit: (term, page, ord, record, error), ``ord`` its place among the
hits of its term, from 0. Filters on ``term`` (equal, in) say what is asked, and
an upper bound of ``ord`` is the limit, a lower one (where pages go by offset) the
first page: they are pushed into the plan and decide which pages are partitions. A service that pages by offset has a partition a
page; without a limit its first answer says how many hits there are. A service
that pages by token has a partition a term, which follows the tokens up to the
limit. A page that fails is a row with an error, and the last of its partition.

Defined cases: no term, or a limit below 1, asks nothing; a term without hits has
no rows; an answer that isn't JSON is an error; null terms are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib import parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lectern.sources import adapters
from lectern.sources.adapters import Fetch, http

PAGE = 100
SCHEMA = "term string, page int, ord long, record string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Service(NamedTuple):
    """How a service is asked: by offset (``total`` names the field with the number of hits) or by token (``token`` names the field with the next one)."""

    hits: str
    total: str | None
    token: str | None

    def request(self, name: str, term: str, start: int, rows: int, token: str | None) -> tuple[str, bytes | None]:
        if name == "rcsb_text":
            return adapters.RCSB_SEARCH, adapters.text_search(term, rows, start)
        if name == "rcsb_polymer":
            return adapters.RCSB_SEARCH, adapters.peptide_search(rows, start, term)
        if name == "dailymed":
            return f"{adapters.labels_url(term)}&{parse.urlencode({'page': start // rows + 1, 'pagesize': rows})}", None
        return adapters.trials_url(term, rows) + (f"&{parse.urlencode({'pageToken': token})}" if token else ""), None


# Fields of the services' answers.
SERVICES = {
    "rcsb_text": Service("result_set", "total_count", None),
    "rcsb_polymer": Service("result_set", "total_count", None),
    "dailymed": Service("data", "metadata.total_elements", None),
    "clinicaltrials": Service("studies", None, "nextPageToken"),
}


class _Page(InputPartition):
    def __init__(self, term: str, start: int, most: int | None):
        self.term, self.start, self.most = term, start, most


class _Reader(DataSourceReader):
    fetch: Fetch = staticmethod(http)

    def __init__(self, options: dict):
        self.name = options["service"]
        self.service, self.rows, self.timeout = SERVICES[self.name], int(options.get("page", PAGE)), int(options.get("timeout", "30"))
        self.terms: list[str] = []
        self.limit: int | None = None
        self.first = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        asked: list[set[str]] = []
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("term",):
                asked.append({f.value})
            elif isinstance(f, In) and f.attribute == ("term",):
                asked.append(set(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("ord",):
                most = f.value + isinstance(f, LessThanOrEqual)
                self.limit = most if self.limit is None else min(self.limit, most)
            else:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("ord",):
                    self.first = max(self.first, f.value)  # which pages; which of their rows is Spark's own
                yield f
        self.terms = sorted(t for t in set.intersection(*asked) if t is not None) if asked else []

    def _ask(self, term: str, start: int, token: str | None = None) -> dict:
        url, body = self.service.request(self.name, term, start, self.rows, token)
        return json.loads(type(self).fetch(url, body, self.timeout) or "{}")

    def partitions(self) -> list[InputPartition]:
        pages: list[InputPartition] = []
        for term in self.terms:
            most = self.limit
            if most is not None and most < 1:
                continue
            if self.service.token:
                pages.append(_Page(term, 0, most))
                continue
            if most is None:
                try:
                    most = self._ask(term, 0)
                    for name in self.service.total.split("."):
                        most = most.get(name, 0)
                except Exception:  # the page itself will say what went wrong
                    most = 1
            pages += [_Page(term, start, min(self.rows, most - start)) for start in range(self.first // self.rows * self.rows, int(most), self.rows)]
        return pages or [_Page("", 0, 0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        at, token, page = partition.start, None, partition.start // self.rows
        last = None if partition.most is None else partition.start + partition.most
        while last is None or at < last:
            try:
                answer = self._ask(partition.term, at, token)
            except Exception as e:
                yield partition.term, page, at, None, f"{type(e).__name__}: {e}"[:300]
                return
            for hit in answer.get(self.service.hits) or []:
                if last is None or at < last:
                    yield partition.term, page, at, json.dumps(hit, sort_keys=True), None
                at += 1
            token, page = answer.get(self.service.token or "", None), page + 1
            if not token:
                return


class Search(DataSource):
    """Hits of a service named in the option ``service``; ``page`` is the number of hits a request."""

    reader_class: type[_Reader] = _Reader

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return self.reader_class(dict(self.options))


def search(spark: SparkSession, service: str, terms: list[str], limit: int | None = None, page: int = PAGE, fetch: Fetch = http) -> DataFrame:
    """The hits of each term, the first ``limit``; what the frame is filtered by further is Spark's work."""
    reader = type("Reader", (_Reader,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(type("Named", (Search,), {"reader_class": reader}))
    spark.conf.set(PUSHDOWN, "true")
    hits = spark.read.format("paged_search").option("service", service).option("page", str(page)).load().where(F.col("term").isin(*terms))
    return hits if limit is None else hits.where(F.col("ord") < limit)


def identifiers(hits: DataFrame) -> DataFrame:
    """(term, ord, pdb_id) of hits that are entries."""
    return hits.select("term", "ord", F.get_json_object("record", "$.identifier").alias("pdb_id")).where("pdb_id is not null")
