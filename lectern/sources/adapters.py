"""Adapters of public sources as Spark data sources: one row a requested id or page, fetched on the executors.

``spark.dataSource.register(HttpJson)`` then
``spark.read.format("http_json").option("urls", ...)``. Fetching goes through a
function that can be replaced (tests, caches, proxies); a failed request is a
row with an error, never a failed query.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib import error, parse, request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.operators.ordering import positions

Fetch = Callable[[str, bytes | None, int], str]

# Public endpoints.
RCSB, RCSB_SEARCH, RCSB_FILES = "https://data.rcsb.org/rest/v1/core", "https://search.rcsb.org/rcsbsearch/v2/query", "https://files.rcsb.org/download"
CLINICAL_TRIALS = "https://clinicaltrials.gov/api/v2/studies"
DAILYMED = "https://dailymed.nlm.nih.gov/dailymed/services/v2"
BATCH = 100


class OutOfCredits(RuntimeError):
    """The provider wants payment (status 402): asking again is no use."""


def http(url: str, body: bytes | None = None, timeout: int = 30) -> str:
    """Text of a GET, or of a POST with a JSON body."""
    headers = {"User-Agent": "lectern", **({"Content-Type": "application/json"} if body else {})}
    try:
        with request.urlopen(request.Request(url, data=body, headers=headers), timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")
    except error.HTTPError as e:
        if e.code == 402:
            raise OutOfCredits(f"out of credits: {url}") from e
        raise


def entry_url(pdb_id: str) -> str:
    return f"{RCSB}/entry/{pdb_id.upper()}"


def entity_url(pdb_id: str, entity: str) -> str:
    return f"{RCSB}/polymer_entity/{pdb_id.upper()}/{entity}"


def mmcif_url(pdb_id: str) -> str:
    return f"{RCSB_FILES}/{pdb_id.upper()}.cif"


def pdb_url(pdb_id: str) -> str:
    return f"{RCSB_FILES}/{pdb_id.upper()}.pdb"


def trials_url(query: str, limit: int = 10) -> str:
    return f"{CLINICAL_TRIALS}?{parse.urlencode({'query.term': query, 'pageSize': limit, 'format': 'json'})}"


def labels_url(name: str) -> str:
    return f"{DAILYMED}/spls.json?{parse.urlencode({'drug_name': name})}"


def label_url(set_id: str) -> str:
    return f"{DAILYMED}/spls/{set_id}.xml"


def _search(query: dict, rows: int, start: int) -> bytes:
    return json.dumps({"query": {"type": "terminal", **query}, "return_type": "entry", "request_options": {"paginate": {"start": start, "rows": rows}}}).encode()


def peptide_search(limit: int, start: int = 0, kind: str = "Protein") -> bytes:
    """Search body: entries with a polymer entity of a type."""
    return _search({"service": "text", "parameters": {"attribute": "entity_poly.rcsb_entity_polymer_type", "operator": "exact_match", "value": kind}}, limit, start)


def text_search(text: str, limit: int, start: int = 0) -> bytes:
    """Search body: ids of entries that a full-text query finds."""
    return _search({"service": "full_text", "parameters": {"value": text}}, limit, start)


# The fields of an entry that builders read.
ENTRY_FIELDS = "rcsb_id exptl { method } rcsb_accession_info { initial_release_date } polymer_entities { rcsb_id entity_poly { type pdbx_seq_one_letter_code_can rcsb_sample_sequence_length } rcsb_polymer_entity_container_identifiers { entity_id auth_asym_ids asym_ids } }"
ENTRIES = "data struct<entries:array<struct<rcsb_id:string,exptl:array<struct<method:string>>,rcsb_accession_info:struct<initial_release_date:string>,polymer_entities:array<struct<rcsb_id:string,entity_poly:struct<type:string,pdbx_seq_one_letter_code_can:string,rcsb_sample_sequence_length:int>,rcsb_polymer_entity_container_identifiers:struct<auth_asym_ids:array<string>,asym_ids:array<string>>>>>>>"


def entry_batches(ids: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, ids, body): entry ids (pdb_id) in batches of ``size`` with the GraphQL body that asks for them."""
    batch = F.floor(F.col("at") / size).alias("batch")
    packed = positions(ids.select(F.upper("pdb_id").alias("pdb_id")).distinct(), ["pdb_id"], "at").groupBy(batch).agg(F.array_sort(F.collect_list("pdb_id")).alias("ids"))
    query = F.concat(F.lit("{ entries(entry_ids: "), F.to_json("ids"), F.lit(") { " + ENTRY_FIELDS + " } }"))
    return packed.withColumn("body", F.to_json(F.struct(query.alias("query"))))


def entities(answers: DataFrame, text: str = "text") -> DataFrame:
    """(pdb_id, entity_id, chains, asym_chains, kind, sequence, length) of the entities in GraphQL answers; a failed answer has none."""
    entry = answers.select(F.explode(F.from_json(text, ENTRIES)["data"]["entries"]).alias("e"))
    one = entry.select(F.col("e.rcsb_id").alias("pdb_id"), F.explode("e.polymer_entities").alias("p"))
    ids = "p.rcsb_polymer_entity_container_identifiers"
    sequence = F.col("p.entity_poly.pdbx_seq_one_letter_code_can")
    return one.select("pdb_id", F.substring_index("p.rcsb_id", "_", -1).alias("entity_id"), F.col(f"{ids}.auth_asym_ids").alias("chains"), F.col(f"{ids}.asym_ids").alias("asym_chains"), F.col("p.entity_poly.type").alias("kind"), sequence.alias("sequence"), F.coalesce("p.entity_poly.rcsb_sample_sequence_length", F.length(sequence), F.lit(0)).alias("length"))


def entry_dates(answers: DataFrame, text: str = "text") -> DataFrame:
    """(pdb_id, method, released) of the entries in GraphQL answers: the first method, and the day of release."""
    entry = answers.select(F.explode(F.from_json(text, ENTRIES)["data"]["entries"]).alias("e"))
    return entry.select(F.col("e.rcsb_id").alias("pdb_id"), F.get("e.exptl.method", F.lit(0)).alias("method"), F.left("e.rcsb_accession_info.initial_release_date", F.lit(10)).alias("released"))


def found_ids(answers: DataFrame, text: str = "text") -> DataFrame:
    """(pdb_id, ord) of a search answer, in its order."""
    return answers.select(F.posexplode(F.from_json(text, "result_set array<struct<identifier:string>>")["result_set"]).alias("ord", "r")).select(F.col("r.identifier").alias("pdb_id"), "ord")


def entry_metadata(answers: DataFrame, text: str = "text") -> DataFrame:
    """(pdb_id, method, resolution_angstrom, entity_ids) of entry answers."""
    kind = "rcsb_id string, exptl array<struct<method:string>>, rcsb_entry_info struct<resolution_combined:array<double>>, rcsb_entry_container_identifiers struct<polymer_entity_ids:array<string>>"
    e = answers.select(F.from_json(text, kind).alias("e"))
    return e.select("e.rcsb_id", F.get("e.exptl.method", F.lit(0)).alias("method"), F.get("e.rcsb_entry_info.resolution_combined", F.lit(0)).alias("resolution_angstrom"), F.col("e.rcsb_entry_container_identifiers.polymer_entity_ids").alias("entity_ids")).withColumnRenamed("rcsb_id", "pdb_id").where("pdb_id is not null")


def labels(answers: DataFrame, text: str = "text") -> DataFrame:
    """(set_id, version, title) of label searches."""
    rows = answers.select(F.explode(F.from_json(text, "data array<struct<setid:string,spl_version:string,title:string>>")["data"]).alias("r"))
    return rows.select(F.col("r.setid").alias("set_id"), F.col("r.spl_version").alias("version"), F.col("r.title").alias("title"))


def cached(urls: DataFrame, store: DataFrame | None, fetch: Fetch = http, valid: Column | None = None, timeout: int = 30) -> DataFrame:
    """(url, text) of each url: from ``store`` (url, text) where it has it, else fetched; null where that fails or the text isn't ``valid``."""
    wanted = urls.select("url").distinct()
    known = wanted.join(store, "url") if store is not None else wanted.limit(0).withColumn("text", F.lit(None).cast("string"))
    rest = fetch_column(wanted.join(store.select("url"), "url", "left_anti") if store is not None else wanted, "url", fetch, timeout).select("url", "text")
    out = known.select("url", "text").unionByName(rest)
    return out if valid is None else out.withColumn("text", F.when(valid, F.col("text")))


def has_atoms(text: str = "text") -> Column:
    """The text of a coordinate file has at least one atom line."""
    return F.coalesce(F.col(text).rlike("(?m)^(ATOM  |HETATM)"), F.lit(False))


def save_texts(answers: DataFrame, path: str, name: str = "url") -> None:
    """Fetched texts as a table below ``path``, a row an answer: a cache that later runs read."""
    answers.where("text is not null").select(F.col(name), "text").write.mode("append").parquet(path)


class _Url(InputPartition):
    def __init__(self, url: str, body: bytes | None):
        self.url, self.body = url, body


class _Reader(DataSourceReader):
    fetch: Fetch = staticmethod(http)

    def __init__(self, options: dict):
        self.urls, self.timeout = json.loads(options.get("urls", "[]")), int(options.get("timeout", "30"))
        self.body = options.get("body")

    def partitions(self) -> list[InputPartition]:
        return [_Url(u, self.body.encode() if self.body else None) for u in self.urls]

    def read(self, partition: _Url) -> Iterator[tuple]:
        try:
            yield partition.url, type(self).fetch(partition.url, partition.body, self.timeout), None
        except Exception as e:  # the row says what went wrong
            yield partition.url, None, f"{type(e).__name__}: {e}"[:300]


class HttpJson(DataSource):
    """(url, text, error) of each url in the option ``urls`` (a JSON list), a partition a request."""

    reader_class: type[_Reader] = _Reader

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return self.reader_class(dict(self.options))


def fetch_all(spark: SparkSession, urls: list[str], timeout: int = 30, body: str | None = None, source: type[DataSource] = HttpJson) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("urls", json.dumps(urls)).option("timeout", str(timeout))
    return (reader.option("body", body) if body else reader).load()


def fetch_column(df: DataFrame, url: str, fetch: Fetch = http, timeout: int = 30) -> DataFrame:
    """Adds (text, error) of the url column, fetched where the rows are; the Arrow batch bounds what is open at once."""
    import pandas as pd

    def one(u: str) -> tuple[str | None, str | None]:
        try:
            return fetch(u, None, timeout), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"[:300]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(u) for u in b[url]]
            yield b.assign(text=[t for t, _ in found], error=[e for _, e in found])

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, text string, error string")


def reference(source: str, source_id: Column, url: Column, **metadata: Column) -> Column:
    """Envelope of a source reference."""
    return F.struct(F.lit(source).alias("source_database"), source_id.alias("source_id"), url.alias("source_url"), *[v.alias(k) for k, v in metadata.items()])


def status(manifest: DataFrame, track: str, created: Column, limitation: Column) -> DataFrame:
    """(source_database, track, cases_created, adapter_status, release_limitation) of each source."""
    return manifest.select(F.col("name").alias("source_database"), F.lit(track).alias("track"), created.alias("cases_created"), "adapter_status", limitation.alias("release_limitation"))


#: Sources whose adapters fetch; all others of a manifest are known by name and url only.
FETCHING = {"rcsb": (entry_url, entity_url, mmcif_url), "clinicaltrials": (trials_url,), "dailymed": (labels_url, label_url)}


def registry(manifest: DataFrame) -> DataFrame:
    """(name, url, fetches) of every source of a manifest: whether its adapter fetches or only names it."""
    return manifest.select("name", "url", F.lower("name").isin(*FETCHING).alias("fetches"))
