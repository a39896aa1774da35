"""Resources of a FHIR server: a Spark data source, and a catalog over it.

`spark.read.format("fhir_search").options(url=..., resource=..., query=..., ...).schema(...).load()` gives a row
for each entry of the search's bundles. Options:

* mapping: JSON object column -> path (a.b.c; lists: the first element), default the column's name
* token: bearer token; page_size: entries of a page; attempts: at a page that fails in passing
* offset_parameter: if the server pages by offset, its name: pages are then read by as many tasks; else
  one task follows the bundles' next links, to the last one

`FhirCatalog` sends a leaf's filter to the server as it is, with the source population's lists, asks for the elements
that the request needs, and joins columns of referenced resources, whose ids are looked up in chunks by many tasks.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.model import PATIENT, Leaf, RequestError
from .catalog import LOGICAL, Catalog
from .retry import ATTEMPTS, retried

#: Fixed value: the security label of patients who must not be listed.
NOLIST = "http://terminology.hl7.org/CodeSystem/v3-ActCode|NOLIST"


def at_path(value, path: str):
    """The first value at a path; a reference or an id is reduced to its id part."""
    for name in path.split("."):
        while isinstance(value, list):
            value = value[0] if value else None
        value = value.get(name) if isinstance(value, dict) else None
    while isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("reference", value.get("value"))
    return value


def typed(value, kind: T.DataType):
    """A bundle's value as its column's type; what cannot be read is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.DateType):
            return date.fromisoformat(str(value)[:10])
        if isinstance(kind, T.TimestampType):
            return datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        if isinstance(kind, (T.LongType, T.IntegerType)):
            return int(str(value).rpartition("/")[2])
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else str(value).lower() == "true"
    except ValueError:
        return None
    text = str(value)
    return text.rpartition("/")[2] if "/" in text and not text.startswith("http") else text


def rows_of(bundle: dict, schema: T.StructType, mapping: dict[str, str]) -> Iterator[tuple]:
    for entry in bundle.get("entry") or ():
        resource = entry.get("resource") or {}
        yield tuple(typed(at_path(resource, mapping.get(f.name, f.name)), f.dataType) for f in schema.fields)


def next_link(bundle: dict) -> str | None:
    return next((x["url"] for x in bundle.get("link") or () if x.get("relation") == "next"), None)


def fetched(url: str, token: str | None = None, attempts: int = ATTEMPTS) -> dict:
    headers = {"Accept": "application/fhir+json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def once() -> dict:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:
            return json.load(r)

    return retried(once, attempts)


def pages(url: str, token: str | None = None, attempts: int = ATTEMPTS) -> Iterator[dict]:
    """The bundles of a search, from page to page."""
    while url:
        bundle = fetched(url, token, attempts)
        yield bundle
        url = next_link(bundle)


class Page(InputPartition):
    def __init__(self, url: str, follow: bool):
        self.url, self.follow = url, follow


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.mapping = json.loads(options.get("mapping", "{}"))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def _url(self, **more) -> str:
        query = [p for p in self.options.get("query", "").split("&") if p]
        return f"{self.options['url'].rstrip('/')}/{self.options['resource']}?{'&'.join([*query, urllib.parse.urlencode(more)])}"

    def partitions(self) -> list[Page]:
        size, name = int(self.options.get("page_size", 1000)), self.options.get("offset_parameter")
        if not name:
            return [Page(self._url(_count=size), True)]
        total = fetched(self._url(_count=0), self.options.get("token"), self.attempts).get("total", 0)
        return [Page(self._url(_count=size, **{name: k}), False) for k in range(0, total, size)] or [Page(self._url(_count=size), False)]

    def read(self, partition: Page) -> Iterator[tuple]:
        token = self.options.get("token")
        found = pages(partition.url, token, self.attempts) if partition.follow else [fetched(partition.url, token, self.attempts)]
        for bundle in found:
            yield from rows_of(bundle, self.schema, self.mapping)


class FhirSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fhir_search"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def count(url: str, resource: str, query: str = "", token: str | None = None) -> int:
    """The total of a search, without its entries."""
    return fetched(f"{url.rstrip('/')}/{resource}?{query + '&' if query else ''}_count=0", token).get("total", 0)


def search(spark: SparkSession, url: str, resource: str, schema: str, query: str = "", **options) -> DataFrame:
    spark.dataSource.register(FhirSearch)
    return spark.read.format("fhir_search").options(url=url, resource=resource, query=query, **options).schema(schema).load()


def with_reference(rows: DataFrame, looked_up: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns of a referenced resource (id, *columns): a left join, so that a missing reference gives nulls."""
    other = looked_up.groupBy("id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns)).withColumnRenamed("id", "_key")
    return rows.join(other, rows[key] == other["_key"], "left").drop("_key")


@dataclass(frozen=True)
class Reference:
    """Another resource, found by the id that a path of this one refers to."""

    path: str
    resource: str


@dataclass(frozen=True)
class RestResource:
    """columns: logical column -> path. Those in `referenced` lie in the resource that the reference leads to."""

    columns: dict[str, str]
    referenced: dict[str, Reference] = field(default_factory=dict)


_ENCOUNTER = Reference("encounter", "Encounter")
_ITEM = RestResource(
    {"id": "id", "patient": "subject", "encounter": "encounter", "code": "code.coding.code", "encounter_start_date": "period.start", "encounter_end_date": "period.end", "episodeOfCare": "episodeOfCare"},
    {"encounter_start_date": _ENCOUNTER, "encounter_end_date": _ENCOUNTER, "episodeOfCare": _ENCOUNTER},
)


def _item(date_path: str, **columns: str) -> RestResource:
    return RestResource(_ITEM.columns | {"event_date": date_path} | columns, _ITEM.referenced)


#: Resources as the standard lays them out.
RESOURCES = {
    "Patient": RestResource({"id": "id", "patient": "id", "patient_birthdate": "birthDate"}),
    "Encounter": RestResource({"id": "id", "patient": "subject", "encounter": "id", "encounter_start_date": "period.start", "encounter_end_date": "period.end", "episodeOfCare": "episodeOfCare"}),
    "Condition": _item("recordedDate"),
    "Observation": _item("effectiveDateTime"),
    "Procedure": _item("performedDateTime"),
    "DocumentReference": _item("date", code="type.coding.code", encounter="context.encounter"),
    "MedicationRequest": _item("authoredOn", code="medicationCodeableConcept.coding.code"),
    "ImagingStudy": _item("started", code="procedureCode.coding.code"),
}


class FhirCatalog(Catalog):
    """Resources of a server's REST interface. Rows come from Spark tasks, page by page; nothing is collected.

    cohorts are the server's lists (`_list`); active_only leaves inactive patients out of the population.
    """

    def __init__(self, spark: SparkSession, url: str, resources: dict[str, RestResource] | None = None, cohorts: Iterable[int] = (), token: str = "", page_size: int = 1000, attempts: int = ATTEMPTS, active_only: bool = True, offset_parameter: str = ""):
        self.spark, self.url, self.resources, self.cohorts = spark, url.rstrip("/"), RESOURCES if resources is None else resources, tuple(cohorts)
        self.token, self.page_size, self.attempts, self.active_only, self.offset_parameter = token, page_size, attempts, active_only, offset_parameter

    def for_cohorts(self, cohorts: Iterable[int]) -> FhirCatalog:
        return FhirCatalog(self.spark, self.url, self.resources, cohorts, self.token, self.page_size, self.attempts, self.active_only, self.offset_parameter)

    def resource(self, name: str) -> RestResource:
        if name not in self.resources:
            raise RequestError(f"unknown resource {name!r}")
        return self.resources[name]

    def columns(self, resource: str) -> frozenset[str]:
        return frozenset(self.resource(resource).columns)

    def _query(self, text: str) -> str:
        """A filter with the source population's lists."""
        lists = f"_list={','.join(map(str, self.cohorts))}" if self.cohorts else ""
        return "&".join(p for p in (text.strip().strip("&"), lists) if p)

    def _read(self, resource: str, query: str, columns: dict[str, str]) -> DataFrame:
        """(columns) of a search; columns: name -> path."""
        query = f"{query}&_elements={','.join(sorted({p.split('.')[0] for p in columns.values()}))}".lstrip("&")
        options = {"mapping": json.dumps(columns), "page_size": self.page_size, "attempts": self.attempts}
        options |= {k: v for k, v in (("token", self.token), ("offset_parameter", self.offset_parameter)) if v}
        return search(self.spark, self.url, resource, ", ".join(f"`{c}` {LOGICAL.get(c, 'string')}" for c in columns), query, **options)

    def scan(self, leaf: Leaf, columns: Iterable[str]) -> DataFrame:
        source = self.resource(leaf.resource)
        wanted = sorted({"patient", *columns})
        has = [c for c in wanted if c in source.columns]
        own = {c: source.columns[c] for c in has if c not in source.referenced}
        references = {source.referenced[c] for c in has if c in source.referenced}
        rows = self._read(leaf.resource, self._query(leaf.filter_fhir), own | {f"_{r.resource}": r.path for r in references})
        for r in sorted(references, key=lambda r: r.resource):
            rows = self._joined(rows, r, {c: source.columns[c] for c in has if source.referenced.get(c) == r})
        return rows.select(*(F.col(c).cast(LOGICAL[c]).alias(c) if c in has else F.lit(None).cast(LOGICAL[c]).alias(c) for c in wanted))

    def _joined(self, rows: DataFrame, reference: Reference, columns: dict[str, str]) -> DataFrame:
        """rows with columns of the resource that they refer to (null where it is missing)."""
        key = f"_{reference.resource}"
        ids = rows.select(F.col(key).alias("id")).filter("id is not null").distinct()
        schema = T._parse_datatype_string(", ".join(["id string", *(f"`{c}` {LOGICAL[c]}" for c in columns)]))
        find = lookup(self.url, reference.resource, schema, {"id": "id"} | columns, self.token, self.page_size, self.attempts)
        return with_reference(rows, ids.mapInPandas(find, schema), key, list(columns)).drop(key)

    def _patients(self) -> str:
        """The default filter of the population."""
        return self._query(f"_security:not={urllib.parse.quote_plus(NOLIST)}" + ("&active=true" if self.active_only else ""))

    def population(self) -> DataFrame:
        source = self.resource(PATIENT)
        return self._read(PATIENT, self._patients(), {"patient": source.columns["patient"]}).filter("patient is not null")

    def count_patients(self) -> int:
        """The population's size as the server tells it, without reading patients."""
        return count(self.url, PATIENT, self._patients(), self.token)


def lookup(url: str, resource: str, schema: T.StructType, mapping: dict[str, str], token: str = "", page_size: int = 1000, attempts: int = ATTEMPTS):
    """For mapInPandas: batches of ids -> the resources with these ids, looked up page_size at a time."""

    def find(batches):
        import pandas as pd

        for batch in batches:
            names = sorted(batch["id"].tolist())
            for i in range(0, len(names), page_size):
                asked = urllib.parse.urlencode({"_id": ",".join(names[i : i + page_size]), "_count": page_size, "_elements": ",".join(sorted({p.split(".")[0] for p in mapping.values()}))}, safe=",")
                for bundle in pages(f"{url}/{resource}?{asked}", token, attempts):
                    yield pd.DataFrame(rows_of(bundle, schema, mapping), columns=schema.names, dtype=object)

    return find
