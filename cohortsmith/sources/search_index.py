"""Documents of a search index with a JSON interface, as a Spark data source for reading and writing.

`spark.read.format("search_index").options(url=..., collection=..., query=...).schema(...).load()` reads
<url>/<collection>/select page by page along its cursor, with only the schema's fields; each page is tried again if it fails
in passing. `df.write.format("search_index").options(url=..., collection=...).mode("append").save()` posts documents to
<url>/<collection>/update, in batches from every task, and commits once all tasks are done. Documents with an id
that is there already replace it, so that a task that runs again does no harm. Options: rows (of a page or batch), attempts.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .fhir_rest import typed
from .retry import ATTEMPTS, retried

ROWS = 10_000


def asked(url: str, body=None, attempts: int = ATTEMPTS) -> dict:
    data = None if body is None else json.dumps(body).encode()

    def once() -> dict:
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=60) as r:
            return json.load(r)

    return retried(once, attempts)


@dataclass(frozen=True)
class Index:
    url: str
    collection: str
    rows: int = ROWS
    attempts: int = ATTEMPTS

    @classmethod
    def of(cls, options: dict) -> Index:
        return cls(options["url"].rstrip("/"), options["collection"], int(options.get("rows", ROWS)), int(options.get("attempts", ATTEMPTS)))

    def select(self, **more) -> dict:
        return asked(f"{self.url}/{self.collection}/select?{urllib.parse.urlencode(more, doseq=True)}", None, self.attempts)

    def documents(self, query: list[str], fields: list[str]) -> Iterator[dict]:
        cursor = "*"
        while True:
            page = self.select(q="*:*", fq=query, fl=",".join(fields), rows=self.rows, sort="id asc", cursorMark=cursor, wt="json")
            yield from page["response"]["docs"]
            if page.get("nextCursorMark", cursor) == cursor:
                return
            cursor = page["nextCursorMark"]

    def count(self, query: list[str]) -> int:
        return self.select(q="*:*", fq=query, rows=0, wt="json")["response"]["numFound"]

    def post(self, documents: list[dict]) -> None:
        asked(f"{self.url}/{self.collection}/update", documents, self.attempts)

    def commit(self) -> None:
        asked(f"{self.url}/{self.collection}/update?commit=true", [], self.attempts)

    def wait(self, query: list[str], expected: int, seconds: float = 60, step: float = 0.5) -> bool:
        """Whether the index holds so many documents before the time is up."""
        end = time.time() + seconds
        while (n := self.count(query)) < expected and time.time() < end:
            time.sleep(step)
        return n >= expected


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a cursor is read from its start to its end

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        query = [q for q in self.options.get("query", "").split("\n") if q]
        for d in Index.of(self.options).documents(query, ["id", *(n for n in self.schema.names if n != "id")]):
            yield tuple(_value(d.get(f.name), f.dataType) for f in self.schema.fields)


def _value(value, kind: T.DataType):
    """A document's value as its column's type."""
    if isinstance(kind, T.ArrayType):
        return None if value is None else [_value(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    if isinstance(value, list):
        value = value[0] if value else None
    if value is None or isinstance(kind, T.StringType):
        return None if value is None else str(value)
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else typed(value, kind)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, rows) -> WriterCommitMessage:
        index = Index.of(self.options)
        for some in batched(rows, index.rows):
            index.post([{k: v.isoformat() if isinstance(v, (date, datetime)) else v for k, v in r.asDict(True).items() if v is not None} for r in some])
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        Index.of(self.options).commit()


class SearchIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_index"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def read(spark: SparkSession, url: str, collection: str, schema: str, query: list[str] = (), **options) -> DataFrame:
    """Documents that all queries (in the index's own language) select."""
    spark.dataSource.register(SearchIndex)
    return spark.read.format("search_index").options(url=url, collection=collection, query="\n".join(query), **options).schema(schema).load()


def write(documents: DataFrame, url: str, collection: str, **options) -> None:
    documents.sparkSession.dataSource.register(SearchIndex)
    documents.write.format("search_index").options(url=url, collection=collection, **options).mode("append").save()
