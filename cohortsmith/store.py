"""Cohorts in Parquet tables: headers, items, and how cohorts come from each other.

Tables only grow: a header's state is its latest row. A cohort is a snapshot (all its members) or a list of
changes to a base cohort (members added and deleted).
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.model import PATIENT, RequestError

SNAPSHOT, CHANGES = "snapshot", "changes"
PENDING, LONG_PENDING, FINISHED, ERROR = "pending", "long_pending", "finished", "entered-in-error"
#: The concepts of "comes from" and "is the source of".
COMES_FROM, SOURCE_OF = 44818821, 44818823
#: Members up to which a cohort is written at once.
LIMIT = 20_000

_COHORT = "cohort_id long, name string, description string, owner string, resource string, mode string, base long, size long, status string, version long"
_ITEM = "_itemreferenceid long, item__reference string, _provider string, _listid long, deleted boolean, hash int, version long"
_RELATION = "cohort_a long, cohort_b long, concept long"


def items(subjects: DataFrame, cohort: int, provider: str, resource: str = PATIENT) -> DataFrame:
    """Item rows of (subject_id[, deleted]) with a hash over all their columns."""
    columns = [F.col("subject_id").alias("_itemreferenceid"), F.concat(F.lit(resource), F.lit("/"), F.col("subject_id").cast("string")).alias("item__reference"), F.lit(provider).alias("_provider"), F.lit(cohort).cast("long").alias("_listid")]
    if "deleted" in subjects.columns:
        columns.append(F.col("deleted"))
    return hashed(subjects.select(*columns))


def hashed(rows: DataFrame) -> DataFrame:
    """rows with `hash`: Murmur3 over all columns in their order."""
    return rows.withColumn("hash", F.hash(*rows.columns))


def folded(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(subject_id): the base with changes (subject_id, date, deleted) applied in order of date. The last change of a subject counts; a null deleted adds."""
    last = changes.groupBy("subject_id").agg(F.max_by(F.coalesce("deleted", F.lit(False)), F.struct("date", F.coalesce("deleted", F.lit(False)))).alias("deleted"))
    kept = base.select("subject_id").union(last.filter("not deleted").select("subject_id")).distinct()
    return kept.join(last.filter("deleted"), "subject_id", "left_anti")


def csv_ready(rows: DataFrame) -> DataFrame:
    """Values as a bulk loader wants them: arrays in braces, no NUL characters, line feeds only."""

    def value(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.concat(F.lit("{"), F.array_join(F.col(f.name).cast("array<string>"), ","), F.lit("}"))
        if isinstance(f.dataType, (T.MapType, T.StructType)):
            return F.to_json(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.regexp_replace(F.regexp_replace(F.col(f.name), "\u0000", ""), "\r\n?", "\n")
        return F.col(f.name)

    return rows.select(*(value(f).alias(f.name) for f in rows.schema.fields))


def absent(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """rows whose key is not present yet: what a load that broke off still has to write."""
    return rows.join(present.select(key), key, "left_anti")


def group_documents(subjects: DataFrame, cohort: int, resource: str = PATIENT) -> DataFrame:
    """(id, resourceId, groupId, resourceType) of (subject_id): one document of a search index for each member."""
    return subjects.select(F.concat_ws("_", F.lit(cohort).cast("string"), F.col("subject_id").cast("string")).alias("id"), F.col("subject_id").alias("resourceId"), F.lit(cohort).cast("long").alias("groupId"), F.lit(resource).alias("resourceType"))


def relation_rows(sources: DataFrame, cohort: int) -> DataFrame:
    """(cohort_a, cohort_b, concept): two rows for each source (source), one in each direction."""
    own = F.lit(cohort).cast("long")
    both = F.array(F.struct(own.alias("cohort_a"), F.col("source").alias("cohort_b"), F.lit(COMES_FROM).cast("long").alias("concept")), F.struct(F.col("source").alias("cohort_a"), own.alias("cohort_b"), F.lit(SOURCE_OF).cast("long").alias("concept")))
    return sources.select(F.explode(both).alias("x")).select("x.*")


def list_entries(rows: DataFrame) -> DataFrame:
    """(line): each item row (item__reference, deleted) as the JSON entry of a List resource."""
    entry = F.struct(F.coalesce("deleted", F.lit(False)).alias("deleted"), F.struct(F.col("item__reference").alias("reference")).alias("item"))
    return rows.select(F.to_json(entry).alias("line"))


#: One writer of headers at a time, for each store.
_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)


@dataclass
class CohortStore:
    """The tables under a path. Jobs of one driver may write at once: ids are given out under a lock, and every write has a folder of its own."""

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.write.parquet(f"{self.path}/{name}/{uuid.uuid4().hex}")

    def _header(self, row: dict) -> None:
        row = row | {"version": time.time_ns()}
        self._append(self.spark.createDataFrame([tuple(row[f.name] for f in T._parse_datatype_string(_COHORT).fields)], _COHORT).coalesce(1), "cohort")

    def cohorts(self) -> DataFrame:
        """The latest state of every cohort."""
        return self._read("cohort", _COHORT).groupBy("cohort_id").agg(F.max_by(F.struct("name", "description", "owner", "resource", "mode", "base", "size", "status"), "version").alias("x")).select("cohort_id", "x.*")

    def cohort(self, cohort: int) -> dict:
        row = self.cohorts().filter(F.col("cohort_id") == cohort).first()
        if row is None:
            raise RequestError(f"no cohort {cohort}")
        return row.asDict()

    def create(self, name: str, description: str = "", owner: str = "0", resource: str = PATIENT, size: int = 0, base: int | None = None, delayed: bool = False) -> int:
        """A header; its id. With a base the cohort is a list of changes to it."""
        with _LOCKS[self.path]:
            ids = self._read("cohort", _COHORT).agg(F.max("cohort_id").alias("n")).first()["n"]
            cohort = (ids or 0) + 1
            self._header({"cohort_id": cohort, "name": name, "description": description, "owner": owner, "resource": resource, "mode": CHANGES if base is not None else SNAPSHOT, "base": -1 if base is None else base, "size": size, "status": LONG_PENDING if delayed else PENDING})
        return cohort

    def write(self, cohort: int, subjects: DataFrame, sources=(), provider: str = "", size: int | None = None) -> None:
        """Items of (subject_id[, deleted]), relations to the source cohorts, and the header's final state. A failure marks the header and is raised."""
        header = self.cohort(cohort)
        try:
            rows = items(subjects, cohort, provider or header["owner"], header["resource"])
            if "deleted" not in rows.columns:
                rows = rows.withColumn("deleted", F.lit(False))
            own = rows.withColumn("_itemreferenceid", F.col("_itemreferenceid").cast("long")).withColumn("version", F.lit(time.time_ns()))
            self._append(own.select(*(f.name for f in T._parse_datatype_string(_ITEM).fields)), "item")
            if sources:
                self._append(self.relations(cohort, sources), "relation")
            n = self._items(cohort).count() if size is None else size
            self._header(header | {"size": n, "status": FINISHED})
        except Exception:
            self._header(header | {"status": ERROR})
            raise

    def relations(self, cohort: int, sources) -> DataFrame:
        """Two rows for each source cohort, one in each direction."""
        return relation_rows(self.spark.range(1).select(F.explode(F.array(*(F.lit(int(s)).cast("long") for s in sources))).alias("source")), cohort)

    def _items(self, cohort: int) -> DataFrame:
        return self._read("item", _ITEM).filter(F.col("_listid") == cohort)

    def read(self, cohort: int) -> DataFrame:
        """(subject_id): a snapshot's members, or its base with its changes."""
        own, header = self._items(cohort), self.cohort(cohort)
        if header["mode"] == SNAPSHOT:
            return own.filter("not deleted").select(F.col("_itemreferenceid").alias("subject_id")).distinct()
        return folded(self.read(header["base"]), own.select(F.col("_itemreferenceid").alias("subject_id"), F.col("version").alias("date"), "deleted"))

    def all_relations(self) -> DataFrame:
        """(cohort_a, cohort_b, concept) of all cohorts."""
        return self._read("relation", _RELATION)

    def members(self, cohorts) -> DataFrame:
        """(cohort, patient) of the members of these cohorts, as read() gives them: what a catalog needs to limit a source population."""
        out = self.spark.createDataFrame([], "cohort long, patient long")
        for c in cohorts:
            out = out.unionByName(self.read(int(c)).select(F.lit(int(c)).cast("long").alias("cohort"), F.col("subject_id").alias("patient")))
        return out

    def as_list(self, cohort: int) -> DataFrame:
        """(line): each item as a JSON entry of a List resource."""
        return list_entries(self._items(cohort))

    def put_list(self, cohort: int, send: Callable[[Iterator[str]], None]) -> None:
        """Hands send the parts of the List resource's JSON, member by member, without holding them all."""

        def parts() -> Iterator[str]:
            yield self.list_header(cohort)[:-1] + ', "entry": ['
            for k, r in enumerate(self.as_list(cohort).toLocalIterator()):
                yield (", " if k else "") + r["line"]
            yield "]}"

        send(parts())

    def list_header(self, cohort: int) -> str:
        h = self.cohort(cohort)
        return json.dumps({"resourceType": "List", "id": str(cohort), "title": h["name"], "status": "current" if h["status"] == FINISHED else h["status"], "mode": h["mode"]})
