"""Where resources come from: tables with logical columns, filter fields, and the source population."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Field, fhir, lucene
from ..plans.model import PATIENT, Leaf, RequestError
from .retry import retried

#: Logical columns and their types; a resource has some of them.
LOGICAL = {
    "id": "bigint", "patient": "bigint", "encounter": "bigint", "episodeOfCare": "string", "event_date": "timestamp", "encounter_start_date": "timestamp",
    "encounter_end_date": "timestamp", "patient_birthdate": "date", "code": "string", "organizations": "array<bigint>",
}


@dataclass(frozen=True)
class Lookup:
    """Another table, joined where a field needs it: on base column = its key."""

    table: Callable[[], DataFrame]
    column: str
    key: str
    how: str = "inner"
    #: Lookups whose columns this one's join needs.
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class Resource:
    """columns: logical columns. fields: further names for filters. one_per: keep one row of each key (the smallest), which is then the id."""

    table: Callable[[], DataFrame]
    columns: dict[str, Field]
    fields: dict[str, Field] = field(default_factory=dict)
    lookups: dict[str, Lookup] = field(default_factory=dict)
    one_per: str | None = None

    def field(self, name: str) -> Field:
        aliases = {"_id": "id", "subject": "patient", "_text": "text", "_text_": "text"}
        for n in (name, aliases.get(name, name), name.rpartition(".")[2]):
            if n in self.fields:
                return self.fields[n]
            if n in self.columns:
                return self.columns[n]
        raise RequestError(f"unknown filter field {name!r}")

    def joined(self, needs: Iterable[str]) -> DataFrame:
        """The table with the lookups that are needed, and no others."""
        wanted: set[str] = set()
        for n in needs:
            wanted |= {n, *self.lookups[n].after}
        out = retried(self.table)
        for name, lookup in self.lookups.items():
            if name in wanted:
                out = out.join(retried(lookup.table), F.col(lookup.column) == F.col(lookup.key), lookup.how)
        return out


def codes_of(*parts: Field) -> Field:
    """One code of several columns: those that are not null, with commas between."""
    return Field(f"concat_ws(',', {', '.join(f'cast({p.expr} as string)' for p in parts)})", "string", tuple(dict.fromkeys(n for p in parts for n in p.lookups)))


class Catalog:
    """What the compiler asks of a source."""

    def columns(self, resource: str) -> frozenset[str]:
        """The logical columns of a resource."""
        raise NotImplementedError

    def scan(self, leaf: Leaf, columns: Iterable[str]) -> DataFrame:
        """The rows that a leaf's filter selects, with the logical columns asked for (null where the resource lacks one)."""
        raise NotImplementedError

    def scan_together(self, leaves: list[Leaf]) -> DataFrame | None:
        """(patient, k): a row for each row that the filter of the k-th leaf selects, from one scan; None if these leaves need one each."""
        return None

    def population(self) -> DataFrame:
        """Patients of the source population: column patient, and organizations if there are any."""
        raise NotImplementedError


class TableCatalog(Catalog):
    """Resources over tables.

    cohort_items gives (cohort, patient), the members of the cohorts asked for. With cohort ids, rows of other patients are left
    out by a semi join; without ids or without members, everybody belongs. default_filter selects the patients of
    the population (a FHIR filter over Patient's logical columns and fields).
    """

    def __init__(self, resources: dict[str, Resource], cohort_items: Callable[[tuple[int, ...]], DataFrame] | None = None, cohorts: Iterable[int] = (), default_filter: str = "", language: str = "fhir"):
        if language not in ("fhir", "lucene"):
            raise RequestError(f"unknown filter language {language!r}")
        self.resources, self.cohort_items, self.cohorts = resources, cohort_items, tuple(cohorts)
        self.default_filter, self.language = default_filter, language

    def for_cohorts(self, cohorts: Iterable[int]) -> TableCatalog:
        return TableCatalog(self.resources, self.cohort_items, cohorts, self.default_filter, self.language)

    def resource(self, name: str) -> Resource:
        if name not in self.resources:
            raise RequestError(f"unknown resource {name!r}")
        return self.resources[name]

    def columns(self, resource: str) -> frozenset[str]:
        return frozenset(self.resource(resource).columns)

    def members(self) -> DataFrame | None:
        if not self.cohorts or self.cohort_items is None:
            return None
        return self.cohort_items(self.cohorts).filter(F.col("cohort").isin(list(self.cohorts))).select("patient").distinct()

    def _filter(self, leaf: Leaf) -> tuple[Column, list[Field]]:
        """A leaf's condition and the fields that it reads."""
        source, used = self.resource(leaf.resource), []

        def find(name: str) -> Field:
            used.append(source.field(name))
            return used[-1]

        if self.language == "lucene" and leaf.filter_lucene:
            return lucene(leaf.filter_lucene, find), used
        return fhir(leaf.filter_fhir, find), used

    def scan(self, leaf: Leaf, columns: Iterable[str]) -> DataFrame:
        source = self.resource(leaf.resource)
        keep, used = self._filter(leaf)
        wanted = {"patient", *columns} | ({source.one_per} if source.one_per else set())
        has = {c: source.columns[c] for c in sorted(wanted) if c in source.columns}
        needs = {n for f in (*used, *has.values()) for n in f.lookups}
        rows = source.joined(needs).filter(keep)
        out = rows.select(*(f.column().cast(LOGICAL[c]).alias(c) for c, f in has.items()), *(F.lit(None).cast(LOGICAL[c]).alias(c) for c in sorted(wanted) if c not in has))
        if source.one_per:
            # one row of each key: the smallest of all its rows, whatever order they come in
            rest = [c for c in out.columns if c != source.one_per]
            out = out.groupBy(source.one_per).agg(F.min(F.struct(*rest)).alias("_r")).select(source.one_per, "_r.*")
        members = self.members()
        return out if members is None else out.join(members, "patient", "left_semi")

    def scan_together(self, leaves: list[Leaf]) -> DataFrame | None:
        source = self.resource(leaves[0].resource)
        if source.one_per or any(leaf.resource != leaves[0].resource for leaf in leaves):
            return None
        kept = [self._filter(leaf) for leaf in leaves]
        patient = source.columns["patient"]
        needs = {n for f in (patient, *(f for _, used in kept for f in used)) for n in f.lookups}
        some = reduce(lambda a, b: a | b, (keep for keep, _ in kept))
        which = F.array_compact(F.array(*(F.when(keep, k) for k, (keep, _) in enumerate(kept))))
        rows = source.joined(needs).filter(some).select(patient.column().cast(LOGICAL["patient"]).alias("patient"), F.explode(which).alias("k"))
        members = self.members()
        return rows if members is None else rows.join(members, "patient", "left_semi")

    def population(self) -> DataFrame:
        has = self.columns(PATIENT)
        rows = self.scan(Leaf(0, resource=PATIENT, filter_fhir=self.default_filter), ["organizations"] if "organizations" in has else [])
        return rows.filter("patient is not null")


class FrameCatalog(Catalog):
    """Leaves with given rows: for each criterion id a DataFrame of logical columns. For tests, and for scans done elsewhere."""

    def __init__(self, frames: dict[int, DataFrame], population: DataFrame):
        self.frames, self.people = frames, population
        self._of: dict[str, frozenset[str]] = {}

    def leaf_columns(self, leaf: Leaf) -> frozenset[str]:
        return frozenset(self.frames[leaf.asked_id].columns)

    def columns(self, resource: str) -> frozenset[str]:
        return frozenset().union(*(f.columns for f in self.frames.values()))

    def scan(self, leaf: Leaf, columns: Iterable[str]) -> DataFrame:
        rows = self.frames[leaf.asked_id]
        wanted = {"patient", *columns}
        return rows.select(*(F.col(c).cast(LOGICAL[c]).alias(c) if c in rows.columns else F.lit(None).cast(LOGICAL[c]).alias(c) for c in sorted(wanted)))

    def population(self) -> DataFrame:
        return self.people


def leaf_columns(catalog: Catalog, leaf: Leaf) -> frozenset[str]:
    own = getattr(catalog, "leaf_columns", None)
    return own(leaf) if own else catalog.columns(leaf.resource)
