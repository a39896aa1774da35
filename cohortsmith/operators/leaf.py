"""Operators on one leaf's rows: date and age filters, occurrences, repeated codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import START, age_filter, local_date, range_filter
from ..plans.model import Leaf, Occurrence, RequestError


def holds(count: Column, operator: str, n: int) -> Column:
    return {"<": count < n, "<=": count <= n, "=": count == n, ">=": count >= n, ">": count > n}[operator]


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """All keys equal, a null to a null."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def needed(leaf: Leaf, has: frozenset[str]) -> set[str]:
    """The columns that the leaf's own conditions read."""
    dates = {c for c in has if c.endswith("_date")}
    out: set[str] = set()
    if leaf.age and (leaf.age.least or leaf.age.most):
        out |= dates | {"patient_birthdate"}
    if leaf.date_ranges or leaf.encounter_range:
        out |= dates
    if leaf.occurrence and not leaf.occurrence.trivial:
        out |= (dates if leaf.occurrence.same_day else set()) | ({"encounter"} if leaf.occurrence.same_encounter else set())
    if _codes(leaf):
        out.add("code")
    return out


def _codes(leaf: Leaf):
    return [u for u in leaf.unique_fields if not (u.operator == ">=" and u.n == 1)]


def filtered(rows: DataFrame, leaf: Leaf, has: frozenset[str]) -> DataFrame:
    """Rows within the date ranges, and at which the patient has the age."""
    for r in leaf.date_ranges:
        rows = rows.filter(range_filter(r, leaf.resource, has))
    if leaf.encounter_range:
        rows = rows.filter(range_filter(leaf.encounter_range, leaf.resource, has, (START,)))
    keep = age_filter(leaf.age, leaf.resource, has) if leaf.age else None
    return rows if keep is None else rows.filter(keep)


def _keys(rows: DataFrame, leaf: Leaf, occurrence: Occurrence, has: frozenset[str]) -> tuple[DataFrame, list[str]]:
    keys = ["patient"]
    if occurrence.same_day:
        rows, keys = rows.withColumn("_day", F.to_date(local_date((), leaf.resource, has))), [*keys, "_day"]
    if occurrence.same_encounter:
        if "encounter" not in has:
            raise RequestError(f"{leaf.resource} has no encounter")
        keys.append("encounter")
    return rows, keys


def qualifying(rows: DataFrame, leaf: Leaf, has: frozenset[str], by_group: bool) -> DataFrame:
    """Rows of the patients whose occurrences and repeated codes are as asked.

    by_group: only rows of the very groups (day, encounter) with the right number of occurrences, as rows
    in a temporal constraint need; else all rows of a patient with such a group.
    """
    occurrence = leaf.occurrence
    if occurrence and not occurrence.trivial:
        rows, keys = _keys(rows, leaf, occurrence, has)
        groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(holds(F.col("_n"), occurrence.operator, occurrence.n)).select(*keys)
        if by_group:
            rows = rows.join(groups, same(rows, groups, keys), "left_semi")
        else:
            people = groups.select("patient").distinct() if len(keys) > 1 else groups
            rows = rows.join(people, same(rows, people, ["patient"]), "left_semi")
    for code in _codes(leaf):
        people = rows.groupBy("patient", "code").agg(F.count(F.lit(1)).alias("_n")).filter(holds(F.col("_n"), code.operator, code.n)).select("patient").distinct()
        rows = rows.join(people, same(rows, people, ["patient"]), "left_semi")
    return rows.drop("_day")


def plain(leaf: Leaf) -> bool:
    """Whether a leaf is its filter alone: any row it selects will do."""
    counts = leaf.occurrence is not None and not leaf.occurrence.trivial
    aged = leaf.age is not None and (leaf.age.least is not None or leaf.age.most is not None)
    return not (counts or aged or _codes(leaf) or leaf.date_ranges or leaf.encounter_range)


def patients(rows: DataFrame, leaf: Leaf, has: frozenset[str]) -> DataFrame:
    """(patient), each once: as qualifying(), where only the patients matter. One aggregation for each condition, no join back."""
    out = None
    if leaf.occurrence and not leaf.occurrence.trivial:
        own, keys = _keys(rows, leaf, leaf.occurrence, has)
        out = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(holds(F.col("_n"), leaf.occurrence.operator, leaf.occurrence.n)).select("patient")
        out = out if len(keys) == 1 else out.distinct()
    for code in _codes(leaf):
        found = rows.groupBy("patient", "code").agg(F.count(F.lit(1)).alias("_n")).filter(holds(F.col("_n"), code.operator, code.n)).select("patient").distinct()
        out = found if out is None else out.join(found, "patient", "left_semi")
    return (rows.select("patient").distinct() if out is None else out).filter("patient is not null")
