"""Dates of resources: defaults, coalescing, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import DateRange, PatientAge, RequestError

EVENT, START, END, BIRTH = "event_date", "encounter_start_date", "encounter_end_date", "patient_birthdate"
_USABLE = (EVENT, START, END)
#: The order in which a resource's dates are tried.
_DEFAULT = {
    "Encounter": (START, END),
    "Condition": (END, START, EVENT),
    "Procedure": (EVENT, END, START),
    "Patient": (BIRTH,),
    "Group": (),
    "unknown": (START, END, EVENT),
}
_OTHERS = (EVENT, START, END)


def default_preference(resource: str) -> tuple[str, ...]:
    return _DEFAULT.get(resource, _OTHERS)


def usable(preference, resource: str, columns) -> list[str]:
    """The preferred dates that a resource's rows have, in order."""
    return [c for c in (preference or default_preference(resource)) if c in _USABLE and c in columns]


def local_date(preference, resource: str, columns) -> Column:
    """The first date that is not null."""
    found = usable(preference, resource, columns)
    if not found:
        raise RequestError(f"{resource} has none of the dates {list(preference or default_preference(resource))}")
    return F.coalesce(*(F.col(c).cast("timestamp") for c in found))


def age_days(text: str) -> float:
    """years-months-days as days: 365.25 for a year, 30 for a month."""
    years, months, days = (int(x) for x in text.split("-"))
    return years * 365.25 + months * 30 + days


def age_filter(age: PatientAge, resource: str, columns) -> Column | None:
    """Rows at whose date the patient has the age; None if no bound is given."""
    if age.least is None and age.most is None:
        return None
    if BIRTH not in columns:
        raise RequestError(f"{resource} has no birth date")
    date = local_date(age.preference, resource, columns)
    days, keep = F.datediff(date, F.col(BIRTH)), F.lit(True)
    if age.least is not None:
        keep = keep & (days >= age_days(age.least))
    if age.most is not None:
        keep = keep & (days <= age_days(age.most))
    return keep if age.not_null else keep | date.isNull()


def range_filter(asked: DateRange, resource: str, columns, preference=()) -> Column:
    """Rows whose date lies between two days, both included."""
    date = local_date(asked.preference or preference, resource, columns)
    keep = F.lit(True)
    if asked.least:
        keep = keep & (F.to_date(date) >= F.lit(asked.least).cast("date"))
    if asked.most:
        keep = keep & (F.to_date(date) <= F.lit(asked.most).cast("date"))
    return keep if asked.not_null else keep | date.isNull()
