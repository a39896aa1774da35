"""A request: a tree of criteria over resources, with its source population and result type."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

AND, OR, N_AMONG_M = "andGroup", "orGroup", "nAmongM"
SAME_ENCOUNTER, DIFFERENT_ENCOUNTER = "sameEncounter", "differentEncounter"
ORDERED, SAME_EPISODE = "directChronologicalOrdering", "sameEpisodeOfCare"
PATIENT = "Patient"
OPERATORS = ("<", "<=", "=", ">=", ">")


class RequestError(ValueError):
    """A request that cannot be evaluated."""


@dataclass(frozen=True)
class Occurrence:
    n: int
    operator: str
    same_encounter: bool = False
    same_day: bool = False

    @property
    def trivial(self) -> bool:
        """Once or more: every subject with a row has that."""
        return self.operator == ">=" and self.n == 1


@dataclass(frozen=True)
class UniqueField:
    n: int
    operator: str


@dataclass(frozen=True)
class PatientAge:
    least: str | None = None
    most: str | None = None
    preference: tuple[str, ...] = ()
    not_null: bool = True


@dataclass(frozen=True)
class DateRange:
    least: str | None = None
    most: str | None = None
    preference: tuple[str, ...] = ()
    not_null: bool = True


@dataclass(frozen=True)
class Duration:
    years: int = 0
    months: int = 0
    days: int = 0
    hours: int = 0
    minutes: int = 0
    seconds: int = 0

    def total_seconds(self) -> int:
        """Months have 30 days and years 365; parts that are not positive don't count."""
        hours = self.hours + 24 * self.days + 24 * 30 * self.months + 24 * 365 * self.years
        return 3600 * max(0, hours) + 60 * max(0, self.minutes) + max(0, self.seconds)


@dataclass(frozen=True)
class Constraint:
    """ids None: all inclusive criteria of the group."""

    kind: str
    ids: tuple[int, ...] | None = None
    least: Duration | None = None
    most: Duration | None = None
    preference: tuple[tuple[int, tuple[str, ...]], ...] = ()
    not_null: bool | tuple[tuple[int, bool], ...] | None = None
    choices: tuple[tuple[int, str], ...] = ()

    def admits_null(self, criterion: int) -> bool:
        """Whether a missing date of this criterion satisfies the order: yes, unless dateIsNotNull says no."""
        told = self.not_null if isinstance(self.not_null, bool) or self.not_null is None else dict(self.not_null).get(criterion)
        return not told


@dataclass(frozen=True)
class Criterion:
    id: int
    inclusive: bool = True


@dataclass(frozen=True)
class Leaf(Criterion):
    resource: str = PATIENT
    filter_fhir: str = ""
    filter_lucene: str = ""
    occurrence: Occurrence | None = None
    age: PatientAge | None = None
    unique_fields: tuple[UniqueField, ...] = ()
    date_ranges: tuple[DateRange, ...] = ()
    encounter_range: DateRange | None = None
    #: The id it was given, if rewriting has given it another.
    origin: int | None = None

    @property
    def asked_id(self) -> int:
        return self.id if self.origin is None else self.origin


@dataclass(frozen=True)
class Group(Criterion):
    kind: str = AND
    children: tuple[Criterion, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    n_among_m: Occurrence | None = None

    @property
    def included(self) -> tuple[Criterion, ...]:
        return tuple(c for c in self.children if c.inclusive)

    @property
    def excluded(self) -> tuple[Criterion, ...]:
        return tuple(c for c in self.children if not c.inclusive)


@dataclass(frozen=True)
class Request:
    root: Criterion | None
    cohorts: tuple[int, ...] = ()
    resource: str = PATIENT
    warnings: tuple[str, ...] = field(default=(), compare=False)


def walk(node: Criterion) -> Iterator[Criterion]:
    yield node
    if isinstance(node, Group):
        for c in node.children:
            yield from walk(c)
