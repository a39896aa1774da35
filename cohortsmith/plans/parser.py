"""JSON requests -> model. Unknown fields are ignored; fields without effect give a warning."""

from __future__ import annotations

import json

from .model import AND, DIFFERENT_ENCOUNTER, N_AMONG_M, OPERATORS, OR, ORDERED, PATIENT, SAME_ENCOUNTER, SAME_EPISODE, Constraint, Criterion, DateRange, Duration, Group, Leaf, Occurrence, PatientAge, Request, RequestError, UniqueField

#: The resources that requests name.
RESOURCES = (
    "Patient", "Encounter", "MedicationRequest", "MedicationAdministration", "Observation", "Condition", "DocumentReference",
    "Composition", "Group", "Procedure", "ImagingStudy", "QuestionnaireResponse", "Claim",
)
#: Parsed, without effect.
_IDLE = ("nullAvailableFieldList",)


def parse(request: str | dict) -> Request:
    data = json.loads(request) if isinstance(request, str) else request
    if not isinstance(data, dict) or data.get("_type") != "request":
        raise RequestError("_type must be request")
    if "sourcePopulation" not in data:
        raise RequestError("sourcePopulation is missing")
    population = data["sourcePopulation"] or {}
    cohorts = population.get("caresiteCohortList") or population.get("cohortList") or ()
    warnings: list[str] = []
    root = _criterion(data["request"], warnings) if data.get("request") else None
    if root is not None:
        ids = [c.id for c in _all(root)]
        if len(ids) != len(set(ids)):
            raise RequestError("criterion ids must differ")
    return Request(root, tuple(int(c) for c in cohorts), resource(data.get("resourceType") or PATIENT), tuple(warnings))


def _all(node: Criterion):
    from .model import walk

    return walk(node)


def resource(name: str) -> str:
    """A resource by its name; names of older requests (lower case first, with a suffix) are understood too."""
    if name == "IPPList":
        return PATIENT
    found = [r for r in RESOURCES if name.lower().startswith(r.lower())]
    return max(found, key=len) if found else name


def _id(data: dict) -> int:
    value = data.get("_id")
    if not isinstance(value, int) or not -(2**15) <= value < 2**15:
        raise RequestError(f"_id must be a 16-bit integer, not {value!r}")
    return value


def _criterion(data: dict, warnings: list[str]) -> Criterion:
    kind = data.get("_type")
    if kind == "basicResource":
        return _leaf(data, warnings)
    if kind not in (AND, OR, N_AMONG_M):
        raise RequestError(f"unknown criterion {kind!r}")
    options = data.get("nAmongMOptions")
    options = options[0] if isinstance(options, list) and options else options or None
    if kind == N_AMONG_M and not options:
        raise RequestError(f"nAmongM {data.get('_id')} needs nAmongMOptions")
    return Group(
        _id(data), bool(data.get("isInclusive", True)), kind, tuple(_criterion(c, warnings) for c in data.get("criteria") or () if not _empty(c)),
        tuple(_constraint(c, warnings) for c in data.get("temporalConstraints") or ()), _occurrence(options, warnings),
    )


def _empty(data: dict) -> bool:
    """A group without a leaf below it."""
    return data.get("_type") != "basicResource" and all(_empty(c) for c in data.get("criteria") or ())


def _leaf(data: dict, warnings: list[str]) -> Leaf:
    if "resourceType" not in data:
        raise RequestError(f"basicResource {data.get('_id')} needs a resourceType")
    warnings += [f"{k} has no effect" for k in _IDLE if data.get(k)]
    age = data.get("patientAge")
    return Leaf(
        _id(data), bool(data.get("isInclusive", True)), resource(data["resourceType"]), data.get("filterFhir") or "", data.get("filterSolr") or "",
        _occurrence(data.get("occurrence"), warnings),
        PatientAge(age.get("minAge"), age.get("maxAge"), tuple(age.get("datePreference") or ()), age.get("dateIsNotNull", True)) if age else None,
        tuple(UniqueField(int(u.get("n", 1)), _operator(u.get("operator", ">="))) for u in data.get("uniqueFields") or ()),
        tuple(_range(r) for r in data.get("dateRangeList") or ()), _range(data["encounterDateRange"]) if data.get("encounterDateRange") else None,
    )


def _range(data: dict) -> DateRange:
    return DateRange(data.get("minDate"), data.get("maxDate"), tuple(data.get("datePreference") or ()), data.get("dateIsNotNull", True))


def _operator(value: str) -> str:
    value = "=" if value == "==" else value
    if value not in OPERATORS:
        raise RequestError(f"unknown operator {value!r}")
    return value


def _occurrence(data: dict | None, warnings: list[str]) -> Occurrence | None:
    if not data:
        return None
    warnings += [f"{k} has no effect" for k in ("timeDelayMin", "timeDelayMax") if data.get(k)]
    return Occurrence(int(data["n"]), _operator(data["operator"]), bool(data.get("sameEncounter")), bool(data.get("sameDay")))


def _constraint(data: dict, warnings: list[str]) -> Constraint:
    kind = data.get("constraintType")
    if kind not in (SAME_ENCOUNTER, DIFFERENT_ENCOUNTER, ORDERED, SAME_EPISODE):
        raise RequestError(f"unknown constraint {kind!r}")
    if data.get("filteredCriteriaIdList"):
        warnings.append("filteredCriteriaIdList has no effect")
    ids = data.get("idList", "all")
    choices = tuple((int(c["_id"]), c["occurrenceChoice"]) for c in data.get("occurrenceChoiceList") or ())
    if any(c not in ("any", "first", "last") for _, c in choices):
        raise RequestError("occurrenceChoice must be any, first or last")
    told = data.get("dateIsNotNullList")
    if isinstance(told, dict):
        told = [told]
    if isinstance(told, list):
        told = tuple((int(x["_id"]), bool(x["dateIsNotNull"])) for x in told)
    preference = tuple((int(x["_id"]), tuple(x.get("datePreference") or x.get("occurrenceChoice") or ())) for x in data.get("datePreferenceList") or ())
    return Constraint(kind, None if isinstance(ids, str) else tuple(dict.fromkeys(int(i) for i in ids)), _duration(data.get("timeRelationMinDuration")), _duration(data.get("timeRelationMaxDuration")), preference, told, choices)


def _duration(data: dict | None) -> Duration | None:
    if not data:
        return None
    return Duration(**{k: int(data[k]) for k in ("years", "months", "days", "hours", "minutes", "seconds") if data.get(k) is not None})
