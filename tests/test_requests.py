"""Parsing, rewriting, filters, dates."""

import pytest
from pyspark.sql import functions as F

from cohortsmith.functions.dates import age_days
from cohortsmith.functions.filters import Field, fhir, lucene
from cohortsmith.plans.model import Duration, Group, RequestError, walk
from cohortsmith.plans.parser import parse, resource
from cohortsmith.plans.rewrite import rewritten
from cohortsmith.queries import REQUESTS, group, leaf, request


def test_registered_requests_parse():
    for name, asked in REQUESTS.items():
        assert parse(asked).resource, name


@pytest.mark.parametrize(
    "broken",
    [
        {"_type": "request"},
        {"_type": "other", "sourcePopulation": {}},
        request({"_type": "xorGroup", "_id": 0}),
        request(leaf(70_000, "Patient", "")),
        request(group("andGroup", 0, leaf(1, "Patient", ""), leaf(1, "Patient", ""))),
        request(group("nAmongM", 0, leaf(1, "Patient", ""))),
        request(leaf(1, "Patient", "", occurrence={"n": 1, "operator": "~"})),
        request(group("andGroup", 0, leaf(1, "Patient", ""), temporalConstraints=[{"constraintType": "sameDay", "idList": "all"}])),
        request({"_type": "basicResource", "_id": 1}),
    ],
)
def test_broken_requests(broken):
    with pytest.raises(RequestError):
        parse(broken)


def test_older_names_and_ignored_fields():
    assert [resource(n) for n in ("conditionXyz", "IPPList", "medicationAdministrationXyz", "Other")] == ["Condition", "Patient", "MedicationAdministration", "Other"]
    asked = parse(request(leaf(1, "Patient", "", unheard=1, occurrence={"n": 1, "operator": "=", "timeDelayMin": 3})))
    assert asked.warnings == ("timeDelayMin has no effect",)


def test_complements_keep_their_id():
    root, _ = rewritten(parse(request(group("orGroup", 0, leaf(1, "Patient", ""), leaf(2, "Patient", "", inclusive=False)))))
    wrapper = next(n for n in walk(root) if n.id == 2)
    assert isinstance(wrapper, Group) and wrapper.inclusive and wrapper.children[0].asked_id == 2 and not wrapper.children[0].inclusive
    assert all(c.inclusive for n in walk(root) if isinstance(n, Group) and n.kind != "andGroup" for c in n.children)


def test_units():
    assert age_days("18-2-4") == 18 * 365.25 + 64
    assert Duration(years=1, months=1, days=1, hours=-2).total_seconds() == 3600 * (24 * 396 - 2)
    assert Duration(minutes=-5, seconds=3).total_seconds() == 3


FIELDS = {"n": Field("n", "number"), "s": Field("s"), "d": Field("d", "date"), "b": Field("b", "boolean"), "text": Field("s", "text"), "l": Field("l", "list")}


def find(name):
    if name not in FIELDS:
        raise RequestError(name)
    return FIELDS[name]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, 1.0, "red", "2020-01-01 10:00:00", True, ["a", "bc"]), (2, 2.5, "a,b", "2020-06-01 00:00:00", False, ["b"]), (3, None, None, None, None, None), (4, 4.0, "reddish x", "2021-01-01 00:00:00", True, [])]
    return spark.createDataFrame(data, "id long, n double, s string, d string, b boolean, l array<string>").withColumn("d", F.col("d").cast("timestamp")).cache()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", [1, 2, 3, 4]),
        ("n=gt1&n=le4", [2, 4]),
        ("n=1,4", [1, 4]),
        ("s=http://x|red", [1]),
        ("s:not=red", [2, 3, 4]),
        ("s=a\\,b", [2]),
        ("s=red*", [1, 4]),
        ("s:contains=RED", [1, 4]),
        ("s:missing=true", [3]),
        ("d=ge2020-06-01&d=lt2021-01-01", [2]),
        ("d=2020-01-01", [1]),
        ("b=true&_count=5", [1, 4]),
        ("text=x%20red", [4]),
        ("l=bc", [1]),
        ("l=b*", [1, 2]),
    ],
)
def test_search_parameters(rows, text, expected):
    assert sorted(r["id"] for r in rows.filter(fhir(text, find)).collect()) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("s:red OR n:4", [1, 4]),
        ("(s:red) AND b:true", [1]),
        ("n:[2 TO *]", [2, 4]),
        ("n:{1 TO 4}", [2]),
        ("b:true AND -(s:red)", [4]),
        ("-s:red", [2, 3, 4]),
        ('s:("*|red" OR "a,b")', [1, 2]),
        ("fq=b:true&fq=n:4", [4]),
        ("s:red*", [1, 4]),
        ("text:(x) text:(a)", [2, 4]),
        ("d:[2020-06-01T00:00:00Z TO *]", [2, 4]),
        ("*:*", [1, 2, 3, 4]),
    ],
)
def test_lucene(rows, text, expected):
    assert sorted(r["id"] for r in rows.filter(lucene(text, find)).collect()) == expected


@pytest.mark.parametrize("text", ["x=1", "n=abc", "b=perhaps", "s:near=1"])
def test_bad_search_parameters(text):
    with pytest.raises(RequestError):
        fhir(text, find)


@pytest.mark.parametrize("text", ["s:(red", "red", "s:red)", "n:[1 2]"])
def test_bad_lucene(text):
    with pytest.raises(RequestError):
        lucene(text, find)
