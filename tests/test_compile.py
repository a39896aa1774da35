"""Small requests over rows given for each criterion, with results worked out by hand."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from cohortsmith import modes, queries
from cohortsmith.plans.compile import Compiled
from cohortsmith.plans.model import RequestError
from cohortsmith.plans.parser import parse
from cohortsmith.queries import group, leaf, request
from cohortsmith.sources.catalog import LOGICAL, FrameCatalog


def frame(spark, columns, rows):
    raw = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in columns))
    return raw.select(*((F.split(c, ",") if LOGICAL[c].startswith("array") else F.col(c)).cast(LOGICAL[c]).alias(c) for c in columns))


def compiled(spark, root, rows, people=range(1, 11), **more):
    frames = {i: frame(spark, columns, values) for i, (columns, values) in rows.items()}
    return Compiled(parse(request(root)), FrameCatalog(frames, frame(spark, ["patient"], [(p,) for p in people])), **more)


def result(spark, root, rows, **more):
    sets = [sorted(r[0] for r in compiled(spark, root, rows, one_pass=way, **more).subjects().collect()) for way in (True, False)]
    assert sets[0] == sets[1]
    return sets[0]


def patients(*ids):
    return ["patient"], [(i,) for i in ids]


THREE = {1: patients(1, 2, 2, 3, None), 2: patients(2, 3, 4), 3: patients(3, 5)}
A, B, C = (leaf(i, "Condition", "") for i in (1, 2, 3))
NOT_C = leaf(3, "Condition", "", inclusive=False)


@pytest.mark.parametrize(
    ("root", "expected"),
    [
        (group("andGroup", 0, A, B), [2, 3]),
        (group("orGroup", 0, A, B, C), [1, 2, 3, 4, 5]),
        (group("andGroup", 0, A, B, NOT_C), [2]),
        (group("orGroup", 0, A, NOT_C), [1, 2, 3, 4, 6, 7, 8, 9, 10]),
        (group("andGroup", 0, NOT_C), [1, 2, 4, 6, 7, 8, 9, 10]),
        (group("nAmongM", 0, A, B, C, nAmongMOptions={"n": 2, "operator": ">="}), [2, 3]),
        (group("nAmongM", 0, A, B, C, nAmongMOptions={"n": 1, "operator": "="}), [1, 4, 5]),
        (group("nAmongM", 0, A, B, C, nAmongMOptions={"n": 2, "operator": "<"}), [1, 4, 5]),
        (group("nAmongM", 0, A, B, NOT_C, nAmongMOptions={"n": 3, "operator": ">="}), [2]),
        (group("orGroup", 0, A, B, inclusive=False), [5, 6, 7, 8, 9, 10]),
        (group("andGroup", 0, A, group("orGroup", -1)), [1, 2, 3]),
        (group("andGroup", 0, group("orGroup", -1, B, C), A), [2, 3]),
    ],
)
def test_groups(spark, root, expected):
    assert result(spark, root, THREE) == expected


def test_no_criteria_means_everybody(spark):
    assert result(spark, None, {1: patients(1)}) == list(range(1, 11))


def test_random_trees_agree_with_sets_and_between_ways(spark):
    import random

    draw = random.Random(5)
    rows = {i: [p for p in range(1, 11) if draw.random() < 0.5] for i in range(1, 6)}
    everybody = set(range(1, 11))

    def tree(depth, ids):
        if depth == 0 or draw.random() < 0.3:
            i = next(ids)
            return leaf(i, "Condition", "", inclusive=draw.random() < 0.7), set(rows[i])
        kind = draw.choice(["andGroup", "orGroup", "nAmongM"])
        parts = [tree(depth - 1, ids) for _ in range(2)]
        inside = [s if c["isInclusive"] else everybody - s for c, s in parts]
        n, operator = draw.choice([(1, "="), (2, ">=")])
        if kind == "andGroup":
            own = set.intersection(*inside)
        elif kind == "orGroup":
            own = set.union(*inside)
        else:
            own = {p for p in everybody if (lambda k: k == 1 if operator == "=" else k >= 2)(sum(p in s for s in inside))}
        return group(kind, next(groups), *(c for c, _ in parts), inclusive=draw.random() < 0.8, nAmongMOptions={"n": n, "operator": operator}), own

    for _ in range(4):
        groups = itertools.count(-1, -1)
        root, own = tree(2, iter(range(1, 6)))
        expected = own if root["isInclusive"] else everybody - own
        assert set(result(spark, root, {i: patients(*v) for i, v in rows.items()})) == expected


def test_occurrences(spark):
    rows = {1: (["patient", "encounter", "event_date"], [(1, 1, "2020-01-01"), (1, 2, "2020-01-01"), (2, 3, "2020-01-01"), (2, 3, "2020-02-01"), (3, 4, "2020-01-01")])}
    times = lambda n, operator=">=", **more: leaf(1, "Condition", "", occurrence={"n": n, "operator": operator, **more})
    assert result(spark, times(2), rows) == [1, 2]
    assert result(spark, times(2, "<"), rows) == [3]
    assert result(spark, times(2, sameDay=True), rows) == [1]
    assert result(spark, times(2, sameEncounter=True), rows) == [2]


def test_a_repeated_code_not_different_codes(spark):
    rows = {1: (["patient", "code"], [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, None)])}
    assert result(spark, leaf(1, "Condition", "", uniqueFields=[{"operator": ">=", "n": 2}]), rows) == [1, 3]


def test_age_is_of_rows(spark):
    rows = {1: (["patient", "patient_birthdate", "encounter_start_date"], [(1, "2000-01-01", "2010-01-01"), (1, "2000-01-01", "2020-01-01"), (2, "2000-01-01", "2010-01-01"), (3, "2000-01-01", None)])}
    aged = lambda **age: leaf(1, "Encounter", "", patientAge=age)
    assert result(spark, aged(minAge="15-0-0"), rows) == [1]
    assert result(spark, aged(maxAge="15-0-0"), rows) == [1, 2]
    assert result(spark, aged(minAge="15-0-0", dateIsNotNull=False), rows) == [1, 3]
    assert result(spark, aged(), rows) == [1, 2, 3]


def constraint(kind, ids="all", **more):
    return {"temporalConstraints": [{"idList": ids, "constraintType": kind, **more}]}


VISITS = {1: (["patient", "encounter"], [(1, 1), (2, 1), (3, None)]), 2: (["patient", "encounter"], [(1, 1), (2, 2), (3, None)]), 3: patients(1, 2)}


def test_same_encounter_null_equals_null(spark):
    assert result(spark, group("andGroup", 0, A, B, **constraint("sameEncounter", [1, 2])), VISITS) == [1, 3]


def test_same_encounter_leaves_out_criteria_without_encounters(spark):
    assert result(spark, group("andGroup", 0, A, B, C, **constraint("sameEncounter")), VISITS) == [1]


def test_different_encounter(spark):
    assert result(spark, group("andGroup", 0, A, B, **constraint("differentEncounter", [1, 2])), VISITS) == [2]


def test_one_criterion_is_no_constraint(spark):
    assert result(spark, group("andGroup", 0, A, C, **constraint("sameEncounter")), VISITS) == [1, 2]


def test_id_lists_go_down_to_where_all_ids_are(spark):
    root = group("orGroup", 0, group("andGroup", -1, A, B), **constraint("sameEncounter", [1, 2]))
    assert result(spark, root, VISITS) == [1, 3]
    lost = compiled(spark, group("andGroup", 0, A, group("andGroup", -1, B), **constraint("sameEncounter", [1, 2])), VISITS)
    assert lost.warnings and "nowhere" in lost.warnings[0]


def test_constraints_on_disjunctions_are_refused(spark):
    with pytest.raises(RequestError):
        compiled(spark, group("orGroup", 0, A, B, **constraint("sameEncounter", [1, 2])), VISITS)


def at(*rows):
    return ["patient", "event_date"], list(rows)


@pytest.mark.parametrize(
    ("limits", "expected"),
    [
        ({}, [1, 2, 4]),
        ({"timeRelationMinDuration": {"hours": 2}}, [1, 2]),
        ({"timeRelationMaxDuration": {"hours": 5}}, [2, 4]),
        ({"timeRelationMinDuration": {"hours": 2}, "timeRelationMaxDuration": {"hours": 3}}, [2]),
        ({"timeRelationMinDuration": {"hours": 2}, "timeRelationMaxDuration": {"hours": 1}}, []),
    ],
)
@pytest.mark.parametrize("known", [True, False])
def test_order(spark, limits, expected, known):
    """Patient 5 has a missing date, which is enough unless dates must be known."""
    rows = {
        1: at((1, "2020-01-01 00:00:00"), (2, "2020-01-01 00:00:00"), (3, "2020-01-02 00:00:00"), (4, "2020-01-01 00:00:00"), (5, None)),
        2: at((1, "2020-01-02 00:00:00"), (2, "2020-01-01 03:00:00"), (3, "2020-01-01 00:00:00"), (4, "2020-01-01 01:00:00"), (5, "2020-01-01 00:00:00")),
    }
    root = group("andGroup", 0, A, B, **constraint("directChronologicalOrdering", [1, 2], dateIsNotNullList=known, **limits))
    assert result(spark, root, rows) == (expected if known else sorted([*expected, 5]))


def test_order_of_three_needs_one_chain(spark):
    rows = {1: at((1, "2020-01-01"), (2, "2020-01-03")), 2: at((1, "2020-01-02"), (2, "2020-01-02"), (2, "2020-01-04")), 3: at((1, "2020-01-03"), (2, "2020-01-03"))}
    assert result(spark, group("andGroup", 0, A, B, C, **constraint("directChronologicalOrdering")), rows) == [1]


def test_order_against_brute_force(spark):
    import random

    draw = random.Random(3)
    rows = {i: [(draw.randrange(1, 9), draw.randrange(0, 200)) for _ in range(40)] for i in (1, 2, 3)}
    root = group("andGroup", 0, A, B, C, **constraint("directChronologicalOrdering", timeRelationMinDuration={"hours": 5}, timeRelationMaxDuration={"hours": 30}, dateIsNotNullList=True))
    frames = {i: at(*((p, f"2020-01-{1 + h // 24:02} {h % 24:02}:00:00") for p, h in v)) for i, v in rows.items()}
    expected = {p for p in range(1, 9) if any(5 <= b - a <= 30 and 5 <= c - b <= 30 for (x, a), (y, b), (z, c) in itertools.product(*rows.values()) if x == y == z == p)}
    assert result(spark, root, frames) == sorted(expected)


def test_cohorts_of_resources(spark):
    rows = {1: (["id", "patient"], [(11, 1), (12, 1), (13, 2)])}
    catalog = FrameCatalog({1: frame(spark, *rows[1])}, frame(spark, ["patient"], [(1,)]))
    asked = parse(request(leaf(1, "Condition", "", occurrence={"n": 2, "operator": ">="}), resourceType="Condition"))
    assert sorted(r[0] for r in Compiled(asked, catalog).subjects().collect()) == [11, 12]
    with pytest.raises(RequestError):
        Compiled(parse(request(group("andGroup", 0, A), resourceType="Condition")), catalog)


@pytest.mark.parametrize("way", [True, False])
def test_stages(spark, way):
    root = group("andGroup", 0, A, group("orGroup", -1, B, NOT_C))
    c = compiled(spark, root, THREE, one_pass=way)
    assert {r["stage"]: r["count"] for r in modes.stage_counts(c).collect()} == {0: 3, 1: 3, -1: 9, 2: 3, 3: 8}
    assert {r["stage"]: (r["count"], r["ratio"]) for r in modes.stage_ratios(c, [2, 3]).collect()} == {2: (2, 2 / 3), 3: (2, 2 / 3)}


def test_organizations(spark):
    rows = {1: (["patient", "organizations"], [(1, "8,3"), (1, "9"), (2, None), (3, "8")]), 2: patients(1, 2)}
    c = compiled(spark, group("andGroup", 0, A, B), rows)
    assert {r[0]: r[1] for r in c.organizations().collect()} == {1: [3, 8, 9], 2: []}
    assert {r[0]: r[1] for r in modes.organization_counts(c).collect()} == {3: 1, 8: 1, 9: 1}


def test_count_modes(spark):
    c = compiled(spark, group("andGroup", 0, A, B), THREE)
    assert modes.count(c).count == 2
    got = modes.count(c, modes.COUNT_ALL, "all", seed=1)
    assert got.count == 2 and got.extra["criteria_count_1"] == "3" and 0 <= int(got.extra["minimum"]) <= 2 < 27 <= int(got.extra["maximum"]) < 52
    assert modes.count(c, details="ratio").extra["criteria_ratio_1"] == "1.0"
    assert modes.count(c, details="2").extra == {"criteria_count_2": "3"}


def test_empty_rows(spark):
    nothing = {1: patients(), 2: patients()}
    assert result(spark, group("andGroup", 0, A, B), nothing) == []
    c = compiled(spark, group("orGroup", 0, A, B), nothing)
    assert {r["stage"]: r["ratio"] for r in modes.stage_ratios(c).collect()} == {0: None, 1: None, 2: None}


def test_ordering_without_upper_bound_holds_subjects_not_times(spark):
    """No aggregation keeps a subject's times apart, and rows of an orGroup don't meet the group's subjects, which are theirs."""
    frame = queries.QUERIES["chronological_in_subgroup"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[subject#\w+, t#", plan)
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 2
