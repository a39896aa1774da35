"""The registered cohort queries over the star schema, with the same results in SQL.

Requests are JSON as a client would send it; thresholds are chosen so that results are neither empty nor everything.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, modes, store
from .cache import ResultCache
from .config import Config
from .plans.compile import Compiled
from .plans.parser import parse
from .sources import jdbc
from .sources.tables import star_catalog


def leaf(i: int, resource: str, fhir: str, inclusive: bool = True, **more) -> dict:
    return {"_type": "basicResource", "_id": i, "isInclusive": inclusive, "resourceType": resource, "filterFhir": fhir, **more}


def group(kind: str, i: int, *criteria: dict, inclusive: bool = True, **more) -> dict:
    return {"_type": kind, "_id": i, "isInclusive": inclusive, "criteria": list(criteria), **more}


def request(root: dict | None, **more) -> dict:
    return {"_type": "request", "sourcePopulation": {"caresiteCohortList": []}, "request": root, **more}


def times(n: int, operator: str = ">=", **more) -> dict:
    return {"occurrence": {"n": n, "operator": operator, **more}}


def _item(i: int, flag: str, quantity: str, **more) -> dict:
    return leaf(i, "Observation", f"l_returnflag={flag}&l_quantity={quantity}", **more)


_URGENT = "class=1-URGENT"
_SAME = {"temporalConstraints": [{"idList": "all", "constraintType": "sameEncounter"}]}


def _ordered(**more) -> dict:
    return {"temporalConstraints": [{"idList": [1, 2], "constraintType": "directChronologicalOrdering", **more}]}


def _between(kind: str, *ids: int) -> dict:
    return {"temporalConstraints": [{"idList": list(ids) or "all", "constraintType": kind}]}


def _errors(i: int, kind: str, **more) -> dict:
    return leaf(i, "Event", f"event_type={kind}&value=gt20", **more)


BUILDING = leaf(3, "Patient", "c_mktsegment=BUILDING")

REQUESTS: dict[str, dict] = {
    "population": request(None),
    "and_group": request(group("andGroup", 0, _item(1, "R", "gt45"), leaf(2, "Encounter", _URGENT))),
    "or_group": request(group("orGroup", 0, _item(1, "R", "gt49"), leaf(2, "Encounter", f"{_URGENT}&status=P"))),
    "n_among_m": request(group("nAmongM", 0, _item(1, "R", "gt49"), leaf(2, "Encounter", _URGENT), BUILDING, nAmongMOptions={"n": 2, "operator": ">="})),
    "n_among_m_exact": request(group("nAmongM", 0, _item(1, "R", "gt49"), leaf(2, "Encounter", _URGENT), BUILDING, nAmongMOptions={"n": 1, "operator": "="})),
    "exclusion": request(group("andGroup", 0, BUILDING, leaf(2, "Encounter", _URGENT, inclusive=False))),
    "or_with_complement": request(group("orGroup", 0, BUILDING, leaf(2, "Encounter", _URGENT, inclusive=False))),
    "root_negation": request(leaf(2, "Encounter", _URGENT, inclusive=False)),
    "only_exclusions": request(group("andGroup", 0, leaf(2, "Encounter", _URGENT, inclusive=False), leaf(3, "Patient", "c_mktsegment=BUILDING", inclusive=False))),
    "nested_groups": request(group("andGroup", 0, group("orGroup", -1, _item(1, "R", "gt49"), BUILDING), group("nAmongM", -2, leaf(4, "Encounter", _URGENT), leaf(5, "Encounter", "status=P"), _item(6, "A", "lt3"), nAmongMOptions={"n": 3, "operator": "<"}))),
    "occurrence": request(_item(1, "R", "gt40", **times(3))),
    "occurrence_exact": request(_item(1, "R", "gt40", **times(2, "="))),
    "occurrence_same_encounter": request(_item(1, "R", "gt40", **times(2, sameEncounter=True))),
    "occurrence_same_day": request(leaf(1, "Event", "event_type=error", **times(2, sameDay=True))),
    "patient_age": request(leaf(1, "Encounter", "", patientAge={"minAge": "18-2-4", "maxAge": "40-0-0"})),
    "unique_codes": request(_item(1, "R,A,N", "gt45", uniqueFields=[{"operator": ">=", "n": 2}])),
    "same_encounter": request(group("andGroup", 0, _item(1, "R", "gt45"), _item(2, "A", "lt3"), **_SAME)),
    "same_encounter_pushed_down": request(group("andGroup", 0, group("andGroup", -1, _item(1, "R", "gt40"), _item(2, "A", "lt10")), BUILDING, **_between("sameEncounter", 1, 2))),
    "different_encounter": request(group("andGroup", 0, _item(1, "R", "gt49"), _item(2, "A", "lt2"), **_between("differentEncounter", 1, 2))),
    "same_episode": request(group("andGroup", 0, _item(1, "R", "gt45"), _item(2, "A", "lt3"), **_between("sameEpisodeOfCare"))),
    "same_encounter_nested": request(group("andGroup", 0, group("andGroup", -1, _item(1, "R", "gt30"), _item(2, "A", "lt20")), leaf(3, "Encounter", _URGENT), **_SAME)),
    "chronological": request(group("andGroup", 0, _errors(1, "error"), _errors(2, "purchase"), **_ordered(timeRelationMinDuration={"hours": 2}, timeRelationMaxDuration={"days": 1}, dateIsNotNullList=True))),
    "chronological_open": request(group("andGroup", 0, _errors(1, "error"), _errors(2, "purchase"), **_ordered(timeRelationMinDuration={"days": 20}))),
    "chronological_three": request(group("andGroup", 0, _errors(1, "error"), _errors(2, "purchase"), _errors(3, "click"), **_between("directChronologicalOrdering"))),
    "chronological_last_to_first": request(group("andGroup", 0, _errors(1, "error"), _errors(2, "purchase"), **_ordered(timeRelationMinDuration={"minutes": 1}, dateIsNotNullList=True, occurrenceChoiceList=[{"_id": 1, "occurrenceChoice": "first"}, {"_id": 2, "occurrenceChoice": "last"}]))),
    "chronological_null_dates": request(group("andGroup", 0, leaf(1, "Event", "event_type=error"), leaf(2, "UndatedEvent", "event_type=purchase"), **_ordered(timeRelationMinDuration={"days": 25}))),
    "chronological_in_subgroup": request(group("andGroup", 0, group("orGroup", -1, _item(4, "R", "gt48"), _item(5, "A", "gt48")), leaf(2, "Encounter", _URGENT), temporalConstraints=[{"idList": [2, -1], "constraintType": "directChronologicalOrdering", "timeRelationMinDuration": {"years": 5}, "dateIsNotNullList": True, "datePreferenceList": [{"_id": 2, "datePreference": ["encounter_start_date"]}, {"_id": -1, "datePreference": ["event_date"]}]}])),
    "age_of_events": request(leaf(1, "Observation", "l_returnflag=R&l_quantity=gt45", patientAge={"minAge": "30-6-0", "datePreference": ["event_date"]}, **times(2))),
    "same_episode_of_groups": request(group("andGroup", 0, _item(1, "R", "gt45"), group("orGroup", -1, _item(2, "A", "lt2"), leaf(3, "Encounter", "status=P")), **_between("sameEpisodeOfCare"))),
    "deep_exclusions": request(group("andGroup", 0, _item(1, "R", "gt40"), group("orGroup", -1, group("andGroup", -2, BUILDING, leaf(4, "Encounter", "status=P", inclusive=False)), leaf(5, "Encounter", _URGENT, inclusive=False), inclusive=False))),
    "encounter_date_range": request(leaf(1, "Observation", "l_returnflag=R&l_quantity=gt45", encounterDateRange={"minDate": "1996-01-01", "maxDate": "1996-12-31"})),
    "resource_cohort": request(leaf(1, "Encounter", f"{_URGENT}&o_totalprice=gt100000"), resourceType="Encounter"),
    "study_dedup": request(leaf(1, "ImagingStudy", "l_returnflag=R&l_quantity=gt40", **times(2))),
    "occurrence_in_constraint": request(group("andGroup", 0, _item(1, "R", "gt20", **times(2, sameEncounter=True)), _item(2, "A", "lt30"), **_SAME)),
    "n_among_m_in_constraint": request(group("andGroup", 0, group("nAmongM", -1, _item(4, "R", "gt48"), _item(5, "A", "gt48"), leaf(6, "Encounter", "status=P"), nAmongMOptions={"n": 2, "operator": ">="}), leaf(2, "Encounter", _URGENT), **_SAME)),
    "two_constraints": request(group("andGroup", 0, _item(1, "R", "gt40"), _item(2, "A", "lt10"), _item(3, "N", "gt20"), temporalConstraints=[{"idList": [1, 2], "constraintType": "sameEncounter"}, {"idList": [1, 3], "constraintType": "sameEpisodeOfCare"}])),
    "two_unique_codes": request(_item(1, "R,A,N", "gt45", uniqueFields=[{"operator": ">=", "n": 2}, {"operator": "=", "n": 1}])),
    "unique_codes_of_two_columns": request(leaf(1, "Claim", "l_quantity=gt40", uniqueFields=[{"operator": ">=", "n": 2}])),
    "filter_not": request(leaf(1, "Encounter", "class:not=1-URGENT,2-HIGH&o_totalprice=lt100000&o_orderdate=ge1997-01-01")),
}


def _compiled(spark: SparkSession, sf_dir: str, name: str, **more) -> Compiled:
    asked = parse(REQUESTS[name])
    return Compiled(asked, star_catalog(spark, sf_dir), **more)


def _subjects(name: str, **more) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _compiled(spark, sf_dir, name, **more).subjects()


def lucene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = star_catalog(spark, sf_dir)
    catalog.language = "lucene"
    asked = leaf(1, "Encounter", "", filterSolr='fq=class:("1-URGENT" OR 2-HIGH) AND -status:P&fq=o_totalprice:[100000 TO 200000}')
    return Compiled(parse(request(asked)), catalog).subjects()


def source_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lambda cohorts: spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 5 = 0").select(F.lit(7).alias("cohort"), F.col("c_custkey").alias("patient"))
    asked = request(leaf(2, "Encounter", _URGENT))
    asked["sourcePopulation"] = {"caresiteCohortList": [7]}
    parsed = parse(asked)
    return Compiled(parsed, star_catalog(spark, sf_dir, items, parsed.cohorts)).subjects()


def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.counted(_compiled(spark, sf_dir, "and_group"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.stage_counts(_compiled(spark, sf_dir, "exclusion"))


def stage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.stage_ratios(_compiled(spark, sf_dir, "or_group"), [0, 1, 2]).withColumn("ratio", F.round("ratio", 6))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.organization_counts(Compiled(parse(request(BUILDING)), star_catalog(spark, sf_dir)))


def organization_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(spark, sf_dir, "exclusion").organizations().select("subject_id", F.array_join("organization_ids", ",").alias("organization_ids"))


def cohort_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.difference(_compiled(spark, sf_dir, "occurrence").subjects(), _compiled(spark, sf_dir, "unique_codes").subjects())


def cohort_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base cohort with its customers' orders as changes: P deletes, anything else adds; the last one counts."""
    base = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subject_id"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderdate < '1993-01-01'")
    changes = orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", True).when(F.col("o_orderstatus") == "F", False).alias("deleted"))
    return store.folded(base, changes)


def cohort_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.items(_compiled(spark, sf_dir, "occurrence").subjects(), 12, "me")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.sample(_compiled(spark, sf_dir, "or_group").subjects(), 0.25, seed=1)


def cohort_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.group_documents(_compiled(spark, sf_dir, "exclusion").subjects(), 12)


def cohort_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference as the entries of a List resource."""
    return store.list_entries(store.items(cohort_difference(spark, sf_dir), 12, "me"))


def cohort_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.relation_rows(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("source")), 12)


def bulk_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bulk load of all customers still has to write when those of BUILDING are there."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return store.absent(rows, rows.filter("c_mktsegment = 'BUILDING'"), "c_custkey").select("c_custkey", "c_name")


def population_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients of the default filter: those with a positive balance."""
    catalog = star_catalog(spark, sf_dir)
    catalog.default_filter = "c_acctbal=gt0"
    return modes.counted(Compiled(parse(REQUESTS["population"]), catalog))


def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count, and whether the bounds that hide it lie where they must."""
    found = modes.count(_compiled(spark, sf_dir, "and_group"), modes.COUNT_ALL)
    low, high = (int(found.extra[k]) for k in ("minimum", "maximum"))
    told = max(0, found.count - 50) <= low <= max(0, found.count), found.count + 25 <= high < found.count + 50
    return spark.range(1).select(F.lit(found.count).cast("long").alias("count"), F.lit(told[0]).alias("low"), F.lit(told[1]).alias("high"))


def _store(spark: SparkSession) -> store.CohortStore:
    """A store of its own in the folder that the executors share; without one only a local master can do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp()}"
    return store.CohortStore(spark, f"{folder}/cohorts-{uuid.uuid4().hex}")


def _created(spark: SparkSession, sf_dir: str) -> tuple[store.CohortStore, int, int]:
    """A cohort, and the changes that make another one of it."""
    kept, catalog = _store(spark), star_catalog(spark, sf_dir)
    base = int(jobs.run(jobs.Parameters(REQUESTS["occurrence"], modes.CREATE), catalog, kept, Config()).group_id)
    changed = int(jobs.run(jobs.Parameters(REQUESTS["unique_codes"], modes.CREATE_DIFF, base_cohort=base), catalog, kept, Config()).group_id)
    return kept, base, changed


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cohort, subject_id): a created cohort as read back, and one stored as changes to it."""
    kept, base, changed = _created(spark, sf_dir)
    return kept.read(base).select(F.lit("base").alias("cohort"), "subject_id").union(kept.read(changed).select(F.lit("changed"), "subject_id"))


def created_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with an urgent encounter among the members of a cohort that is stored as changes."""
    kept, _, changed = _created(spark, sf_dir)
    asked = request(leaf(2, "Encounter", _URGENT))
    asked["sourcePopulation"] = {"caresiteCohortList": [changed]}
    parsed = parse(asked)
    return Compiled(parsed, star_catalog(spark, sf_dir, kept.members, parsed.cohorts)).subjects()


def nested_groups_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As nested_groups, from results that another request left behind."""
    kept = ResultCache(spark, "me")
    _compiled(spark, sf_dir, "nested_groups", cache=kept).subjects()
    return _compiled(spark, sf_dir, "nested_groups", cache=kept).subjects()


def dealt_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return jdbc.dealt_exactly(rows, "c_custkey", 7).select("c_custkey", F.spark_partition_id().cast("long").alias("task"))


def csv_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat("n_name", F.lit("\r\nx\ry")).alias("name"), F.array(F.col("n_nationkey"), F.col("n_regionkey")).alias("keys"))
    return store.csv_ready(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _subjects(name) for name in REQUESTS},
    "and_group_joins": _subjects("and_group", one_pass=False),
    "nested_groups_joins": _subjects("nested_groups", one_pass=False),
    **{f.__name__: f for f in (lucene_filter, source_population, count, stage_counts, stage_ratios, organizations, organization_lists, cohort_difference, cohort_folded, cohort_items, cohort_documents, cohort_list, cohort_relations, bulk_retry, population_count, sampled, csv_ready, count_all, created, created_population, nested_groups_cached, dealt_exactly)},
}

_I = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_URGENT_SQL = "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderpriority = '1-URGENT'"
_BUILDING_SQL = "SELECT c_custkey AS subject_id FROM customer WHERE c_mktsegment = 'BUILDING'"
_ALL_SQL = "SELECT c_custkey AS subject_id FROM customer"


def _items_sql(flag: str, condition: str) -> str:
    return f"SELECT DISTINCT o_custkey AS subject_id FROM {_I} WHERE l_returnflag = '{flag}' AND l_quantity {condition}"


def _among(sets: tuple[str, ...], having: str) -> str:
    return f"SELECT subject_id FROM ({' UNION ALL '.join(f'({s})' for s in sets)}) GROUP BY subject_id HAVING count(*) {having}"


def _pair(key: str, first: tuple[str, str], second: tuple[str, str]) -> str:
    rows = lambda f: f"SELECT o_custkey AS s, {key} AS k FROM {_I} WHERE l_returnflag = '{f[0]}' AND l_quantity {f[1]}"
    return f"SELECT DISTINCT a.s AS subject_id FROM ({rows(first)}) a JOIN ({rows(second)}) b ON a.s = b.s AND a.k"


def _events(kind: str) -> str:
    return f"SELECT user_id AS s, ts FROM events WHERE event_type = '{kind}' AND value > 20"


_OCCURRENCE = f"SELECT o_custkey AS subject_id FROM {_I} WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1 HAVING count(*)"
_CODES = f"SELECT DISTINCT o_custkey AS subject_id FROM (SELECT o_custkey FROM {_I} JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY o_custkey, p_brand HAVING count(*) >= 2)"
_NESTED = f"({_items_sql('R', '> 49')} UNION {_BUILDING_SQL}) INTERSECT ({_among((_URGENT_SQL, "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'P'", _items_sql('A', '< 3')), '< 3')})"
_AND = f"{_items_sql('R', '> 45')} INTERSECT {_URGENT_SQL}"
_OR = f"{_items_sql('R', '> 49')} UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"
_EXCLUSION = f"{_BUILDING_SQL} EXCEPT {_URGENT_SQL}"
_THREE = (_items_sql("R", "> 49"), _URGENT_SQL, _BUILDING_SQL)



def _murmur3(*columns: tuple[str, str]) -> str:
    """Murmur3 over columns (expression; long or text of ASCII characters), seeded with 42 and each next one with the hash so far."""
    let = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    times = lambda x, by: f"((({x})::HUGEINT * {by}) % 4294967296)::BIGINT"
    turned = lambda x, by: let("v", x, f"((v << {by}) & 4294967295) | (v >> {32 - by})")
    mixed = lambda h, k: f"({times(turned(f'xor({h}, {times(turned(times(k, 0xCC9E2D51), 15), 0x1B873593)})', 13), 5)} + {0xE6546B64}) % 4294967296"
    down = lambda x, by: let("v", x, f"xor(v, v >> {by})")
    ended = lambda h, size: down(times(down(times(down(f"xor({h}, {size})", 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)
    found = "42::BIGINT"
    for value, kind in columns:
        if kind == "long":
            words, size = f"[({value}) & 4294967295, ({value}) >> 32]", "8"
        else:
            four = " + ".join(f"{256**i} * ascii(({value})[4 * i + {i + 1}])" for i in range(4))
            words, size = f"list_concat(list_transform(range(0, length({value}) // 4), lambda i: ({four})::BIGINT), list_transform(range(4 * (length({value}) // 4), length({value})), lambda i: ascii(({value})[i + 1])::BIGINT))", f"length({value})"
        found = ended(f"list_reduce(list_concat([{found}], {words}), lambda h, k: {mixed('h', 'k')})", size)
    return let("v", found, "(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END)::INTEGER")


ORACLES: dict[str, str] = {
    "population": _ALL_SQL,
    "and_group": _AND,
    "and_group_joins": _AND,
    "or_group": _OR,
    "n_among_m": _among(_THREE, ">= 2"),
    "n_among_m_exact": _among(_THREE, "= 1"),
    "exclusion": _EXCLUSION,
    "or_with_complement": f"{_BUILDING_SQL} UNION ({_ALL_SQL} EXCEPT {_URGENT_SQL})",
    "root_negation": f"{_ALL_SQL} EXCEPT {_URGENT_SQL}",
    "only_exclusions": f"{_ALL_SQL} EXCEPT ({_URGENT_SQL} UNION {_BUILDING_SQL})",
    "nested_groups": _NESTED,
    "nested_groups_joins": _NESTED,
    "occurrence": f"{_OCCURRENCE} >= 3",
    "occurrence_exact": f"{_OCCURRENCE} = 2",
    "occurrence_same_encounter": f"SELECT DISTINCT subject_id FROM (SELECT o_custkey AS subject_id FROM {_I} WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY o_custkey, l_orderkey HAVING count(*) >= 2)",
    "occurrence_same_day": "SELECT DISTINCT subject_id FROM (SELECT user_id AS subject_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts::DATE HAVING count(*) >= 2)",
    "patient_age": "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE datediff('day', DATE '1940-01-01' + ((o_custkey * 37) % 20000)::INT, o_orderdate::DATE) BETWEEN 18 * 365.25 + 2 * 30 + 4 AND 40 * 365.25",
    "unique_codes": _CODES,
    "same_encounter": _pair("l_orderkey", ("R", "> 45"), ("A", "< 3")) + " = b.k",
    "same_encounter_pushed_down": _pair("l_orderkey", ("R", "> 40"), ("A", "< 10")) + f" = b.k INTERSECT {_BUILDING_SQL}",
    "different_encounter": _pair("l_orderkey", ("R", "> 49"), ("A", "< 2")) + " <> b.k",
    "same_episode": _pair("year(o_orderdate)", ("R", "> 45"), ("A", "< 3")) + " = b.k",
    "same_encounter_nested": f"SELECT DISTINCT o_custkey AS subject_id FROM {_I} AS x WHERE l_returnflag = 'R' AND l_quantity > 30 AND o_orderpriority = '1-URGENT' AND EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_returnflag = 'A' AND y.l_quantity < 20)".replace(f"{_I} AS x", "lineitem x JOIN orders ON x.l_orderkey = o_orderkey"),
    "chronological": f"SELECT DISTINCT a.s AS subject_id FROM ({_events('error')}) a JOIN ({_events('purchase')}) b ON a.s = b.s AND b.ts BETWEEN a.ts + INTERVAL 2 HOUR AND a.ts + INTERVAL 24 HOUR",
    "chronological_open": f"SELECT DISTINCT a.s AS subject_id FROM ({_events('error')}) a JOIN ({_events('purchase')}) b ON a.s = b.s AND b.ts >= a.ts + INTERVAL 480 HOUR",
    "chronological_three": f"SELECT DISTINCT a.s AS subject_id FROM ({_events('error')}) a JOIN ({_events('purchase')}) b ON a.s = b.s AND b.ts >= a.ts JOIN ({_events('click')}) c ON a.s = c.s AND c.ts >= b.ts",
    "chronological_last_to_first": f"SELECT a.s AS subject_id FROM (SELECT s, min(ts) AS t FROM ({_events('error')}) GROUP BY s) a JOIN (SELECT s, max(ts) AS t FROM ({_events('purchase')}) GROUP BY s) b ON a.s = b.s AND b.t >= a.t + INTERVAL 1 MINUTE",
    "chronological_null_dates": "SELECT DISTINCT a.user_id AS subject_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND (b.value < 3 OR b.ts >= a.ts + INTERVAL 600 HOUR)",
    "chronological_in_subgroup": f"SELECT DISTINCT a.s AS subject_id FROM (SELECT o_custkey AS s, o_orderdate AS t FROM orders WHERE o_orderpriority = '1-URGENT') a JOIN (SELECT o_custkey AS s, l_shipdate AS t FROM {_I} WHERE l_returnflag IN ('R', 'A') AND l_quantity > 48) b ON a.s = b.s AND b.t >= a.t + INTERVAL 43800 HOUR",
    "age_of_events": f"SELECT o_custkey AS subject_id FROM {_I} WHERE l_returnflag = 'R' AND l_quantity > 45 AND datediff('day', DATE '1940-01-01' + ((o_custkey * 37) % 20000)::INT, l_shipdate::DATE) >= 30 * 365.25 + 180 GROUP BY 1 HAVING count(*) >= 2",
    "same_episode_of_groups": f"SELECT DISTINCT a.s AS subject_id FROM (SELECT o_custkey AS s, year(o_orderdate) AS k FROM {_I} WHERE l_returnflag = 'R' AND l_quantity > 45) a JOIN (SELECT o_custkey AS s, year(o_orderdate) AS k FROM {_I} WHERE l_returnflag = 'A' AND l_quantity < 2 UNION ALL SELECT o_custkey, year(o_orderdate) FROM orders WHERE o_orderstatus = 'P') b ON a.s = b.s AND a.k = b.k",
    "deep_exclusions": f"{_items_sql('R', '> 40')} EXCEPT (({_BUILDING_SQL} EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ({_ALL_SQL} EXCEPT {_URGENT_SQL}))",
    "encounter_date_range": f"SELECT DISTINCT o_custkey AS subject_id FROM {_I} WHERE l_returnflag = 'R' AND l_quantity > 45 AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
    "resource_cohort": "SELECT o_orderkey AS subject_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000",
    "study_dedup": f"SELECT o_custkey AS subject_id FROM {_I} WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2",
    "filter_not": "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_totalprice < 100000 AND o_orderdate::DATE >= DATE '1997-01-01'",
    "lucene_filter": "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' AND o_totalprice >= 100000 AND o_totalprice < 200000",
    "source_population": "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 5 = 0",
    "count": f"SELECT count(*) AS count FROM ({_AND})",
    "stage_counts": f"SELECT 0 AS stage, (SELECT count(*) FROM ({_EXCLUSION})) AS count UNION ALL SELECT 3, (SELECT count(*) FROM ({_BUILDING_SQL})) UNION ALL SELECT 2, (SELECT count(*) FROM ({_ALL_SQL} EXCEPT {_URGENT_SQL}))",
    "stage_ratios": f"WITH r AS ({_OR}), s AS (SELECT 0 AS stage, subject_id FROM r UNION ALL SELECT 1, subject_id FROM ({_items_sql('R', '> 49')}) UNION ALL SELECT DISTINCT 2, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') SELECT stage, count(*) AS count, round(count(*) / (SELECT count(*) FROM r), 6) AS ratio FROM s WHERE subject_id IN (FROM r) GROUP BY stage",
    "organizations": "SELECT o AS organization, count(*) AS count FROM (SELECT unnest([c_nationkey::BIGINT, (100 + n_regionkey)::BIGINT]) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING') GROUP BY o",
    "organization_lists": f"SELECT c_custkey AS subject_id, c_nationkey || ',' || (100 + n_regionkey) AS organization_ids FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN ({_EXCLUSION})",
    "cohort_difference": f"SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, b.subject_id IS NULL AS deleted FROM ({_OCCURRENCE} >= 3) a FULL JOIN ({_CODES}) b ON a.subject_id = b.subject_id WHERE a.subject_id IS NULL OR b.subject_id IS NULL",
    "cohort_folded": f"WITH c AS (SELECT o_custkey AS subject_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus = 'P' DESC) AS k, o_orderstatus = 'P' AS deleted FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'), l AS (SELECT subject_id, deleted FROM c WHERE k = 1) ({_BUILDING_SQL} UNION SELECT subject_id FROM l WHERE NOT deleted) EXCEPT SELECT subject_id FROM l WHERE deleted",
    "cohort_items": f"SELECT subject_id AS _itemreferenceid, 'Patient/' || subject_id AS item__reference, 'me' AS _provider, 12::BIGINT AS _listid, {_murmur3(('subject_id::BIGINT', 'long'), ("('Patient/' || subject_id)", 'text'), ("'me'", 'text'), ('12::BIGINT', 'long'))} AS hash FROM ({_OCCURRENCE} >= 3)",
    "cohort_documents": f"SELECT '12_' || subject_id AS id, subject_id AS \"resourceId\", 12::BIGINT AS \"groupId\", 'Patient' AS \"resourceType\" FROM ({_EXCLUSION})",
    "cohort_list": "SELECT '{\"deleted\":' || deleted || ',\"item\":{\"reference\":\"Patient/' || subject_id || '\"}}' AS line FROM (@DIFF@)",
    "cohort_relations": "SELECT 12::BIGINT AS cohort_a, r_regionkey::BIGINT AS cohort_b, 44818821::BIGINT AS concept FROM region UNION ALL SELECT r_regionkey, 12, 44818823 FROM region",
    "bulk_retry": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "population_count": "SELECT count(*) AS count FROM customer WHERE c_acctbal > 0",
    "occurrence_in_constraint": "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20 GROUP BY 1 HAVING count(*) >= 2) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 30)",
    "n_among_m_in_constraint": f"WITH s AS ({_among((_items_sql('R', '> 48'), _items_sql('A', '> 48'), "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'P'"), '>= 2')}), r AS (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity > 48 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT DISTINCT o_custkey AS subject_id FROM r JOIN orders ON k = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT subject_id FROM s)",
    "two_constraints": _pair("l_orderkey", ("R", "> 40"), ("A", "< 10")) + " = b.k INTERSECT " + _pair("year(o_orderdate)", ("R", "> 40"), ("N", "> 20")) + " = b.k",
    "two_unique_codes": f"{_CODES} INTERSECT {_CODES.replace('>= 2', '= 1')}",
    "unique_codes_of_two_columns": f"SELECT DISTINCT o_custkey AS subject_id FROM (SELECT o_custkey FROM {_I} JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40 GROUP BY o_custkey, p_brand, l_linestatus HAVING count(*) >= 2)",
    "sampled": f"WITH r AS ({_OR}) SELECT subject_id FROM r ORDER BY md5('1-' || subject_id), subject_id LIMIT (SELECT floor(0.25 * count(*) + 0.5)::BIGINT FROM r)",
    "count_all": f"SELECT count(*) AS count, true AS low, true AS high FROM ({_AND})",
    "created": f"SELECT 'base' AS cohort, subject_id FROM ({_OCCURRENCE} >= 3) UNION ALL SELECT 'changed', subject_id FROM ({_CODES})",
    "created_population": f"{_URGENT_SQL} INTERSECT {_CODES}",
    "nested_groups_cached": _NESTED,
    "dealt_exactly": "SELECT c_custkey, c_custkey % 7 AS task FROM customer",
    "csv_ready": "SELECT n_nationkey, n_name || chr(10) || 'x' || chr(10) || 'y' AS name, '{' || n_nationkey || ',' || n_regionkey || '}' AS keys FROM nation",
}
ORACLES["cohort_list"] = ORACLES["cohort_list"].replace("@DIFF@", ORACLES["cohort_difference"])
