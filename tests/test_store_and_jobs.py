"""Cohort store, jobs, server and the REST source, each against small local doubles."""

import json
import threading
import time
import urllib.error
import urllib.request
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from cohortsmith import jobs, modes, store
from cohortsmith.config import Config
from cohortsmith.plans.model import RequestError
from cohortsmith.queries import leaf, request
from cohortsmith.server import server
from cohortsmith.sources import fhir_rest
from cohortsmith.sources.catalog import Resource, TableCatalog
from cohortsmith.functions.filters import Field


def ids(df):
    return sorted(r[0] for r in df.collect())


def subjects(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "subject_id long")


def test_difference(spark):
    got = modes.difference(subjects(spark, 20, 50, 50, 90), subjects(spark, 90, 20, 11, 70, 70))
    assert sorted(map(tuple, got.collect())) == [(11, False), (50, True), (70, False)]


def test_changes_are_folded_in_order(spark):
    changes = spark.createDataFrame([(3, 1, True), (3, 2, False), (4, 1, None), (4, 3, True), (5, 2, None), (1, 1, True), (1, 2, None)], "subject_id long, date long, deleted boolean")
    assert ids(store.folded(subjects(spark, 1, 2, 3, 4), changes)) == [1, 2, 3, 5]


def test_sampling(spark):
    drawn = modes.sample(subjects(spark, *range(100)), 0.3, seed=4)
    assert drawn.count() == 30 and ids(drawn) == ids(modes.sample(subjects(spark, *range(100)), 0.3, seed=4))
    assert modes.sample(subjects(spark, 1, 2, 3, 4, 5), 0.5).count() == 3  # half up
    with pytest.raises(RequestError):
        modes.sample(subjects(spark, 1), 1.5)


def test_snapshots_and_changes(spark, tmp_path):
    s = store.CohortStore(spark, f"file://{tmp_path}/store")
    first = s.create("a", owner="me", size=3)
    s.write(first, subjects(spark, 1, 2, 3), sources=[7, 8])
    assert ids(s.read(first)) == [1, 2, 3] and s.cohort(first)["status"] == store.FINISHED and s.cohort(first)["size"] == 3
    second = s.create("b", base=first)
    s.write(second, modes.difference(s.read(first), subjects(spark, 1, 4)), size=2)
    assert ids(s.read(second)) == [1, 4] and s.cohort(second)["mode"] == store.CHANGES
    assert sorted(map(tuple, s.members([first, second]).collect())) == [(first, 1), (first, 2), (first, 3), (second, 1), (second, 4)]
    third = s.create("c", base=second)  # changes to changes
    s.write(third, modes.difference(s.read(second), subjects(spark, 4, 5)), size=2)
    assert sorted(map(tuple, s.members([third]).collect())) == [(third, 4), (third, 5)] and s.members([]).count() == 0
    relations = s.all_relations()
    assert sorted(map(tuple, relations.collect())) == sorted([(first, c, store.COMES_FROM) for c in (7, 8)] + [(c, first, store.SOURCE_OF) for c in (7, 8)])
    assert [json.loads(r[0]) for r in s.as_list(first).orderBy("line").collect()][0] == {"deleted": False, "item": {"reference": "Patient/1"}}
    assert json.loads(s.list_header(first))["status"] == "current"
    with pytest.raises(Exception, match="no_such_column"):
        s.write(first, subjects(spark, 1).select(F.col("no_such_column").alias("subject_id")))
    broken = s.create("c")
    with pytest.raises(Exception):
        s.write(broken, subjects(spark, 1).withColumn("subject_id", F.raise_error(F.lit("no")).cast("long")))
    assert s.cohort(broken)["status"] == store.ERROR


def test_row_hashes_are_of_all_columns(spark):
    rows = store.items(subjects(spark, 1, 2), 12, "me")
    assert rows.columns == ["_itemreferenceid", "item__reference", "_provider", "_listid", "hash"]
    assert len({r["hash"] for r in rows.collect()}) == 2


def test_row_hashes_are_murmur3(spark):
    """Rows of an integer, two texts, a long and a Boolean, and their hashes."""
    told = {1: -1662328687, 3: -1015512107, 5: -1473784149}
    rows = spark.createDataFrame([(i, f"Patient/{i}", "Cohort360", 12345, False) for i in told], "a int, b string, c string, d long, e boolean")
    assert {r["a"]: r["hash"] for r in store.hashed(rows).collect()} == told


def test_concurrent_jobs_create_cohorts_of_their_own(spark, catalog, tmp_path):
    s = store.CohortStore(spark, f"file://{tmp_path}/store")
    manager = jobs.JobManager(spark, catalog, s, Config(threads=8))
    made = [manager.submit(parameters(modes.CREATE, f"g={i % 3}")) for i in range(8)]
    manager.wait()
    assert [j.message for j in made if j.status != jobs.FINISHED] == []
    cohorts = [int(j.result.group_id) for j in made]
    assert len(set(cohorts)) == 8
    for i, c in enumerate(cohorts):
        assert ids(s.read(c)) == [k for k in range(1, 10) if k % 3 == i % 3]


def test_finished_jobs_are_forgotten_in_time(spark, catalog):
    manager = jobs.JobManager(spark, catalog, None, Config(threads=1, kept_jobs=3), work=lambda *args: modes.Result(1))
    made = [manager.submit(parameters())]
    for _ in range(6):
        while not made[-1].ended:
            time.sleep(0.01)
        made.append(manager.submit(parameters()))
    manager.wait()
    assert len(manager.list()) <= 4 and manager.job(made[-1].id) and not manager.job(made[0].id)


def test_kept_results(spark, catalog):
    """Jobs of one user share the subjects of a criterion; other filters, populations and users do not."""
    manager = jobs.JobManager(spark, catalog, None, Config(threads=1, cache=True, cached=2))
    counts = [manager.submit(parameters(query=q, owner=o)) for q, o in (("g=1", "me"), ("g=1", "me"), ("g=2", "me"), ("g=1", "you"), ("g=0", "me"))]
    manager.wait()
    assert [j.result.count for j in counts] == [3] * 5
    assert set(manager.caches) == {"me", "you"} and len(manager.caches["me"].names) == 2 and len(manager.caches["you"].names) == 1
    assert manager.caches["me"].purge() == 2 and not manager.caches["me"].names


def test_rows_are_dealt_by_key_modulo_tasks(spark):
    from cohortsmith.sources.jdbc import dealt_exactly

    rows = spark.createDataFrame([(i,) for i in [*range(-5, 20), None]], "k long")
    got = {(r["k"], r["p"]) for r in dealt_exactly(rows, "k", 4).select("k", F.spark_partition_id().alias("p")).collect()}
    assert got == {(i, i % 4) for i in range(-5, 20)} | {(None, 0)}


def test_hocon_bodies():
    from cohortsmith import hocon
    from cohortsmith.server import posted

    text = """
    # a job
    mode = count_all, owner.entity = "7"
    owner { name : some one // with a comment
    }
    modeOptions { sampling = 0.5, list = [1, two
      "three",] , off = null }
    """ + 'syntax = """{"a": "b"}"""'
    assert hocon.loads(text) == {"mode": "count_all", "owner": {"entity": "7", "name": "some one"}, "modeOptions": {"sampling": 0.5, "list": [1, "two", "three"], "off": None}, "syntax": '{"a": "b"}'}
    assert hocon.loads("") == {} and hocon.loads('{"a": {"b": [true, {}]}, "url": "http://x/y"}') == {"a": {"b": [True, {}]}, "url": "http://x/y"}
    for bad in ("a", "a = ", "{a: 1", "a = ${b}", "a : [1", "a : 1 }"):
        with pytest.raises(ValueError):
            hocon.loads(bad)
    with pytest.raises(RequestError):
        posted("[1]")


def test_what_a_bulk_loader_wants(spark):
    rows = spark.createDataFrame([(1, [1, 2], "a\r\nb\rc\u0000d", {"k": 1})], "id long, a array<long>, t string, m map<string,int>")
    assert tuple(store.csv_ready(rows).first()) == (1, "{1,2}", "a\nb\ncd", '{"k":1}')
    assert ids(store.absent(subjects(spark, 1, 2, 3), subjects(spark, 2), "subject_id")) == [1, 3]


def test_bounds():
    import random

    for n in (0, 1, 10, 26, 27, 60, 1000):
        low, high = modes.bounds(n, random.Random(n))
        assert 0 <= low <= n and n + 25 <= high < n + 50


@pytest.fixture
def catalog(spark):
    table = lambda: spark.createDataFrame([(i, i % 3) for i in range(1, 10)], "k long, g long")
    return TableCatalog({"Patient": Resource(table, {"patient": Field("k", "number"), "id": Field("k", "number")}, {"g": Field("g", "number")})})


def parameters(mode=modes.COUNT, query="g=1", **more):
    return jobs.Parameters(request(leaf(1, "Patient", query)), mode, **more)


def test_jobs_count_create_and_differ(spark, catalog, tmp_path):
    s = store.CohortStore(spark, f"file://{tmp_path}/store")
    told = []
    manager = jobs.JobManager(spark, catalog, s, Config(threads=1, callback_url="http://x"), notify=lambda url, body: told.append((url, body)))
    a = manager.submit(parameters(details="all"))
    b = manager.submit(parameters(modes.CREATE))
    manager.wait()
    assert a.status == jobs.FINISHED and a.result.count == 3 and a.result.extra == {"criteria_count_1": "3"}
    assert ids(s.read(int(b.result.group_id))) == [1, 4, 7]
    assert [t[1]["count"] for t in told] == [3, 3] and told[0][0].endswith(f"/cohort/{a.id}/")
    c = jobs.run(parameters(modes.CREATE_DIFF, "g=1,2", base_cohort=int(b.result.group_id)), catalog, s, Config())
    assert ids(s.read(int(c.group_id))) == [1, 2, 4, 5, 7, 8] and c.count == 6


def test_a_failed_job_runs_again_once_but_a_wrong_request_does_not(spark, catalog):
    calls = []

    def fails(*args):
        calls.append(1)
        raise OSError("no connection")

    manager = jobs.JobManager(spark, catalog, None, Config(threads=1), work=fails)
    first = manager.submit(parameters())
    while len(calls) < 2 or manager.job(first.next).status == jobs.STARTED:
        time.sleep(0.05)
    assert first.status == jobs.ERROR and manager.job(first.next).status == jobs.ERROR and not manager.job(first.next).next
    manager = jobs.JobManager(spark, catalog, None, Config(threads=1))
    wrong = manager.submit(parameters(query="unknown=1"))
    manager.wait()
    assert wrong.status == jobs.ERROR and not wrong.next and "unknown" in wrong.message
    for bad in (parameters("other"), parameters(modes.CREATE_DIFF), parameters(modes.CREATE, sampling=2.0)):
        with pytest.raises(RequestError):
            manager.submit(bad)


def test_cancelling(spark, catalog):
    going, stop = threading.Event(), threading.Event()

    def waits(*args):
        going.set()
        stop.wait(10)
        return modes.Result(1)

    manager = jobs.JobManager(spark, catalog, None, Config(threads=1), work=waits)
    a, b = manager.submit(parameters()), manager.submit(parameters())
    going.wait(10)
    manager.cancel(a.id)
    manager.cancel(b.id)
    stop.set()
    manager.wait()
    assert a.status == b.status == jobs.KILLED


def served(handler):
    s = HTTPServer(("127.0.0.1", 0), handler) if isinstance(handler, type) else handler
    threading.Thread(target=s.serve_forever, daemon=True).start()
    return s, f"http://127.0.0.1:{s.server_address[1]}"


def call(url, method="GET", body=None):
    r = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, method=method)
    with urllib.request.urlopen(r, timeout=60) as got:
        return got.status, json.load(got)


def test_server(spark, catalog):
    manager = jobs.JobManager(spark, catalog, None, Config(threads=1))
    s, url = served(server(manager, 0))
    try:
        assert call(f"{url}/health") == (200, {"status": "UP"})
        code, job = call(f"{url}/jobs", "POST", {"cohortDefinitionSyntax": json.dumps(request(leaf(1, "Patient", "g=2"))), "mode": "count"})
        manager.wait()
        assert code == 202 and call(f"{url}/jobs/{job['jobId']}")[1]["count"] == 3
        assert len(call(f"{url}/jobs")[1]) == 1
        with pytest.raises(urllib.error.HTTPError, match="400"):
            call(f"{url}/jobs", "POST", {"mode": "count"})
        with pytest.raises(urllib.error.HTTPError, match="404"):
            call(f"{url}/jobs/none")
    finally:
        s.shutdown()


class Fhir(BaseHTTPRequestHandler):
    """25 encounters in pages; next links hold the offset."""

    def do_GET(self):
        from urllib.parse import parse_qs, urlparse

        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        size, start = int(asked["_count"]), int(asked.get("_offset", 0))
        entries = [{"resource": {"id": str(i), "subject": {"reference": f"Patient/{i % 4}"}, "period": {"start": f"2020-01-{i + 1:02}T00:00:00Z"} if i % 5 else {}}} for i in range(start, min(25, start + size))]
        body = {"resourceType": "Bundle", "total": 25, "entry": entries}
        if start + size < 25 and size:
            body["link"] = [{"relation": "next", "url": f"http://{self.headers['Host']}{urlparse(self.path).path}?_count={size}&_offset={start + size}"}]
        data = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.mark.parametrize("options", [{}, {"offset_parameter": "_offset"}])
def test_search_source_reads_all_pages(spark, options):
    s, url = served(Fhir)
    try:
        mapping = json.dumps({"patient": "subject.reference", "encounter_start_date": "period.start"})
        rows = fhir_rest.search(spark, url, "Encounter", "id long, patient long, encounter_start_date timestamp", "status=finished", mapping=mapping, page_size=10, **options)
        got = sorted(map(tuple, rows.select("id", "patient", F.col("encounter_start_date").isNull()).collect()))
        assert got == [(i, i % 4, i % 5 == 0) for i in range(25)]
        assert fhir_rest.count(url, "Encounter") == 25
        people = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id long, name string")
        joined = fhir_rest.with_reference(rows, people, "patient", ["name"])
        assert joined.count() == 25 and {(r["patient"], r["name"]) for r in joined.collect()} == {(0, None), (1, "x"), (2, "y"), (3, None)}
    finally:
        s.shutdown()


PEOPLE = [{"id": str(i), "active": i != 4, "birthDate": f"19{60 + i}-02-03", "meta": {"security": [{"code": "NOLIST"}] if i == 5 else []}} for i in range(1, 9)]
VISITS = [{"id": str(100 + i), "subject": {"reference": f"Patient/{1 + i % 8}"}, "period": {"start": f"2020-01-{1 + i:02}T00:00:00Z"}, "episodeOfCare": [{"reference": f"EpisodeOfCare/{i % 3}"}]} for i in range(20)]
FINDINGS = [{"id": str(500 + i), "subject": {"reference": f"Patient/{1 + i % 8}"}, **({"encounter": {"reference": f"Encounter/{100 + i % 25}"}} if i % 7 else {}), "status": "final" if i % 3 else "draft", "code": {"coding": [{"code": "ab"[i % 2]}]}} for i in range(60)]


class Hospital(BaseHTTPRequestHandler):
    """Patients, encounters and observations behind a search interface; some requests get an error at first."""

    calls: list[str] = []

    def do_GET(self):
        from urllib.parse import parse_qs, urlparse

        url = urlparse(self.path)
        again = self.path in Hospital.calls
        Hospital.calls.append(self.path)
        if not again and zlib.crc32(url.query.encode()) % 3 == 0:
            self.send_response(503)
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        asked = {k: v[0] for k, v in parse_qs(url.query).items()}
        kind = url.path.strip("/")
        rows = {"Patient": PEOPLE, "Encounter": VISITS, "Observation": FINDINGS}[kind]
        if "_id" in asked:
            rows = [r for r in rows if r["id"] in asked["_id"].split(",")]
        if "_list" in asked:  # list 7: patients 1 to 4
            rows = [r for r in rows if int((r["id"] if kind == "Patient" else r["subject"]["reference"].split("/")[1])) <= 4]
        if "active" in asked:
            rows = [r for r in rows if r["active"]]
        if "_security:not" in asked:
            assert asked["_security:not"].endswith("|NOLIST")
            rows = [r for r in rows if not r["meta"]["security"]]
        if "status" in asked:
            rows = [r for r in rows if r["status"] == asked["status"]]
        if "code" in asked:
            rows = [r for r in rows if r["code"]["coding"][0]["code"] == asked["code"]]
        size, start = int(asked["_count"]), int(asked.get("_offset", 0))
        keep = set(asked["_elements"].split(",")) | {"id"} if "_elements" in asked else None
        page = [{k: v for k, v in r.items() if keep is None or k in keep} for r in rows[start : start + size]]
        body = {"total": len(rows), "entry": [{"resource": r} for r in page]}
        if size and start + size < len(rows):
            more = "&".join(p for p in url.query.split("&") if not p.startswith("_offset"))
            body["link"] = [{"relation": "next", "url": f"http://{self.headers['Host']}{url.path}?{more}&_offset={start + size}"}]
        data = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def hospital():
    from http.server import ThreadingHTTPServer

    Hospital.calls.clear()
    s, url = served(ThreadingHTTPServer(("127.0.0.1", 0), Hospital))
    yield url
    s.shutdown()


def over_tables(spark):
    """The hospital's content as tables."""
    people = spark.createDataFrame([(int(p["id"]), p["birthDate"]) for p in PEOPLE if p["active"] and not p["meta"]["security"]], "id long, birth string")
    visits = [(int(v["id"]), int(v["subject"]["reference"].split("/")[1]), v["period"]["start"][:10], v["episodeOfCare"][0]["reference"].split("/")[1]) for v in VISITS]
    findings = [(int(f["id"]), int(f["subject"]["reference"].split("/")[1]), int(f["encounter"]["reference"].split("/")[1]) if "encounter" in f else None, f["status"], f["code"]["coding"][0]["code"]) for f in FINDINGS]
    visits = spark.createDataFrame(visits, "vid long, vp long, start string, episode string")
    findings = spark.createDataFrame(findings, "id long, p long, e long, status string, code string")
    from cohortsmith.sources.catalog import Lookup

    own = {"encounter_start_date": Field("cast(start as timestamp)", "date", ("visit",)), "episodeOfCare": Field("episode", "string", ("visit",))}
    lookup = {"visit": Lookup(lambda: visits, "e", "vid", "left")}
    return TableCatalog(
        {
            "Patient": Resource(lambda: people, {"id": Field("id", "number"), "patient": Field("id", "number"), "patient_birthdate": Field("cast(birth as date)", "date")}),
            "Encounter": Resource(lambda: visits, {"id": Field("vid", "number"), "encounter": Field("vid", "number"), "patient": Field("vp", "number"), "encounter_start_date": Field("cast(start as timestamp)", "date"), "episodeOfCare": Field("episode")}),
            "Observation": Resource(lambda: findings, {"id": Field("id", "number"), "patient": Field("p", "number"), "encounter": Field("e", "number"), "code": Field("code"), **own}, {"status": Field("status"), "code": Field("code")}, lookup),
        },
        lambda cohorts: spark.createDataFrame([(7, i) for i in range(1, 5)], "cohort long, patient long"),
    )


HOSPITAL_REQUESTS = {
    "filter": leaf(1, "Observation", "status=final&code=a"),
    "everybody": None,
    "exclusion": {"_type": "andGroup", "_id": 0, "isInclusive": True, "criteria": [leaf(1, "Observation", "status=final"), leaf(2, "Observation", "status=draft&code=b", inclusive=False)]},
    "complement": {"_type": "orGroup", "_id": 0, "isInclusive": True, "criteria": [leaf(1, "Observation", "code=a"), leaf(2, "Observation", "status=draft", inclusive=False)]},
    "occurrence": leaf(1, "Observation", "code=a", occurrence={"n": 2, "operator": ">=", "sameEncounter": True}),
    "codes": leaf(1, "Observation", "status=draft", uniqueFields=[{"operator": ">=", "n": 2}]),
    "same encounter": {"_type": "andGroup", "_id": 0, "isInclusive": True, "criteria": [leaf(1, "Observation", "code=a"), leaf(2, "Encounter", "")], "temporalConstraints": [{"idList": "all", "constraintType": "sameEncounter"}]},
    "same episode": {"_type": "andGroup", "_id": 0, "isInclusive": True, "criteria": [leaf(1, "Observation", "code=a&status=draft"), leaf(2, "Observation", "code=b&status=draft")], "temporalConstraints": [{"idList": "all", "constraintType": "sameEpisodeOfCare"}]},
}


@pytest.mark.parametrize("name", HOSPITAL_REQUESTS)
@pytest.mark.parametrize("cohorts", [(), (7,)])
def test_requests_over_a_server_equal_those_over_tables(spark, hospital, name, cohorts):
    from cohortsmith.plans.compile import Compiled
    from cohortsmith.plans.parser import parse

    asked = request(HOSPITAL_REQUESTS[name])
    asked["sourcePopulation"] = {"caresiteCohortList": list(cohorts)}
    catalog = fhir_rest.FhirCatalog(spark, hospital, page_size=7)
    got, told = (ids(Compiled(parse(asked), c.for_cohorts(cohorts)).subjects()) for c in (catalog, over_tables(spark)))
    assert got == told
    assert catalog.for_cohorts(cohorts).count_patients() == (3 if cohorts else 6)
    assert any("_elements=" in c for c in Hospital.calls)


def test_references_are_looked_up_in_chunks(spark, hospital):
    from cohortsmith.plans.model import Leaf

    rows = fhir_rest.FhirCatalog(spark, hospital, page_size=5).scan(Leaf(1, resource="Observation"), ["encounter", "encounter_start_date", "episodeOfCare"])
    got = {(r["patient"], r["encounter"], r["encounter_start_date"] is not None, r["episodeOfCare"]) for r in rows.collect()}
    expected = set()
    for i in range(60):
        k = i % 25 if i % 7 else None
        there = k is not None and k < 20
        expected.add((1 + i % 8, None if k is None else 100 + k, there, str(k % 3) if there else None))
    assert got == expected
    asked = [c for c in Hospital.calls if c.startswith("/Encounter?_id=")]
    assert asked and all(len(c.split("_id=")[1].split("&")[0].split(",")) <= 5 for c in asked)


def test_attempts(monkeypatch):
    from cohortsmith.sources import retry

    monkeypatch.setattr(retry.time, "sleep", lambda s: None)
    tried = []

    def fails(error, times):
        def call():
            tried.append(1)
            if len(tried) <= times:
                raise error
            return "fine"

        return call

    assert retry.retried(fails(ConnectionError(), 2)) == "fine" and len(tried) == 3
    for error in (ConnectionError(), ValueError(), urllib.error.HTTPError("u", 404, "no", {}, None)):
        tried.clear()
        with pytest.raises(type(error)):
            retry.retried(fails(error, 9))
        assert len(tried) == (3 if isinstance(error, ConnectionError) else 1)


class SearchServer(BaseHTTPRequestHandler):
    """A collection of documents; posts fail at first."""

    documents: dict[str, dict] = {}
    staged: dict[str, dict] = {}
    failed: list[int] = []

    def _send(self, body, code=200):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        from urllib.parse import parse_qs, urlparse

        asked = parse_qs(urlparse(self.path).query)
        rows = [d for _, d in sorted(SearchServer.documents.items()) if all(str(d.get(f.split(":")[0])) == f.split(":")[1] for f in asked.get("fq", []))]
        n, mark = int(asked["rows"][0]), asked.get("cursorMark", ["*"])[0]
        start = 0 if mark == "*" else int(mark)
        page = [{k: v for k, v in d.items() if k in asked["fl"][0].split(",")} for d in rows[start : start + n]] if n else []
        self._send({"response": {"numFound": len(rows), "docs": page}, "nextCursorMark": str(start + len(page)) if page else mark})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if len(SearchServer.failed) < 2:
            SearchServer.failed.append(1)
            return self._send({}, 500)
        SearchServer.staged |= {d["id"]: d for d in body}
        if "commit=true" in self.path:
            SearchServer.documents |= SearchServer.staged
        self._send({"status": 0})

    def log_message(self, *args):
        pass


def test_cohorts_go_to_a_search_index_and_are_read_from_it(spark):
    from http.server import ThreadingHTTPServer

    from cohortsmith.sources import search_index

    s, url = served(ThreadingHTTPServer(("127.0.0.1", 0), SearchServer))
    try:
        for cohort, n in ((12, 25), (13, 4)):
            search_index.write(store.group_documents(subjects(spark, *range(n)), cohort).repartition(3), url, "groups", rows=4)
        index = search_index.Index(url, "groups")
        assert index.wait(["groupId:12"], 25, 5) and not index.wait(["groupId:12"], 26, 0.1, 0.05)
        rows = search_index.read(spark, url, "groups", "id string, resourceId long, groupId long, resourceType string", ["groupId:12"], rows=10)
        assert sorted(map(tuple, rows.collect())) == sorted((f"12_{i}", i, 12, "Patient") for i in range(25))
        assert search_index.read(spark, url, "groups", "id string, none double", ["groupId:13", "resourceId:2"]).collect() == [("13_2", None)]
    finally:
        s.shutdown()


def test_settings(spark):
    from cohortsmith.sources.registry import catalog_of

    assert Config.load({"COHORTSMITH_THREADS": "3", "COHORTSMITH_CALLBACK_URL": "u", "COHORTSMITH_CACHE": "true"}) == Config(threads=3, callback_url="u", cache=True)
    tables = catalog_of(spark, Config(folder="/f", filter_language="lucene"))
    assert isinstance(tables, TableCatalog) and tables.language == "lucene"
    rest = catalog_of(spark, Config(source="fhir", url="http://x/", page_size=50, source_attempts=9, active_only=False))
    assert (rest.url, rest.page_size, rest.attempts, rest.active_only) == ("http://x", 50, 9, False)
    for wrong in (Config(source="other"), Config(filter_language="other")):
        with pytest.raises(RequestError):
            catalog_of(spark, wrong)


def test_lists_are_handed_over_member_by_member(spark, tmp_path):
    s = store.CohortStore(spark, f"file://{tmp_path}/store")
    cohort = s.create("a")
    s.write(cohort, subjects(spark, 1, 2))
    got = []
    s.put_list(cohort, lambda parts: got.append(json.loads("".join(parts))))
    assert sorted(e["item"]["reference"] for e in got[0]["entry"]) == ["Patient/1", "Patient/2"] and got[0]["title"] == "a"


def test_database_reads_and_loads(spark):
    from cohortsmith.sources.jdbc import Database

    database = Database("jdbc:derby:memory:cohorts;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    rows = spark.createDataFrame([(i, i * 2) for i in range(100)], "ID long, V long")
    database.append(rows.filter("ID < 2"), "T", tasks=1)
    database.append(rows.filter("ID >= 2"), "T", tasks=3)
    assert database.read(spark, "T", ("ID", 0, 100, 4)).count() == 100
    assert database.read(spark, "(SELECT V FROM T WHERE ID = 7) q").first()[0] == 14


def test_a_load_that_breaks_off_goes_on_with_what_is_missing(spark):
    from cohortsmith.sources.jdbc import loaded

    there, calls = [1, 2], []

    def write(df):
        calls.append(ids(df))
        if len(calls) == 1:
            there.append(3)
            raise OSError("connection lost")

    loaded(subjects(spark, 1, 2, 3, 4, 5), write, lambda: subjects(spark, *there), "subject_id")
    assert calls == [[1, 2, 3, 4, 5], [4, 5]]


def test_results_are_kept_by_what_was_asked(spark):
    from cohortsmith.cache import ResultCache

    cache = ResultCache(spark)
    a, b = cache.name({"x": 1, "y": 2}, [2, 1], "me.too"), cache.name({"y": 2, "x": 1}, [1, 2], "me.too")
    assert a == b != cache.name({"x": 1}, [1, 2], "me.too") and cache.get(a) is None
    cache.put(a, subjects(spark, 1, 2))
    assert ids(cache.get(a)) == [1, 2] and cache.purge() == 1 and cache.get(a) is None
