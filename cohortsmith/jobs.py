"""Runs requests as jobs: a pool, statuses, cancelling, another attempt after a failure, and a callback."""

from __future__ import annotations

import json
import threading
import traceback
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from . import modes
from .cache import ResultCache
from .config import Config
from .plans.compile import Compiled
from .plans.model import PATIENT, RequestError
from .plans.parser import parse
from .sources.catalog import Catalog
from .store import CohortStore

PENDING, STARTED, FINISHED, ERROR, KILLED = "PENDING", "STARTED", "FINISHED", "ERROR", "KILLED"


@dataclass
class Parameters:
    """A job's input."""

    request: str | dict
    mode: str = modes.COUNT
    details: str = ""
    sampling: float | None = None
    base_cohort: int | None = None
    existing_cohort: int | None = None
    name: str = "Unnamed Cohort"
    description: str = ""
    owner: str = "0"
    callback_url: str = ""
    callback_path: str = ""

    @classmethod
    def from_json(cls, data: dict) -> Parameters:
        """A job as clients post it: the request as text or object, options under modeOptions."""
        options = data.get("modeOptions") or {}
        syntax = data.get("cohortDefinitionSyntax")
        if syntax is None:
            raise RequestError("cohortDefinitionSyntax is missing")
        share, base, existing = options.get("sampling"), options.get("baseCohortId"), data.get("existingCohortId")
        return cls(
            syntax, data.get("mode", modes.COUNT), options.get("details") or "", None if share in (None, "") else float(share), None if base in (None, "") else int(base), None if existing in (None, "") else int(existing),
            data.get("cohortDefinitionName") or "Unnamed Cohort", data.get("cohortDefinitionDescription") or "", str(data.get("ownerEntityId") or "0"), data.get("callbackUrl") or "", data.get("callbackPath") or "",
        )

    def check(self) -> None:
        if self.mode not in modes.MODES:
            raise RequestError(f"unknown mode {self.mode!r}")
        if self.sampling is not None and not 0 < self.sampling <= 1:
            raise RequestError("sampling must be above 0 and at most 1")
        if self.mode == modes.CREATE_DIFF and self.base_cohort is None:
            raise RequestError("create_diff needs a base cohort")
        if self.mode == modes.CREATE_DIFF and self.sampling is not None:
            raise RequestError("create_diff cannot sample")


@dataclass
class Job:
    id: str
    mode: str
    status: str = PENDING
    result: modes.Result | None = None
    message: str = ""
    stack: str = ""
    started: str = ""
    ended: str = ""
    attempt: int = 1
    #: The job that tries again.
    next: str = ""

    def summary(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("result", "stack")} | {"count": self.result.count if self.result else None}

    def callback(self) -> dict:
        r = self.result or modes.Result()
        return {"request_job_id": self.id, "request_job_status": self.status.lower(), "_type": "create" if self.mode.startswith("create") else "count", "message": self.message or self.status, "group.id": r.group_id, "count": r.count, "extra": r.extra, "stack": self.stack}


def callback_url(parameters: Parameters, job: str, base: str) -> str:
    """The URL given, else the path given on the configured host, else a path made of the job's id."""
    if parameters.callback_url:
        return parameters.callback_url
    if not base:
        return ""
    return f"{base.rstrip('/')}/{(parameters.callback_path or f'cohort/{job}').strip('/')}/"


def patch(url: str, body: dict) -> None:
    data = json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}, method="PATCH"), timeout=30) as r:
        r.read()


def run(parameters: Parameters, catalog: Catalog, store: CohortStore | None, config: Config, cache: ResultCache | None = None) -> modes.Result:
    """One job, here and now."""
    parameters.check()
    asked = parse(parameters.request)
    compiled = Compiled(asked, catalog.for_cohorts(asked.cohorts), cache=cache)
    if not parameters.mode.startswith("create"):
        return modes.count(compiled, parameters.mode, parameters.details)
    if store is None:
        raise RequestError("creating cohorts needs a store")
    if asked.root is None and asked.resource != PATIENT:
        raise RequestError("a request without criteria can only be for patients")
    new = compiled.subjects()
    if parameters.sampling is not None:
        new = modes.sample(new, parameters.sampling)
    new = new.persist()
    try:
        n = new.count()
        late = n > config.cohort_limit and asked.resource == PATIENT
        cohort = parameters.existing_cohort or store.create(parameters.name, parameters.description, parameters.owner, asked.resource, n, parameters.base_cohort if parameters.mode == modes.CREATE_DIFF else None, late)
        rows = modes.difference(store.read(parameters.base_cohort), new) if parameters.mode == modes.CREATE_DIFF else new
        store.write(cohort, rows, asked.cohorts, size=n)
    finally:
        new.unpersist()
    return modes.Result(n, str(cohort))


class JobManager:
    """Jobs on a pool of threads; each is a Spark job group of its own."""

    def __init__(self, spark: SparkSession, catalog: Catalog, store: CohortStore | None = None, config: Config | None = None, work: Callable = run, notify: Callable[[str, dict], None] = patch):
        self.spark, self.catalog, self.store, self.config = spark, catalog, store, config or Config.load()
        self.work, self.notify = work, notify
        self.pool = ThreadPoolExecutor(self.config.threads)
        self.jobs: dict[str, Job] = {}
        self.caches: dict[str, ResultCache] = {}
        self.lock = threading.Lock()

    def submit(self, parameters: Parameters) -> Job:
        parameters.check()
        return self._queue(parameters, 1)

    def _queue(self, parameters: Parameters, attempt: int) -> Job:
        job = Job(str(uuid.uuid4()), parameters.mode, attempt=attempt)
        with self.lock:
            self.jobs[job.id] = job
            over = [j.id for j in self.jobs.values() if j.ended][: max(0, len(self.jobs) - self.config.kept_jobs)]
            for name in over:  # the oldest that have ended
                del self.jobs[name]
        self.pool.submit(self._run, job, parameters)
        return job

    def _run(self, job: Job, parameters: Parameters) -> None:
        with self.lock:
            if job.status == KILLED:
                return
            job.status, job.started = STARTED, _now()
        self.spark.sparkContext.setJobGroup(job.id, job.mode, True)
        wrong = False
        try:
            more = (self._cache(parameters.owner),) if self.config.cache else ()
            result, status, message, stack = self.work(parameters, self.catalog, self.store, self.config, *more), FINISHED, "", ""
        except Exception as e:
            wrong = isinstance(e, RequestError)
            result, status, message, stack = None, ERROR, str(e), traceback.format_exc()
        with self.lock:
            if job.status == KILLED:
                status = KILLED
            job.status, job.result, job.message, job.stack, job.ended = status, result, message, stack, _now()
        # a request that is wrong stays wrong; anything else may work the next time
        if status == ERROR and job.attempt < self.config.attempts and not wrong:
            job.next = self._queue(parameters, job.attempt + 1).id
            return
        url = callback_url(parameters, job.id, self.config.callback_url)
        if url:
            try:
                self.notify(url, job.callback())
            except OSError as e:
                job.message = f"{job.message} (callback failed: {e})".strip()

    def _cache(self, user: str) -> ResultCache:
        """The results kept for a user."""
        with self.lock:
            return self.caches.setdefault(user, ResultCache(self.spark, user, self.config.cached))

    def job(self, name: str) -> Job | None:
        return self.jobs.get(name)

    def list(self) -> list[Job]:
        return list(self.jobs.values())

    def cancel(self, name: str) -> Job | None:
        job = self.jobs.get(name)
        if job and job.status in (PENDING, STARTED):
            with self.lock:
                job.status = KILLED
            self.spark.sparkContext.cancelJobGroup(name)
        return job

    def wait(self) -> None:
        """Until all that is queued has run."""
        self.pool.shutdown(wait=True)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()

