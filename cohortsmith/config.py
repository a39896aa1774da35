"""Settings, from environment variables with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Each field can be set by COHORTSMITH_<FIELD>."""

    port: int = 8090
    threads: int = 20
    #: Members up to which a cohort counts as small.
    cohort_limit: int = 20_000
    #: Attempts at a job that fails.
    attempts: int = 2
    callback_url: str = ""
    #: Finished jobs that are remembered.
    kept_jobs: int = 1000
    #: Where resources come from, see sources.registry; a folder of tables, or a server's URL and token.
    source: str = "tables"
    folder: str = ""
    #: Folder of the cohort store, shared by all executors; without one, jobs can only count.
    store: str = ""
    url: str = ""
    token: str = ""
    filter_language: str = "fhir"
    #: FHIR filter of the patients that belong to the population of tables.
    default_filter: str = ""
    #: Entries of a page, and attempts at a page or a table.
    page_size: int = 1000
    source_attempts: int = 3
    #: Whether only active patients belong to a server's population.
    active_only: bool = True
    #: Whether results of criteria are kept on disk for the next request, and how many.
    cache: bool = False
    cached: int = 200

    @classmethod
    def load(cls, env=os.environ) -> Config:
        given = {f.name: env.get(f"COHORTSMITH_{f.name.upper()}") for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        read = lambda kind, text: text.lower() in ("1", "true", "yes") if kind is bool else kind(text)
        return cls(**{k: read(kinds[k], v) for k, v in given.items() if v is not None})
