"""Sources by name: what a job's resources are read from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..config import Config
from ..plans.model import RequestError
from ..store import CohortStore
from .catalog import Catalog
from .fhir_rest import FhirCatalog
from .tables import star_catalog


def _tables(spark: SparkSession, config: Config, store: CohortStore | None) -> Catalog:
    catalog = star_catalog(spark, config.folder, store.members if store else None)
    catalog.language, catalog.default_filter = config.filter_language, config.default_filter
    return catalog


def _fhir(spark: SparkSession, config: Config, store: CohortStore | None) -> Catalog:
    return FhirCatalog(spark, config.url, token=config.token, page_size=config.page_size, attempts=config.source_attempts, active_only=config.active_only)


SOURCES: dict[str, Callable[[SparkSession, Config, CohortStore | None], Catalog]] = {"tables": _tables, "fhir": _fhir}


def catalog_of(spark: SparkSession, config: Config, store: CohortStore | None = None) -> Catalog:
    """The catalog of the source that the settings name. An unknown name or filter language is an error."""
    if config.source not in SOURCES:
        raise RequestError(f"unknown source {config.source!r}")
    if config.filter_language not in ("fhir", "lucene"):
        raise RequestError(f"unknown filter language {config.filter_language!r}")
    return SOURCES[config.source](spark, config, store)
