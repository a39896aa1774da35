"""Serves jobs over HTTP: `python -m cohortsmith`, with the settings of config."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .config import Config
from .jobs import JobManager
from .server import server
from .shipping import ship
from .sources.registry import catalog_of
from .store import CohortStore


def main() -> None:
    config = Config.load()
    spark = SparkSession.builder.appName("cohortsmith").getOrCreate()
    ship(spark)
    store = CohortStore(spark, config.store) if config.store else None
    manager = JobManager(spark, catalog_of(spark, config, store), store, config)
    server(manager, config.port).serve_forever()


if __name__ == "__main__":
    main()
