"""Kept results of criteria, by what was asked and for whom."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class ResultCache:
    """DataFrames on the executors' disks as temporary views named by a hash of the criterion, its source population and the user.

    At most `most` are kept, those used last.
    """

    def __init__(self, spark: SparkSession, user: str = "", most: int = 200):
        self.spark, self.user, self.most = spark, user, most
        self.names: OrderedDict[str, None] = OrderedDict()

    def subjects(self, criterion, cohorts, make) -> DataFrame:
        """The subjects of a criterion for a source population: kept ones, or those of make(), which are kept then."""
        name = self.name(_told(criterion), cohorts, self.user)
        kept = self.get(name)
        return self.put(name, make()) if kept is None else kept

    @staticmethod
    def name(criterion: dict, cohorts, user: str) -> str:
        text = json.dumps([criterion, sorted(cohorts)], sort_keys=True, default=str)
        return f"c{hashlib.md5(text.encode()).hexdigest()}_{''.join(c if c.isalnum() else '_' for c in user)}"

    def get(self, name: str) -> DataFrame | None:
        if name not in self.names or not self.spark.catalog.tableExists(name):
            return None
        self.names.move_to_end(name)
        return self.spark.table(name)

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        rows.persist(StorageLevel.DISK_ONLY).createOrReplaceTempView(name)
        self.names[name] = None
        while len(self.names) > self.most:
            self._drop(next(iter(self.names)))
        return self.spark.table(name)

    def _drop(self, name: str) -> None:
        self.spark.table(name).unpersist()
        self.spark.catalog.dropTempView(name)
        del self.names[name]

    def purge(self) -> int:
        """Drops everything that was put; how many there were."""
        n = len(self.names)
        for name in list(self.names):
            self._drop(name)
        return n


def _told(criterion) -> dict:
    """What a criterion says, whatever its own id and exclusion: ids of children stay, since constraints name them."""
    return {"kind": type(criterion).__name__} | {k: v for k, v in asdict(criterion).items() if k not in ("id", "origin", "inclusive")}
