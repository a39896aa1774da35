"""Tables of a database: reading a query or a table, and loading rows in bulk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import absent
from .retry import retried


@dataclass(frozen=True)
class Database:
    """A JDBC URL with its connection properties (user, password, driver)."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, what: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        """A table by name, or a query in brackets. partition: (column, lowest, highest, tasks) reads in parallel."""
        reader = spark.read.format("jdbc").options(url=self.url, dbtable=what, **self.properties)
        if partition:
            column, low, high, n = partition
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
        return retried(reader.load)

    def append(self, rows: DataFrame, table: str, tasks: int = 8, batch: int = 10_000, key: str | None = None) -> None:
        """One connection for each task. key: rows are dealt by it, see dealt_exactly(); else as they lie."""
        (rows.coalesce(tasks) if key is None else dealt_exactly(rows, key, tasks)).write.format("jdbc").options(url=self.url, dbtable=table, batchsize=batch, **self.properties).mode("append").save()

    def load(self, rows: DataFrame, table: str, key: str, tasks: int = 8) -> None:
        """Appends; if that breaks off, appends once more what is not there yet, by key."""
        loaded(rows, lambda df: self.append(df, table, tasks), lambda: self.read(rows.sparkSession, table), key)


def dealt_exactly(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows in n partitions, each key in that with its number modulo n; null keys in the first."""
    return rows.repartitionById(n, F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(n)), F.lit(0)).cast("int"))


def loaded(rows: DataFrame, write: Callable[[DataFrame], None], present: Callable[[], DataFrame], key: str) -> None:
    """Writes rows; after a failure, once more those whose key is not present."""
    try:
        write(rows)
    except Exception:
        write(absent(rows, present(), key))
