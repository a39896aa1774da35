"""Set operators on subjects: each takes and gives DataFrames (subject), each subject once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Occurrence
from .leaf import holds


def all_of(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "subject", "left_semi"), sets)


def any_of(sets: list[DataFrame]) -> DataFrame:
    return sets[0] if len(sets) == 1 else reduce(DataFrame.union, sets).distinct()


def n_among(sets: list[DataFrame], asked: Occurrence) -> DataFrame:
    """Subjects in as many sets as asked; a subject in none of them never counts."""
    return reduce(DataFrame.unionAll, sets).groupBy("subject").agg(F.count(F.lit(1)).alias("_n")).filter(holds(F.col("_n"), asked.operator, asked.n)).select("subject")


def without(subjects: DataFrame, excluded: list[DataFrame]) -> DataFrame:
    """One anti join, whatever the number of exclusions."""
    return subjects.join(reduce(DataFrame.union, excluded), "subject", "left_anti") if excluded else subjects


def flags(tagged: list[DataFrame], n: int) -> DataFrame:
    """(subject, f0 .. f<n-1>) from (subject, k): one shuffle for all sets; rows may repeat, the partial aggregation folds them where they are."""
    rows = reduce(DataFrame.unionAll, tagged)
    return rows.groupBy("subject").agg(*(F.max(F.col("k") == k).alias(f"f{k}") for k in range(n)))


def n_flags(values: list[Column], asked: Occurrence) -> Column:
    count = reduce(lambda a, b: a + b, (v.cast("int") for v in values))
    return (count > 0) & holds(count, asked.operator, asked.n)
