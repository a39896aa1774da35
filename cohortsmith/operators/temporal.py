"""Temporal relations between rows of criteria: (subject, encounter, episodeOfCare, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leaf import same


def same_key(rows: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first whose subject and key all others have too; a null key equals a null key."""
    out = rows[0]
    for other in rows[1:]:
        found = other.select("subject", key).distinct()
        out = out.join(found, same(out, found, ["subject", key]), "left_semi")
    return out


def different_key(rows: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first for which every other has a row of the same subject with another key (nulls are no keys).

    A smallest and a largest key for each subject decide: one of them differs unless both are equal to it.
    """
    out = rows[0].filter(F.col(key).isNotNull())
    for other in rows[1:]:
        ends = other.filter(F.col(key).isNotNull()).groupBy("subject").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
        out = out.join(ends, "subject").filter((F.col(key) != F.col("_low")) | (F.col(key) != F.col("_high"))).drop("_low", "_high")
    return out


def ordered(times: list[DataFrame], least: int, most: int | None, admits_null: list[bool]) -> DataFrame:
    """(subject) of subjects with a row in every frame (subject, t) so that each next t is least to most seconds later.

    A missing t in a frame that admits nulls satisfies all pairs; it is enough that the subject has rows
    in all frames then. Otherwise only the times that can be reached matter: without an upper bound the
    earliest one of a subject, with one those in the reach of an earlier row, found by an equi join on
    buckets as wide as the reach.
    """
    reach = times[0].filter("t is not null").select("subject", "t")
    for k, nxt in enumerate(times[1:], 1):
        ahead = nxt.filter("t is not null").select("subject", "t")
        if most is None:
            first = reach.groupBy("subject").agg(F.min("t").alias("_first"))
            if k == len(times) - 1:  # the latest time decides, so that subjects are held and joined, not all their times
                ahead = ahead.groupBy("subject").agg(F.max("t").alias("t"))
            reach = ahead.join(first, "subject").filter(F.col("t") >= F.col("_first") + F.make_dt_interval(secs=F.lit(least))).select("subject", "t")
        elif most < least:
            reach = ahead.limit(0)
        else:
            reach, ahead = reach.distinct(), ahead.distinct()
            width = max(1, most - least)
            second = lambda c: F.unix_micros(F.col(c))
            bucket = lambda c, plus: F.floor((second(c) + plus * 1_000_000) / (width * 1_000_000))
            spans = reach.select("subject", F.col("t").alias("_t"), F.explode(F.sequence(bucket("t", least), bucket("t", most))).alias("_b"))
            ahead = ahead.withColumn("_b", bucket("t", 0))
            later = second("t") - second("_t")
            on = (ahead["subject"] == spans["subject"]) & (ahead["_b"] == spans["_b"]) & later.between(least * 1_000_000, most * 1_000_000)
            reach = ahead.join(spans, on, "left_semi").select("subject", "t")
    found = reach.select("subject").distinct()
    missing = [t.filter("t is null").select("subject") for t, admits in zip(times, admits_null, strict=True) if admits]
    if missing:
        some = missing[0]
        for m in missing[1:]:
            some = some.union(m)
        some = some.distinct()
        for t in times:
            some = some.join(t.select("subject"), "subject", "left_semi")
        found = found.union(some).distinct()
    return found
