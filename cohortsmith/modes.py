"""What a request can be asked for: counts, counts with details, and cohorts."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.compile import Compiled
from .plans.model import RequestError

COUNT, COUNT_ALL, COUNT_WITH_DETAILS, CREATE, CREATE_DIFF = "count", "count_all", "count_with_details", "create", "create_diff"
MODES = (COUNT, COUNT_ALL, COUNT_WITH_DETAILS, CREATE, CREATE_DIFF)


@dataclass
class Result:
    """What a job gives back; extra holds details by name."""

    count: int = -1
    group_id: str = ""
    extra: dict[str, str] = field(default_factory=dict)


def counted(compiled: Compiled) -> DataFrame:
    """(count)."""
    return compiled.subjects().agg(F.count(F.lit(1)).alias("count"))


def stage_counts(compiled: Compiled, ids=None) -> DataFrame:
    """(stage, count) of the given criteria (all): subjects of each; of an exclusive one the population's others. A stage without subjects counts 0."""
    ids = compiled.stage_ids() if ids is None else list(ids)
    found = compiled.stages(ids).groupBy("stage").agg(F.count_distinct("subject").alias("n"))
    return _all_stages(compiled, ids).join(found, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def stage_ratios(compiled: Compiled, ids=None) -> DataFrame:
    """(stage, count, ratio): the subjects of the result that are in the stage, and their share of the result (null if that is empty)."""
    ids = compiled.stage_ids() if ids is None else list(ids)
    result = compiled.subjects().withColumnRenamed("subject_id", "subject")
    found = compiled.stages(ids).join(result, "subject", "left_semi").groupBy("stage").agg(F.count_distinct("subject").alias("n"))
    total = result.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))  # one row
    every = _all_stages(compiled, ids).withColumn("_k", F.lit(1)).join(total, "_k")
    n = F.coalesce("n", F.lit(0))
    return every.join(found, "stage", "left").select("stage", n.cast("long").alias("count"), F.when(F.col("total") > 0, n / F.col("total")).alias("ratio"))


def _all_stages(compiled: Compiled, ids) -> DataFrame:
    spark = compiled.population().sparkSession
    return spark.range(1).select(F.explode(F.array(*(F.lit(int(i)) for i in ids))).alias("stage"))


def organization_counts(compiled: Compiled) -> DataFrame:
    """(organization, count): subjects of the result in each organization."""
    return compiled.organizations().select(F.explode("organization_ids").alias("organization")).groupBy("organization").agg(F.count(F.lit(1)).alias("count"))


def bounds(n: int, draw: random.Random) -> tuple[int, int]:
    """A least and a greatest count around n that hide it: they are 25 to 50 away, and never below 0 or above n."""
    below = range(max(0, n - 50), n - 25) if n > 26 else range(n) if n > 0 else (0,)  # a small count has no 25 below it
    return draw.choice(below), draw.choice(range(n + 25, n + 50))


def parse_details(text: str, compiled: Compiled) -> tuple[list[int], bool]:
    """The criteria to detail, and whether as ratios: `all`, `ratio`, or ids with commas between."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if "ratio" in parts:
        return compiled.stage_ids(), True
    return (compiled.stage_ids() if "all" in parts else [int(p) for p in parts]), False


def count(compiled: Compiled, mode: str = COUNT, details: str = "", seed: int | None = None) -> Result:
    """The count modes' result. The result set is kept while several actions read it."""
    if mode not in (COUNT, COUNT_ALL, COUNT_WITH_DETAILS):
        raise RequestError(f"{mode} does not count")
    extra: dict[str, str] = {}
    if mode == COUNT_WITH_DETAILS:
        kept = compiled.organizations().persist()
        try:
            n = kept.count()
            rows = kept.select(F.explode("organization_ids").alias("o")).groupBy("o").count().collect()  # a row for each organization
        finally:
            kept.unpersist()
        extra |= {str(r["o"]): str(r["count"]) for r in rows}
    else:
        n = counted(compiled).first()["count"]
    if mode == COUNT_ALL:
        low, high = bounds(n, random.Random(seed))
        extra |= {"minimum": str(low), "maximum": str(high)}
    if details:
        ids, ratios = parse_details(details, compiled)
        if ids and ratios:
            extra |= {f"criteria_ratio_{r['stage']}": str(r["ratio"]) for r in stage_ratios(compiled, ids).collect()}
        elif ids:
            extra |= {f"criteria_count_{r['stage']}": str(r["count"]) for r in stage_counts(compiled, ids).collect()}
    return Result(n, extra=extra)


def sample(subjects: DataFrame, share: float, seed: int | None = None) -> DataFrame:
    """Exactly share * count subjects, rounded half up, drawn by a hash of seed and subject (random without one)."""
    if not 0 < share <= 1:
        raise RequestError("sampling must be above 0 and at most 1")
    n = int(share * subjects.count() + 0.5)
    order = F.rand() if seed is None else F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("subject_id").cast("string")))
    return subjects.orderBy(order, "subject_id").limit(n)


def difference(base: DataFrame, new: DataFrame) -> DataFrame:
    """(subject_id, deleted) of subjects in only one of two cohorts (subject_id): deleted ones were in the base."""
    a, b = base.select("subject_id").distinct().withColumn("_a", F.lit(True)), new.select("subject_id").distinct().withColumn("_b", F.lit(True))
    return a.join(b, "subject_id", "full_outer").filter("_a is null or _b is null").select("subject_id", F.col("_b").isNull().alias("deleted"))
