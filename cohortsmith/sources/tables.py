"""The star schema's tables as resources: customers are patients, orders encounters, their items observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.filters import Field
from .catalog import Lookup, Resource, TableCatalog, codes_of


def star_catalog(spark: SparkSession, folder: str, cohort_items: Callable[[tuple[int, ...]], DataFrame] | None = None, cohorts=()) -> TableCatalog:
    """Resources over the Parquet tables of a folder. Lookups are joined only where a request needs one of their columns."""

    def table(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{folder}/{name}.parquet")

    def fields(kind: str, *names: str, lookups: tuple[str, ...] = ()) -> dict[str, Field]:
        return {n: Field(n, kind, lookups) for n in names}

    birth = Field("date_add(date'1940-01-01', cast((c_custkey * 37) % 20000 as int))", "date")
    patient = Resource(
        table("customer"),
        {"id": Field("c_custkey", "number"), "patient": Field("c_custkey", "number"), "patient_birthdate": birth, "organizations": Field("array(cast(c_nationkey as bigint), cast(100 + n_regionkey as bigint))", "list", ("nation",))},
        {**fields("string", "c_name", "c_mktsegment"), **fields("number", "c_custkey", "c_nationkey", "c_acctbal")},
        {"nation": Lookup(table("nation"), "c_nationkey", "n_nationkey")},
    )
    period = {"encounter_start_date": Field("o_orderdate", "date", ("orders",)), "encounter_end_date": Field("o_orderdate + make_dt_interval(cast(o_orderkey % 7 as int))", "date", ("orders",))}
    episode = Field("cast(o_custkey * 10000 + year(o_orderdate) as string)", "string", ("orders",))
    encounter = Resource(
        table("orders"),
        {
            "id": Field("o_orderkey", "number"), "encounter": Field("o_orderkey", "number"), "patient": Field("o_custkey", "number"), "episodeOfCare": Field(episode.expr),
            "patient_birthdate": Field("date_add(date'1940-01-01', cast((o_custkey * 37) % 20000 as int))", "date"), **{k: Field(f.expr, "date") for k, f in period.items()},
            "organizations": Field("array(cast(c_nationkey as bigint), cast(100 + n_regionkey as bigint))", "list", ("customer", "nation")),
        },
        {"class": Field("o_orderpriority"), "status": Field("o_orderstatus"), **fields("string", "o_orderpriority", "o_orderstatus"), **fields("number", "o_totalprice"), **fields("date", "o_orderdate")},
        {"customer": Lookup(table("customer"), "o_custkey", "c_custkey"), "nation": Lookup(table("nation"), "c_nationkey", "n_nationkey", after=("customer",))},
    )
    item = Resource(
        table("lineitem"),
        {
            "encounter": Field("l_orderkey", "number"), "patient": Field("o_custkey", "number", ("orders",)), "episodeOfCare": episode, **period, "event_date": Field("l_shipdate", "date"),
            "code": Field("p_brand", "string", ("part",)), "patient_birthdate": Field("date_add(date'1940-01-01', cast((o_custkey * 37) % 20000 as int))", "date", ("orders",)),
        },
        {
            **fields("string", "l_returnflag", "l_linestatus"), **fields("number", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"), **fields("date", "l_shipdate"),
            **fields("string", "p_name", "p_brand", "p_type", lookups=("part",)), **fields("number", "p_size", lookups=("part",)),
        },
        {"orders": Lookup(table("orders"), "l_orderkey", "o_orderkey"), "part": Lookup(table("part"), "l_partkey", "p_partkey")},
    )
    study = Resource(
        item.table,
        {**item.columns, "id": Field("l_orderkey", "number")},
        item.fields,
        item.lookups,
        one_per="id",
    )
    #: Items coded by two columns.
    claim = Resource(item.table, item.columns | {"code": codes_of(Field("p_brand", "string", ("part",)), Field("l_linestatus"))}, item.fields, item.lookups)
    event = Resource(
        table("events"),
        {"id": Field("event_id", "number"), "patient": Field("user_id", "number"), "event_date": Field("ts", "date"), "code": Field("event_type")},
        {**fields("string", "event_type"), **fields("number", "value"), **fields("text", "props")},
    )
    #: The same without the dates of its smallest values: what missing dates look like.
    undated = Resource(event.table, event.columns | {"event_date": Field("case when value >= 3 then ts end", "date")}, event.fields)
    return TableCatalog({"Patient": patient, "Encounter": encounter, "Observation": item, "ImagingStudy": study, "Claim": claim, "Event": event, "UndatedEvent": undated}, cohort_items, cohorts)
