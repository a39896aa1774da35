"""The corpus pipeline: quality rules, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a table that
is written as Parquet in the shared folder and read again as the next stage's docs. All but the last
return the columns of documents, whatever their names: apart from doc_id and text they travel inside one column, so
that no name can clash. In every stage null ids and texts, empty texts, repeated rows, very long texts and an
empty table have the result that its operator defines; stages 3 and 4 leave one row of rows equal in
doc_id and text, and the other rows of a null or repeated doc_id as documents of their own.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortsmith.llm import jaccard_join, language_id, packing, quality_rules, suffix_dedup
from cohortsmith.llm._common import keyed, named, remove, shared_path, table, tables_made, written
from cohortsmith.shipping import ship

#: A prediction below this is no decision between languages.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of stages whose results may not be written yet.
_held: list[str] = []


def _stage(work: Stage) -> Stage:
    """A stage's result is written before the next one begins, so that its working tables can go then, unless docs still reads them."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        _release(spark, docs.inputFiles() if _held else [])
        with tables_made() as made:
            out = work(spark, docs, sf_dir)
        _held.extend(made)
        return out

    return stage


def _release(spark: SparkSession, read: list[str] = ()) -> None:
    used = {p for p in _held if any(os.path.basename(p) in f for f in read)}
    for path in _held:
        if path not in used:
            remove(spark, path)
    _held[:] = [p for p in _held if p in used]


def _name(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): rest holds all other columns."""
    others = [F.col(_name(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("rest"))


def unpacked(out: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """Rows of carried(docs) with docs' columns again."""
    own = {c: F.col(c) if c in ("doc_id", "text") else changed.get(c, F.col("rest").getField(c)) for c in docs.columns}
    return out.select(*(v.cast(docs.schema[c].dataType).alias(c) for c, v in own.items()))


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs; a null or empty text does not. Each row is judged by itself.

    Every text is counted once: the counts are written beside the rows, and both the fit and the verdicts read them.
    """
    counted = written(quality_rules.counted(carried(docs)), "counted")
    model = quality_rules.fit(counted.select("doc_id", "_q"), table(spark, sf_dir, "labels"), pooled=True)
    return unpacked(counted.filter(quality_rules.verdict(model, F.col("_q"))["kept"]), docs)


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: not `und` (null, empty, or without a letter), and not undecided between two. With no labels to learn from, those with a letter."""
    model = language_id.fit(docs)
    if not model["languages"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.predicted(carried(docs), model, ("language", "score"))
    return unpacked(found.filter((F.col("language") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id (null first). Null or empty texts are nobody's duplicates."""
    texts, names = keyed(carried(docs), "rest")
    kept = jaccard_join.linked_keys(texts.select("_id", "_text")).filter("_id = class").select("_id")
    return unpacked(named(texts.join(kept, "_id", "left_semi"), names).withColumnRenamed("_text", "text"), docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that occur earlier; one of which nothing is left goes, and so does one with a null or empty text. n_chars follows the text."""
    texts, names = keyed(carried(docs), "rest")
    kept = suffix_dedup.kept_of(texts.select("_id", "_text")).select("_id", "text").filter("text != ''")
    return unpacked(named(texts.drop("_text").join(kept, "_id"), names), docs, n_chars=F.length("text"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, in batches of optimal length buckets: a row for each batch, with lists of its doc_ids. Null and empty texts are listed without ids."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: The language model's sums and the chosen paths are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's input and working tables are removed once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    _release(spark)
    return docs
