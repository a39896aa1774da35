"""Language identification, words first.

A known word scores by its log frequency in each language; an unseen one falls back to its character
4-grams, if none of those is known to its 3-grams, and so on. The model is a naive Bayes over words;
a document's score is the posterior of the predicted language, with equal priors.

The model is learned from a bounded sample: about `docs_per_language` whole labelled documents of each
language, chosen by a hash of the id, of which it keeps `words_per_language` words and
`grams_per_length` n-grams of each length in each language. Prediction covers every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, distinct_spans, release, text_bytes, tidy

DOCS_PER_LANGUAGE = 2000
WORDS_PER_LANGUAGE = 10_000
GRAMS_PER_LENGTH = 3_000
LONGEST = 4
FOLDS = 5
_CACHE = 150_000


def remainder() -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE, grams_per_length: int = GRAMS_PER_LENGTH) -> dict:
    """{"languages": [...], "words"/"grams": {term: log frequencies}} from text and lang of documents outside the held-out fold."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 0))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return {"languages": [], "words": {}, "grams": {}}
    share = F.element_at(F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n))))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000
    words = labelled.filter(drawn).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("term"))
    words = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    marked = F.concat(F.lit("^"), "term", F.lit("$"))
    grams = words.select("lang", "n", F.lit(0).alias("length"), "term")
    for k in range(1, LONGEST + 1):
        # single letters without the marks
        source, length = (F.col("term"), F.length("term")) if k == 1 else (marked, F.length(marked))
        at = F.when(length >= k, F.sequence(F.lit(1), length - (k - 1))).otherwise(F.array().cast("array<int>"))
        grams = grams.union(words.select("lang", "n", F.lit(k).alias("length"), F.explode(_grams(at, source, k)).alias("term")))
    counts = grams.groupBy("lang", "length", "term").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "length").orderBy(F.desc("n"), "term")
    most = F.when(F.col("length") == 0, words_per_language).otherwise(grams_per_length)
    kept = counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "length"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    languages = sorted(sizes)
    column = {x: i for i, x in enumerate(languages)}
    totals, found = {}, {}
    got = kept.select("lang", "length", "term", "n", "total").toArrow()  # bounded by the parameters
    for lang, length, term, n, total in zip(*(c.to_pylist() for c in got.columns), strict=True):
        totals[lang, length] = total
        found.setdefault((length, term), {})[lang] = n
    del got
    model: dict = {"languages": languages, "words": {}, "grams": {}}
    for (length, term), n in found.items():
        row = np.full(len(languages), 0.0, np.float32)
        for x, i in column.items():
            total = totals.get((x, length), 0)
            row[i] = math.log((n.get(x, 0) + 0.5) / (total + 0.5 * 1000))
        model["grams" if length else "words"][term] = row
    release()
    return model


def _grams(at: Column, source: Column, k: int) -> Column:
    return F.transform(at, lambda i: source.substr(i, F.lit(k)))


#: For each Latin-1 character its lower case, and whether it is a letter.
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256)], np.uint8)
_LETTER = np.array([chr(i).isalpha() for i in range(256)])
#: Bytes of texts that are predicted at a time, or one text.
_BLOCK = 1 << 20


class Predictor:
    """Predicts in a Python worker; remembers the words it has scored, up to a bound.

    Texts of Latin-1 characters are cut into words in numpy, many at a time, and each different word is looked up once;
    other texts go one by one.
    """

    def __init__(self, model: dict):
        import regex

        self.languages = model["languages"]
        self.find = regex.compile(r"\p{L}+").findall
        self.known = len(model["words"])
        width = max(1, len(self.languages))
        self.table = np.zeros((self.known + _CACHE, width), np.float32)
        if self.known:
            self.table[: self.known] = np.stack(list(model["words"].values()))
        self.words = list(model["words"])
        self.gram = {g: i for i, g in enumerate(model["grams"])}
        self.grams = np.stack(list(model["grams"].values())).astype(np.float64) if model["grams"] else np.zeros((0, width))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {w: i for i, w in enumerate(self.words)}
        #: Places of words by the names that distinct_spans() gives them.
        self.named: dict[int | bytes, int] = {}

    def backoff(self, word: str) -> list[int]:
        """The grams that an unseen word scores by, the mean of theirs: its longest known ones."""
        marked, get = f"^{word}$", self.gram.get
        for k in range(LONGEST, 1, -1):
            got = [i for j in range(len(marked) - k + 1) if (i := get(marked[j : j + k])) is not None]
            if got:
                return got
        return [i for c in word if (i := get(c)) is not None]

    def _room(self, more: int) -> None:
        """Makes room for so many unseen words, if need be by forgetting others."""
        if len(self.index) + more > len(self.table):
            self.forget()
            if len(self.index) + more > len(self.table):  # one text with more unseen words than are remembered
                self.table = np.concatenate((self.table, np.zeros((more, self.table.shape[1]), np.float32)))

    def _places(self, words: list[str]) -> list[int]:
        """Where words' scores are; of those unseen so far, too. There must be room for them."""
        index, start = self.index, len(self.index)
        out = [index.setdefault(w, len(index)) for w in words]
        if len(index) > start:
            grams = list(map(self.backoff, islice(index, start, None)))
            count = np.array(list(map(len, grams)))
            some, flat = np.flatnonzero(count), np.array(list(chain.from_iterable(grams)), np.int64)
            self.table[start : len(index)] = 0
            if len(some):
                self.table[start + some] = np.add.reduceat(self.grams[flat], np.cumsum(count[some]) - count[some], axis=0) / count[some, None]
        return out

    def _best(self, total: np.ndarray) -> tuple[str, float]:
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = self.find(text.lower()) if text else []
        if not words or not self.languages:
            return "und", 0.0
        self._room(len(words))
        return self._best(self.table[np.array(self._places(words))].sum(axis=0, dtype=np.float64))

    def _cut(self, texts: list[bytes]) -> list[tuple[str, float]]:
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        low = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        inside = np.diff(np.concatenate(([False], _LETTER[low], [False])).astype(np.int8))
        start, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        out = [("und", 0.0)] * len(texts)
        if not len(start):
            return out
        names, one, place = distinct_spans(low, start, end)
        self._room(len(names))
        rows = list(map(self.named.get, names))
        raw = low.tobytes()
        new = [k for k, i in enumerate(rows) if i is None]
        if new:
            words = [raw[a:b].decode("latin-1") for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
            for k, i in zip(new, self._places(words), strict=True):
                rows[k] = self.named[names[k]] = i
        text = np.searchsorted(at, start, side="right") - 1
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        total = np.add.reduceat(self.table[np.array(rows)[place]], first, axis=0, dtype=np.float64)
        for k, t in zip(text[first].tolist(), total, strict=True):
            out[k] = self._best(t)
        return out

    def many(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """The language and score of each text (UTF-8)."""
        out, plain = [("und", 0.0)] * len(texts), []
        if not self.languages:
            return out
        for i, raw in enumerate(texts):
            if not raw:
                continue
            if raw.isascii():
                plain.append((i, raw))
                continue
            try:
                plain.append((i, raw.decode().encode("latin-1")))
            except UnicodeEncodeError:
                out[i] = self(raw.decode())
        for (i, _), found in zip(plain, self._cut([t for _, t in plain]) if plain else [], strict=True):
            out[i] = found
        return out


def predicted(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns, the predicted language and its score. `und` with score 0 where text is null or has no letter, or nothing was learned.

    A text of any length is read whole, in one task. docs must not have a column of one of the names (ValueError).
    """
    if taken := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"there are columns {sorted(taken)} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    where = columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Predictor(shared.value)
        for batch in batches:
            data, at = text_bytes(batch.column(where).fill_null(""))
            found = [x for i, j in blocks(at, _BLOCK) for x in one.many([data[at[k] : at[k + 1]].tobytes() for k in range(i, j)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*columns, *names])

    return docs.mapInArrow(tidy(predict), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only text is an input of a prediction.

    Rows that repeat an id are predicted each by itself; a null id's fold is that of empty text. Equal scores go to the first
    language by name. Other columns are ignored. No documents, no rows; no labelled ones: every lang_pred is `und`.
    """
    model = fit(docs)
    out = predicted(docs.select("doc_id", "text", (remainder() == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
