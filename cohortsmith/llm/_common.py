"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id where ids are keys of joins; it sorts before every other id.
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a new local one, which only a local master can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        done = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = done.get() if done.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that lineage ends there and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Spark removes shuffle files and checkpoints that nobody needs any more when the driver collects its garbage, which a driver with little to do may not do for a long time: it does so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The tables that written() made and nobody removed yet.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """As saved(), as a Parquet table in the shared folder, which takes less room; it stays there until the folder is cleared, or whoever asked for tables_made() removes it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables that written() makes inside, known at the end; whoever asks for them removes them."""
    before, out = len(_made), []
    try:
        yield out
    finally:
        out += _made[before:]
        del _made[before:]


def partitions_for(df: DataFrame, each: int) -> int:
    """Partitions of about `each` bytes of df, by the size that the optimizer knows of its sources; the session's shuffle partitions at least."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(known // each, 1_000_000)) if known < 1 << 60 else least  # a plan of unknown size says 2**63 - 1


#: Rows of a key up to which it is never too frequent for one task.
FEW = 1000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts, which have each key once and the number of its rows in column n. Facts are read several times, so they should be saved.

    Frequent keys are those with more rows than half a partition would have if all were even, so that there are at most
    twice as many as partitions. Only their facts are broadcast, and their rows stay where they lie; the rest is joined as usual.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, most = facts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(FEW, total // (2 * parts))
    if most <= limit:
        return rows.join(facts, key, how)
    frequent = facts.filter(F.col(n) > limit)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(facts.filter(F.col(n) <= limit), key, how)
    return rows.join(F.broadcast(frequent), key).select(rest.columns).union(rest)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame | None]:
    """((_id, _text, more...) of every document, and the doc_id of every key); a null text is empty.

    Where no doc_id repeats (found by a pass over the ids alone), it is the key, NULL_ID for a null one, and there
    is no second table. Else rows equal in id and text are one document (of the other columns, those with the
    smallest JSON), and keys count documents up by doc_id (null first) and the hash of the text, in ranges
    that split the rows of a frequent id as well.
    """
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("_text")
    out = docs.select(key, text, *more)
    if not out.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        return out, None
    rows = docs.select(F.col("doc_id").cast("long").alias("_name"), text, *more)
    if more:
        row = F.struct(*more)
        rows = rows.groupBy("_name", "_text").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_name", "_text", "_row.*")
    else:
        rows = rows.distinct()
    order = ("_name", F.xxhash64("_text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text").withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, "documents")
    return rows.select("_id", "_text", *more), rows.select("_id", F.col("_name").alias("doc_id"))


def id_back(column: str = "_id"):
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias("doc_id")


def named(out: DataFrame, names: DataFrame | None, **columns: str) -> DataFrame:
    """out with key columns turned into ids, names as from keyed(); columns: the new name of each, `_id` to doc_id if not given."""
    for key, name in (columns or {"_id": "doc_id"}).items():
        if names is None:
            out = out.withColumn(name, id_back(key)).drop(key)
        else:
            out = out.join(names.select(F.col("_id").alias(key), F.col("doc_id").alias(name)), key).drop(key)
    return out


def tidy(f):
    """f, a generator over batches, that gives its memory back to the system when it ends: workers wait idle beside other stages."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: A 64-bit code for every byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any span of a code sequence, from one prefix sum."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, k: int) -> np.ndarray:
        """The hash of every window of k codes."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column without nulls, and where each value starts and ends."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte sequence."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: For each number of bytes left in a word, the bits of an eight-byte load that are its own.
OWN = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words above these bytes are named one by one.
_LONG_WORD = 64


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of each span of bytes: eight bytes at a time through a keyed finaliser; long spans by BLAKE2.

    Spans of up to eight bytes and the same length have different codes if they differ; for longer ones a
    collision is a chance of 2**-64. Where a result depends on equality, bytes are compared besides.
    """
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(size):
        return out
    loads = eights(data)
    k, at, left = np.arange(len(size)), start, size
    while len(k):
        out[k] = mix(out[k] ^ mix((loads[at] & OWN[np.minimum(left, 8)]) + np.uint64(0xD1342543DE82EF95)))
        go = np.flatnonzero((left > 8) & (size[k] <= _LONG_WORD))
        k, at, left = k[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the data."""
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the same bytes as the span of its length that starts at `other`."""
    size = end - start
    out = other + size <= len(data)
    loads = eights(data)
    k = np.flatnonzero(out & (size > 0))
    done = 0
    while len(k):
        own = OWN[np.minimum(size[k] - done, 8)]
        equal = (loads[start[k] + done] & own) == (loads[other[k] + done] & own)
        out[k[~equal]] = False
        done += 8
        k = k[equal]
        k = k[size[k] > done]
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int | bytes], np.ndarray, np.ndarray]:
    """(names, one, place): of the different spans their names, the index of one such span, and for each span which it is.

    A name is a number for up to seven bytes, else the bytes. Longer spans are brought together by hash and compared.
    """
    size = end - start
    key = (eights(data)[start] & OWN[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56))
    long, top = np.flatnonzero(size > 7), np.uint64(1 << 63)
    key[long] = span_codes(data, start[long], end[long]) | top
    raw = data.tobytes()
    unique, one, place = np.unique(key, return_index=True, return_inverse=True)
    told = one[place[long]]
    if (size[told] != size[long]).any() or not same_spans(data, start[long], end[long], start[told]).all():
        # different spans of equal hash: by their bytes
        seen: dict[bytes, int] = {}
        key[long] = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)], np.uint64) | top
        unique, one, place = np.unique(key, return_index=True, return_inverse=True)
    short = int(np.searchsorted(unique, top))
    return unique[:short].tolist() + [raw[i:j] for i, j in zip(start[one[short:]].tolist(), end[one[short:]].tolist(), strict=True)], one, place


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit code of every word of a byte sequence, with the words' starts and ends."""
    start, end = word_spans(data)
    return span_codes(data, start, end), start, end


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, edges) of the words of texts laid end to end, edges: each text's first word, and the number of all.

    at: where in data each text starts, and the last one's end. No word spans two texts.
    """
    part = data[at[0] : at[-1]]
    start, end = word_spans(part)
    inside = np.unique((at - at[0])[1:-1])
    inside = inside[(inside > 0) & (inside < len(part))]
    k = np.searchsorted(start, inside, side="right") - 1
    crossing = inside[(k >= 0) & (start[k] < inside) & (end[k] > inside)] if len(start) else inside[:0]
    if len(crossing):
        start, end = np.sort(np.concatenate((start, crossing))), np.sort(np.concatenate((end, crossing)))
    edges = np.searchsorted(start, at - at[0])
    edges[-1] = len(start)
    return span_codes(part, start, end), start, end, edges


def grouped(batches: Iterator, column: str, most: int = 1 << 24) -> Iterator:
    """Batches sorted by a column of integers, as tables of whole groups, of about `most` bytes or one group."""
    import pyarrow as pa

    held, size, limit = [], 0, most
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        t = pa.Table.from_batches(held)
        key = t.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
        limit = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def blocks(at: np.ndarray, most: int = 1 << 17):
    """Runs of values (first, last + 1) of about `most` bytes; a longer value is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
