"""Packing by optimal length buckets.

Texts become token ids, cut into sequences of at most MAX_TOKENS (nothing is lost). The global histogram of
sequence lengths, at most MAX_TOKENS numbers, goes to the driver, where dynamic programming finds the bucket
boundaries that minimise padding. Inside a bucket sequences, ordered by length, are dealt into batches of the
token budget: a batch is a row with its sequences' ids, padded to the bucket's bound, and where they come from. A
bucket with many sequences is dealt as several shards, each with batches of its own, so that no task has to order them all.
Tasks read their shards in sorted order and hold one batch at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, keyed, text_bytes, tidy, written
from .token_store import encoder_of, width

MAX_TOKENS, BUCKETS, BUDGET = 4096, 16, 65_536
#: What fills a sequence up to its bucket's bound.
PAD_ID = 0
#: Tokens of a bucket that one shard holds, on average, and the most partitions that shards are dealt to.
SHARD, MOST = 1 << 22, 20_000
#: Documents without tokens that share a row.
_EMPTY = 4096


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least padding; the last is the greatest length.

    best[k][j]: the least padding of the first j lengths in k buckets; the first of equal choices wins.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    before = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    n, far = len(lengths), np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    chosen, totals = [], []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (before[j] - before[:j]) - (tokens[j] - tokens[:j])
            cut[j] = cost.argmin()
            new[j] = cost[cut[j]]
        chosen.append(cut)
        totals.append(int(new[n]))
        best = new
    k, j, out = int(np.argmin(totals)), n, []
    while j:
        out.append(int(lengths[j - 1]))
        j = int(chosen[k][j])
        k -= 1
    return out[::-1]


def padding(histogram: dict[int, int], bounds: list[int]) -> int:
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


_PIECES = "_id long, doc_id long, n_tokens long, piece long, start long, length long, ids binary"
_PIECES_ARROW = pa.schema([*((c, pa.int64()) for c in ("_id", "doc_id", "n_tokens", "piece", "start", "length")), ("ids", pa.binary())])


def _cut(tokenizer: str, most: int):
    """(_id, _text, name) -> the sequences of each text: _PIECES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(tokenizer)
        w = encode.width
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            keys, names = batch.column("_id").to_pylist(), batch.column("name").to_pylist()
            for i, j in blocks(at, 1 << 20):
                rows = []
                for k, ids in zip(range(i, j), encode([data[at[k] : at[k + 1]].tobytes() for k in range(i, j)]), strict=True):
                    n = len(ids) // w
                    rows += [(keys[k], names[k], n, p, p * most, min(most, n - p * most), ids[p * most * w : (p + 1) * most * w]) for p in range(max(1, -(-n // most)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return cut


_LISTS = ("doc_ids", "totals", "pieces", "starts", "lengths")
_BATCHES = "bucket long, shard long, batch long, n long, padding long, " + ", ".join(f"{c} array<long>" for c in _LISTS) + ", ids binary"
_BATCHES_ARROW = pa.schema([*((c, pa.int64()) for c in ("bucket", "shard", "batch", "n", "padding")), *((c, pa.list_(pa.int64())) for c in _LISTS), ("ids", pa.binary())])


def _filled(budget: int, w: int, pad_id: int):
    """Sequences sorted by bucket, shard, length, _id and piece -> batches."""
    pad = np.array([pad_id], f"<u{w}").tobytes()

    def row(bucket, shard, batch, held):
        ids = b"".join([x[-1] + pad * (bucket - x[4]) for x in held]) if bucket else b""
        return (bucket, shard, batch, len(held), len(ids) // w - sum(x[4] for x in held), *([x[k] for x in held] for k in range(5)), ids)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BATCHES_ARROW, strict=True)], schema=_BATCHES_ARROW)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, rows = None, 0, [], []
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                columns = [batch.column(c).slice(i, 512).to_pylist() for c in ("bucket", "shard", "doc_id", "n_tokens", "piece", "start", "length", "ids")]
                for bucket, shard, *x in zip(*columns, strict=True):
                    most = max(1, budget // bucket) if bucket else _EMPTY
                    if held and ((bucket, shard) != at or len(held) == most):
                        rows.append(row(*at, number, held))
                        number, held = number + 1 if (bucket, shard) == at else 0, []
                    at = (bucket, shard)
                    held.append(x)
                if rows:
                    yield out(rows)
                    rows = []
        if held:
            yield out([row(*at, number, held)])

    return fill


def packed(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, pad_id: int = PAD_ID) -> DataFrame:
    """A row for each batch: bucket, shard, batch (its name), n sequences, padding (ids that fill up), lists with an entry for each
    sequence (doc_ids, totals: the document's tokens, pieces, starts, lengths), and ids: n * bucket little-endian integers of
    16 bits, if the tokenizer has at most 65,536 pieces, else of 32.

    bucket is the upper bound of its sequences' lengths; a batch has at most budget // bucket sequences (one at least), in
    order of length, document and piece. Documents without tokens (null or empty text) are listed in batches of bucket 0
    without ids. A text of any length is cut into sequences. Different texts of one doc_id are documents of their own;
    a null doc_id is null in the lists. Other columns are ignored. No documents, no rows.
    """
    if max_tokens < 1 or buckets < 1 or budget < 1:
        raise ValueError("needs positive limits")
    from tokenizers import Tokenizer

    texts, _ = keyed(docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("name")), "name")
    rows = written(texts.mapInArrow(tidy(_cut(tokenizer, max_tokens)), _PIECES), "sequences")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # max_tokens + 1 rows at most
    empty = histogram.pop(0, 0)
    bounds = boundaries(histogram, buckets)
    sizes = [sum(n for x, n in histogram.items() if a < x <= b) for a, b in zip([0, *bounds], bounds, strict=False)]
    shards = [max(1, -(-empty // SHARD)), *(-(-n * b // SHARD) for b, n in zip(bounds, sizes, strict=True))]
    kind = F.struct(F.lit(0).cast("long").alias("bucket"), F.lit(shards[0]).alias("shards"), F.lit(0).cast("long").alias("before"))
    for k, (a, b) in enumerate(zip([0, *bounds], bounds, strict=False)):
        own = F.struct(F.lit(b).cast("long").alias("bucket"), F.lit(shards[k + 1]).alias("shards"), F.lit(sum(shards[: k + 1])).cast("long").alias("before"))
        kind = F.when(F.col("length") > a, own).otherwise(kind)
    dealt = rows.withColumn("kind", kind).withColumn("shard", F.pmod(F.xxhash64("_id", "piece"), F.col("kind.shards")).cast("long"))
    dealt = dealt.withColumn("bucket", F.col("kind.bucket")).withColumn("place", F.pmod(F.col("kind.before") + F.col("shard"), F.lit(MOST)).cast("int"))
    ordered = dealt.repartitionById(min(MOST, sum(shards)), "place").drop("kind", "place").sortWithinPartitions("bucket", "shard", "length", "_id", "piece")
    return ordered.mapInArrow(tidy(_filled(budget, width(Tokenizer.from_file(tokenizer).get_vocab_size()), pad_id)), _BATCHES)


def unpacked(batches: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, piece, start, length, bucket, shard, batch, slot, ids, ids_crc32): a row for each sequence of the batches, read from their ids.

    ids_crc32: of the sequence's ids as little-endian unsigned 32-bit integers. bucket, shard, batch and slot are null for
    documents without tokens.
    """

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                n, bucket, some = r["n"], r["bucket"], bool(r["bucket"])
                w = len(r["ids"]) // (n * bucket) if some else 0
                ids = [r["ids"][w * bucket * k : w * (bucket * k + x)] for k, x in enumerate(r["lengths"])]
                place = [[r[c] if some else None] * n for c in ("bucket", "shard", "batch")]
                crcs = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4")) if x else 0 for x in ids]
                columns = [r["doc_ids"], r["totals"], r["pieces"], r["starts"], r["lengths"], *place, list(range(n)) if some else [None] * n]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary()), pa.array(crcs, pa.int64())], names=names)

    names = ["doc_id", "n_tokens", "piece", "start", "length", "bucket", "shard", "batch", "slot", "ids", "ids_crc32"]
    return batches.mapInArrow(tidy(read), "doc_id long, n_tokens long, piece long, start long, length long, bucket long, shard long, batch long, slot long, ids binary, ids_crc32 long")
