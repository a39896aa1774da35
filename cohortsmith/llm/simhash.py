"""SimHash fingerprints, and all pairs of them within a Hamming radius by permuted block tables.

A text's terms are its words and its pairs of neighbouring words. Each term has 128 hash bits and a weight of 1 to 3 that
grows with its bytes, counted as often as it occurs; each bit of the fingerprint is the sign of the terms' weighted
vote. Likeness is the share of equal bits.

Texts with a 5-word Jaccard similarity of 0.8 differ in some 4 to 13 bits (measured, see README), so RADIUS is 13. Two
fingerprints within 13 bits have one of 7 blocks (of 18 or 19 bits) in which 1 bit at most differs. Each block makes a table,
which holds every fingerprint and is looked up with the block's own value and those one bit off; a pair counts in the
first table that finds it, so that `near` finds every pair within the radius exactly once from each side. A table is dealt
by the block's leading bits, more of them as the fingerprints grow in number, and crowded shards are looked up by several tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import blocks, grouped, keyed, mix, named, partitions_for, saved, text_bytes, tidy, words_of
from ._windows import sorted_by

BITS = 128
#: Bits in which near documents may differ.
RADIUS = 13
#: Fingerprints of a shard of a table, on average at most, and in one task; candidates that are compared at once.
SHARD, CANDIDATES = 200_000, 1 << 20
#: Ranges of ids in which documents meet their successor, at most, and the bytes of each; each is read in order by one task.
MOST_RANGES, RANGE_BYTES = 10_000, 1 << 25


#: For each byte its eight bits, the highest first, as the eight bytes of a number: adding such numbers adds bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view("<u8").ravel()
#: Terms whose weights, of 3 at most, add up in a byte.
_ADDED = 64
_SALTS = (np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BE6546B64))


def _votes(out: np.ndarray, total: np.ndarray, terms: np.ndarray, weight: np.ndarray, owner: np.ndarray) -> None:
    """Adds the weighted votes of terms, in order of their texts (owner), to each text's bits and to its sum of weights."""
    if not len(terms):
        return
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(terms)))
    part = np.flatnonzero((np.arange(len(terms)) - np.repeat(first, count)) % _ADDED == 0)
    wide, sums = weight.astype(np.uint64), np.empty((len(part), BITS // 8), np.uint64)
    for half, salt in enumerate(_SALTS):
        names = np.ascontiguousarray(mix(terms ^ salt).view(np.uint8).reshape(-1, 8).T)
        for k in range(8):
            sums[:, 8 * half + k] = np.add.reduceat(_LANES[names[k]] * wide, part)
    out[owner[first]] += np.add.reduceat(sums.view(np.uint8).reshape(len(part), BITS), np.searchsorted(part, first), axis=0, dtype=np.int64)
    total[owner[first]] += np.add.reduceat(weight, first)


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bytes for each text of a batch (its bytes, and where each text starts and the last ends)."""
    out = np.zeros((len(at) - 1, BITS // 8), np.uint8)
    for i, j in blocks(at):
        codes, start, end, edges = words_of(data, at[i : j + 1])
        if not len(codes):
            continue
        text = np.searchsorted(edges, np.arange(len(codes)), side="right") - 1
        size = end - start
        pair = np.flatnonzero(text[1:] == text[:-1])
        both = size[pair] + size[pair + 1]
        votes, total = np.zeros((j - i, BITS), np.int64), np.zeros(j - i, np.int64)
        _votes(votes, total, mix(codes + np.uint64(7)), 1 + (size >= 5) + (size >= 8), text)
        _votes(votes, total, mix(codes[pair] * np.uint64(3) ^ mix(codes[pair + 1])), 1 + (both >= 8) + (both >= 14), text[pair])
        out[i:j] = np.packbits(2 * votes > total[:, None], axis=1)
    return out


def _of(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    return fingerprints(np.frombuffer(b"".join(raw), np.uint8), at)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - _ONES[a ^ b].sum(axis=-1, dtype=np.int64) / BITS


def edited(text: str, following: str) -> str:
    """The last half of the text's code points (rounded down), replaced by the first as many of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds a value has reached; a step of some hundred, then one by one."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    reached = lambda array: F.size(F.filter(array, lambda b: b <= value))
    row = lambda values: F.array(*(F.lit(b).cast("long") for b in values))
    whole = reached(row([p[-1] for p in parts]))
    return (F.least(whole * step, F.lit(len(bounds))) + F.coalesce(reached(F.get(F.array(*(row(p) for p in parts)), whole)), F.lit(0))).cast("int")


def followed(docs: DataFrame) -> DataFrame:
    """docs (_id, _text) dealt so that a partition has runs of documents, by descending id, each run's last row only the next of the one before.

    Columns: range, guest (1: belongs to another range), _id, _text; sorted by range, guest, descending _id. A range is a
    partition; there are more of them as the input grows.
    """
    n = min(MOST_RANGES, partitions_for(docs, RANGE_BYTES))
    bounds = sorted({int(b) for b in docs.select("_id").approxQuantile("_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    place = _below(F.col("_id"), bounds)
    ranges = docs.select(place.alias("range"), "_id").groupBy("range").agg(F.max("_id").alias("top")).orderBy("range").collect()  # a row for each range
    out = F.array(F.struct(place.alias("range"), F.lit(0).alias("guest")))
    if ranges:
        # the largest id of a range follows the smallest of the range above; the largest of all follows the smallest
        to = {r["top"]: ranges[(i + 1) % len(ranges)]["range"] for i, r in enumerate(ranges)}
        target = F.element_at(F.create_map(*(F.lit(x).cast(t) for k, v in to.items() for x, t in ((k, "long"), (v, "int")))), F.col("_id"))
        out = F.when(F.col("_id").isin(list(to)), F.array(F.struct(place.alias("range"), F.lit(0).alias("guest")), F.struct(target.alias("range"), F.lit(1).alias("guest")))).otherwise(out)
    dealt = docs.select(F.explode(out).alias("x"), "_id", "_text").select("x.range", "x.guest", "_id", "_text")
    return dealt.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "guest", F.desc("_id"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row, which waits for the next
    for batch in batches:
        data, at = text_bytes(batch.column("_text"))
        prints = fingerprints(data, at)
        texts = batch.column("_text").to_pylist()
        rows = [*([held] if held else []), *zip(batch.column("range").to_pylist(), batch.column("guest").to_pylist(), batch.column("_id").to_pylist(), texts, prints, strict=True)]
        held = rows[-1] if rows else held
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1] and a[0] == b[0]]
        for k in range(0, len(pairs), 256):
            some = pairs[k : k + 256]
            news = [edited(a[3], b[3]) for a, b in some]
            own, following, new = np.stack([a[4] for a, _ in some]), np.stack([b[4] for _, b in some]), _of(news)
            columns = (
                pa.array([a[2] for a, _ in some], pa.int64()), pa.array([len(a[3]) for a, _ in some], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in news]),
                pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in new]), pa.array(likeness(own, new)), pa.array(likeness(own, following)),
            )
            yield pa.RecordBatch.from_arrays(list(columns), names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is that with the next smaller doc_id (a null id is the smallest), for the last the
    first; a single document is its own next. Null text is empty; texts without words have the
    fingerprint 0; different texts of one doc_id are documents that follow each other, see keyed(). A text of any
    length is fingerprinted whole, in one task. Other columns are ignored. No documents, no rows.
    """
    texts, names = keyed(docs)
    out = followed(texts).mapInArrow(tidy(_compare), "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return named(out, names).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def tables(radius: int) -> list[tuple[int, int]]:
    """The first bit and the bits of each block: so many that within the radius one of them differs in 1 bit at most."""
    n = max(3, radius // 2 + 1)
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _values(prints: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    """The values of a block; prints: rows of two numbers, high bits first."""
    start, bits = block
    high, low = prints[:, 0], prints[:, 1]
    if start >= 64:
        value = high >> np.uint64(start - 64)
    else:
        value = low >> np.uint64(start)
        if start and start + bits > 64:
            value |= high << np.uint64(64 - start)
    return value & np.uint64((1 << bits) - 1)


def found(blocks_: list[tuple[int, int]], table: int, low: int, entries: np.ndarray, probes: np.ndarray, flipped: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (probe, entry) of different fingerprints within the radius that this table is the first to find.

    All have the same leading bits of the table's block (but for one, in probes that are `flipped`), `low` bits of it follow;
    flipped ones are looked up as they are, others with each of these bits changed as well.
    """
    mask = np.uint64((1 << low) - 1)
    keys = _values(entries, blocks_[table]) & mask
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], _values(probes, blocks_[table]) & mask
    ball = np.concatenate(([0], np.left_shift(1, np.arange(low)))).astype(np.uint64)
    for which, change in ((np.flatnonzero(flipped), ball[:1]), (np.flatnonzero(~flipped), ball)):
        for i in range(0, len(which), 8192):
            some = which[i : i + 8192]
            asked = (own[some, None] ^ change[None]).ravel()
            first = np.searchsorted(keys, asked)
            count = np.searchsorted(keys, asked, side="right") - first
            hit = np.flatnonzero(count)
            total = np.cumsum(count[hit])
            k = 0
            while k < len(hit):
                m = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + CANDIDATES, side="right")))
                probe, n = hit[k:m], count[hit[k:m]]
                k, ends = m, np.cumsum(n)
                x = some[np.repeat(probe // len(change), n)]
                y = order[np.arange(ends[-1]) + np.repeat(first[probe] - ends + n, n)]
                differ = probes[x] ^ entries[y]
                bits = np.bitwise_count(differ).sum(axis=1)
                keep = (bits <= radius) & (bits > 0)
                for b in blocks_[:table]:  # an earlier table has the pair
                    keep &= np.bitwise_count(_values(differ, b)) > 1
                yield x[keep], y[keep]


def near(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n, n_near): rows with this fingerprint, and rows with another one within the radius (at most 31).

    prints: rows with a column fingerprint (32 hex digits; null ones are left out). Equal fingerprints are one entry with a
    count before they are dealt, and pairs are counted where they meet, not listed. No rows, no fingerprints.
    """
    if not 0 <= radius <= 31:
        raise ValueError("needs 0 <= radius <= 31")
    blocks_ = tables(radius)
    distinct = saved(prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")))
    # leading bits that name a shard: twice the fingerprints, one bit more
    lead = min(16, blocks_[0][1] - 1, max(1, math.ceil(math.log2(max(1, distinct.count()) / SHARD))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.frombuffer(bytes.fromhex("".join(batch.column(0).to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)
            n = batch.column(1).to_numpy()
            for t, block in enumerate(blocks_):
                shard = (_values(both, block) >> np.uint64(block[1] - lead)).astype(np.int64)
                for flip in (0, *(1 << b for b in range(lead))):
                    yield pa.RecordBatch.from_arrays([pa.array((t << 16) | (shard ^ flip)), pa.array(np.full(len(n), flip > 0)), pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)), pa.array(n)], names=["shard", "flipped", "high", "low", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "part"):
            part, n = (t.column(c).to_numpy() for c in ("part", "n"))
            flipped, entry, probe = (t.column(c).to_numpy(zero_copy_only=False) for c in ("flipped", "entry", "probe"))
            both = np.stack([t.column(c).to_numpy() for c in ("high", "low")], axis=1).view(np.uint64)
            for k in np.unique(part).tolist():
                i, j = np.searchsorted(part, (k, k + 1))
                entries, probes = i + np.flatnonzero(entry[i:j]), i + np.flatnonzero(probe[i:j])
                table = k >> 40
                count = np.zeros(len(probes), np.int64)
                for x, y in found(blocks_, table, blocks_[table][1] - lead, both[entries], both[probes], flipped[probes], radius):
                    np.add.at(count, x, n[entries[y]])
                some = np.flatnonzero(count)
                name = both[probes[some]].astype(">u8").tobytes().hex()
                yield pa.RecordBatch.from_arrays([pa.array([name[i : i + 32] for i in range(0, len(name), 32)], pa.string()), pa.array(count[some])], names=["fingerprint", "near"])

    dealt = distinct.mapInArrow(tidy(deal), "shard long, flipped boolean, high long, low long, n long")
    # a crowded shard's work grows with its square: so many tasks share its lookups, each with all of its entries
    crowded = dealt.filter("not flipped").groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 2 * SHARD)
    shares = F.coalesce(F.ceil(F.pow(F.col("rows") / SHARD, 2)), F.lit(1)).cast("long")
    rows = dealt.join(crowded, "shard", "left").withColumn("shares", shares).withColumn("share", F.pmod(F.xxhash64("high", "low"), "shares"))
    to = F.when(F.col("flipped"), F.array("share")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    spread = rows.withColumn("to", F.explode(to)).select((F.col("shard") * (1 << 24) + F.col("to")).alias("part"), "flipped", (~F.col("flipped")).alias("entry"), (F.col("to") == F.col("share")).alias("probe"), "high", "low", "n")
    met = sorted_by(spread, "part").mapInArrow(tidy(meet), "fingerprint string, near long").groupBy("fingerprint").agg(F.sum("near").alias("n_near"))
    return distinct.join(met, "fingerprint", "left").select("fingerprint", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
