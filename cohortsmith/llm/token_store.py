"""Content-addressed store of token ids.

Texts become id streams. A rolling hash over the last ids decides, from content alone, where a stream
is cut into chunks; a chunk is named by its digest and stored once, and a document is a recipe, the
list of its chunks. The store is a folder with three tables:

* chunks: digest (16 bytes), body (ids as little-endian unsigned integers of 16 bits, if the vocabulary
  has at most 65,536 pieces, else of 32), each digest once
* recipes: doc_id, start (ids of all documents before it), n_tokens, digests, sizes; segments (files)
  follow each other in ascending doc_id order, index is a recipe's place in its segment
* manifest: for each segment its documents, ids and the root of the Merkle tree over its recipes; segment -1
  is the root over all segments' roots

A tree's leaves are the recipes' hashes; each node is the hash of FAN nodes below, so that no row ever holds more
than FAN hashes. Reading verifies every chunk against its digest, every recipe against its chunks' sizes, every
segment against its root, and the root over all against the manifest's and the one that writing returned.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Rolling, blocks, distinct_spans, keyed, mix, named, remove, saved, text_bytes, tidy

END_ID = 2
#: A chunk ends where the hash of the last WINDOW ids has its lowest CUT_BITS bits zero, or at LONGEST ids.
WINDOW, CUT_BITS, LONGEST = 16, 8, 4096
#: Nodes under one node of a Merkle tree.
FAN = 1024
#: Parts that a worker remembers, each of at most so many characters.
_CACHE, _LONGEST_PART = 700_000, 64
#: Bytes of texts that are encoded at a time, or one text.
_BLOCK = 1 << 20


#: What the tokenizer's normalizer and pattern make of a text of Latin-1 characters: its parts, in lower case.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each Latin-1 character its lower case, and its class: 0 white space, 1 letter, 2 digit (a part by itself), 3 other."""
    lower = np.array([ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256)], np.uint8)
    kinds = np.array([0 if c in "\t\n\v\f\r \x85\xa0" else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in map(chr, range(256))], np.uint8)
    return lower, kinds


class Encoder:
    """Encodes texts with a tokenizer, remembering the ids of their parts (words, digits, marks) up to a bound.

    word_bpe_49k.json drops white space and merges inside parts only, so that a text's ids are its parts' ids.
    Texts are cut in numpy, many at a time, and each different part is looked up once, by its characters: parts of up to
    seven are numbers, longer ones are found by hash and compared byte by byte. Unknown parts are encoded many at a time, set apart by spaces:
    each has exactly one piece with the end mark, its last. Texts with apostrophes (contractions are parts of their
    own) are cut by pattern; texts with other than Latin-1 characters or with `<|`, which may begin a special token, go
    through the tokenizer whole. So does every text if the tokenizer cuts `probes()` in another way than this class.
    """

    def __init__(self, path: str, end_mark: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.find = Tokenizer.from_file(path), re.compile(_PARTS).findall
        self.width = width(self.tokenizer.get_vocab_size())
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(end_mark)]] = True
        self.lower, self.kinds = _classes()
        self.known: dict[int | bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.by_parts = True
        texts = [t.encode() for t in probes()]
        try:
            self.by_parts = self(texts) == self._ids([t.decode() for t in texts])
        except ValueError:
            self.by_parts = False

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str], names: list, into: dict) -> None:
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            raw, at = self._ids([" ".join(some)])[0], 0
            ends = self.width * (np.flatnonzero(self.ends[np.frombuffer(raw, f"<u{self.width}")]) + 1)
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not end each part with a marked piece")
            for name, e in zip(names[i : i + 1000], ends.tolist(), strict=True):
                into[name] = raw[at:e]
                at = e

    @staticmethod
    def _bound(known: dict, long) -> None:
        """What is remembered stays bounded in number and in bytes: without these long parts, and without any above _CACHE."""
        for p in long:
            del known[p]
        if len(known) > _CACHE:
            known.clear()

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts without apostrophes."""
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        low = self.lower[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        kinds = np.concatenate(([0], self.kinds[low], [0])).astype(np.uint8)
        own = kinds[1:-1]
        start = np.flatnonzero((own > 0) & ((own != kinds[:-2]) | (own == 2)))
        stop = np.flatnonzero((own > 0) & ((own != kinds[2:]) | (own == 2))) + 1
        names, first, place = distinct_spans(low, start, stop)
        raw = low.tobytes()
        got = list(map(self.known.get, names))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            a, b = start[first[new]].tolist(), stop[first[new]].tolist()
            parts = [raw[i:j].decode("latin-1") for i, j in zip(a, b, strict=True)]
            self._learn(parts, [names[i] for i in new], self.known)
            for i in new:
                got[i] = self.known[names[i]]
            self._bound(self.known, [names[i] for i, p in zip(new, parts, strict=True) if len(p) > _LONGEST_PART])
        size = np.array([len(x) for x in got], np.int64) // self.width
        flat, lengths = np.frombuffer(b"".join(got), f"<u{self.width}"), size[place]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat((np.cumsum(size) - size)[place] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate(([0], ends))[np.searchsorted(start, at)].tolist()
        raw, w = ids.tobytes(), self.width
        return [raw[w * i : w * j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def _found(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of Latin-1 characters, cut by pattern."""
        found = [self.find(t.lower()) for t in texts]
        new = list(set(chain.from_iterable(found)) - self.parts.keys())
        self._learn(new, new, self.parts)
        out = [b"".join(map(self.parts.__getitem__, parts)) for parts in found]
        self._bound(self.parts, [p for p in new if len(p) > _LONGEST_PART])
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, each as little-endian integers of `width` bytes."""
        out, plain, marked, rest = [b""] * len(texts), [], [], []
        for i, raw in enumerate(texts):
            narrow = raw
            if not raw.isascii():
                try:
                    narrow = raw.decode().encode("latin-1")
                except UnicodeEncodeError:
                    narrow = None
            if narrow is None or b"<|" in narrow or not self.by_parts:
                rest.append((i, raw.decode()))
            elif b"'" in narrow:
                marked.append((i, narrow.decode("latin-1")))
            else:
                plain.append((i, narrow))
        for some, encode in ((plain, self._cut), (marked, self._found), (rest, self._ids)):
            if some:
                for (i, _), ids in zip(some, encode([t for _, t in some]), strict=True):
                    out[i] = ids
        return out


def probes() -> list[str]:
    """Texts that show how a tokenizer cuts: every Latin-1 character alone, doubled, and beside letters, digits and marks."""
    out = [f"{c}{c} a{c}b {c}1{c}2 .{c}, {c}" for c in map(chr, range(256))]
    return [*out, "don't I'LL we've x'S 'tis ''re", "AbCd12e ÀÉÿß ª²½ 3.14-15", "  two  spaces\n\nlines\t.\r\n", "word" * 30 + " 1" * 9]


def width(vocabulary: int) -> int:
    """Bytes of a stored id."""
    return 2 if vocabulary <= 1 << 16 else 4


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder; what it remembers lasts from task to task."""
    return Encoder(path)


def cuts(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks end, in streams laid end to end; edges: the streams' starts, and the end of the last."""
    found = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        hashes = Rolling(mix(ids.astype(np.uint64) + np.uint64(1))).windows(WINDOW)
        found = np.flatnonzero((hashes & np.uint64((1 << CUT_BITS) - 1)) == 0) + WINDOW
        start = edges[np.searchsorted(edges, found, side="left") - 1]
        found = found[found - start >= WINDOW]  # no window reaches over a stream's start
    ends = np.unique(np.concatenate((found, edges[1:])))
    ends = ends[ends > 0]
    long = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    more = [np.arange((ends[i - 1] if i else 0) + LONGEST, ends[i], LONGEST) for i in long]
    return np.unique(np.concatenate((ends, *more))) if more else ends


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(path), set()
        size = encoder.width
        end = np.array([end_id], f"<u{size}").tobytes()
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            names = batch.column("_id").to_pylist()
            for i, j in blocks(at, _BLOCK):
                streams = [x + end for x in encoder([data[at[k] : at[k + 1]].tobytes() for k in range(i, j)])]
                sizes = np.array([len(x) // size for x in streams])
                edges = np.concatenate(([0], np.cumsum(sizes)))
                raw = b"".join(streams)
                ends = cuts(np.frombuffer(raw, f"<u{size}"), edges)
                starts = np.concatenate(([0], ends[:-1]))
                bodies = [raw[size * s : size * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                digests = [hashlib.blake2b(b, digest_size=16).digest() for b in bodies]
                last = np.searchsorted(ends, edges[1:], side="left") + 1
                first = np.concatenate(([0], last[:-1]))
                lengths = (ends - starts).tolist()
                if len(seen) > _CACHE:
                    seen.clear()
                fresh = []
                for d, b in zip(digests, bodies, strict=True):
                    if d not in seen:  # what this task has sent already need not travel again
                        seen.add(d)
                        fresh.append((d, b))
                yield _rows([int.from_bytes(d[:8], "little", signed=True) for d, _ in fresh], "chunks", digest=[d for d, _ in fresh], body=[b for _, b in fresh])
                doc = names[i:j]
                yield _rows(
                    [int(x) for x in mix(np.array(doc, np.int64).view(np.uint64)).view(np.int64)], "recipes", doc_id=doc, n_tokens=sizes.tolist(),
                    digests=[digests[a:b] for a, b in zip(first, last, strict=True)], sizes=[lengths[a:b] for a, b in zip(first, last, strict=True)],
                )

    return encode


_SCHEMA = pa.schema([("route", pa.int64()), ("kind", pa.string()), ("digest", pa.binary()), ("body", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
_DDL = "route long, kind string, digest binary, body binary, doc_id long, n_tokens long, digests array<binary>, sizes array<long>"


def _rows(route: list[int], kind: str, **columns) -> pa.RecordBatch:
    columns |= {"route": route, "kind": [kind] * len(route)}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(route)), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests lie in one partition: the first body of each stays."""
    seen = set()
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d is None or d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> str:
    """Writes the ids of every document (null text: empty) with end_id appended; returns the root digest.

    A null doc_id comes first. Different texts of one doc_id are documents that follow each other; the store
    then has keys and a table of their ids, see keyed(). A text of any length is encoded whole, in one task, and stored in
    chunks of at most LONGEST ids. Other columns are ignored. No documents: a store without rows.
    """
    spark = docs.sparkSession
    texts, names = keyed(docs)
    if names is not None:
        names.write.parquet(f"{path}/ids")
    rows = texts.mapInArrow(tidy(_encode(tokenizer, end_id)), _DDL)
    rows.repartition("route").mapInArrow(tidy(_once), _DDL).drop("route").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/parts")
    recipes = spark.read.schema(_DDL.replace("route long, ", "")).parquet(f"{path}/parts").filter("kind = 'recipes'").select("doc_id", "n_tokens", "digests", "sizes")
    recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("segment", F.spark_partition_id()).write.parquet(f"{path}/sorted")
    ordered = spark.read.parquet(f"{path}/sorted")
    sums = ordered.groupBy("segment").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first")).collect()  # a row for each partition
    before, offset = {}, 0
    for r in sorted(sums, key=lambda r: r["first"]):
        before[r["segment"]] = offset
        offset += r["n"]
    starts = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("segment")) if before else F.lit(0)
    running = Window.partitionBy("segment").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("start", (starts + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).cast("long"))
    placed = placed.withColumn("index", (F.row_number().over(Window.partitionBy("segment").orderBy("doc_id")) - 1).cast("long"))
    placed.write.parquet(f"{path}/recipes")
    roots = _roots(spark.read.parquet(f"{path}/recipes"))
    from tokenizers import Tokenizer

    size = width(Tokenizer.from_file(tokenizer).get_vocab_size())
    top = _top(roots).select(F.lit(-1).alias("segment"), F.lit(None).cast("long").alias("first"), F.lit(offset).cast("long").alias("n"), F.lit(None).cast("long").alias("docs"), "root")
    roots.unionByName(top).withColumn("width", F.lit(size)).coalesce(1).write.parquet(f"{path}/manifest")
    remove(spark, f"{path}/sorted")
    return spark.read.parquet(f"{path}/manifest").filter("segment = -1").first()["root"]


def _hashed(hashes) -> Column:
    return F.sha2(F.concat_ws("", hashes).cast("binary"), 256)


def _roots(recipes: DataFrame) -> DataFrame:
    """(segment, first, n, docs, root): each segment's Merkle tree over its recipes, built level by level, FAN nodes to one."""
    facts = recipes.groupBy("segment").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    most = facts.agg(F.max("docs").alias("n")).first()["n"] or 0
    listed = F.concat_ws(",", F.transform("digests", lambda d: F.hex(d)))
    nodes = recipes.select("segment", "index", F.sha2(F.concat_ws("|", "index", "doc_id", "start", "n_tokens", listed).cast("binary"), 256).alias("hash"))
    while True:
        below = F.array_sort(F.collect_list(F.struct("index", "hash")))
        nodes = nodes.groupBy("segment", F.floor(F.col("index") / FAN).alias("index")).agg(_hashed(F.transform(below, lambda x: x["hash"])).alias("hash"))
        most = -(-most // FAN)
        if most <= 1:
            return facts.join(nodes.select("segment", F.col("hash").alias("root")), "segment")


def _top(roots: DataFrame) -> DataFrame:
    """(root): over the segments' roots, of which there is one for each file."""
    return roots.agg(_hashed(F.transform(F.array_sort(F.collect_list(F.struct("segment", "root"))), lambda x: x["root"])).alias("root"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_DDL.replace("route long, ", "")).parquet(f"{path}/parts").filter("kind = 'chunks'").select("digest", "body")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def _names(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of keys and ids, where keys are not ids."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    return spark.read.parquet(f"{path}/ids") if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def verify(spark: SparkSession, path: str, root: str | None = None) -> None:
    """Raises unless every segment has the root, documents and ids that the manifest names, and all together the manifest's root and `root` (as write() returned it)."""
    manifest = spark.read.parquet(f"{path}/manifest")
    found = saved(_roots(recipes(spark, path)))
    same = ["segment", "first", "n", "docs", "root"]
    told = manifest.filter("segment >= 0").select(same)
    if found.select(same).exceptAll(told).union(told.exceptAll(found.select(same))).limit(1).count():
        raise ValueError(f"{path}: recipes differ from the manifest")
    top = _top(found).first()["root"]
    if top != manifest.filter("segment = -1").first()["root"] or root not in (None, top):
        raise ValueError(f"{path}: the root differs from the manifest's, or from the one given")


def stored_width(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/manifest").filter("segment = -1").first()["width"]


def _facts(size: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = batch.column("digest").to_pylist(), batch.column("body").to_pylist()
            for d, b in zip(names, bodies, strict=True):
                if hashlib.blake2b(b, digest_size=16).digest() != d:
                    raise ValueError(f"chunk {d.hex()} has other content")
            crcs = [zlib.crc32(np.frombuffer(b, f"<u{size}").astype("<u4")) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("digest").cast(pa.binary()), pa.array([len(b) // size for b in bodies], pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    return facts


_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC's, in its reflected bit order."""
    out, a = np.zeros(len(a), np.uint64), a.copy()
    one, poly = np.uint64(1), np.uint64(_POLYNOMIAL)
    b = b.copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(i)) & one, b, np.uint64(0))
        b = (b >> one) ^ np.where(b & one, poly, np.uint64(0))
    return out


def moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a CRC-32 becomes when `after` more bytes follow, apart from those bytes' own CRC."""
    out, step, left = crc.astype(np.uint64), np.full(1, 1 << 23, np.uint64), after.astype(np.int64).copy()  # x**8
    while left.any():
        odd = (left & 1) == 1
        if odd.any():
            out[odd] = _times(out[odd], np.repeat(step, int(odd.sum())))
        step = _times(step, step)
        left >>= 1
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(moved(crc, 4 * after).astype(np.int64)), batch.column("n")], names=["doc_id", "term", "n"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    A document's CRC is the exclusive or of its chunks' CRCs, each moved by the bytes that follow, so ids
    are read once where they lie and only a few numbers for each chunk are joined.
    """
    facts = chunks(spark, path).mapInArrow(tidy(_facts(stored_width(spark, path))), "digest binary, n long, crc long")
    listed = recipes(spark, path)
    items = listed.mapInArrow(tidy(_after), "doc_id long, digest binary, size long, after long")
    joined = items.join(facts, "digest", "left")
    checked = joined.select("doc_id", "after", "crc", F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("missing or wrong chunk "), F.hex("digest"))).cast("long")).alias("n"))
    summed = checked.mapInArrow(tidy(_terms), "doc_id long, term long, n long").groupBy("doc_id").agg(F.bit_xor("term").alias("ids_crc32"), F.sum("n").alias("read"))
    out = listed.select("doc_id", "start", "n_tokens").join(summed, "doc_id")
    return named(out.withColumnRenamed("doc_id", "_id"), _names(spark, path)).select("doc_id", "start", F.col("read").alias("n_tokens"), "ids_crc32")


def _after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = batch.column("digests"), batch.column("sizes")
        flat = sizes.flatten().to_numpy(zero_copy_only=False)
        count = np.diff(sizes.offsets.to_numpy())
        ends = np.cumsum(flat)
        last = np.cumsum(count) - 1
        after = np.repeat(ends[last], count) - ends if len(flat) else flat
        doc = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), count)
        yield pa.RecordBatch.from_arrays([pa.array(doc), digests.flatten().cast(pa.binary()), pa.array(flat, pa.int64()), pa.array(after, pa.int64())], names=["doc_id", "digest", "size", "after"])


def texts_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) rebuilt whole from recipes and chunks; ids as stored, see stored_width()."""
    items = recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    got = items.join(chunks(spark, path), "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("x"))
    return named(got.withColumnRenamed("doc_id", "_id"), _names(spark, path)).select("doc_id", "start", F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["body"])), "")).alias("ids"))
