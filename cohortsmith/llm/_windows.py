"""Windows of a fixed length that occur before: the machinery of the two exact substring operators.

A sequence is a text's bytes or its words. Every window of `length` codes holds one *anchor*, the
leftmost of its `gram`-code windows with the smallest hash. The choice depends on the window's content
alone, so equal windows have equal anchors at the same offset, and only one anchor in several codes
has to be moved, not every window. Hashes only choose anchors and bring rows together; what is equal
is decided by 128-bit cryptographic digests of content, or by the content itself.

1. Each document gives a row for each anchor: its hash, the stretch of windows it serves, and the digest
   of the stretch's whole content.
2. Rows meet by anchor, sorted, group by group. Of equal stretches the first stays, the later ones repeat as a whole.
   Rows that already lost to an equal stretch of their own batch skip the meeting: they are dealt
   anywhere, so that an anchor in a third of all documents gives a row for each batch, not for each copy.
   Where only other documents count, equal stretches of one document are one row.
3. Only where one anchor has different stretches is content fetched, and their windows are decided one by one
   (`_order`, which each operator does in its own way).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BYTE_CODES, Rolling, blocks, grouped, mix, text_bytes, tidy, words_of

_LOW = (1 << 20) - 1
#: Stretches of one anchor above which it is crowded: its windows are dealt by their content.
SPLIT = 4096


@dataclass
class Laid:
    """Texts laid end to end. edges: each text's first code, and the number of all. content[start[i]:stop[j]] is what codes i to j say."""

    make: Callable[[], np.ndarray]
    edges: np.ndarray
    content: bytes
    start: np.ndarray
    stop: np.ndarray

    @cached_property
    def codes(self) -> np.ndarray:
        return self.make()

    def one(self, k: int) -> Laid:
        """The k-th text alone."""
        a, b = self.edges[k], self.edges[k + 1]
        return Laid(lambda: self.codes[a:b], np.array([0, b - a]), self.content, self.start[a:b], self.stop[a:b])

    def whole(self) -> bytes:
        """All of the content."""
        return self.content[self.start[0] : self.stop[-1]] if len(self.start) else b""


def as_bytes(data: np.ndarray, at: np.ndarray) -> Laid:
    part = data[at[0] : at[-1]]
    place = np.arange(len(part) + 1)
    return Laid(lambda: BYTE_CODES[part], at - at[0], part.tobytes(), place[:-1], place[1:])


def as_words(data: np.ndarray, at: np.ndarray) -> Laid:
    """Words as codes; their content is the words with one space between."""
    part = data[at[0] : at[-1]]
    codes, start, stop, edges = words_of(data, at)
    size = stop - start
    first = np.cumsum(size + 1) - (size + 1)
    total = int(size.sum())
    own = np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
    content = np.full(total + len(size), 0x20, np.uint8)
    content[np.arange(total) + np.repeat(np.arange(len(size)), size)] = part[own]
    return Laid(lambda: codes, edges, content.tobytes(), first, first + size)


def anchors(codes: np.ndarray, edges: np.ndarray, length: int, gram: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Rows (anchor hash, first window, windows, offset of the anchor) of sequences laid end to end.

    edges: where each sequence starts, and the end of the last. alive: whether a window that starts at each code counts (all, if not given).
    """
    n = len(codes) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(codes) > _LOW:
        return _pieces(codes, edges, length, gram, alive)
    grams = Rolling(codes).windows(gram)
    low = (grams & ~np.uint64(_LOW)) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low[:n] & np.uint64(_LOW)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    starts, ends = edges[:-1], edges[1:] - length + 1
    some = ends > starts
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, ends[some], -1)
    valid = np.cumsum(valid[:n]) > 0
    at = np.flatnonzero(valid if alive is None else valid & alive[:n])
    if not len(at):
        return anchors(codes[:0], edges, length, gram)
    anchor = anchor[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(at) != 1))))
    count = np.diff(np.append(first, len(at)))
    start, anchor = at[first], anchor[first]
    return grams[anchor], start, count, anchor - start


def _pieces(codes, edges, length, gram, alive=None):
    """A very long sequence in pieces that overlap by length - 1; each window belongs to one piece."""
    out, step = [], 1 << 19
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for s in range(int(a), max(int(a) + 1, int(b) - length + 1), step):
            e = min(int(b), s + step + length - 1)
            h, p, n, o = anchors(codes[s:e], np.array([0, e - s]), length, gram, None if alive is None else alive[s:e])
            out.append((h, p + s, n, o))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(start, count, offset, late, again, crowded=0):
    """One number for a row's place: start, windows, anchor's offset, whether it is known to repeat, whether it stands
    for further equal stretches of its document, and whether its anchor is crowded."""
    return (start << 25) | (np.asarray(crowded, np.int64) << 18) | (again << 17) | (count << 9) | (offset << 1) | late


def unpacked(m: np.ndarray) -> tuple[np.ndarray, ...]:
    return m >> 25, (m >> 9) & 255, (m >> 1) & 255, (m >> 17) & 1, (m >> 18) & 127


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _ids(batch: pa.RecordBatch, name: str = "_id") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def digests(laid: Laid, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """16 bytes (as two numbers) for the content of each run of codes."""
    content, blake = laid.content, hashlib.blake2b
    raw = b"".join([blake(content[a:b], digest_size=16).digest() for a, b in zip(laid.start[start].tolist(), laid.stop[stop - 1].tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in one of the columns."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


class Repeats:
    """laid: how texts become codes. other_document: whether only windows of documents before count, or earlier ones of the same as well."""

    def __init__(self, laid: Callable[[np.ndarray, np.ndarray], Laid], length: int, gram: int, other_document: bool, split: int = SPLIT):
        if not 0 < gram <= length <= 255 or length - gram > 126:
            raise ValueError("needs 0 < gram <= length <= 255, and length - gram <= 126")
        self.laid, self.length, self.gram, self.other, self.split = laid, length, gram, other_document, split

    def later(self, first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of equal stretches in order of document and start (first: where a new content begins), which ones repeat an earlier one."""
        raise NotImplementedError

    def _order(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Contents of contested stretches, whole anchors -> windows with an earlier occurrence, as runs (doc, start, stop, again)."""
        raise NotImplementedError

    def candidates(self, docs: DataFrame) -> DataFrame:
        """docs with `alive`: the runs of windows [(start << 8 | windows)] that may repeat; here all of them, null."""
        return docs.withColumn("alive", F.lit(None).cast("array<long>"))

    def _found(self, batch: pa.RecordBatch, gram: int) -> Iterator[tuple]:
        """(laid, first document, anchors' hashes, starts, windows, offsets, documents) of a batch (_id, _text, alive), for runs of documents."""
        data, at = text_bytes(batch.column("_text"))
        runs = batch.column("alive")
        limited = runs.null_count < len(runs)
        ids = _ids(batch)
        for i, j in blocks(at):
            laid = self.laid(data, at[i : j + 1])
            alive = None
            if limited:
                mark = np.zeros(len(laid.codes) + 1, np.int32)
                for k in range(i, j):
                    got = runs[k]
                    if got.is_valid:
                        own = got.values.to_numpy(zero_copy_only=False)
                        first = laid.edges[k - i] + (own >> 8)
                        np.add.at(mark, first, 1)
                        np.add.at(mark, first + (own & 255), -1)
                alive = np.cumsum(mark[:-1]) > 0
            h, s, n, o = anchors(laid.codes, laid.edges, self.length, gram, alive)
            # an empty document shares its edge with the next one; the last of them holds the window
            yield laid, h, s, n, o, ids[i + np.searchsorted(laid.edges, s, side="right") - 1]

    def _each(self, batch: pa.RecordBatch) -> Iterator[tuple[int, Laid]]:
        """The documents of a batch, one by one, laid many at a time."""
        data, at = text_bytes(batch.column("_text"))
        for i, j in blocks(at):
            laid = self.laid(data, at[i : j + 1])
            for k in range(i, j):
                yield k, laid.one(k - i)

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for laid, h, s, n, o, d in self._found(batch, self.gram):
                c = digests(laid, s, s + n - 1 + self.length)
                parts.append((h, c[:, 0], c[:, 1], d, s - laid.edges[np.searchsorted(laid.edges, s, side="right") - 1], n, o))
            if not parts:
                continue
            h, c, c2, d, s, n, offsets = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(h):
                continue
            order = np.lexsort((s, d, c2, c))
            first = changes(c[order], c2[order])
            late, again = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            late[order] = self.later(first, d[order], s[order])
            if self.other:
                # equal stretches of one document share their fate: the first stands for all
                i = np.flatnonzero(first | changes(d[order]))
                again[order[i]] = np.diff(np.append(i, len(order))) > 1
                keep = np.sort(order[i])
                h, c, c2, d, s, n, offsets, late, again = (x[keep] for x in (h, c, c2, d, s, n, offsets, late, again))
            route = np.where(late == 1, mix(d.view(np.uint64) * np.uint64(31) + s.view(np.uint64)), h).view(np.int64)
            yield batch_of(route=route, c=np.where(late == 1, 0, c), c2=np.where(late == 1, 0, c2), doc=d, at=packed(s, n, offsets, late, again))

    def _meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor -> repeats (anchor null), and firsts whose anchor has other contents too."""
        for t in grouped(batches, "route"):
            route, c, c2, doc, at = (t.column(x).to_numpy() for x in ("route", "c", "c2", "doc", "at"))
            late = (at & 1) == 1
            if late.any():
                yield batch_of(anchor=pa.nulls(int(late.sum()), pa.int64()), doc=doc[late], at=at[late])
                route, c, c2, doc, at = (x[~late] for x in (route, c, c2, doc, at))
            if not len(route):
                continue
            order = np.lexsort((at, doc, c2, c, route))
            route, c, c2, doc, at = (x[order] for x in (route, c, c2, doc, at))
            new_route = changes(route)
            new_content = new_route | changes(c, c2)
            later = self.later(new_content, doc, at >> 25)
            group = np.cumsum(new_route) - 1
            contents = np.bincount(group, weights=new_content).astype(np.int64)
            if later.any():
                yield batch_of(anchor=pa.nulls(int(later.sum()), pa.int64()), doc=doc[later], at=at[later] & ~np.int64(1))
            if self.other:  # all of one document: nothing can repeat another
                low, high = np.full(len(contents), np.iinfo(np.int64).max), np.full(len(contents), np.iinfo(np.int64).min)
                np.minimum.at(low, group, doc)
                np.maximum.at(high, group, doc)
                contents = np.where(low == high, 1, contents)
            ask = ~later & (contents[group] > 1)
            if ask.any():
                crowded = (contents > self.split)[group[ask]].astype(np.int64)
                start, count, offset, again, _ = unpacked(at[ask])
                yield batch_of(anchor=route[ask], doc=doc[ask], at=packed(start, count, offset, 0, again, crowded))

    def _fetch(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The content of the windows asked for: one row for each stretch; where an anchor is crowded, the digest of each window, which deals them.

        Of equal windows of a batch the first one goes; the others that repeat it are late: they travel aside.
        """
        names = ["again", "anchor", "doc", "start", "count", "crowded", "late", "content"]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.binary()]
        for batch in batches:
            out, first, windows = [], {}, []
            ids, met = _ids(batch).tolist(), batch.column("met")
            for i, laid in self._each(batch):
                doc, rows = ids[i], met[i]
                anchor_, place = rows.values.field("anchor").to_pylist(), rows.values.field("at").to_numpy()
                for name, start, count, _, again, crowded in zip(anchor_, *(x.tolist() for x in unpacked(place)), strict=True):
                    if name is None:  # decided already
                        continue
                    if not crowded:
                        out.append((again, name, doc, start, count, False, False, laid.content[laid.start[start] : laid.stop[start + count - 2 + self.length]]))
                        continue
                    for s in range(start, start + count):
                        digest = hashlib.blake2b(laid.content[laid.start[s] : laid.stop[s + self.length - 1]], digest_size=16).digest()
                        windows.append((digest, doc, s, again))
                        if digest not in first or (doc, s) < first[digest]:
                            first[digest] = doc, s
            for digest, doc, s, again in windows:
                d, p = first[digest]
                late = doc > d or (not self.other and s > p)
                name = hashlib.blake2b(b"%d %d" % (doc, s), digest_size=8).digest() if late else digest[:8]
                out.append((again, int.from_bytes(name, "little", signed=True), doc, s, 1, True, late, b"" if late else digest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def _ordered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fetched contents and digests, sorted by anchor -> windows with an earlier occurrence, as runs (doc, start, stop, again)."""
        for t in grouped(batches, "anchor"):
            late, crowded = (t.column(c).to_numpy() for c in ("late", "crowded"))
            if late.any():
                yield runs(*(t.column(c).to_numpy()[late] for c in ("doc", "start", "again")), self.length)
            if (single := crowded & ~late).any():
                some = t.filter(pa.array(single))
                doc, start, again = (some.column(c).to_numpy() for c in ("doc", "start", "again"))
                digest = np.frombuffer(b"".join(some.column("content").to_pylist()), np.int64).reshape(-1, 2)
                order = np.lexsort((start, doc, digest[:, 1], digest[:, 0]))
                doc, start, again, digest = doc[order], start[order], again[order], digest[order]
                later = self.later(changes(digest[:, 0], digest[:, 1]), doc, start)
                if later.any():
                    yield runs(doc[later], start[later], again[later], self.length)
            if not crowded.all():
                yield from self._order(t.filter(pa.array(~crowded)))

    def find(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the documents (_id, _text) have that occurs earlier, two tables: (_id, met: [(anchor, at)]), in which stretches without an
        anchor repeat as a whole, and (_id, runs: [(start, stop, again)]) of the windows that were decided one by one.

        again: what is so in the run is so wherever the document has the same windows.
        """
        rows = self.candidates(docs).mapInArrow(tidy(self._rows), "route long, c long, c2 long, doc long, at long")
        met = sorted_by(rows, "route").mapInArrow(tidy(self._meet), "anchor long, doc long, at long").filter("doc is not null")
        # one exchange by document serves both the contents asked for and the result
        met = met.groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("anchor", "at")).alias("met"))
        asked = met.filter(F.exists("met", lambda x: x["anchor"].isNotNull()))
        content = docs.join(asked, "_id").select("_id", "_text", "met").mapInArrow(tidy(self._fetch), "again long, anchor long, doc long, start long, count long, crowded boolean, late boolean, content binary")
        decided = sorted_by(content, "anchor").mapInArrow(tidy(self._ordered), "doc long, start long, stop long, again long")
        return met, decided.groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("start", "stop", "again")).alias("runs"))

    def _told(self, met: pa.ListScalar, runs_: pa.ListScalar) -> list[tuple[np.ndarray, ...]]:
        """(start, stop, again) of what repeats in a document."""
        out = []
        if met.is_valid:
            got = met.values
            start, count, _, again, _ = unpacked(got.field("at").to_numpy(zero_copy_only=False)[got.field("anchor").is_null().to_numpy(zero_copy_only=False)])
            out.append((start, start + count + self.length - 1, again))
        if runs_.is_valid:
            out.append(tuple(runs_.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop", "again")))
        return out

    def _everywhere(self, laid: Laid, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Where in a document the windows of some of its runs start, all of their occurrences."""
        hashes = Rolling(laid.codes).windows(self.length)
        inside = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(inside, start, 1)
        np.add.at(inside, stop - self.length + 1, -1)
        told = np.cumsum(inside[:-1]) > 0
        may = np.flatnonzero(np.isin(hashes, hashes[told]))  # equal windows have equal hashes; which ones are equal their content says
        a, b = laid.start[may].tolist(), laid.stop[may + self.length - 1].tolist()
        content = [laid.content[i:j] for i, j in zip(a, b, strict=True)]
        known = {c for c, t in zip(content, told[may].tolist(), strict=True) if t}
        return may[np.array([c in known for c in content], bool)]

    def removed(self, docs: DataFrame, digest: Callable, columns: str) -> DataFrame:
        """digest(laid text, removed mask) -> values of `columns` for every document of (_id, _text)."""
        dealt = docs.repartition("_id")
        met, decided = self.find(dealt)
        joined = dealt.join(met, "_id", "left").join(decided, "_id", "left").select("_id", "_text", "met", "runs")

        def apply(batches):
            for batch in batches:
                out, met_, runs_ = [], batch.column("met"), batch.column("runs")
                for i, laid in self._each(batch):
                    n = len(laid.start)
                    gone = np.zeros(n + 1, np.int32)
                    for start, stop, again in self._told(met_[i], runs_[i]):
                        np.add.at(gone, start, 1)
                        np.add.at(gone, stop, -1)
                        if again.any():
                            more = self._everywhere(laid, start[again > 0], stop[again > 0])
                            np.add.at(gone, more, 1)
                            np.add.at(gone, more + self.length, -1)
                    out.append(digest(laid, np.cumsum(gone[:n]) > 0))
                names = [x.split()[0] for x in columns.split(",")]
                types = {"long": pa.int64(), "string": pa.string()}
                kinds = [types[x.split()[1]] for x in columns.split(",")]
                yield batch_of(_id=batch.column("_id"), **{k: pa.array(v, t) for k, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)} if out else {k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})

        return joined.mapInArrow(tidy(apply), f"_id long, {columns}")


def sorted_by(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key and sorted by it, so that its groups can be read one after the other; the sort spills, a worker's table can't."""
    return rows.repartition(key).sortWithinPartitions(key)


def runs(doc: np.ndarray, at: np.ndarray, again: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows as runs: covered codes without a gap; where they stand for more, windows without a gap."""
    order = np.lexsort((at, doc, again))
    doc, at, again = doc[order], at[order], again[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (again[1:] != again[:-1]) | (at[1:] > at[:-1] + np.where(again[1:] > 0, 1, length))))
    i = np.flatnonzero(new)
    return batch_of(doc=doc[i], start=at[i], stop=at[np.append(i[1:], len(at)) - 1] + length, again=again[i])
