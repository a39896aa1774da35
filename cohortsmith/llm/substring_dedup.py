"""Substring dedup by level-wise doubling over words.

Levels run from short windows to the wanted length, each at most twice the one before (`lengths`: 7 and 13 words for 13).
At each level only windows that are still candidates are looked at, and a candidate stays only if its
part of that level's length occurs in more than one document; the rest is never extended. It ends at the
wanted length, or as soon as no candidate is left. The part that stands for a candidate is its anchor
(see _windows): the level's window with the smallest hash inside the full one. Equal full windows hold equal
anchors, so a level loses none of them, and moves one short window in several. At the last level candidates
are compared whole, as digests of stretches and, where those differ, word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import grouped, keyed, mix, named, saved, tidy
from ._windows import Repeats, as_words, batch_of, changes, packed, runs, sorted_by, unpacked

WINDOW = 13
#: Words above which a window is halved for the level before.
_SHORT = 7


def lengths(window: int = WINDOW) -> list[int]:
    """The levels, in ascending order."""
    out = [window]
    while out[-1] > _SHORT:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


class Levels(Repeats):
    """Windows of words that also start in a document before."""

    def __init__(self, window: int = WINDOW, **more):
        self.levels = lengths(window)
        super().__init__(as_words, window, self.levels[-2] if len(self.levels) > 1 else window, other_document=True, **more)

    def candidates(self, docs: DataFrame) -> DataFrame:
        """docs with the windows that survive all levels but the last; documents without any are left out."""
        alive = super().candidates(docs)
        for k, level in enumerate(self.levels[:-1]):
            alive = docs.join(self._surviving(alive, level), "_id")
            if k < len(self.levels) - 2:
                alive = saved(alive)
                if not alive.limit(1).count():
                    break
        return alive

    def _surviving(self, docs: DataFrame, level: int) -> DataFrame:
        """(_id, alive) of the documents with windows whose anchors of this level's length more than one document has."""
        rows = docs.mapInArrow(tidy(self._short(level)), "route long, doc long, at long")
        found = sorted_by(rows, "route").mapInArrow(tidy(self._common), "doc long, run long")
        return found.groupBy(F.col("doc").alias("_id")).agg(F.collect_list("run").alias("alive"))

    def _short(self, level: int):
        def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(route, doc, at) of every anchor. Where a batch has an anchor in two documents, all of its rows survive: they travel
            aside (late), and one more (again) tells the others that the anchor is common."""
            for batch in batches:
                parts = [(h, d, s - laid.edges[np.searchsorted(laid.edges, s, side="right") - 1], n, o) for laid, h, s, n, o, d in self._found(batch, level)]
                if not parts:
                    continue
                h, d, s, n, o = (np.concatenate(x) for x in zip(*parts, strict=True))
                if not len(h):
                    continue
                order = np.lexsort((d, h))
                new = np.flatnonzero(changes(h[order]))
                last = np.append(new[1:], len(order)) - 1
                twice = d[order[new]] != d[order[last]]
                common = np.zeros(len(h), bool)
                common[order] = np.repeat(twice, np.diff(np.append(new, len(order))))
                late, told = common.astype(np.int64), order[new[twice]]
                route = np.where(common, mix(d.view(np.uint64) * np.uint64(31) + s.view(np.uint64)), h).view(np.int64)
                zero = np.zeros(len(told), np.int64)
                yield batch_of(route=np.concatenate((route, h[told].view(np.int64))), doc=np.concatenate((d, d[told])), at=np.concatenate((packed(s, n, o, late, 0), packed(zero, zero, zero, 0, zero + 1))))

        return short

    @staticmethod
    def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors' rows, sorted -> (doc, run) of those that more than one document has."""
        for t in grouped(batches, "route"):
            route, doc, at = (t.column(x).to_numpy() for x in ("route", "doc", "at"))
            start, count, _, told, _ = unpacked(at)
            late = (at & 1) == 1
            group = np.cumsum(changes(route)) - 1
            low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, group[~late], doc[~late])
            np.maximum.at(high, group[~late], doc[~late])
            common = low < high
            common[group[told == 1]] = True
            keep = (late | common[group]) & (told == 0)
            if keep.any():
                yield batch_of(doc=doc[keep], run=(start[keep] << 8) | count[keep])

    def later(self, first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        i = np.flatnonzero(first)
        return doc > np.repeat(doc[i], np.diff(np.append(i, len(doc))))

    def _order(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, start, count, again = (t.column(x).to_pylist() for x in ("doc", "start", "count", "again"))
        first: dict[bytes, int] = {}
        windows = []
        for d, n, content in zip(doc, count, t.column("content").to_pylist(), strict=True):
            at = [0]
            while (i := content.find(b" ", at[-1])) >= 0:
                at.append(i + 1)
            at.append(len(content) + 1)
            own = [content[at[k] : at[k + self.length] - 1] for k in range(n)]
            windows.append(own)
            for w in own:
                if first.setdefault(w, d) > d:
                    first[w] = d
        found = [(d, s + k, r) for d, s, r, own in zip(doc, start, again, windows, strict=True) for k, w in enumerate(own) if first[w] < d]
        if found:
            d, s, r = (np.array(x, np.int64) for x in zip(*found, strict=True))
            yield runs(d, s, r, self.length)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller
    doc_id; repeats inside one document alone stay. Windows are judged on the input. Null or empty
    text: no words; a null doc_id sorts first; different texts of one doc_id are documents that follow
    each other, see keyed(). A text of any length is treated whole, in one task. Other columns are ignored. No documents, no rows.
    """

    def digest(laid, gone):
        kept = laid.whole()
        if gone.any():
            kept = b" ".join([laid.content[a:b] for a, b in zip(laid.start[~gone].tolist(), laid.stop[~gone].tolist(), strict=True)])
        return len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    texts, names = keyed(docs)
    out = Levels(window).removed(texts, digest, "n_words long, n_removed long, kept_sha256 string")
    return named(out, names).select("doc_id", "n_words", "n_removed", "kept_sha256")
