"""Suffix-array dedup: remove every byte inside a string that occurs earlier in the corpus.

A longest-previous-factor array says for every position of a text how long a string starting there
also starts at an earlier position. With suffixes in order, the best earlier match of a position is
its previous or its next smaller position in that order (`previous_factors`), so that two neighbours decide.
`lpf_array` does it for one text. `remove_repeats` does it over all documents: the suffix order is cut into
blocks by anchor (see _windows). Stretches of a block come in the order of their contents' digests, which puts equal
ones next to each other as suffix order does; where contents differ, the suffixes themselves are put in order,
compared as far as the minimum length, ties in order of position. A position goes if its factor reaches the minimum length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import BYTE_CODES, Rolling, keyed, named
from ._windows import Repeats, as_bytes, changes, runs

MIN_BYTES = 100
_GRAM = 32


def suffix_array(text: bytes) -> np.ndarray:
    """Suffixes in order, by doubling the prefix that ranks compare."""
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n:
        second = np.full(n, -1)
        second[:-step or None] = rank[step:] if step < n else -1
        order = np.lexsort((second, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


def previous_factors(position: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors of suffixes in order; those shorter than `least` as 0.

    position: where each suffix starts. common[i]: the bytes that suffix i shares with suffix i - 1. The previous and the
    next smaller positions are found by following, from neighbour to neighbour, those of larger neighbours, all at once.
    """
    before = _smaller(position, common, least)
    after = np.zeros(len(common), common.dtype)
    after[1:] = common[:0:-1]  # what each suffix of the reversed order shares with the one before
    return np.maximum(before, _smaller(position[::-1], after, least)[::-1])


def _smaller(position: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """What each suffix shares with the last one before it that starts earlier."""
    smaller, shared = np.arange(len(position)) - 1, common.copy()
    if len(shared):
        shared[0] = 0
    shared[shared < least] = 0
    todo = np.flatnonzero(shared > 0)
    todo = todo[position[smaller[todo]] > position[todo]]
    while len(todo):
        over = smaller[todo]
        # all between smaller[over] and over start later than over does
        shared[todo], smaller[todo] = np.minimum(shared[todo], shared[over]), smaller[over]
        todo = todo[shared[todo] > 0]
        todo = todo[position[smaller[todo]] > position[todo]]
    return shared


def lpf_array(text: bytes) -> list[int]:
    """Longest previous factors of one text."""
    order = suffix_array(text).tolist()
    n = len(order)
    rank = [0] * n
    for i, p in enumerate(order):
        rank[p] = i
    common, h = np.zeros(n, np.int64), 0
    for p in range(n):
        if rank[p]:
            q = order[rank[p] - 1]
            while p + h < n and q + h < n and text[p + h] == text[q + h]:
                h += 1
            common[rank[p]] = h
            h = max(0, h - 1)
        else:
            h = 0
    out = np.zeros(n, np.int64)
    out[order] = previous_factors(np.array(order, np.int64), common)
    return out.tolist()


def factors(raw: np.ndarray, place: np.ndarray, length: int, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Longest previous factors, cut off at `length`, of suffixes (at `place` in raw, position `at` of document `doc`); shorter ones as 0.

    Only suffixes whose first `length` bytes have a hash that another one shares can reach that length; these are put in
    order, in whole intervals of equal hashes, by their first `length` bytes and then by position.
    """
    out = np.zeros(len(place), np.int64)
    hashes = np.zeros(len(place), np.uint64)
    if len(place):
        # Hash in blocks, so that the prefix sums stay small.
        cut = np.searchsorted(place, np.arange(0, len(raw) + (1 << 19), 1 << 19))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i < j:
                low, high = place[i], place[j - 1] + length
                r = Rolling(BYTE_CODES[raw[low:high]])
                hashes[i:j] = r.spans(place[i:j] - low, place[i:j] - low + length)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(order) else same
    kept = order[shared]
    edges = np.append(np.flatnonzero(changes(hashes[kept])), len(kept))
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + (1 << 18), side="right")) - 1)
        part = kept[edges[i] : edges[j]]
        part = part[np.lexsort((at[part], doc[part]))]
        prefix = np.lib.stride_tricks.sliding_window_view(raw, length)[place[part]]
        order = _sorted(prefix)
        prefix = prefix[order]
        differ = prefix[1:] != prefix[:-1]
        common = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), length)))
        out[part[order]] = previous_factors(order, common, length)  # part is in order of position, so that an index in it is one
        i = j
    return out


def _sorted(prefix: np.ndarray) -> np.ndarray:
    """The order of rows of bytes; equal rows stay in theirs."""
    n, length = prefix.shape
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = prefix
    return np.lexsort(wide.view(">u8")[:, ::-1].T)


class Factors(Repeats):
    """Windows of bytes with an earlier occurrence, by longest previous factors inside blocks of the suffix order."""

    def __init__(self, min_bytes: int = MIN_BYTES, **more):
        super().__init__(as_bytes, min_bytes, min(_GRAM, (min_bytes + 1) // 2), other_document=False, **more)

    def later(self, first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        # equal stretches share all their bytes, and rows come in order of position
        return previous_factors(np.arange(len(first)), np.where(first, 0, self.length), self.length) >= self.length

    def _order(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, start, count, again = (t.column(x).to_numpy() for x in ("doc", "start", "count", "again"))
        raw = np.frombuffer(b"".join(t.column("content").to_pylist()), np.uint8)
        lengths = count - 1 + self.length
        base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        row = np.repeat(np.arange(len(doc)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = start[row] + step
        earlier = factors(raw, base[row] + step, self.length, doc[row], at) >= self.length
        if earlier.any():
            yield runs(doc[row[earlier]], at[earlier], again[row[earlier]], self.length)


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    A byte goes if a string of min_bytes that covers it also starts earlier: in a document with a
    smaller doc_id, or earlier in its own. Strings are judged on the input; overlaps count. Null text
    is empty; a null doc_id sorts first; different texts of one doc_id are documents that follow each
    other, see keyed(). A text of any length is treated whole, in one task. Other columns are ignored. No documents, no rows.
    """

    def digest(laid, gone):
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        return len(gone), int(gone.sum()), spans, hashlib.sha256(_left(laid, gone)).hexdigest()

    texts, names = keyed(docs)
    out = Factors(min_bytes).removed(texts, digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return named(out, names).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _left(laid, gone: np.ndarray) -> bytes:
    return np.frombuffer(laid.whole(), np.uint8)[~gone].tobytes() if gone.any() else laid.whole()


def kept_texts(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, n_removed, text) with the repeats cut out of the texts; characters cut in two at an edge go as well."""
    texts, names = keyed(docs)
    return named(kept_of(texts, min_bytes), names).select("doc_id", "n_removed", "text")


def kept_of(texts: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """As kept_texts(), by key: (_id, n_removed, text) from (_id, _text)."""

    def digest(laid, gone):
        return int(gone.sum()), _left(laid, gone).decode("utf-8", "ignore")

    return Factors(min_bytes).removed(texts, digest, "n_removed long, text string")
