"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; documents whose sets have a Jaccard similarity of at
least the threshold are linked.

1. Equal sets become one representative, the smallest doc_id, with a count.
2. In each of RUNS runs a set chooses the tokens whose hash is below 1 / (threshold * size), 1.25 of them
   on average, and goes to their buckets. Two sets above the threshold share a chosen token with
   probability 1 - 1/e at least. Buckets above LIMIT are split again by the tokens chosen under
   another hash, up to DEPTH times; before the first time, members are joined to a few pivots, as in 3, and buckets that are
   one component then, but for a few members that meet all others, are not split. No two runs or depths share a hash: with at most DEPTH choices a
   run finds a link with probability (1 - 1/e)^DEPTH at least, independently of the other runs, and
   RUNS is the number that brings the misses of this step below 1 - RECALL.
3. Buckets with equal members count once. Inside a bucket sketches (one-permutation minima) are
   compared with pivots: what is surely similar to a pivot needs no pivot of its own, since whatever is
   linked to it lies within twice the distance of the pivot and is joined to it, as far as the sketches' estimates hold:
   their error (some 0.04 for 128 cells) is covered by the gap between TIGHT, LOOSE and the threshold, by measurement and
   not by proof. This joins candidates into components without listing pairs. Huge buckets are dealt in parts that all meet the
   same pivots, round by round.
4. Inside each candidate component every pair is decided exactly, by products of blocks of the
   sets' incidence matrix. Links are counted there, for each document, and classes are the components of
   the exact links. Large components are split into bands of set sizes, which are compared with themselves and the
   next only, and dealt as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, grouped, keyed, let_go, mix, named, saved, spread_join, text_bytes, tidy, words_of
from ._windows import sorted_by
from .components import components

SHINGLE, THRESHOLD = 5, 800  # words; thousandths
RECALL, DEPTH, LIMIT = 0.98, 3, 500
RUNS = 16
SKETCH = 128
#: Sketch likeness from which a member is surely / possibly near a pivot.
TIGHT, LOOSE = 0.86, 0.5
#: Pivots that members of a bucket above LIMIT meet before it is split, about, and the members of the parts in which they do.
FIRST, PART = 32, 2000
#: Members above which a bucket is dealt in parts, and the pivots that all its parts meet in a round.
HUGE, PIVOTS = 50_000, 1000
#: Most rows and shingles of a block in the exact step.
BLOCK_ROWS, BLOCK_SHINGLES = 2000, 2_000_000

assert (1 - (1 - 1 / math.e) ** DEPTH) ** RUNS < 1 - RECALL


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE):
    """For runs of texts: (first text, owner of each shingle, hash), sorted by owner and hash, each once.

    A text of one to size - 1 words has one shingle, all its words; a text without words has none.
    """
    for i, j in blocks(at):
        codes, _, _, edges = words_of(data, at[i : j + 1])
        count = np.diff(edges)
        start = np.flatnonzero(_in_whole(edges, size, len(codes)))
        short = np.flatnonzero((count > 0) & (count < size))
        owner = np.concatenate((np.searchsorted(edges, start, side="right") - 1, short))
        hashes = np.concatenate((_chained(codes, start, np.full(len(start), size)), _chained(codes, edges[:-1][short], count[short])))
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))) if len(owner) else np.zeros(0, bool)
        yield i, j, owner[new], hashes[new]


def _in_whole(edges: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether a run of `size` codes starts at each code and ends in its text."""
    keep = np.zeros(n + 1, np.int32)
    some = np.diff(edges) >= size
    np.add.at(keep, edges[:-1][some], 1)
    np.add.at(keep, edges[1:][some] - size + 1, -1)
    return np.cumsum(keep[:-1]) > 0


def _chained(codes: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each run of codes, one code after the other through a keyed finaliser."""
    out = mix(count.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(int(count.max()) if len(count) else 0):
        on = slice(None) if len(count) and count.min() > k else np.flatnonzero(count > k)
        out[on] = mix(out[on] ^ (codes[start[on] + k] + np.uint64(0xD1342543DE82EF95)))
    return out


#: The columns of the tokens chosen at each depth.
CHOSEN = [f"chosen{depth}" for depth in range(DEPTH)]
_DESCRIBED = "_id long, name binary, size long, sketch binary, " + ", ".join(f"{c} array<struct<r:int,t:long>>" for c in CHOSEN)
#: Of each depth and run.
_SALTS = mix(np.arange(100, 100 + DEPTH * RUNS, dtype=np.uint64))
_A = pa.struct([("r", pa.int32()), ("t", pa.int64())])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: its set's name (16 bytes), size, sketch, and the tokens it chooses under each salt."""
    for batch in batches:
        data, at = text_bytes(batch.column("_text"))
        n = len(at) - 1
        size, name, sketch = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, SKETCH), np.uint8)
        parts = []
        for i, _, owner, hashes in shingles(data, at):
            if not len(owner):
                continue
            owner = owner + i
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            who = owner[first]
            size[who] = np.diff(np.append(first, len(owner)))
            name[who, 0] = np.add.reduceat(mix(hashes), first)
            name[who, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)
            # sorted hashes: the first of each range of high bits is the range's minimum
            mixed = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
            order = np.lexsort((mixed, owner))
            low, its = mixed[order], owner[order]
            cell = (low >> np.uint64(57)).astype(np.int64)
            f = np.flatnonzero(np.concatenate(([True], (its[1:] != its[:-1]) | (cell[1:] != cell[:-1]))))
            sketch[its[f], cell[f]] = 1 + (low[f] % np.uint64(255)).astype(np.uint8)
            share = 2.0**64 * 1000 / (THRESHOLD * size[owner])
            most = np.where(share >= 2.0**64, np.uint64(2**64 - 1), np.minimum(share, 2.0**63 * 1.9999).astype(np.uint64))
            for r in range(len(_SALTS)):
                g = mix(hashes ^ _SALTS[r])
                k = np.flatnonzero(g <= most)
                parts.append((owner[k], np.full(len(k), r, np.int32), mix(hashes[k] + _SALTS[r])))
        owner, run, token = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
        order = np.argsort(owner, kind="stable")
        chosen = []
        for depth in range(DEPTH):
            k = order[run[order] // RUNS == depth]
            offsets = np.searchsorted(owner[k], np.arange(n + 1)).astype(np.int32)
            chosen.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(run[k] % RUNS), pa.array(token[k].view(np.int64))], names=["r", "t"])))
        raw, marks = name.tobytes(), sketch.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array([raw[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), pa.array(size), pa.array([marks[SKETCH * i : SKETCH * (i + 1)] for i in range(n)], pa.binary()), *chosen],
            names=["_id", "name", "size", "sketch", *CHOSEN],
        )


def _buckets(sets: DataFrame) -> DataFrame:
    """(path, rep, n) of the buckets to look into, each with two members or more (n), no two alike."""
    return _split(sets, None)[0]


def _split(sets: DataFrame, sketches: DataFrame | None, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Buckets as _buckets() gives them, and (a, b) joining members of larger buckets that met pivots before they were split (none without sketches).

    chosen: a table with the tokens of all sets, and maybe of others, if reading it costs less than reading sets.
    """
    level = sets.select("rep", F.explode(CHOSEN[0]).alias("x")).select("rep", F.col("x.r").alias("r"), F.col("x.t").alias("path"))
    out, counts, edges, chosen = None, None, None, sets if chosen is None else chosen
    sized = lambda rows: saved(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("members")).filter("n > 1"))

    def taken(rows, some):
        nonlocal out, counts
        found = spread_join(rows, some.select("path", "n"), "path", "n").select("path", "rep")
        out, counts = (found, some) if out is None else (out.union(found), counts.union(some))

    def larger(rows, sizes):
        return spread_join(rows, sizes.filter(F.col("n") > LIMIT).select("path", "n"), "path", "n").select("rep", "r", "path", "n")

    for depth in range(1, DEPTH + 1):
        level = saved(level)
        sizes = sized(level)
        let_go(sets.sparkSession)
        taken(level, sizes if depth == DEPTH else sizes.filter(F.col("n") <= LIMIT))
        if depth == DEPTH or sizes.filter(F.col("n") > LIMIT).isEmpty():
            break
        start = larger(level, sizes)
        if sketches is not None and depth == 1:  # later, a meeting costs more disk than it saves
            level, edges = _thinned(start, sketches)
            sizes = sized(level)
            let_go(sets.sparkSession)
            taken(level, sizes.filter(F.col("n") <= LIMIT))
            start = larger(level, sizes)
        tokens = chosen.select("rep", F.explode(CHOSEN[depth]).alias("x")).select("rep", F.col("x.r").alias("r"), F.col("x.t").alias("t"))
        level = start.join(tokens, ["rep", "r"]).select("rep", "r", F.xxhash64("path", "t").alias("path"))
    once = saved(counts.groupBy("n", "members").agg(F.min("path").alias("path")).select("path", "n"))
    return spread_join(out, once, "path", "n"), edges


def _thinned(rows: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, r, path) of the members of large buckets (rows, with n) that have to be split, and (a, b) joining members.

    A group of near copies would meet again in all the smaller buckets, as many times as its members choose tokens. So
    members meet about FIRST pivots of their bucket: what is surely near one leaves. A bucket that they join to one component,
    but for a few others, is not split: these are pivots to all its members, and two members of one component need not meet.
    """
    rows = saved(rows.join(sketches, "rep"))
    met = saved(_met(rows, rows.filter(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / FIRST)) == 0)))
    left = met.filter("not tight and not pivot").select(F.col("b").alias("rep"), "r", "path", F.col("a").alias("label"))
    of_label = left.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))
    shape = of_label.groupBy("path").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"))
    shape = saved(shape.withColumn("ends", (F.col("others") <= PIVOTS) & (F.col("others") * 4 <= F.col("n"))))
    left, edges = saved(spread_join(left, shape, "path", "n")), met.filter("a != b").select("a", "b")
    ending = left.filter(F.col("ends") & (F.col("others") > 0))
    if not ending.isEmpty():
        ending = saved(rows.join(ending.select("path", "rep", (F.col("label") != F.col("most")).alias("other")), ["path", "rep"]))
        edges = edges.union(_met(ending, ending.filter("other")).filter("a != b").select("a", "b"))
    return left.filter(~F.col("ends")).select("rep", "r", "path"), edges


def _met(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """What _against_pivots() gives for buckets (path, r, rep, sketch, n members) dealt in parts that all meet the bucket's pivots, some of its rows."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    members = rows.select("path", F.pmod(F.xxhash64("rep", F.lit("part")), parts).cast("int").alias("salt"), "r", "rep", "sketch", F.lit(False).alias("pivot"))
    pivots = pivots.select("path", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), "r", "rep", "sketch", F.lit(True).alias("pivot"))
    return sorted_by(members.union(pivots).withColumn("part", F.xxhash64("path", "salt")), "part").mapInArrow(tidy(_against_pivots), _MET)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, sorted by path -> (a, b): each member with the smallest member it is joined to."""
    for t in grouped(batches, "path"):
        path, rep = (t.column(c).to_numpy() for c in ("path", "rep"))
        order = np.lexsort((rep, path))
        path, rep = path[order], rep[order]
        marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        start = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        a, b = [], []
        for i, j in zip(start.tolist(), np.append(start[1:], len(path)).tolist(), strict=True):
            label = candidates(marks[order[i:j]])
            away = np.flatnonzero(label != np.arange(j - i))
            a.append(rep[i + label[away]])
            b.append(rep[i + away])
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack((a, b), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def candidates(marks: np.ndarray) -> np.ndarray:
    """For each sketch the index of the first one that it is joined to, over pivots."""
    label, left, used = np.arange(len(marks)), np.ones(len(marks), bool), marks > 0
    for p in range(len(marks)):
        if left[p] and label.any():
            like = _likeness(marks, used, marks[p])
            left[like >= TIGHT] = False
            left[p] = False
            _unite(label, np.flatnonzero(like >= LOOSE))
    return label


def _likeness(marks: np.ndarray, used: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of each sketch to one."""
    equal = ((marks == pivot) & used).sum(axis=1)
    return equal / np.maximum(1, (used | (pivot > 0)).sum(axis=1))


def _unite(label: np.ndarray, hit: np.ndarray) -> None:
    old = np.unique(label[hit])
    if len(old) > 1:
        label[np.isin(label, old)] = old[0]


_MET = "path long, r int, a long, b long, tight boolean, pivot boolean"


def _against_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of huge buckets, sorted by `part`, each with all of the round's pivots -> (path, r, a, b, tight, pivot): b is joined to a, a pivot if to anyone else, and whether it is surely near a pivot."""
    for t in grouped(batches, "part"):
        path, salt, r, rep, pivot = (t.column(c).to_numpy(zero_copy_only=False) for c in ("path", "salt", "r", "rep", "pivot"))
        marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((rep, ~pivot, salt, path))
        start = np.flatnonzero(np.concatenate(([True], (np.diff(path[order]) != 0) | (np.diff(salt[order]) != 0))))
        for i, j in zip(start.tolist(), np.append(start[1:], len(order)).tolist(), strict=True):
            k = order[i:j]
            own, used, label, tight = marks[k], marks[k] > 0, np.arange(len(k)), np.zeros(len(k), bool)
            for p in np.flatnonzero(pivot[k]):
                like = _likeness(own, used, own[p])
                tight |= like >= TIGHT
                _unite(label, np.flatnonzero(like >= LOOSE))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (path[k], r[k], rep[k][label], rep[k], tight, pivot[k])], names=["path", "r", "a", "b", "tight", "pivot"])


def pivoted(buckets: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b) joining the members of huge buckets (path, rep, n), dealt in parts of about HUGE members.

    As in candidates(), but round by round: all parts meet the same PIVOTS or so pivots, members surely
    near one need not become pivots, and the rest goes on until nobody is left.
    """
    parts = F.ceil(F.col("n") / HUGE).cast("int")
    full = saved(buckets.join(sketches, "rep").select("path", "rep", "sketch", parts.alias("parts")))
    left, edges, turn = full.select("path", "rep"), None, 0
    members = full.select("path", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("salt"), "rep", "sketch", F.lit(False).alias("pivot"))
    while True:
        share = left.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / PIVOTS).alias("m"))
        drawn = left.join(share, "path").filter(F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("m")) == 0).select("path", "rep")
        pivots = full.join(drawn, ["path", "rep"]).select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "rep", "sketch", F.lit(True).alias("pivot"))
        both = members.union(pivots).withColumn("r", F.lit(0)).withColumn("part", F.xxhash64("path", "salt"))
        met = saved(sorted_by(both, "part").mapInArrow(tidy(_against_pivots), _MET))
        found = met.filter("a != b").select("a", "b")
        edges = found if edges is None else edges.union(found)
        left = saved(left.join(met.filter("tight").select("path", F.col("b").alias("rep")).distinct(), ["path", "rep"], "left_anti"))
        if left.isEmpty():
            return edges
        turn += 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of candidates, once for each pair of blocks that they take part in.

    part names a component's pair of blocks: of one band of sizes, or of a band and the next. left: the side that a set is on
    (null where all pairs of one block count).
    """
    for batch in batches:
        data, at = text_bytes(batch.column("_text"))
        label, band, rep, n, blocks_, above, below = (batch.column(c).to_pylist() for c in ("label", "band", "_id", "n", "n_blocks", "above", "below"))
        for i, j, owner, hashes in shingles(data, at):
            edges = np.searchsorted(owner, np.arange(j - i + 1))
            rows = []
            for k in range(i, j):
                raw = hashes[edges[k - i] : edges[k - i + 1]].tobytes()
                spread = int(mix(np.array([rep[k]], np.int64).view(np.uint64))[0])
                own = spread % blocks_[k]
                parts = [(2 * band[k], min(own, o), max(own, o), own < o if own != o else None) for o in range(blocks_[k])]
                parts += [(2 * band[k] + 1, own, o, True) for o in range(above[k])]
                parts += [(2 * band[k] - 1, o, own, False) for o in range(below[k])]
                for kind, x, y, left in parts:
                    rows.append((label[k], (kind << 40) | (x << 20) | y, left, rep[k], n[k], raw))
            if rows:
                c = list(zip(*rows, strict=True))
                labels, parts = np.array(c[0], np.int64), np.array(c[1], np.int64)
                key = mix(labels.view(np.uint64) ^ mix(parts.view(np.uint64) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(labels), pa.array(parts), pa.array(c[2], pa.bool_()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.binary())], names=["key", "label", "part", "left", "rep", "n", "tokens"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks, sorted by key -> (rep, links, root): documents linked here, and the smallest representative joined here."""
    for t in grouped(batches, "key"):
        label, part, rep, n = (t.column(c).to_numpy() for c in ("label", "part", "rep", "n"))
        side = t.column("left")
        all_pairs, left = side.is_null().to_numpy(), side.fill_null(False).to_numpy()
        order = np.lexsort((rep, part, label))
        tokens = t.column("tokens").combine_chunks()
        start = np.flatnonzero(np.concatenate(([True], (np.diff(label[order]) != 0) | (np.diff(part[order]) != 0))))
        for i, j in zip(start.tolist(), np.append(start[1:], len(order)).tolist(), strict=True):
            k = order[i:j]
            sets = [np.frombuffer(tokens[int(a)].as_py(), np.uint64) for a in k]
            links, root = decide(sets, n[k], None if all_pairs[k[0]] else left[k])
            yield pa.RecordBatch.from_arrays([pa.array(rep[k]), pa.array(links), pa.array(rep[k][root])], names=["rep", "links", "root"])


def decide(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """For each set the weight of the sets linked to it, and the index of the first set in its component.

    side: None for all pairs; else only pairs of a set of either side.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    left, right = (np.arange(m), np.arange(m)) if side is None else (np.flatnonzero(side), np.flatnonzero(~side))
    if not len(left) or not len(right):
        return np.zeros(m, np.int64), np.arange(m)
    owner = np.repeat(np.arange(m), size)
    token, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(left), len(right)), np.float32)
    step = 2048
    for c in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(place, (c, c + step))
        block = np.zeros((m, step), np.float32)
        block[owner[i:j], place[i:j] - c] = 1
        common += block[left] @ block[right].T
    both = common.astype(np.int64)
    linked = (1000 + threshold) * both >= threshold * (size[left][:, None] + size[right][None])
    linked &= both > 0
    links = np.zeros(m, np.int64)
    if side is None:
        np.fill_diagonal(linked, False)
        links = linked @ weight
        neighbours = lambda ks: np.flatnonzero(linked[ks].any(axis=0))
    else:
        links[left], links[right] = linked @ weight[right], linked.T @ weight[left]
        rank = np.empty(m, np.int64)
        rank[left], rank[right] = np.arange(len(left)), np.arange(len(right))

        def neighbours(ks):
            a, b = ks[side[ks]], ks[~side[ks]]
            return np.concatenate((right[linked[rank[a]].any(axis=0)] if len(a) else a, left[linked[:, rank[b]].any(axis=1)] if len(b) else b))

    root = np.full(m, -1)
    for k in range(m):
        if root[k] < 0:
            root[k], front = k, np.array([k])
            while len(front):
                front = neighbours(front)
                front = front[root[front] < 0]
                root[front] = k
    return links, root


def blocked(sized: DataFrame) -> DataFrame:
    """sized (node, label, size, ...) with the set's band of sizes, and the blocks of that band, the one above and the one below.

    Linked sets' sizes differ by the threshold's share at most, so that they lie in one band or in two that follow each
    other. A component of one block is one band.
    """
    blocks_ = lambda rows, size: F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("long")
    banded = sized.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / math.log(1000 / THRESHOLD)).cast("long"))
    # a component has a band for each factor of 1000 / threshold in size, so the map is small
    bands = banded.groupBy("label", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("all"))
    shape = bands.groupBy("label").agg(F.sum("rows").alias("rows"), F.sum("all").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", blocks_("rows", "all")))).alias("shape"))
    shape = saved(shape.select("label", "rows", (blocks_("rows", "all") > 1).alias("large"), "shape"))
    at = lambda step: F.coalesce(F.try_element_at("shape", F.col("band") + step), F.lit(0)).cast("long")
    own = lambda value, small: F.when(F.col("large"), value).otherwise(F.lit(small)).cast("long")
    found = spread_join(banded, shape, "label", "rows")
    return found.select(*sized.columns, own(F.col("band"), 0).alias("band"), own(at(0), 1).alias("n_blocks"), own(at(1), 0).alias("above"), own(at(-1), 0).alias("below"))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document.

    class_id: the smallest doc_id that links connect with this one (itself, if none). n_links: documents
    with a similarity of at least the threshold; n_copies: those among them with an equal set. Null text
    is empty; texts without words have no links, not even with each other; different texts of one doc_id are
    documents of their own, see keyed(). A null doc_id's class_id is null. A text of any length is one set, described in one
    task. Other columns are ignored. No documents, no rows.
    """
    texts, names = keyed(docs)
    return named(linked_keys(texts), names, _id="doc_id", **{"class": "class_id"}).select("doc_id", "class_id", "n_links", "n_copies")


def linked_keys(texts: DataFrame) -> DataFrame:
    """As linked(), by key: (_id, class, n_links, n_copies) from (_id, _text)."""
    described = saved(texts.mapInArrow(tidy(_described), _DESCRIBED))
    named = described.filter("size > 0").groupBy("name").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    groups = saved(named)
    sets = described.select(F.col("_id").alias("rep"), "size", "sketch", *CHOSEN).join(groups.select("rep", "n"), "rep")
    # sketches and further tokens are joined with representatives only: they need not be theirs alone
    of_all = described.withColumnRenamed("_id", "rep")
    sketches = of_all.select("rep", "sketch")
    found, met = _split(sets.select("rep", *CHOSEN), sketches, of_all)
    found = saved(found)
    let_go(texts.sparkSession)
    near = sorted_by(found.filter(F.col("n") <= HUGE).select("path", "rep").join(sketches, "rep"), "path").mapInArrow(tidy(_joined), "a long, b long")
    huge = found.filter(F.col("n") > HUGE)
    if not huge.isEmpty():
        near = near.union(pivoted(huge, sketches))
    if met is not None:
        near = near.union(met)
    labels = saved(components(near))
    let_go(texts.sparkSession)
    sized = labels.join(sets.select(F.col("rep").alias("node"), "size", "n"), "node")
    members = blocked(sized)
    content = texts.join(members.withColumnRenamed("node", "_id"), "_id").select("_id", "_text", "label", "band", "n_blocks", "above", "below", "n")
    dealt = content.mapInArrow(tidy(_sets), "key long, label long, part long, left boolean, rep long, n long, tokens binary")
    decided = saved(sorted_by(dealt, "key").mapInArrow(tidy(_decided), "rep long, links long, root long"))
    let_go(texts.sparkSession)
    classes = components(decided.select(F.col("root").alias("a"), F.col("rep").alias("b")))
    links = decided.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = groups.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    of_name = of_rep.select("name", F.coalesce("label", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    named = described.select("_id", F.when(F.col("size") > 0, F.col("name")).alias("name"))
    out = spread_join(named, saved(of_name.withColumn("rows", F.col("n_copies") + 1)), "name", "rows", "left")
    return out.select("_id", F.coalesce("class", "_id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))
