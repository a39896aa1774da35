"""The two exact substring operators against brute force, and their parts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortsmith.llm import _windows, substring_dedup, suffix_dedup
from cohortsmith.llm._common import BYTE_CODES, word_spans


def corpus(draw, n=40, letters="ab ", blocks=6):
    """Texts that share passages of various lengths, with small alphabets, so that everything repeats."""
    shared = ["".join(draw.choice("abcdef ") for _ in range(draw.randrange(20, 260))) for _ in range(blocks)]
    texts = []
    for _ in range(n):
        text = "".join(draw.choice([*shared, "".join(draw.choice("xyzé ") for _ in range(draw.randrange(0, 80)))]) for _ in range(draw.randrange(0, 5)))
        texts.append(text[draw.randrange(0, 30) :])
    return [*texts, *texts[:3], "", "a" * 350, " " * 150, None]


def removed_bytes(texts, length):
    """(n_bytes, n_removed, n_spans, digest) by looking at every string."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def removed_words(texts, window):
    first, docs = {}, [(t or "").encode().split() for t in texts]
    for d, words in enumerate(docs):
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), d)
    out = []
    for d, words in enumerate(docs):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed):
    texts = corpus(random.Random(seed))
    docs = spark.createDataFrame([(3 * i - 20, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {3 * i - 20: x for i, x in enumerate(removed_bytes(texts, 100))}
    assert sum(x[1] for x in got.values()) > 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    draw = random.Random(seed)
    texts = corpus(draw) + [" ".join(draw.choice(["a", "b", "c"]) for _ in range(draw.randrange(0, 60))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(removed_words(texts, 13)))
    assert sum(x[1] for x in got.values()) > 100


def test_crowded_anchors_are_dealt_by_content(spark, monkeypatch):
    whole = suffix_dedup.Factors
    monkeypatch.setattr(suffix_dedup, "Factors", lambda n: whole(n, split=2))
    draw = random.Random(7)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(draw.choice("ijkl") for _ in range(20)) + draw.choice(["u", "v"]) * 6 + passage + draw.choice(["x", "y"]) * 8 for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(removed_bytes(texts, 100)))


def test_crowded_anchors_of_words(spark, monkeypatch):
    whole = substring_dedup.Levels
    monkeypatch.setattr(substring_dedup, "Levels", lambda n: whole(n, split=2))
    draw = random.Random(8)
    passage = [f"p{i}" for i in range(14)]
    texts = [" ".join([draw.choice(["a", "b"]) for _ in range(5)] + passage[draw.randrange(3) :] + [draw.choice(["c", "d"]) for _ in range(4)] + (passage if i % 9 == 0 else [])) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(removed_words(texts, 13)))


def test_edges(spark):
    """Null ids come first, repeated rows are one document, other columns don't matter, an empty table has no rows."""
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    docs = spark.createDataFrame([(5, text, "x"), (None, text, "y"), (7, None, "z"), (5, text, "x")], "doc_id long, text string, runs string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {None: 0, 5: len(text), 7: 0}
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert words == {None: 0, 5: 0, 7: 0}
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.kept_texts(docs).collect()} == {None: text, 5: "", 7: ""}


def test_different_texts_of_one_id_are_documents(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    docs = spark.createDataFrame([(None, "a"), (None, ""), (None, text), (3, text), (3, "b"), (3, "b")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [("3", 1, 0), ("3", len(text), len(text)), ("None", 0, 0), ("None", 1, 0), ("None", len(text), 0)]
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in substring_dedup.remove_repeats(docs).collect()) == [("3", 1), ("3", 1), ("None", 0), ("None", 1), ("None", 1)]


@given(st.binary(max_size=40).map(lambda b: bytes(97 + x % 3 for x in b)))
@settings(max_examples=60, deadline=None)
def test_longest_previous_factors(text):
    expected = [max((next((k for k in range(len(text) - p) if text[q + k] != text[p + k]), len(text) - p) for q in range(p)), default=0) for p in range(len(text))]
    assert suffix_dedup.lpf_array(text) == expected
    order = suffix_dedup.suffix_array(text).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_anchors_depend_on_the_window_alone():
    draw = np.random.default_rng(1)
    part = draw.integers(97, 101, 300, dtype=np.uint8)
    a, b = np.concatenate((draw.integers(97, 101, 77, dtype=np.uint8), part)), part
    offsets = []
    for data, shift in ((a, 77), (b, 0)):
        _, start, count, offset = _windows.anchors(BYTE_CODES[data], np.array([0, len(data)]), 100, 32)
        offsets.append({int(p) - shift: int(s + o) - shift for s, n, o in zip(start, count, offset, strict=True) for p in range(s, s + n)})
        assert sorted(offsets[-1]) == list(range(-shift, 201))
    assert all(offsets[0][p] == offsets[1][p] for p in range(201))


def test_very_long_sequences_fall_into_pieces(monkeypatch):
    draw = np.random.default_rng(2)
    codes, edges = BYTE_CODES[draw.integers(97, 99, 3000, dtype=np.uint8)], np.array([0, 1200, 1200, 3000])
    whole = _windows.anchors(codes, edges, 50, 20)
    parts = _windows._pieces(codes, edges, 50, 20)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def collided():
    """Two words of 1,024 letters that agree under every polynomial hash modulo 2**64 with an odd base."""
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    return a, b


def test_words_of_equal_rolling_hash_are_different_words(spark):
    a, b = collided()
    rest = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(" ".join([*rest[:6], x, *rest[6:]]) for x in (a, b, a))), "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()) == [(0, 0), (1, 0), (2, 13)]
    windows = [" ".join("pq"[c == "b"] for c in x) for x in (a, b)]  # the same at the level of windows
    docs = spark.createDataFrame(list(enumerate(windows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(removed_words(windows, 13)))


@pytest.mark.parametrize("window", [3, 7, 13, 40])
def test_levels_of_any_window_against_brute_force(spark, window):
    """Windows longer than two levels, and shorter than one; passages that break off at each level's length."""
    draw = random.Random(window)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join(f"{d}x{k}" for k in range(5)) + " " + " ".join(passage[a : a + n]) + f" {d}y" for d, (a, n) in enumerate((draw.randrange(40), draw.choice([2, 6, 8, 12, 14, 21, 39, 41, 50])) for _ in range(30))]
    texts += [" ".join(draw.choice(["a", "b"]) for _ in range(70)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, window).collect()}
    assert got == dict(enumerate(removed_words(texts, window)))


def test_levels_double_and_end_where_no_candidate_is_left(spark, monkeypatch):
    assert [substring_dedup.lengths(n) for n in (5, 13, 100)] == [[5], [7, 13], [7, 13, 25, 50, 100]]
    words = [f"p{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(["x", *words[:20], "y"]), " ".join(f"q{i}" for i in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    seen, own = [], substring_dedup.Levels._surviving
    monkeypatch.setattr(substring_dedup.Levels, "_surviving", lambda self, alive, level: seen.append(level) or own(self, alive, level))
    assert substring_dedup.Levels(100).candidates(docs).count() == 0 and seen == [7]  # 20 words in common: no 100-word window holds that anchor twice
    left = {r["_id"]: r["alive"] for r in substring_dedup.Levels(13).candidates(docs).collect()}
    assert set(left) == {0, 1}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_keys_are_joined_where_they_lie(spark, monkeypatch, how):
    from cohortsmith.llm import _common

    monkeypatch.setattr(_common, "FEW", 5)
    keys = [1] * 400 + [2] * 90 + [*range(3, 60)] * 2 + [None] * 3 + [99]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(3)
    facts = spark.createDataFrame([(k, keys.count(k), f"f{k}") for k in set(keys) - {None, 99}], "k long, n long, f string")
    got = _common.spread_join(rows, facts, "k", "n", how)
    assert got.columns == rows.join(facts, "k").columns
    expected = sorted((str(k), i, f"f{k}" if k in range(1, 60) else None) for i, k in enumerate(keys) if how == "left" or k in range(1, 60))
    assert sorted((str(r["k"]), r["i"], r["f"]) for r in got.collect()) == expected
    assert _common.spread_join(rows.limit(0), facts.limit(0), "k", "n", how).count() == 0


def test_groups_stay_whole():
    import pyarrow as pa

    from cohortsmith.llm._common import grouped

    keys = np.sort(np.random.default_rng(3).integers(0, 50, 4000))
    keys[1000:3000] = keys[1000]
    keys.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 37])], names=["k"]) for i in range(0, 4000, 37)]
    tables = [t.column("k").to_numpy() for t in grouped(iter(batches), "k", 1500)]
    assert (np.concatenate(tables) == keys).all() and len(tables) > 5
    assert all(a[-1] != b[0] for a, b in zip(tables[:-1], tables[1:], strict=True))


def test_white_space_is_ascii():
    data = np.frombuffer(" a\tb\x0bc d\x1fe\r\n".encode(), np.uint8)
    assert len(word_spans(data)[0]) == 3
