"""N-gram Jaccard join and fingerprints against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import components as components_module
from cohortsmith.llm import jaccard_join, simhash
from cohortsmith.llm._common import let_go, saved
from cohortsmith.llm.components import components


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        out[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def expected(texts):
    """{id: (class, links, copies)} by comparing all pairs."""
    sets, parent = sets_of(texts), {i: i for i in texts}
    links = {i: {j for j in texts if j != i and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, js in links.items():
        for j in js:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (root(i), len(links[i]), sum(sets[i] == sets[j] for j in links[i])) for i in texts}


def near_corpus(draw):
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts, passage = [], " ".join(word() for _ in range(40))
    for k in range(14):
        base = [word() for _ in range(draw.choice([3, 30, 120]))]
        for _ in range(draw.choice([1, 2, 6])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                words[draw.randrange(len(words))] = word()
            texts.append(" ".join(words))
        if k % 3 == 0:
            texts.append(" ".join([passage, *(word() for _ in range(60))]))
    return {2 * i + 1: t for i, t in enumerate([*texts, *texts[:4], "", "   ", None, "one", "one"])}


def joined(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.linked(docs).collect()}


@pytest.mark.parametrize("limit", [500, 2])
def test_links_against_all_pairs(spark, monkeypatch, limit):
    """With a limit of 2 almost every bucket is split again."""
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    texts = near_corpus(random.Random(3))
    assert joined(spark, texts) == expected(texts)


def test_recall_where_all_buckets_are_split(spark, monkeypatch):
    """Of 2,000 pairs at J = 0.806 at least RECALL meet in a bucket, with every bucket split up to DEPTH."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 0)
    texts = []
    for i in range(2000):
        words = [f"{i}w{k}" for k in range(200)]
        texts += [" ".join(words), " ".join([*words[:90], *(f"{i}x{k}" for k in range(17)), *words[107:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string").repartition(4)
    described = docs.mapInArrow(jaccard_join._described, jaccard_join._DESCRIBED)
    found = jaccard_join._buckets(described.withColumnRenamed("_id", "rep")).selectExpr("rep div 2 as pair", "path").groupBy("pair", "path").count().filter("count = 2")
    assert found.select("pair").distinct().count() >= jaccard_join.RECALL * 2000


def test_near_copies_are_not_split_further(spark, monkeypatch):
    """A large group of near copies, most of them no more alike than 0.7, meets pivots and isn't dealt to smaller buckets; links stay those of all pairs."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 60)
    monkeypatch.setattr(jaccard_join, "PART", 50)
    draw = random.Random(8)
    base, passage = [f"w{k}" for k in range(150)], [f"p{k}" for k in range(30)]
    texts = {}
    for i in range(200):
        words = list(base)
        for k in draw.sample(range(150), draw.choice([1, 2, 4, 6])):
            words[k] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(200, 300):
        texts[i] = " ".join([*passage, *(f"{i}y{k}" for k in range(draw.choice([5, 20, 60])))])
    texts |= {i: f"{texts[i - 100]} z" for i in range(300, 310)}
    docs = spark.createDataFrame(list(texts.items()), "_id long, _text string").repartition(4)
    sets = docs.mapInArrow(jaccard_join._described, jaccard_join._DESCRIBED).withColumnRenamed("_id", "rep").cache()
    found, edges = jaccard_join._split(sets.select("rep", *jaccard_join.CHOSEN), sets.select("rep", "sketch"))
    assert found.filter("rep < 200").count() < 200
    of_copies = components(edges).filter("node < 200")
    assert of_copies.count() == 200 and of_copies.select("label").distinct().count() == 1
    assert joined(spark, texts) == expected(texts)


def test_huge_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HUGE", 5)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    draw = random.Random(6)
    texts = {}
    for g in range(2):
        base = [f"{g}w{i}" for i in range(50)]
        for i in range(22):
            words = list(base)
            for k in draw.sample(range(50), draw.choice([0, 1, 2])):
                words[k] = f"x{draw.randrange(50)}"
            texts[100 * g + i] = " ".join(words)
    assert joined(spark, texts) == expected(texts)


def test_large_groups_are_decided_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 10)
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        words = list(base)
        for k in draw.sample(range(60), draw.choice([0, 1, 2])):
            words[k] = f"x{draw.randrange(5)}"
        texts[i] = " ".join(words)
    assert joined(spark, texts) == expected(texts)


def test_large_components_fall_into_bands_of_sizes(spark, monkeypatch):
    """A chain of sets, each a little larger than the one before, links across bands; blocks of two rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 2)
    words = [f"w{i}" for i in range(400)]
    texts = {k: " ".join(words[: int(30 * 1.13**k)]) for k in range(20)} | {100 + k: " ".join([*words[:60], f"x{k}"]) for k in range(8)}
    assert joined(spark, texts) == expected(texts)


def test_words_of_equal_rolling_hash_make_no_link(spark):
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    texts = {i: f"p q r {x} s t u" for i, x in enumerate((a, b))}
    assert joined(spark, texts) == expected(texts) == {0: (0, 0, 0), 1: (1, 0, 0)}


def test_very_long_texts(spark):
    """One text of a million words, and near copies of it."""
    words = [f"w{i * 7919 % 1_000_003}" for i in range(1_000_000)]
    texts = {1: " ".join(words), 2: " ".join(["x", *words]), 3: " ".join(words[:500_000])}
    assert joined(spark, texts) == {1: (1, 1, 0), 2: (1, 1, 0), 3: (3, 0, 0)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.compared(docs).collect()}
    assert {i: r["n_chars"] for i, r in got.items()} == {i: len(t) for i, t in texts.items()}
    assert got[2]["near_next"] > 0.95


def test_join_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (9, None, 3), (8, "", 4), (4, "a b c d e f", 2)], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.linked(docs).collect()}
    assert got == {None: (None, 1, 1), 4: (None, 1, 1), 9: (9, 0, 0), 8: (8, 0, 0)}
    assert jaccard_join.linked(docs.limit(0)).count() == 0


def test_different_texts_of_one_id_are_linked_and_printed(spark):
    rows = [(None, "a b c d e f"), (None, ""), (None, "u v w x y z"), (4, "u v w x y z"), (4, "k l m n o p"), (4, "k l m n o p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.linked(docs).collect())
    assert got == [("4", "4", 0), ("4", "None", 1), ("None", "None", 0), ("None", "None", 0), ("None", "None", 1)]
    prints = sorted((str(r["doc_id"]), r["fingerprint"]) for r in simhash.compared(docs).collect())
    assert prints == sorted((str(i), simhash._of([t])[0].tobytes().hex()) for i, t in set(rows))


def test_deciding_a_block():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 30, draw.integers(1, 25)).astype(np.uint64)) for _ in range(40)]
    weight = draw.integers(1, 4, 40)
    side = draw.integers(0, 2, 40) == 1
    for which in (None, side):
        links, root = jaccard_join.decide(sets, weight, which, 500)
        near = np.array([[i != j and (which is None or side[i] != side[j]) and 2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        assert (links == near @ weight).all()
        label = np.arange(40)
        for _ in range(40):
            label = np.array([min([label[i], *label[near[i]]]) for i in range(40)])
        assert (root == label).all()


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(draw.randrange(40, 90), draw.randrange(40, 90)) for _ in range(30)] + [(100, 100)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: x for n, x in label.items() if n != 100}


def test_fingerprints_of_documents_and_their_edits(spark):
    draw = random.Random(1)
    texts = {i * 7 - 30: " ".join(draw.choice(["ab", "cdé", "ef", "日本", "g" * 9]) for _ in range(draw.randrange(0, 60))) for i in range(60)}
    texts |= {1000: "", 1001: "x", 1002: "x y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in simhash.compared(docs).collect()}
    assert set(got) == set(texts)
    ids = sorted(texts, reverse=True)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, half = texts[i], len(texts[i]) // 2
        new = text[: len(text) - half] + texts[j][:half]
        own, other, edit = (simhash._of([t])[0] for t in (text, texts[j], new))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.tobytes().hex(), edit.tobytes().hex())
        assert r["near_edited"] == simhash.likeness(own, edit) and r["near_next"] == simhash.likeness(own, other)


def test_votes_are_weighted():
    """A bit is the sign of the terms' weighted votes."""
    from cohortsmith.llm._common import mix, word_codes

    text = b"aa bb aa bb cccccccccccccc"
    codes, start, end = word_codes(np.frombuffer(text, np.uint8))
    votes = np.zeros(128)
    size = (end - start).tolist()
    terms = [(mix(codes[k : k + 1] + np.uint64(7)), 1 + (size[k] >= 5) + (size[k] >= 8)) for k in range(5)]
    terms += [(mix(codes[k : k + 1] * np.uint64(3) ^ mix(codes[k + 1 : k + 2])), 1 + (size[k] + size[k + 1] >= 8) + (size[k] + size[k + 1] >= 14)) for k in range(4)]
    for term, weight in terms:
        bits = np.concatenate([np.unpackbits(mix(term ^ np.uint64(s)).view(np.uint8)) for s in (0x1B873593CC9E2D51, 0x85EBCA6BE6546B64)])
        votes += weight * (2.0 * bits - 1)
    assert (np.unpackbits(simhash._of([text.decode()])[0]) == (votes > 0)).all()


def test_print_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "u"), (None, None, "v"), (1, "a b", "u")], "doc_id long, text string, fingerprint string")
    assert {r["doc_id"] for r in simhash.compared(docs).collect()} == {None, 1}
    one = simhash.compared(docs.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0 and one["fingerprint"] == simhash._of(["a b"])[0].tobytes().hex()
    assert simhash.compared(docs.limit(0)).count() == 0


def some_prints(seed, n=300, flips=16):
    """Fingerprints, three of four around one, with repeated ones."""
    draw = random.Random(seed)
    base, prints = draw.getrandbits(128), []
    for k in range(n):
        p = base if k % 4 else draw.getrandbits(128)
        for b in draw.sample(range(128), draw.randrange(0, flips)):
            p ^= 1 << b
        prints.append(f"{p:032x}")
    return prints + prints[:3]


def near_by_all_pairs(prints, radius):
    return {p: (prints.count(p), sum(0 < bin(int(p, 16) ^ int(q, 16)).count("1") <= radius for q in prints)) for p in prints}


def near_of(spark, prints, radius=simhash.RADIUS):
    return {r["fingerprint"]: (r["n"], r["n_near"]) for r in simhash.near(spark.createDataFrame([(p,) for p in [*prints, None]], "fingerprint string"), radius).collect()}


@pytest.mark.parametrize("radius", [0, 3, 11, 13, 23])
def test_all_near_prints_are_found(spark, radius):
    prints = some_prints(radius)
    got = near_of(spark, prints, radius)
    assert got == near_by_all_pairs(prints, radius)
    assert sum(n for _, n in got.values()) > (500 if radius > 9 else 5 if radius else -1)
    with pytest.raises(ValueError):
        simhash.near(spark.createDataFrame([], "fingerprint string"), 32)


@pytest.mark.parametrize("shard", [2, 20])
def test_crowded_shards_are_looked_up_by_several_tasks(spark, monkeypatch, shard):
    """Few fingerprints to a shard: many leading bits, so that probes one bit off in these go to other shards, and shards in shares."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    prints = some_prints(5, 200)
    assert near_of(spark, prints) == near_by_all_pairs(prints, simhash.RADIUS)


def test_no_prints(spark):
    assert simhash.near(spark.createDataFrame([], "fingerprint string")).count() == 0


def test_ranges_are_counted_in_steps(spark):
    draw = random.Random(3)
    ids = spark.range(-50, 300)
    for n in (0, 1, 2, 9, 10, 101):
        bounds = sorted(draw.sample(range(-40, 280), n))
        got = {r["id"]: r["x"] for r in ids.select("id", simhash._below(F.col("id"), bounds).alias("x")).collect()}
        assert got == {i: sum(b <= i for b in bounds) for i in range(-50, 300)}


def test_recall_of_near_documents(spark):
    """Of pairs of texts with a 5-word similarity of 0.8 or little more, most are neighbours within the radius."""
    draw, texts = random.Random(9), []
    for _ in range(100):
        words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(draw.choice([60, 200, 400]))]
        edited = list(words)
        for k in draw.sample(range(2, len(words) - 2), len(words) // 50):
            edited[k] = "".join(draw.choice("klmnop") for _ in range(5))
        texts += [" ".join(words), " ".join(edited)]
    sets = sets_of(dict(enumerate(texts)))
    true = [i for i in range(0, 200, 2) if 10 * len(sets[i] & sets[i + 1]) >= 8 * len(sets[i] | sets[i + 1])]
    prints = [x.tobytes().hex() for x in simhash._of(texts)]
    got = {r["fingerprint"]: r["n_near"] for r in simhash.near(spark.createDataFrame([(p,) for p in prints], "fingerprint string")).collect()}
    assert len(true) > 90 and sum(got[prints[i]] > 0 and got[prints[i + 1]] > 0 for i in true) >= 0.85 * len(true)


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars are seen to be done; others, if a node is on both sides or has two smaller neighbours."""
    made = []
    monkeypatch.setattr(components_module, "saved", lambda df: made.append(1) or saved(df))
    for edges, rounds in (([(1, k) for k in range(2, 9)] + [(9, 10), (12, 11)], 0), ([], 0), ([(1, 2), (2, 3)], 1), ([(1, 3), (2, 3)], 1)):
        made.clear()
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: min(x for e in edges for x in e if (n < 9) == (x < 9) and (n < 11) == (x < 11)) for e in edges for n in e}
        assert len(made) - 1 == rounds
    assert {r["node"]: r["label"] for r in components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")).collect()} == dict.fromkeys(range(21), 0)


def test_files_of_finished_steps_go(spark, monkeypatch):
    """The driver of this session has no need to collect garbage: without being told, Spark would keep the shuffle files of all steps."""
    files = lambda: time.sleep(1) or spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    gone = []

    def counted(spark):
        before = files()
        let_go(spark)
        gone.append(before - files())

    monkeypatch.setattr(jaccard_join, "let_go", counted)
    draw = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    texts = {i: " ".join(w if draw.random() > 0.01 else f"x{i}" for w in base) for i in range(200)}
    out = jaccard_join.linked(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert len(gone) > 3 and sum(gone) > 10
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in out.collect()} == expected(texts)
