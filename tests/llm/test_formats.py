"""Chat formatting, packing, token store, pieces: round trips and brute force."""

import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortsmith.llm import chat_format, packing, piece_tokens, token_store

P = pytest.importorskip("public_tokenizers")

# --- chat formatting

RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}, [("user", "q"), ("assistant", "a")]),
    "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    "dialogue": ({"dialog": {"turns": [{"speaker": "bot", "text": "a"}]}}, [("assistant", "a")]),
    "instruction": ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    "instruction without input": ({"instruction": "i", "input": None, "output": "o"}, [("user", "i"), ("assistant", "o")]),
    "prompt with system": ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    "question": ({"question": "q", "answer": {"b": 1, "a": 2}}, None),
}


def test_layouts_become_turns(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS.values())] + [(90, None), (91, "[1]"), (92, "no json"), (93, '{"other": 1}')]
    got = {}
    for r in chat_format.turns_of(spark.createDataFrame(rows, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["fingerprint"]))
    for i, (_, turns) in enumerate(RECORDS.values()):
        if turns is not None:
            assert [x[:2] for x in got[i]] == turns
    assert got[6] == [(None, None, got[6][0][2])] and got[6][0][2]  # the answer's paths are another layout
    assert all(got[i] == [(None, None, None)] for i in (90, 91, 92)) and got[93][0][:2] == (None, None)


def test_a_fingerprint_ignores_order_and_unknown_paths():
    a = chat_format.selected(chat_format.record_paths({"prompt": "x", "response": "y"}))
    b = chat_format.selected(chat_format.record_paths({"z": {"u": [1]}, "response": "y", "prompt": "x"}))
    assert a == b and a[1].name == "prompt"


def test_tables_select_their_mapping_by_schema(spark):
    t = spark.createDataFrame([(1, "p", "r", "other")], "conv_id long, prompt string, response string, text string")
    assert [(r["turn"], r["role"], r["text"]) for r in chat_format.turns_table(t).orderBy("turn").collect()] == [(0, "user", "p"), (1, "assistant", "r")]
    rows = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, None, None, "y")], "conversation_id long, position int, author string, content string, speaker string")
    assert [tuple(r) for r in chat_format.turns_table(rows).orderBy("turn").collect()] == [(1, 0, "user", "q", False), (1, 1, None, None, False)]
    assert chat_format.selected(chat_format.schema_paths(rows.schema), chat_format.ROW_MAPPINGS)[1].name == "message rows"
    with pytest.raises(ValueError):
        chat_format.turns_table(spark.createDataFrame([(1,)], "conv_id long"))


def test_nulls_in_typed_records_lose_no_conversation(spark):
    """Null answers are empty turns; null and empty lists of turns are conversations without turns."""
    asked = spark.createDataFrame([(1, "q", None), (2, None, None), (3, "q", "a")], "conv_id long, question string, answer string")
    got = {r["conv_id"]: tuple(r)[1:3] for r in chat_format.read_back(chat_format.formatted(chat_format.turns_table(asked))).collect()}
    assert got == {i: expected_digest([("user", q), ("assistant", a)])[:2] for i, q, a in ((1, "q", ""), (2, "", ""), (3, "q", "a"))}
    lists = spark.createDataFrame([(1, [("user", None)]), (2, []), (3, None), (4, [("user", "x"), None])], "conv_id long, messages array<struct<role:string,content:string>>")
    got = {r["conv_id"]: tuple(r)[1:3] for r in chat_format.read_back(chat_format.formatted(chat_format.turns_table(lists))).collect()}
    assert got == {i: expected_digest(t)[:2] for i, t in ((1, [("user", "")]), (2, []), (3, []), (4, [("user", "x")]))}


def test_layouts_of_several_mappings(spark):
    """What one mapping alone explains goes by it; what two explain stays unmapped."""
    one, mapping = chat_format.selected(["messages[].role", "messages[].content", "prompt"])
    assert mapping.name == "messages"
    assert chat_format.selected(["question", "answer", "prompt", "response"])[1] is None


@given(st.lists(st.tuples(st.text("<|\\im_startend>\n xé", max_size=12), st.text("<|\\im_startend>\n xé", max_size=30)), max_size=5))
@settings(max_examples=80, deadline=None)
def test_formatting_is_reversible(turns):
    text = "".join(f"{chat_format.START}{chat_format._role_out(r)}\n{chat_format.escaped(t)}{chat_format.END}\n" for r, t in turns)
    assert [(r, t) for r, t, _ in chat_format.parsed(text)] == turns
    assert text.count(chat_format.START) == text.count(chat_format.END) == len(turns)


def expected_digest(turns):
    body, learned = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_formatted_conversations_read_back(spark, part):
    """With parts of 40 characters conversations go on over many rows."""
    draw = random.Random(1)
    convs = {i: [(draw.choice(["user", "assistant", "system"]), draw.choice(["", "hi <|im_end|>", "a<\\|b", "é🙂" * 9])) for _ in range(draw.randrange(1, 12))] for i in range(20)}
    convs[None] = [("assistant", "x")]
    rows = [(i, k, r, t) for i, turns in convs.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat_format.formatted(table, part)
    assert (formatted.count() > 21 + 3) == (part == 40)  # a row for each conversation, and one for each range that begins inside one
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.read_back(formatted).collect()}
    assert got == {i: expected_digest(t) for i, t in convs.items()}


def test_one_conversation_is_formatted_by_many_tasks(spark):
    turns = [("assistant" if i % 2 else "user", f"turn {i} <|x") for i in range(4000)]
    table = spark.createDataFrame([(5, i, r, t) for i, (r, t) in enumerate(turns)] + [(6, 0, "user", "y")], "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        formatted = chat_format.formatted(table)
        assert formatted.filter("conv_id = 5").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.read_back(formatted).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {5: expected_digest(turns), 6: expected_digest([("user", "y")])}


def test_chat_edges(spark):
    """Null roles and texts are empty, a null turn comes first, ties go by role and text, repeated rows stay."""
    rows = [(1, 2, "b", "y", 0), (1, None, None, None, 0), (1, 2, "a", "z", 0), (1, 2, "a", "z", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss long")
    got = chat_format.read_back(chat_format.formatted(table)).first()
    assert (got["n_turns"], got["turns_sha256"]) == expected_digest([("", ""), ("a", "z"), ("a", "z"), ("b", "y")])[:2]
    assert chat_format.read_back(chat_format.formatted(table.limit(0))).count() == 0


# --- packing


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_boundaries_are_optimal(histogram, buckets):
    got = packing.boundaries(histogram, buckets)
    lengths = sorted(histogram)
    best = min(packing.padding(histogram, [*c, lengths[-1]]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
    assert len(got) <= buckets and got[-1] == lengths[-1] and packing.padding(histogram, got) == best


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def packed(spark, rows, **more):
    return packing.packed(spark.createDataFrame(rows, "doc_id long, text string, n long"), P.path("word_bpe_49k.json"), **more)


def test_every_token_is_packed_once_and_batches_fit(spark, monkeypatch):
    """Read back from the batches, every document's ids are the tokenizer's; batches are full, ordered and padded."""
    monkeypatch.setattr(packing, "SHARD", 500)
    monkeypatch.setattr(packing, "_EMPTY", 3)
    draw = random.Random(2)
    texts = {i: " ".join(draw.choice(WORDS) for _ in range(draw.choice([0, 1, 3, 10, 40, 99, 250]))) for i in range(120)} | {500: None, 501: "", 502: "x " * 3000}
    batches = packed(spark, [(i, t, 0) for i, t in texts.items()], max_tokens=100, buckets=4, budget=256, pad_id=7).persist()
    rows = batches.collect()
    for r in rows:
        if not r["bucket"]:
            assert r["n"] <= 3 and r["ids"] == b"" and set(r["lengths"]) == {0}
            continue
        assert 0 < r["n"] * r["bucket"] <= 256 and max(r["lengths"]) <= r["bucket"] and r["lengths"] == sorted(r["lengths"])
        ids = np.frombuffer(r["ids"], "<u2").reshape(r["n"], r["bucket"])
        assert r["padding"] == ids.size - sum(r["lengths"]) and all((x[k:] == 7).all() for x, k in zip(ids, r["lengths"], strict=True))
    assert len({(r["bucket"], r["shard"], r["batch"]) for r in rows}) == len(rows) and len({r["bucket"] for r in rows} - {0}) <= 4
    parts = {}
    for r in rows:
        if r["bucket"]:
            parts.setdefault((r["bucket"], r["shard"]), []).append((r["batch"], r["n"]))
    for (bucket, _), got in parts.items():  # all but the last batch of a shard are full
        got.sort()
        assert [k for k, _ in got] == list(range(len(got))) and all(n == 256 // bucket for _, n in got[:-1])
    found = {}
    for r in packing.unpacked(batches).collect():
        found.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]))
    for i, ids in library_ids(texts).items():
        pieces = sorted(found[i])
        assert [(p, s) for p, s, *_ in pieces] == [(k, 100 * k) for k in range(len(pieces))]
        assert np.frombuffer(b"".join(x[4] for x in pieces), "<u2").tolist() == ids
        assert all(x[2] == len(x[4]) // 2 and x[3] == len(ids) and x[5] == zlib.crc32(np.frombuffer(x[4], "<u2").astype("<u4")) for x in pieces)
    histogram = {}
    for pieces in found.values():
        for x in pieces:
            histogram[x[2]] = histogram.get(x[2], 0) + 1
    histogram.pop(0)
    assert sum(r["padding"] for r in rows) == packing.padding(histogram, packing.boundaries(histogram, 4))


def test_packing_edges(spark):
    """Null and repeated ids, ties (in order of id), no tokens, no rows."""
    rows = [(None, "a b", 1), (1, None, 2), (2, "", 3), (5, "a", 4), (5, "a", 4), (5, "c", 4), (4, "a", 0)]
    found = sorted(((r["doc_id"], r["n_tokens"], r["bucket"], r["slot"]) for r in packing.unpacked(packed(spark, rows)).collect()), key=str)
    assert found == sorted([(None, 2, 2, 0), (1, 0, None, None), (2, 0, None, None), (4, 1, 1, 0), (5, 1, 1, 1), (5, 1, 1, 2)], key=str)
    assert packed(spark, rows[:0]).count() == 0 and packing.unpacked(packed(spark, rows[2:3])).count() == 1
    with pytest.raises(ValueError):
        packed(spark, rows, budget=0)


# --- token store

WORDS = ["the", "The", "dog's", "can't", "x1y22", "née", "naïve.", "日本語", "<|endoftext|>", "a b", "...", "¿qué?", "ÀÉ", "½", "don’t", "_", "\x1c", "I'LL"]


def make_texts():
    draw = random.Random(3)
    shared = " ".join(draw.choice(WORDS) for _ in range(800))
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 200))) for _ in range(40)]
    return {3 * i - 9: t for i, t in enumerate([*texts, shared, shared + " end", "more " + shared, "", None, " \n"])}


def test_store_reads_back_what_the_tokenizer_says(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, name = make_texts(), P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([*texts.items(), (None, "null id")], "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/store"
    root = token_store.write(docs, path, name)
    token_store.verify(spark, path, root)
    assert len(root) == 64
    tokenizer, expected, start = Tokenizer.from_file(name), {}, 0
    for i, t in sorted([*texts.items(), (None, "null id")], key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        expected[i] = (start, ids)
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.checksums(spark, path).collect()}
    assert got == {i: (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, (s, x) in expected.items()}
    rebuilt = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in token_store.texts_ids(spark, path).collect()}
    assert rebuilt == {i: x for i, (_, x) in expected.items()}
    stored = token_store.chunks(spark, path)
    assert stored.count() == stored.select("digest").distinct().count()
    used = token_store.recipes(spark, path).select(F.explode("digests").alias("digest"))
    assert stored.count() == used.distinct().count() < used.count()


def test_store_notices_changes(spark, tmp_path):
    path, other = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    token_store.write(docs, path, P.path("word_bpe_49k.json"))
    (spark.read.parquet(f"{path}/parts").withColumn("body", F.when(F.col("body").isNotNull(), F.concat("body", F.lit(b"\0\0")))).write.partitionBy("kind").parquet(f"{other}/parts"))
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{other}/{name}")
    with pytest.raises(Exception, match="other content"):
        token_store.checksums(spark, other).collect()
    wrong = f"file://{tmp_path}/c"
    spark.read.parquet(f"{path}/recipes").withColumn("start", F.col("start") + 1).write.parquet(f"{wrong}/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{wrong}/manifest")
    with pytest.raises(ValueError):
        token_store.verify(spark, wrong)


def test_the_root_notices_recipes_and_manifest_changed_together(spark, tmp_path, monkeypatch):
    """Trees of several levels, with two nodes under one; the other store is sound in itself."""
    monkeypatch.setattr(token_store, "FAN", 2)
    rows = [(i, f"text {i} " * (i + 1)) for i in range(9)]
    roots = []
    for k, changed in enumerate((rows, [*rows[:4], (4, "another text"), *rows[5:]])):
        roots.append(token_store.write(spark.createDataFrame(changed, "doc_id long, text string"), f"file://{tmp_path}/{k}", P.path("word_bpe_49k.json")))
        token_store.verify(spark, f"file://{tmp_path}/{k}", roots[k])
    with pytest.raises(ValueError, match="root"):
        token_store.verify(spark, f"file://{tmp_path}/1", roots[0])
    manifest = spark.read.parquet(f"file://{tmp_path}/0/manifest")
    top = F.when(F.col("segment") == -1, F.lit(roots[1])).otherwise(F.col("root"))
    manifest.withColumn("root", top).write.parquet(f"file://{tmp_path}/2/manifest")
    spark.read.parquet(f"file://{tmp_path}/0/recipes").write.parquet(f"file://{tmp_path}/2/recipes")
    with pytest.raises(ValueError, match="root"):
        token_store.verify(spark, f"file://{tmp_path}/2")


def test_words_of_equal_rolling_hash_have_their_own_ids():
    from tokenizers import Tokenizer

    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    texts = [f"{a} x", f"{b} x", f"{a} {b}", "x" * 200 + " y", "y " + "x" * 200]
    encode, library = token_store.Encoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert encode.by_parts
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(len(k) <= token_store._LONGEST_PART for k in encode.known if isinstance(k, bytes))


def test_parts_of_equal_hash_keep_their_ids(monkeypatch):
    from cohortsmith.llm import _common

    texts = [b"understanding notwithstanding two", b"two notwithstanding", b"understandings"]
    right = token_store.Encoder(P.path("word_bpe_49k.json"))(texts)
    encode = token_store.Encoder(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(_common, "span_codes", lambda data, start, stop: np.zeros(len(start), np.uint64))
    assert encode(texts) == right and len(encode.known) >= 4


def test_a_tokenizer_that_cuts_otherwise_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    data = json.load(open(P.path("word_bpe_49k.json")))
    data["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(data))
    encode, library = token_store.Encoder(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    texts = ["The Cat's hat", "ÀÉ née", "can't 12"]
    assert not encode.by_parts
    assert [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_different_texts_of_one_id_are_stored(spark, tmp_path):
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/store"
    rows = [(None, "one two three"), (None, "four"), (None, "four"), (None, None), (7, "five"), (7, "six seven")]
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    token_store.verify(spark, path)
    stored = lambda x: sorted(str(i) for i in x)
    assert stored(r["doc_id"] for r in token_store.checksums(spark, path).collect()) == stored([None, None, None, 7, 7])
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()[:-1]) for r in token_store.texts_ids(spark, path).collect()]
    assert stored(got) == stored((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in {(i, t or "") for i, t in rows})


def test_an_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    token_store.verify(spark, path)
    assert token_store.checksums(spark, path).count() == 0


def test_cuts_depend_on_content(monkeypatch):
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 1000, 5000).astype(np.uint16)
    shifted = np.concatenate((draw.integers(0, 1000, 37).astype(np.uint16), ids))
    a, b = token_store.cuts(ids, np.array([0, 5000])), token_store.cuts(shifted, np.array([0, 5037]))
    assert len(a) > 5 and set(a) <= set(b - 37)
    assert token_store.cuts(np.zeros(10_000, np.uint16), np.array([0, 0, 10_000, 10_000])).tolist()[-1] == 10_000
    monkeypatch.setattr(token_store, "LONGEST", 100)
    assert np.diff(token_store.cuts(ids, np.array([0, 5000])), prepend=0).max() <= 100


@given(st.lists(st.binary(max_size=50), max_size=6))
@settings(max_examples=60, deadline=None)
def test_checksums_of_parts_make_the_whole(parts):
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))], np.int64)
    terms = token_store.moved(np.array([zlib.crc32(p) for p in parts], np.uint64), after)
    assert int(np.bitwise_xor.reduce(terms, initial=0)) == zlib.crc32(b"".join(parts))


# --- pieces


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public model as a unigram model, so that the library itself looks for the highest sum of scores.

    The score of the lone mark is raised above -1e9, beside which the library's 32-bit sums lose the others.
    """
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.piece == "▁":
            p.score = -40_000
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


ODD = ["", " ", "  ", " a", "a ", "a  b", "  a  b  ", "\n\n x", "日本語 한국어", "🙂 a🙂b", "a\tb\r\n", "\u0000 z", "x" * 300]


def test_segmentation_is_the_librarys_best(unigram):
    import sentencepiece

    library, own, draw = sentencepiece.SentencePieceProcessor(model_file=unigram), piece_tokens.Pieces(unigram), random.Random(5)
    texts = ODD + [" ".join("".join(draw.choice(["the", "an", "er", "x", "é", "ing", "☃", "7", "."]) for _ in range(draw.randrange(1, 6))) for _ in range(30)) for _ in range(60)]
    for t in texts:
        assert np.frombuffer(own(t), "<u4").tolist() == library.encode(t), t


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_pieces_give_every_text_back(text):
    own = pieces()
    text = text.encode("utf-8", "ignore").decode()
    assert own.decode(np.frombuffer(own(text), "<u4")) == text
    marked = f"▁{text}▁ ▁"
    assert own.decode(np.frombuffer(own(marked), "<u4")) == marked


_PIECES = []


def pieces():
    if not _PIECES:
        _PIECES.append(piece_tokens.Pieces(P.path("piece_bpe_32k.model")))
    return _PIECES[0]


def test_viterbi_against_all_segmentations():
    own = pieces()
    score = {s: own.score[i] for i, s in enumerate(own.surface) if s in own.automaton}

    def best(unit):
        ways = [0.0]
        for end in range(1, len(unit) + 1):
            ways.append(max(ways[s] + (score.get(unit[s:end]) if unit[s:end] in score else own.lowest if end - s == 1 else -np.inf) for s in range(end)))
        return ways[-1]

    for unit in ["▁the", "▁international", "▁☃snow", "▁x☃☃", "▁▁▁a", "▁qqzzjx"]:
        assert sum(own.score[i] if i >= 0 else own.lowest for i in own.best(unit)) == best(unit)


def test_piece_digests(spark):
    rows = [(1, "the dog"), (None, None), (1, "the dog"), (2, "▁ x")]
    got = piece_tokens.digests(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()
    assert len(got) == 4 and all(r["exact"] for r in got) and {r["doc_id"] for r in got} == {1, None, 2}
    ids = piece_tokens.encoded(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()
    assert [r["decoded"] for r in ids] == ["the dog", "", "the dog", "▁ x"]


def test_pieces_of_very_long_texts_and_of_none(spark):
    """A unit of 200,000 letters, and a text of as many words; no rows."""
    draw = random.Random(4)
    texts = {1: "".join(draw.choice("abcdefgh") for _ in range(200_000)), 2: " ".join(draw.choice(["the", "dog", "☃"]) for _ in range(200_000))}
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, ids long")
    got = {r["doc_id"]: r for r in piece_tokens.digests(docs, P.path("piece_bpe_32k.model")).collect()}
    assert all(got[i]["exact"] and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
    assert piece_tokens.digests(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0
    own = pieces()
    own(texts[1])
    assert max(map(len, own.units), default=0) <= piece_tokens._LONGEST


def test_a_very_long_text_is_stored(spark, tmp_path):
    draw = random.Random(6)
    texts = {1: " ".join(draw.choice(WORDS) for _ in range(100_000)), 2: "ab" * 100_000}
    path = f"file://{tmp_path}/store"
    token_store.write(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    token_store.verify(spark, path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in token_store.texts_ids(spark, path).collect()}
    assert got == {i: [*ids, 2] for i, ids in library_ids(texts).items()}
