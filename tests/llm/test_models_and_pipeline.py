"""Quality rules, language ID, and the pipeline."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortsmith.llm import language_id, packing, quality_rules
from test_formats import library_ids
from test_join_and_prints import expected as near_expected
from test_windows import removed_bytes

# --- quality rules


def base(text):
    words, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), sum(c.isupper() for c in text)


TEXTS = ["", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h i " * 3, "x\ny\nx\n\n x\nx", "É#$ ünï|<> A" * 4, "a b " * 40, "p q r s t u v w x y z\x0bé\x1f k", "w " * 7 + "v " * 9]


def test_counts_against_brute_force(spark):
    draw = random.Random(1)
    texts = TEXTS + ["".join(draw.choice(["a ", "b ", "c\n", "Ü", "#"]) for _ in range(draw.randrange(0, 90))) for _ in range(60)]
    rows = quality_rules.counted(spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")).collect()
    for r in rows:
        q = r["_q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["n_upper"]) == base(r["text"] or ""), r["text"]


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (100, 3, 0.05), (5000, 20, 0.005), (5000, 26, 0.005), (0, 0, 0.1)])
def test_binomial_tail_is_exact(spark, n, k, p):
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert got == pytest.approx(1.0 if k > n * p else exact, rel=1e-9)


def labelled(spark, n, good, bad, labels):
    rows = [(i, bad(i) if labels(i) == 0 else good(i)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, labels(i)) for i in range(n)], "doc_id long, quality int")


def words(i, k=30):
    draw = random.Random(i)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(k))


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = labelled(spark, 5000, words, lambda i: words(i).replace(" ", "## "), lambda i: int(i % 10 > 0))
    rows = quality_rules.judged(docs, labels).join(labels, "doc_id").groupBy("quality", F.col("_verdict.kept").alias("kept")).count().collect()
    got = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert got == {(0, False): 500, (1, True): 4500}


def test_without_proof_nothing_goes(spark):
    """Few labels prove no cutoff; labels that have nothing to do with texts prove none that rejects much."""
    docs, labels = labelled(spark, 300, words, lambda i: words(i).replace(" ", "## "), lambda i: int(i % 10 > 0))
    assert quality_rules.judged(docs, labels).filter("not _verdict.kept").count() == 0
    docs, labels = labelled(spark, 4000, words, words, lambda i: int(random.Random(i).random() > 0.3))
    assert quality_rules.judged(docs, labels).filter("not _verdict.kept").count() <= 4000 * 0.01


def test_strata_with_few_labels_take_the_pooled_cutoff(spark):
    """Short documents are too few for a cutoff of their own; all together prove one."""
    bad = lambda i: i % 10 == 0
    text = lambda i: words(i, 30 if i % 50 < 2 else 120)
    docs, labels = labelled(spark, 5000, text, lambda i: text(i).replace(" ", "## "), lambda i: int(not bad(i)))
    model = quality_rules.fit(quality_rules.counted(docs).select("doc_id", "_q"), labels)
    assert model.cutoffs[0] is None and model.cutoffs[1] is not None
    assert {r["doc_id"] for r in quality_rules.judged(docs, labels).filter("not _verdict.kept").collect()} == {i for i in range(5000) if bad(i)}


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, words(1), 1), (1, words(2), 2), (1, words(2), 2)], "doc_id long, text string, kept_before long")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    rows = quality_rules.judged(docs, labels).collect()
    assert sorted((r["doc_id"] is None, r["_verdict"]["kept"]) for r in rows) == [(False, False), (False, True), (False, True), (True, True)]
    assert quality_rules.judged(docs.limit(0), labels.limit(0)).count() == 0


# --- language identification

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["eau", "oux", "ent", "que"]}


def speech(lang, i, k=12):
    draw = random.Random(f"{lang}{i}")
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(k))


def test_held_out_accuracy(spark):
    rows = [(i, speech(lang, i), lang if i % 17 else None) for i, lang in enumerate(["aa", "bb", "cc"] * 100)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    truth = {i: ["aa", "bb", "cc"][i % 3] for i in range(300)}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30 and all(r["lang_pred"] == truth[r["doc_id"]] and 0.5 < r["score"] <= 1 for r in held)


def plain_model(rows, words_most=language_id.WORDS_PER_LANGUAGE, grams_most=language_id.GRAMS_PER_LENGTH):
    """Log frequencies of words and n-grams by language, and what a word scores, by the definition."""
    import re
    from collections import Counter

    counts = {}
    for i, text, lang in rows:
        if lang is None or text is None or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for k in range(1, 5):
                s = w if k == 1 else f"^{w}$"
                for j in range(len(s) - k + 1):
                    counts.setdefault((lang, k), Counter())[s[j : j + k]] += 1
    langs = sorted({lang for lang, _ in counts})
    kept = {key: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: words_most if key[1] == 0 else grams_most]) for key, c in counts.items()}

    def row(k, term):
        if not any(term in kept.get((x, k), ()) for x in langs):
            return None
        return [math.log((kept.get((x, k), {}).get(term, 0) + 0.5) / (sum(counts.get((x, k), {}).values()) + 500)) for x in langs]

    def word(w):
        if (got := row(0, w)) is not None:
            return got
        for k in range(4, 0, -1):
            s = w if k == 1 else f"^{w}$"
            found = [r for j in range(len(s) - k + 1) if (r := row(k, s[j : j + k])) is not None]
            if found:
                return [sum(c) / len(found) for c in zip(*found, strict=True)]
        return [0.0] * len(langs)

    def predicted(text):
        scores = [word(w) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        if not scores:
            return "und", 0.0
        total = [sum(c) for c in zip(*scores, strict=True)]
        best = total.index(max(total))
        return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)

    return predicted


@pytest.mark.parametrize("most", [(10_000, 3_000), (15, 6)])
def test_predictions_equal_a_plain_model(spark, most):
    """Known words, words that fall back to grams of every length, and words of which nothing is known; with few words and grams kept, too."""
    rows = [(i, speech(lang, i), lang if i % 11 else None) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(200 + i, t, None) for i, t in enumerate(["kaxx toq", "xschx", "zz 12", "12", "", None, "ent kaka bobo", "qqq www", "Ka-TO_mi"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, words_per_language=most[0], grams_per_length=most[1])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(docs, model).collect()}
    plain = plain_model(rows, *most)
    for i, text, _ in rows:
        lang, score = plain(text)
        assert got[i][1] == pytest.approx(score, abs=1e-4) and (got[i][0] == lang or score < 0.5001), (text, got[i], lang, score)


def test_only_the_training_folds_text_and_language_matter(spark):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    told = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lied = told.withColumn("lang", F.when(F.col("doc_id").isin(held), F.lit("cc")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(d).collect()} for d in (told, lied))
    assert a == b


def test_unseen_words_fall_back_to_shorter_grams():
    model = {"languages": ["x", "y"], "words": {}, "grams": {g: language_id.np.array(v, "f4") for g, v in {"abcd": [0, -5], "abc": [-5, 0], "^ab": [-9, -1], "z": [-1, -4]}.items()}}
    one = language_id.Predictor(model)
    assert one("xabcdx")[0] == "x" and one("xabce")[0] == "y" and one("z")[0] == "x"
    assert one("12 ?!") == ("und", 0.0) == one(None) and one("qqq")[1] == 0.5


def test_the_memory_of_unseen_words_is_bounded(monkeypatch):
    monkeypatch.setattr(language_id, "_CACHE", 5)
    model = {"languages": ["x", "y"], "words": {"known": language_id.np.array([0, -3], "f4")}, "grams": {"a": language_id.np.array([-1, 0], "f4")}}
    one = language_id.Predictor(model)
    texts = [f"known a{chr(98 + i % 20)}{chr(98 + i // 20)}" for i in range(60)]
    long = " ".join(f"{chr(98 + i)}{chr(98 + j)}" for i in range(9) for j in range(9)) + " known"
    assert [one(t)[0] for t in texts] == ["x"] * 60 and one(long)[0] == "x"


def test_language_edges(spark):
    docs = spark.createDataFrame([(None, "kato", "aa", 1.0), (1, None, "aa", 1.0), (2, "", None, 1.0), (2, "123", "aa", 1.0)], "doc_id long, text string, lang string, score double")
    got = language_id.identify(docs).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] is not None] == ["und"] * 3 and len(got) == 4
    assert language_id.identify(docs.limit(0)).count() == 0


# --- the pipeline


def test_stages_take_effect(spark, tmp_path):
    """Every stage's rows against brute force on what the stage before kept."""
    long = lambda i: speech("aa", i, 60)
    texts = {i: long(i) for i in range(40)}
    texts |= {100: long(3), 101: long(4) + " kato", 102: "too short", 103: "### " * 200, 104: "1 2 3 " + " ".join(map(str, range(5, 90))), 105: None, 106: speech("aa", 999, 20) + " " + long(5)}
    rows = [(i, t, "aa", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        path = f"file://{tmp_path}/stage{len(kept)}"
        stage(spark, docs, f"file://{tmp_path}").write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append((before, docs))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(d.columns == columns for _, d in kept[:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for _, d in kept[:-1]]
    assert ids[0] == {i for i, t in texts.items() if not (base(t or "")[0] < 20 or 100 * base(t)[4] > 30 * base(t)[0])}
    assert ids[0] - ids[1] == {104}
    near = near_expected(kept[2][0])
    assert ids[2] == {i for i in kept[2][0] if near[i][0] == i} and {100, 101}.isdisjoint(ids[2])
    order = sorted(kept[3][0])
    left = {i: n - gone for i, (n, gone, _, _) in zip(order, removed_bytes([kept[3][0][i] for i in order], 100), strict=True)}
    after = {r["doc_id"]: r for r in kept[3][1].collect()}
    assert {i: len(r["text"].encode()) for i, r in after.items()} == {i: n for i, n in left.items() if n}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values()) and left[106] < len(texts[106])
    packed = packing.unpacked(kept[4][1]).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("n_tokens").alias("told")).collect()
    assert {r["doc_id"]: (r["n"], r["told"]) for r in packed} == {i: (len(ids), len(ids)) for i, ids in library_ids({i: r["text"] for i, r in after.items()}).items()}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == kept[4][1].count()


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, extra columns, and no rows at all."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
    text = speech("aa", 1, 60)
    rows = [(1, text, "aa", None, None, None), (1, text, "aa", None, None, None), (None, speech("aa", 2, 60), None, None, None, True), (3, None, None, "s", 0, None)]
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for n, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, columns)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"file://{tmp_path}/{n}-{k}"
            stage(spark, docs, f"file://{tmp_path}").write.parquet(path)
            docs = spark.read.parquet(path)
            assert k == 4 or docs.columns == [c.split()[0] for c in columns.split(", ")]
        assert packing.unpacked(docs).select("doc_id").distinct().count() == (2 if data else 0)


def test_extra_columns_have_any_name(spark, tmp_path):
    """Every internal name of the stages, as columns whose values must come through."""
    names = ["_id", "_text", "_name", "_row", "_k", "_n", "_q", "_verdict", "_language", "_score", "_kept", "rest", "language", "score", "kept", "key", "class", "name", "label", "runs", "alive", "asked", "n", "rep", "route", "a.b", "n_chars"]
    text = speech("aa", 1, 60)
    rows = [(i, t, "aa", *(f"{i} {n}" for n in names[:-1]), len(t)) for i, t in [(1, text), (None, text), (5, speech("aa", 5, 60)), (5, speech("aa", 6, 60)), (5, speech("aa", 6, 60)), (7, speech("aa", 7, 50) + " " + text)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names[:-1]) + ", n_chars int")
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert len(got) == {corpus_pipeline.near_duplicates: 4, corpus_pipeline.repeated_passages: 4}.get(stage, 6)
        for r in got:
            assert all(r[n] == f"{r['doc_id']} {n}" for n in names[:-1]) and r["n_chars"] == len(r["text"]) and r["lang"] == "aa"
    assert corpus_pipeline.pack(spark, docs, "").count() > 0


def test_working_tables_are_removed(spark, tmp_path):
    """A stage's tables go when the next one begins, unless its input still reads them."""
    text = speech("aa", 1, 60)
    docs = spark.createDataFrame([(i, text + str(i), "aa") for i in range(3)], "doc_id long, text string, lang string")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    corpus_pipeline._release(spark)
    lazy = corpus_pipeline.quality(spark, docs, f"file://{tmp_path}")
    (path,) = corpus_pipeline._held
    assert corpus_pipeline.language(spark, lazy, "").count() == 3  # not written, so the table must stay
    assert spark.read.parquet(path).count() == 3
    corpus_pipeline.language(spark, docs, "")
    assert path not in corpus_pipeline._held
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_different_texts_of_one_id_go_through_all_stages(spark, tmp_path):
    """Of null and repeated ids every text is a document: each is packed, a copy under another id goes, an empty one takes nothing along."""
    texts = [speech("aa", i, 60) for i in range(8)]
    ids = [None, None, None, 5, 5, 5, 9, -(2**63)]
    rows = [(i, t, "aa", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[0], (None, "", "aa", "s", 0), (None, None, "aa", "s", 0), (12, texts[1], "aa", "s", len(texts[1]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        got = [(r["doc_id"], r["text"]) for r in stage(spark, docs, "").filter("text != ''").collect()]
        assert len(got) == 8 and set(got) == set(zip(ids, texts, strict=True))
    got = [(r["doc_id"], r["length"]) for r in packing.unpacked(corpus_pipeline.run(spark, f"file://{tmp_path}")).collect()]
    assert sorted(got, key=str) == sorted(((i, len(x)) for i, x in zip(ids, library_ids(dict(enumerate(texts))).values(), strict=True)), key=str)


def test_without_languages_to_learn_documents_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "ab", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]
