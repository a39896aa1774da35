"""The subpackage's registered queries over whole small tables: against their SQL, or plain Python and the tokenizers' own results."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import oracle
from cohortsmith.llm import language_id, simhash
from cohortsmith.llm.queries import QUERIES
from cohortsmith.llm.sql import ORACLES
from test_formats import P, library_ids
from test_join_and_prints import expected as near_expected
from test_join_and_prints import near_by_all_pairs

needs_data = pytest.mark.skipif(not oracle.THERE, reason="no tables")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, QUERIES[name], ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def texts():
    if not oracle.THERE:
        pytest.skip("no tables")
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{oracle.FOLDER}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def ids(texts):
    return library_ids(texts)


def rows(spark, name, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in QUERIES[name](spark, oracle.FOLDER).collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_packs_the_tokenizers_ids(spark, texts, ids):
    got, whole = rows(spark, "op3_packing", "doc_id", "piece"), {}
    for (i, piece), r in got.items():
        part = ids[i][r["start"] : r["start"] + r["length"]]
        assert (r["n_tokens"], r["start"], r["ids_crc32"]) == (len(ids[i]), 4096 * piece, crc(part)) and (r["length"] == 0 or r["length"] <= r["bucket"])
        whole[i] = whole.get(i, 0) + r["length"]
    assert whole == {i: len(x) for i, x in ids.items()}


def test_op5_prints_and_neighbours(spark, texts):
    got, order = rows(spark, "op5_document_fingerprints", "doc_id"), sorted(texts, reverse=True)
    prints = {}
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        edit = simhash.edited(texts[i], texts[j])
        own, other, new = simhash._of([texts[i], texts[j], edit])
        r, prints[i] = got[i], own.tobytes().hex()
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(texts[i]), hashlib.sha256(edit.encode()).hexdigest(), prints[i], new.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (simhash.likeness(own, new), simhash.likeness(own, other))
    near = near_by_all_pairs(list(prints.values()), simhash.RADIUS)
    assert {i: (r["n"], r["n_near"]) for i, r in got.items()} == {i: near[p] for i, p in prints.items()}


def test_op6_predicts_held_out_languages(spark):
    told = {i: lang for i, lang in duckdb.sql(f"SELECT doc_id, lang FROM '{oracle.FOLDER}/documents.parquet'").fetchall()}
    got = rows(spark, "op6_language_id", "doc_id")
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % language_id.FOLDS == 0 for i in told}
    held = [(r["lang_pred"], told[i]) for i, r in got.items() if r["held_out"] and told[i] and r["lang_pred"] != "und"]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 10


def test_op7_links_all_pairs(spark, texts):
    got = {i: (r["class_id"], r["n_links"], r["n_copies"]) for i, r in rows(spark, "op7_ngram_jaccard_join", "doc_id").items()}
    assert got == near_expected(texts)


def test_op8_stores_the_tokenizers_ids(spark, ids):
    start, told = 0, {}
    for i in sorted(ids):
        told[i] = (start, len(ids[i]) + 1, crc([*ids[i], 2]))
        start += len(ids[i]) + 1
    assert {i: (r["start"], r["n_tokens"], r["ids_crc32"]) for i, r in rows(spark, "op8_token_store", "doc_id").items()} == told


def test_op10_gives_every_text_back(spark, texts):
    got = rows(spark, "op10_sentencepiece", "doc_id")
    assert {i: (r["exact"], r["decoded_sha256"]) for i, r in got.items()} == {i: (True, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
