"""One text of megabytes among short ones: each operator's result for it equals the plain version's."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_duplicates import brute_shingles, brute_simhash
from test_quality import brute as brute_quality
from test_tokens import direct, encoder  # noqa: F401

from kindred.llm import filter_audit, fingerprints, mixing, near_dedup, packing, quality

rng = random.Random(12)
VOCABULARY = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
LONG = " ".join(rng.choice(VOCABULARY) for _ in range(150_000)) + "\n" + "x" * 200_000 + "\n" + "same line of words here\n" * 2000
SHORT = ["a short text of some words", "", None, "one"]


@pytest.fixture(scope="module")
def long_folder(spark, tmp_path_factory):
    assert len(LONG) > 1 << 20
    top = str(tmp_path_factory.mktemp("long"))
    edited = LONG.replace(VOCABULARY[0], "edited")
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate([*SHORT, LONG, LONG, edited])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{top}/documents.parquet")
    return top


def test_op2(spark, long_folder, encoder):  # noqa: F811
    got = {}
    for r in packing.op2_best_fit_packing(spark, long_folder).filter("doc_id = 4").collect():
        got[r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    ids = np.array([*direct(encoder, LONG), 0], "<u4")
    assert got == {k: (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))}


def test_op3(spark, long_folder):
    got = {r["doc_id"]: r for r in mixing.op3_source_mixing(spark, long_folder).collect()}
    assert got[4]["size"] == len(LONG.split()) and all(0 <= r["taken"] <= 2 * r["size"] for r in got.values())
    for source in (0, 1):
        own = [r for i, r in got.items() if i % 2 == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 256


def test_op5(spark, long_folder):
    r = next(r for r in quality.op5_quality_rules(spark, long_folder).collect() if r["doc_id"] == 4)
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(LONG)


def test_op6(spark, long_folder):
    got = {r["doc_id"]: r for r in fingerprints.op6_document_fingerprints(spark, long_folder).collect()}
    assert got[4]["n_chars"] == len(LONG) and got[4]["fingerprint"] == got[5]["fingerprint"] and got[5]["near_next"] == 1.0
    half = len(LONG) // 2
    expected = LONG[: len(LONG) - half] + SHORT[3][:half]  # the next document, descending, is number 3
    assert got[4]["edited_sha256"] == hashlib.sha256(expected.encode()).hexdigest()


def test_op9_and_near_copies(spark, long_folder):
    got = {r["doc_id"]: r for r in near_dedup.op9_simhash_near_dedup(spark, long_folder).collect()}
    assert got[4]["fingerprint"] == f"{brute_simhash(LONG):016x}" and got[4]["component_id"] == got[5]["component_id"] == 4
    docs = spark.read.parquet(f"{long_folder}/documents.parquet")
    a, b = brute_shingles(LONG), brute_shingles(LONG.replace(VOCABULARY[0], "edited"))
    assert len(a & b) >= 0.8 * len(a | b)
    for most in (1, 4096):
        assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs, most).collect()) == [0, 1, 3, 4]


def test_op12(spark, long_folder):
    rows = {r["doc_id"]: r["mask"] for r in filter_audit.measured(spark.read.parquet(f"{long_folder}/documents.parquet")).collect()}
    n, distinct = len(LONG.split()), len(set(LONG.split()))
    assert rows[4] == 2 * (100 * distinct < 50 * n)
