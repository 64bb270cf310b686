import math
import os
import re
from collections import Counter

import pytest

from kindred.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_op5_against_brute_force(spark, folder, unique):
    got = {r["doc_id"]: r for r in Q.op5_quality_rules(spark, folder).collect()}
    assert len(got) == len(unique)
    for i, text, *_ in unique:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), i
        assert not (r["base_failed"] and r["kept"])
    assert Q.op5_quality_rules(spark, f"{folder}/none").count() == 0


def test_filter_keeps_columns_and_rows(spark, docs, empty):
    out = Q.filter_quality(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert Q.filter_quality(empty).count() == 0


def pattern(against="", abstain=""):
    return "".join("-" if r in against.split() else "0" if r in abstain.split() else "+" for r in Q.RULES)


def test_uniformly_good_documents_are_all_kept():
    patterns = [pattern(), pattern(abstain="lines variety"), pattern("short"), pattern("digits")]
    good, _ = Q.score_votes(patterns, [10_000, 300, 50, 20])
    assert (good > 0.9).all()
    assert (Q.score_votes(patterns[:1], [1])[0] > 0.5).all()
    assert len(Q.score_votes([], [])[0]) == 0


def test_votes_that_agree_are_believed_and_a_lone_one_is_outvoted():
    patterns = [pattern(), pattern("symbols symbol_words plain"), pattern("repeats capitals exclaims"), pattern("digits"), pattern("symbols symbol_words", "plain")]
    good, _ = Q.score_votes(patterns, [9_000, 700, 300, 60, 40])
    assert good[0] > 0.9 and good[1] < 0.1 and good[2] < 0.1 and good[3] > 0.5 and good[4] < 0.5


def test_the_order_of_patterns_has_no_say():
    patterns = [pattern(), pattern("symbols symbol_words plain"), pattern("repeats lines"), pattern("short"), pattern("short digits")]
    counts = [900, 70, 30, 60, 4]
    one, other = Q.score_votes(patterns, counts)[0], Q.score_votes(patterns[::-1], counts[::-1])[0]
    assert one.tolist() == other[::-1].tolist()


@pytest.mark.parametrize("rule", ["lines", "digits", "lengths"])
def test_a_random_rule_is_found_out(rule):
    """Half of its votes are negative, whatever the document: its accuracy is near chance and nobody goes for it."""
    patterns, counts = [], []
    for against, n in (("", 8000), ("symbols symbol_words plain", 1200), ("repeats capitals exclaims", 800)):
        for flipped in (against, f"{against} {rule}"):
            patterns.append(pattern(flipped))
            counts.append(n // 2)
    good, learnt = Q.score_votes(patterns, counts)
    assert (good[:2] > 0.9).all() and (good[2:] < 0.1).all()
    assert abs(learnt["accuracy"][rule] - 0.5) < 0.05 and learnt["accuracy"]["symbols"] > 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in Q.op5_quality_rules(spark, DATA).collect() if r["doc_id"] in labels and not (r["base_failed"])]
    right = sum(bool(a) == b for a, b in judged)
    assert right / len(judged) > 0.98
    assert sum(b for a, b in judged if a) / sum(a for a, _ in judged) > 0.99


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_the_posterior_beats_all_must_pass(spark):
    """On labelled documents that pass the base rule: the verdicts differ from "no rule votes against" for many, and for the better."""
    labels = {r["doc_id"]: bool(r["quality"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [(labels[r["doc_id"]], r["kept"], "-" not in r["votes"]) for r in Q.op5_quality_rules(spark, DATA).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(a != c for _, a, c in rows) > 0.1 * len(rows)
    assert sum(y == a for y, a, _ in rows) > sum(y == c for y, _, c in rows) + 0.1 * len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_quality_and_verdict_against_a_second_version(spark):
    """Plain expectation maximisation, one document at a time, from the votes that the query shows."""
    rows = Q.op5_quality_rules(spark, DATA).collect()
    counts = Counter(r["votes"] for r in rows)
    several = sorted(p for p in counts if p.count("-") >= 2)
    ones = {p: {j for j, c in enumerate(p) if c == "-"} for p in several}
    first = max(several, key=lambda p: (counts[p], [-ord(c) for c in p]))
    second = max(several, key=lambda p: (counts[p] * (1 - len(ones[p] & ones[first]) / len(ones[p] | ones[first])), [-ord(c) for c in p]))
    shares = [0.8, 0.1, 0.1]
    prior = [[0.05] * len(Q.RULES)] + [[0.7 if c == "-" else 0.1 for c in p] for p in (first, second)]
    counts, share, negative, post = Counter(r["votes"] for r in rows), list(shares), [list(x) for x in prior], {}
    for _ in range(500):
        for p in counts:
            like = [s * math.prod(q if c == "-" else 1 - q for c, q in zip(p, qs, strict=True) if c != "0") for s, qs in zip(share, negative, strict=True)]
            post[p] = [x / sum(like) for x in like]
        share = [(sum(n * post[p][k] for p, n in counts.items()) + 4 * shares[k]) / (len(rows) + 4) for k in range(len(shares))]
        negative = [[(sum(n * post[p][k] for p, n in counts.items() if p[j] == "-") + 4 * prior[k][j]) / (sum(n * post[p][k] for p, n in counts.items() if p[j] != "0") + 4) for j in range(len(Q.RULES))] for k in range(len(shares))]
    for r in rows:
        assert abs(r["quality"] - post[r["votes"]][0]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
