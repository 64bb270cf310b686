import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import filter_audit as fa


def conditions(text, n_before):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        x
        for x, fails in zip(
            "ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), n_before > 0), strict=True
        )
        if fails
    )


def brute(rows, labels):
    """rows: (doc_id or None, text, source); labels: (doc_id, quality, toxic). Every order is walked document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    at = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", 2**63), at(i))
    kinds = [(source or "", conditions(text or "", at(i) > first[text or ""]), i in good, i in toxic) for i, text, source in rows]
    out = {}
    for part in {p for p, *_ in kinds}:
        own, shapley = [k for k in kinds if k[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                shapley[f] += len(removed)
                n_failing = sum(f in k[1] for k in own)
                out[part, order, step] = [len(left), len(removed), n_failing - len(removed), sum(k[1] == f for k in own), sum(k[2] for k in removed), sum(k[3] for k in removed)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def labels_of(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    return [(i, i % 2, int(i % 5 == 0)) for i in ids if i % 3] + [(ids[4], None, 1), (ids[4], 1, None), (None, 1, 1), (10**9, 1, 1)]


def test_audit_against_every_order(spark, docs, rows):
    """Repeated rows, nulls in all columns and clashing names included."""
    labels = labels_of(rows)
    table = spark.createDataFrame([(*x, "extra") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = found(fa.audit(docs, table))
    assert got == brute([(r[0], r[1], r[3]) for r in rows], labels)
    assert all(sum(got[p, o, s][1] for s in range(1, 6)) + got[p, o, 5][0] == got[p, o, 1][0] + got[p, o, 1][1] for p, o, s in got)


def test_op12_and_empty_tables(spark, folder, unique):
    labels = labels_of(unique)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert found(fa.op12_filter_audit(spark, folder)) == brute([(r[0], r[1], r[3]) for r in unique], labels)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    assert fa.op12_filter_audit(spark, f"{folder}/none").count() == 0


def test_parity_sums_are_inverted_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [("p", bool(m & 1), bool(m & 2), m, int(n)) for m, n in enumerate(rng.integers(0, 2**40, fa.CELLS))] + [("q", False, False, 31, 7)]
    sums = fa.parity_sums(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long"))
    for r in sums.filter("part = 'q'").collect():
        assert r["sums"] == [7 * (1 - 2 * (bin(w).count("1") % 2)) for w in range(fa.CELLS)]
    got = {r["part"]: r for r in fa.cells(sums).collect()}
    assert got["p"]["all"] == [n for *_, n in rows[:-1]] and got["q"]["all"] == [0] * 31 + [7]
    assert got["p"]["good"] == [n if g else 0 for _, g, _, _, n in rows[:-1]] and got["p"]["toxic"] == [n if t else 0 for _, _, t, _, n in rows[:-1]]


def test_a_hot_text_sends_few_rows(spark):
    """Copies of one text, a third of all rows, are one row a part and label before they meet."""
    rows = spark.range(3000).selectExpr("id as doc_id", "'s' as part", "1 as mask", "if(id % 3 = 0, unhex('00'), unhex(hex(id))) as same", "false as good", "false as toxic")
    counted = {(r["mask"]): r["n"] for r in fa.masks(rows).groupBy("mask").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    copies = len([i for i in range(3000) if i % 3 == 0])
    assert counted == {1: 3000 - copies + 1, 17: copies - 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", " ", "\n", "\x0b", "\x1c", "#", "word ", "日"]), max_size=30).map("".join), st.sampled_from([1, 3, 1000]))
def test_failures_of_odd_texts(text, stretch):
    kept, fa.STRETCH = fa.STRETCH, stretch
    try:
        mask = fa.failures(text.encode())
    finally:
        fa.STRETCH = kept
    assert "".join(x for i, x in enumerate("ABCD") if mask >> i & 1) == conditions(text, 0)


def test_a_very_long_text():
    words = " ".join(f"w{i % 70_000}" for i in range(200_000))
    assert len(words) > 1 << 20 and fa.failures(words.encode()) == 2
    assert hashlib.sha256(words.encode()).digest()
