import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import decontaminate as de


def words_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def brute_windows(items, width=10):
    """{window: item ids as texts}"""
    out = {}
    for i, text in items:
        w = words_of(text)
        for at in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[at : at + width]), set()).add("" if i is None else str(i))
    return out


def brute(text, windows):
    w = words_of(text)
    hit, found = set(), set()
    for n in {len(x) for x in windows}:
        for at in range(len(w) - n + 1):
            if (x := tuple(w[at : at + n])) in windows:
                hit.update(range(at, at + n))
                found |= windows[x]
    return len(w), len(hit), sorted(found)


def brute_near(text, windows, slop):
    """(begin, length, item) of every stretch that begins and ends with a word of a window and holds all, the shortest of each begin."""
    w, out = words_of(text), set()
    for x, items in windows.items():
        for a in range(len(w)):
            if w[a] not in x:
                continue
            left = set(x)
            for b in range(a, min(len(w), a + len(x) + slop)):
                left.discard(w[b])
                if not left:
                    out |= {(a, b + 1 - a, i) for i in items}
                    break
    return out


def some_items(rows):
    rng = random.Random(4)
    texts = [r[1] for r in rows if r[1] and len(words_of(r[1])) > 30]
    items = []
    for i in range(12):
        w = rng.choice(texts).split()
        at = rng.randrange(max(1, len(w) - 25))
        items.append((100 + i, " ".join(w[at : at + rng.choice([3, 10, 12, 25])]).upper()))
    return items + [(7, "x y"), (8, "x y"), (9, None), (10, " .. "), (None, "naïve"), (11, "in no document at all"), (100, items[0][1])]


def test_against_brute_force(spark, docs, rows):
    """Repeated rows, nulls, clashing names, items of one word, repeated items; one block of windows or many."""
    items = some_items(rows)
    table = spark.createDataFrame([(*x, 1, "k") for x in items], "item_id long, text string, n_words long, item string")
    windows = brute_windows(items)
    want = sorted((str(r[0]), *brute(r[1], windows)) for r in rows)
    for most in (de.BLOCK, 7):
        got = de.decontaminate(docs, table, most=most).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == want
        assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert any(x[2] for x in want) and not all(x[2] for x in want)


def test_op11_and_empty_tables(spark, folder, unique):
    items = [x for x in some_items(unique) if x[0] is not None]
    kind = "item_id long, text string"
    spark.createDataFrame(items, kind).write.parquet(f"{folder}/benchmark.parquet")
    windows = brute_windows(items)
    got = {r["doc_id"]: tuple(r)[1:] for r in de.op11_benchmark_decontamination(spark, folder).collect()}
    for i, text, *_ in unique:
        n, hit, ids = brute(text, windows)
        assert got[i] == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
    assert len(got) == len(unique)
    spark.createDataFrame(items, kind).write.parquet(f"{folder}/none/benchmark.parquet")
    assert de.op11_benchmark_decontamination(spark, f"{folder}/none").count() == 0
    none = de.decontaminate(spark.read.parquet(f"{folder}/documents.parquet"), spark.createDataFrame([], kind)).collect()
    assert len(none) == len(unique) and not any(r["contaminated"] for r in none)


def test_texts_over_several_shards(spark, monkeypatch):
    """Long texts go in stretches; windows that cross their ends are found once, by every search."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (400_000, 5, 3000, 0)] + ["z" * 300_000 + " w1 w2 w3 " + "z" * 5]
    items = [(i, " ".join(texts[0].split()[at : at + 10])) for i, at in enumerate(range(0, 399_000, 4001))] + [(900, "w1 w2 w3"), (901, "w1"), (902, texts[1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = brute_windows(items)
    want = [(i, *brute(t, windows)) for i, t in enumerate(texts)]
    assert len(texts[0]) > 1 << 20
    for shard in (1 << 20, 1 << 14):
        monkeypatch.setattr(de.shards, "__defaults__", (shard,))
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in de.decontaminate(docs, table).collect()) == want


def test_index_serves_phrase_and_proximity_searches(spark, unique):
    docs = spark.createDataFrame([r[:2] for r in unique], "doc_id long, text string").repartition(3)
    index = de.build_index(docs, overlap=4 + 3)
    text = next(r[1] for r in unique if r[1] and len(words_of(r[1])) > 100).split()
    items = [(1, " ".join(text[10:14])), (2, " ".join([text[33], text[31], text[30], text[34]])), (3, "x y x y"), (4, "nowhere at all here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = brute_windows(items, 4)
    exact = {(r["doc_id"], r["begin"], r["n_words"], r["item"]) for r in de.matches(index, table, width=4).collect()}
    near = {(r["doc_id"], r["begin"], r["n_words"], r["item"]) for r in de.matches(index, table, width=4, slop=3).collect()}
    want_exact, want_near = set(), set()
    for i, t, *_ in unique:
        w = words_of(t)
        for x, names in windows.items():
            want_exact |= {(i, at, len(x), n) for at in range(len(w) - len(x) + 1) if tuple(w[at : at + len(x)]) == x for n in names}
        want_near |= {(i, *m) for m in brute_near(t, windows, 3)}
    assert exact == want_exact and near == want_near
    assert any(m[3] == "2" for m in near) and not any(m[3] == "2" for m in exact)




@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=5), min_size=1, max_size=5), st.integers(0, 4), st.sampled_from([1, 5, 1 << 21]))
def test_one_shard_against_brute_force(texts, items, slop, most):
    found = [[w.encode() for w in t] for t in texts]
    begin, n, names, ends, positions = de.posted(found, 12, None)
    row = {k: pa.scalar(v.to_pylist() if hasattr(v, "to_pylist") else v.tolist(), t) for k, v, t in (("terms", names, pa.list_(pa.binary())), ("ends", ends, pa.list_(pa.int32())), ("positions", positions, pa.list_(pa.int32())))}
    block = de.Block([{"item": str(i), "terms": [x.encode() for x in w]} for i, w in enumerate(items)])
    windows = {tuple(w): {str(i) for i, v in enumerate(items) if v == w} for w in items}
    kept, de.CANDIDATES = de.CANDIDATES, most
    try:
        shard = de.Shard(row, block)
        exact, near = shard.phrases(), shard.near(slop)
    finally:
        de.CANDIDATES = kept
    number = lambda w: tuple(x.decode() for x in (block.vocabulary[t] for t in block.term[w] if t >= 0))
    at = lambda p: int(np.searchsorted(begin, p, "right")) - 1
    got = {(at(s), s - begin[at(s)], number(w)) for w, s in zip(*exact, strict=True)}
    assert got == {(d, i, x) for d, t in enumerate(texts) for x in windows for i in range(len(t) - len(x) + 1) if tuple(t[i : i + len(x)]) == x}
    assert len(exact[0]) == len(got)
    got = {(at(a), a - begin[at(a)], b + 1 - a, i) for w, a, b in zip(*near, strict=True) for i in windows[number(w)]}
    assert got == {(d, *m) for d, t in enumerate(texts) for m in brute_near(" ".join(t), windows, slop)}


