import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm import fingerprints, near_dedup, repeats, substring, suffix


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_simhash(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps):
    label = list(range(len(fps)))
    moved = True
    while moved:
        moved = False
        for i, x in enumerate(fps):
            m = min(label[j] for j, y in enumerate(fps) if (x ^ y).bit_count() <= 2)
            if m < label[i]:
                label[i], moved = m, True
    return label


def test_op9_against_brute_force(spark, folder, unique):
    got = {r["doc_id"]: r for r in near_dedup.op9_simhash_near_dedup(spark, folder).collect()}
    order = sorted(unique)
    fps = [brute_simhash(r[1]) for r in order]
    label = components_of(fps)
    assert len(got) == len(order)
    for i, r in enumerate(order):
        assert (got[r[0]]["fingerprint"], got[r[0]]["component_id"]) == (f"{fps[i]:016x}", order[label[i]][0])
    assert near_dedup.op9_simhash_near_dedup(spark, f"{folder}/none").count() == 0


def distances(fp):
    return np.bitwise_count(fp[:, None] ^ near_dedup.PIVOT_VALUES[None, :]).astype(np.int8)


@pytest.mark.parametrize("most", [1, 5, 4096])
def test_links_of_large_keys_are_dealt_out_by_pivots(spark, most):
    rng = random.Random(11)
    fps = {rng.getrandbits(32) | 5 << 40 for _ in range(120)}
    for x in list(fps)[:60]:
        fps.add(x ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32))
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    a, b = zip(*((r["a"], r["b"]) for r in near_dedup.links(df, most=most).collect()), strict=True)
    place = {x: i for i, x in enumerate(fps)}
    assert near_dedup._labels(len(fps), np.array([place[x] for x in a]), np.array([place[x] for x in b])).tolist() == components_of(fps)


def test_pivot_distances(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) - 2**63 for _ in range(50)]
    got = spark.createDataFrame([(x,) for x in fps], "fp long").select("fp", *near_dedup.pivot_distances(F.col("fp"))).collect()
    table = near_dedup._table([np.array([r[c] for r in got]) for c in near_dedup.TABLE])
    assert table.tolist() == distances(np.array([r["fp"] for r in got]).view(np.uint64)).tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 300), st.integers(1, 6), st.sampled_from([2, 64]))
def test_links_connect_what_pairs_connect(seed, n, flips, wide):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    fps = set()
    for _ in range(n):
        x = centre
        for _ in range(rng.randrange(flips + 1)):
            x ^= 1 << rng.randrange(20)  # leaves three blocks alone: all meet in a few large runs
        fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    a, b = near_dedup.link_sorted(np.zeros(len(fp), np.int64), fp, distances(fp), 2, wide)
    got = np.arange(len(fp))
    got = near_dedup._labels(len(fp), np.searchsorted(fp, a), np.searchsorted(fp, b), got)
    assert got.tolist() == components_of([int(x) for x in fp])


def test_labels_keep_every_link():
    """Both ends of a link move to other lower neighbours in one round."""
    a, b = np.array([(2, 4), (2, 5), (4, 6), (5, 7), (6, 1), (7, 0)]).T
    assert near_dedup._labels(8, a, b).tolist() == [0, 0, 0, 3, 0, 0, 0, 0]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 400), st.integers(1, 5))
def test_labels_of_sparse_trees_in_random_order(seed, n, trees):
    rng = random.Random(seed)
    name = rng.sample(range(n), n)
    edges = [(name[i], name[rng.choice([i - trees, rng.randrange(i % trees, i, trees)])]) for i in range(trees, n)]
    rng.shuffle(edges)
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    expected = [0] * n
    for t in range(min(trees, n)):
        for i in range(t, n, trees):
            expected[name[i]] = min(name[t::trees])
    assert near_dedup._labels(n, a, b).tolist() == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 150), st.sampled_from([2, 64, 512]))
def test_links_connect_sparse_chains_in_random_order(seed, n, wide):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64)]
    for _ in range(n):
        x = fps[-1]
        for bit in rng.sample(range(32), 2):
            x ^= 1 << bit
        if x not in fps:
            fps.append(x)
    rng.shuffle(fps)
    fp, place = np.array(fps, np.uint64), {x: i for i, x in enumerate(fps)}
    a, b = near_dedup.link_sorted(np.zeros(len(fp), np.int64), fp, distances(fp), 2, wide)
    ends = [np.array([place[int(v)] for v in x], np.int64) for x in (a, b)]
    assert near_dedup._labels(len(fp), *ends).tolist() == components_of(fps) == [0] * len(fps)


def brute_shingles(text):
    w = (text or "").encode().translate(near_dedup.LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def near_copies_of(texts):
    """Component labels over all pairs of five-word Jaccard similarity 0.8 or more."""
    sets = [brute_shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("most", [4, 4096])
def test_one_row_of_each_component_of_near_copies_stays(spark, docs, rows, empty, most):
    out = near_dedup.drop_near_duplicates(docs, most)
    assert out.columns == docs.columns
    by = {}
    for r, c in zip(rows, near_copies_of([r[1] for r in rows]), strict=True):
        by.setdefault(c, []).append(r[0])
    least = sorted((min((i for i in ids if i is not None), default=None) for ids in by.values()), key=str)
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == least
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def texts_of_shape(shape, rng):
    """Texts of one component: a chain of windows over one stream, a star of edits of one text, two heaps with a bridge."""
    stream = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    if shape == "chain":
        return [" ".join(stream[4 * k : 4 * k + 100]) for k in range(120)]
    if shape == "star":
        texts = [stream[:200]]
        for k in range(80):
            texts.append(stream[:200])
            for i in rng.sample(range(0, 200, 10), 2):
                texts[-1] = [*texts[-1][:i], f"x{k}", *texts[-1][i + 1 :]]
        return [" ".join(t) for t in texts]
    heap = lambda base, tag: [" ".join([*base[:i], f"{tag}{i}", *base[i + 1 :]]) for i in range(0, 100, 4)]
    return heap(stream[:100], "a") + heap(stream[12:112], "b") + [" ".join(stream[6:106])]


@pytest.mark.parametrize("shape", ["chain", "star", "bridge"])
def test_no_link_is_lost_at_any_size(spark, shape, monkeypatch):
    """A key of any size gives the same components, whether it is compared in one task or in lines."""
    rng = random.Random(shape)
    texts = texts_of_shape(shape, rng)
    others = [" ".join(f"y{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    assert len(set(near_copies_of(texts))) == 1
    rows = list(enumerate(texts + others))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {most: sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs.repartition(3), most).collect()) for most in (1, 2, 5, 4096)}
    assert all(x == kept[4096] for x in kept.values()) and kept[4096][1:] == list(range(len(texts), len(rows)))
    monkeypatch.setattr(near_dedup, "HELD", 3)
    monkeypatch.setattr(near_dedup, "PASSING", 7)
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs, 2).collect()) == kept[4096]


def test_a_key_without_a_component_of_its_own(spark):
    """One key, texts in many components: every pair with different labels is looked at, in lines of any size."""
    rng = random.Random(6)
    streams = [[f"{c}{rng.randrange(10**6)}" for _ in range(200)] for c in "abcdefgh"]
    texts = [" ".join(s[4 * k : 4 * k + 60]) for s in streams for k in range(12)]
    h, bounds = near_dedup.shingle_sets([t.encode() for t in texts])
    fp = near_dedup.sketches(h, bounds)[0]
    classes = spark.createDataFrame([(i, i, int(x), [7, 8]) for i, x in enumerate(fp.view(np.int64))], "id long, at long, fp long, bands array<long>")
    table = spark.createDataFrame(list(enumerate(texts)), "at long, text string")
    for most in (1, 10, 4096):
        found = {r["v"]: r["root"] for r in near_dedup.roots(near_dedup.similar_links(classes, table, most=most, radius=64)).collect()}
        assert [found.get(i, i) for i in range(len(texts))] == near_copies_of(texts)


@pytest.mark.parametrize("most", [4, 4096])
def test_recall_of_near_copies(spark, most):
    """Copies with a similarity from 0.8 up: at least 0.95 go, and what is below 0.8 stays."""
    rng = random.Random(4)
    texts, copies = [], 0
    for k in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 100, 400]))]
        texts.append(" ".join(w))
        v = list(w)
        for _ in range(rng.randrange(0, 1 + len(w) // 40)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(v).upper())
    sets = [brute_shingles(t) for t in texts]
    near = [5 * len(a & b) >= 4 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    out = {r["doc_id"] for r in near_dedup.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most).collect()}
    gone = [2 * k + 1 not in out for k in range(150)]
    assert sum(near) > 60 and not any(g and not n for g, n in zip(gone, near, strict=True)) and all(2 * k in out for k in range(150))
    assert sum(gone) >= 0.95 * sum(near)


def brute_words(rows):
    first, words = {}, {}
    for i, text in rows:
        words[i] = (text or "").encode().split()
        for j in range(len(words[i]) - 12):
            k = tuple(words[i][j : j + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_op7_against_brute_force(spark, folder, unique):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op7_substring_dedup(spark, folder).collect()}
    assert got == brute_words([(r[0], r[1]) for r in unique])
    assert sum(v[1] for v in got.values()) > 1000
    assert substring.op7_substring_dedup(spark, f"{folder}/none").count() == 0


def test_runs_are_settled_alike_in_small_parts(unique):
    """The kernels of the three steps, without Spark, with tiny slices and flushes."""
    texts = [(r[0], (r[1] or "").encode()) for r in sorted(unique)]
    values, bounds = repeats.word_units([t for _, t in texts])
    text, start, windows, anchor, span = repeats.anchor_runs(values, bounds, 13, 7)
    covered = np.zeros(len(texts), np.int64)
    np.add.at(covered, text, windows)
    sizes = np.diff(bounds)
    assert covered.tolist() == np.maximum(sizes - 12, 0).tolist()  # every window is in one run
    parts = [repeats.anchor_runs(*repeats.word_units([t]), 13, 7) for _, t in texts]
    assert np.concatenate([p[3] for p in parts]).tolist() == anchor.tolist()  # whatever lies beside a text
    assert np.concatenate([p[4] for p in parts]).tolist() == span.tolist()


def test_long_texts_are_cut_into_stretches(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 64)
    monkeypatch.setattr(suffix, "SLICE", 64)
    monkeypatch.setattr(suffix, "STRETCH", 256)
    rng = random.Random(3)
    words = b" ".join(bytes(rng.randrange(97, 105) for _ in range(rng.randrange(1, 9))) for _ in range(900)) + b" " + b"w" * 700 + b" end of it"
    got, whole = [], repeats.word_units([words])[0]
    for values, bounds, index, at in repeats.slices([b"x", words, b""], 13, repeats.word_units):
        t, s, w, *_ = repeats.anchor_runs(values, bounds, 13, 7)
        got += [(int(index[i]), int(a + at[i]), int(n)) for i, a, n in zip(t, s, w, strict=True)]
        if index[0] == 1:
            assert values.tolist() == whole[at[0] : at[0] + len(values)].tolist()
    assert sorted(x for i, a, n in got if i == 1 for x in range(a, a + n)) == list(range(len(whole) - 12))
    got, doc = [], np.array([5, 3, 4])
    for data, bounds, index, at in suffix.pieces(doc, doc * 0, [b"x", words, b""], 100):
        t, s, w, *_ = repeats.anchor_runs(repeats.BYTE_VALUES[data], bounds, 100, 32)
        got += [(int(index[i]), int(a + at[i]), int(n)) for i, a, n in zip(t, s, w, strict=True)]
    assert sorted(x for i, a, n in got if i == 1 for x in range(a, a + n)) == list(range(len(words) - 99))


def brute_bytes(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        x = (text or "").encode()
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - 99):
            k = x[j : j + 100]
            if k in seen:
                gone[j : j + 100] = True
            else:
                seen.add(k)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_op10_against_brute_force(spark, folder, unique):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op10_suffix_array_dedup(spark, folder).collect()}
    assert got == brute_bytes([(r[0], r[1]) for r in unique])
    assert suffix.op10_suffix_array_dedup(spark, f"{folder}/none").count() == 0


def common_passage(n, seed=8):
    """Texts that share a passage with other words around it, some of which are equal on one side."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    line, sides = word(130), [word(80) for _ in range(4)]
    return [(i, rng.choice(sides)[-rng.randrange(1, 80) :] + word(rng.randrange(3)) + line[rng.randrange(20) :] + word(rng.randrange(3)) + rng.choice(sides)[: rng.randrange(80)]) for i in range(n)]


@pytest.mark.parametrize("most", [1, 8, 4096])
def test_op10_large_buckets_are_dealt_out_anew(spark, most):
    texts = common_passage(90)
    docs = spark.createDataFrame([(i, 0, t) for i, t in texts], "doc long, version long, text string").repartition(6)
    got = {r["doc"]: sorted(x for a in r["ranges"] for x in range(a["start"], a["start"] + a["windows"])) for r in suffix.covered_ranges(docs, 100, most).collect()}
    seen, expected = set(), {}
    for i, t in texts:
        own = [t[j : j + 100] for j in range(len(t) - 99)]
        expected[i] = [j for j, k in enumerate(own) if k in seen or k in own[:j]]
        seen.update(own)
    assert got == {i: x for i, x in expected.items() if x}


def test_op10_result_comes_from_the_refinement(spark, monkeypatch):
    """With buckets that are never split, windows that share their first bytes pass for equal."""
    texts = common_passage(60)
    data = np.frombuffer("".join(t for _, t in texts).encode(), np.uint8)
    starts = np.arange(0, len(data) - 99)
    right = suffix.first_of_buckets(data, starts, 100)
    monkeypatch.setattr(suffix, "refine", lambda buckets, offset: buckets[:-offset])
    assert suffix.first_of_buckets(data, starts, 100).sum() < right.sum()


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=60), st.integers(1, 20), st.integers(1, 8))
def test_ranks_order_suffixes(text, depth, bucket):
    data = np.frombuffer(text.encode(), np.uint8)
    ranks = suffix.rank_suffixes(data, depth, bucket)
    parts = [text[i : i + depth] for i in range(len(text) - depth + 1)]
    expected = {p: k for k, p in enumerate(sorted(set(parts)))}
    assert ranks.tolist() == [expected[p] for p in parts]


def test_repeated_rows_and_null_ids(spark, docs, rows):
    words = substring.repeated_words(docs).collect()
    raw = suffix.repeated_bytes(docs).collect()
    assert len(words) == len(raw) == len(rows)
    assert sum(r["doc_id"] is None for r in raw) == 1
    twice = [bytes(r["kept"]) for r in raw if r["doc_id"] == 3]
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("parts", [1, 4])
def test_op10_repeated_rows_stay_once(spark, parts):
    """A repeated row covers others, and itself only where its text repeats inside."""
    rng = random.Random(5)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 250, 400))
    texts = [(1, a), (2, b + a[100:]), (3, c[:130] + "|" + c + "|" + c[:200]), (4, "short"), (5, None)]
    repeated = [x for x in texts for _ in range(1 + 2 * (x[0] != 2))]
    docs = spark.createDataFrame(repeated, "doc_id long, text string").repartition(parts)
    expected = brute_bytes(texts)
    got = suffix.repeated_bytes(docs).collect()
    shown = [(r["doc_id"], (r["n_bytes"], sum(x["end"] - x["start"] for x in r["repeats"]), len(r["repeats"]), hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in got]
    assert sorted(shown) == sorted((i, expected[i]) for i, _ in repeated)


def test_op10_of_mixed_rows_against_brute_force(spark, docs, rows):
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    expected = brute_bytes([(k, k[1]) for k in {key(r) for r in rows}])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix.repeated_bytes(docs).collect())
    assert got == sorted((key(r)[0], expected[key(r)][3]) for r in rows)


def test_op6_against_brute_force(spark, folder, unique):
    got = {r["doc_id"]: r for r in fingerprints.op6_document_fingerprints(spark, folder).collect()}
    order = sorted(unique, reverse=True)
    texts = [r[1] or "" for r in order]
    assert len(got) == len(order)
    for k, r in enumerate(order):
        t, following = texts[k], order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(k + 1) % len(order)][:half]
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        far = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert g["near_edited"] == far(g["fingerprint"], g["edited_fingerprint"])
        assert g["near_next"] == far(g["fingerprint"], got[following[0]]["fingerprint"])
        others = {int(x["fingerprint"], 16) for x in got.values()} - {int(g["fingerprint"], 16)}
        assert g["n_near"] == (sum((x ^ int(g["fingerprint"], 16)).bit_count() <= 3 for x in others) if r[0] % 100 == 0 else None)
    same = {}
    for r in order:
        same.setdefault(r[1] or "", set()).add(got[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.op6_document_fingerprints(spark, f"{folder}/none").count() == 0


def test_op6_votes(spark):
    """One document's bits, from the hashes of its terms."""
    df = spark.createDataFrame([(1, "aa bbb c aa bbb")], "doc_id long, text string")
    pairs = [("aa", "bbb"), ("bbb", "c"), ("c", "aa"), ("aa", "bbb")]
    hashes = {p: spark.range(1).select(F.xxhash64(F.lit(p[0]), F.lit(p[1])).alias("h")).first()["h"] & 2**64 - 1 for p in set(pairs)}
    weight = [(hashes[p], len(p[0]) + len(p[1])) for p in pairs]
    total = sum(w for _, w in weight)
    expected = sum(1 << b for b in range(64) if 2 * sum(w for h, w in weight if h >> b & 1) > total)
    assert fingerprints.fingerprint(df).first()["fp"] & 2**64 - 1 == expected


def test_op6_with_repeats(spark, docs, rows):
    out = fingerprints.edited_fingerprints(docs)
    assert out.count() == len(rows)


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_block_tables_find_all_neighbours(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(63) for _ in range(30)]
    values = set(base)
    for x in base:
        for k in range(1, 8):
            y = x
            for b in rng.sample(range(63), k):
                y ^= 1 << b
            values.add(y)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r["query"], r["fp"]) for r in fingerprints.within_radius(df, df, radius).collect()}
    assert got == {(a, b) for a in values for b in values if a != b and (a ^ b).bit_count() <= radius}
