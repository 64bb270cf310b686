import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import packing, token_output
from kindred.llm.tokens import WordTokenizer, default_vocabulary


@pytest.fixture(scope="module")
def encoder():
    return WordTokenizer(default_vocabulary(), most_words=50)


def direct(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


PIECES = ["a", "B", "É", "é", " ", "\n", " ", "　", "\x1c", "'s", "'T", ",", "!!", "$", "İ", "ẞ", "Σ", "1", "٣", "日", "<|endoftext|>", "<|END", "👍🏽", "\x00", "‍", "-", "_", " ́", "K", ". "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=4))
def test_words_give_the_library_ids(encoder, texts):
    ids, bounds = encoder.encode(pa.array([*texts, None], pa.string()))
    for i, t in enumerate([*texts, None]):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == direct(encoder, t)


def test_op1_against_brute_force(spark, folder, unique, encoder):
    got = {r["doc_id"]: r for r in token_output.op1_token_output(spark, folder).collect()}
    start = 0
    for i, text, *_ in sorted(unique):
        ids = [*direct(encoder, text), 2]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(unique)
    assert token_output.op1_token_output(spark, f"{folder}/none").count() == 0


def test_op1_with_repeats_and_null_ids(spark, docs, rows, tmp_path):
    out = token_output.read_tokens(token_output.write_tokens(docs, f"file://{tmp_path}/t"), f"file://{tmp_path}/t").collect()
    assert len(out) == len(rows)
    order = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    ids = [r["doc_id"] for r in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_shards_have_a_bounded_length(spark, docs, rows, encoder, tmp_path):
    """A task rolls over to a next shard; order, starts and ids are those of one long shard, and nothing of lost attempts stays."""
    one, many = f"file://{tmp_path}/one", f"file://{tmp_path}/many"
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / ".shard-00000000000.arrows.lost").write_bytes(b"x")
    long = spark.createDataFrame([(10**6, "some long text " * 400_000)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(long)
    a = token_output.read_tokens(token_output.write_tokens(table, one), one).collect()
    b = token_output.read_tokens(token_output.write_tokens(table, many, shard_ids=3000), many).collect()
    key = lambda r: (r["start"], r["n_tokens"], r["ids_crc32"])
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == len(rows) + 1
    assert len({r["shard"] for r in b}) > 2 * len({r["shard"] for r in a})
    names = sorted(p.name for p in (tmp_path / "many").iterdir())
    assert len(names) == len({r["shard"] for r in b}) and not any(n.startswith(".") and n.endswith("lost") for n in names)
    assert max(r["n_tokens"] for r in b) == 3 * 400_000 + 1
    for r in b:
        assert r["position"] < 3000 + max(x["n_tokens"] for x in b)


def test_shards_are_read_without_a_copy(tmp_path):
    folder = f"file://{tmp_path}"
    ids = np.random.default_rng(1).integers(0, 49000, 10_000)
    w = token_output.ShardWriter(folder, 7, np.dtype(np.uint16), sequence=64, rows=4)
    for part in np.array_split(ids, 23):
        w.append(part)
    w.close()
    shard = token_output.TokenShard(folder, 7)
    assert len(shard) == -(-10_000 // 64)
    for i in range(len(shard)):
        row, mask = shard.sequence(i)
        assert row.base is not None and len(row) == len(mask) == 64
        assert row[mask].tolist() == ids[64 * i : 64 * i + 64].tolist()
    for start, n in ((0, 1), (63, 2), (250, 1000), (9_999, 1), (0, 10_000), (5, 0)):
        assert shard.tokens(start, n).tolist() == ids[start : start + n].tolist()


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= x]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - x)
        else:
            bins.append(capacity - x)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_plan_equals_plain_best_fit(lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    plan = packing.plan_packing(histogram, 16)
    left, placed = {}, {x: 0 for x in histogram}
    for length, rank, n, first, each, fill in sorted(plan.tolist(), key=lambda p: (-p[0], p[1])):
        assert rank == placed[length]
        placed[length] += n
        for j in range(n):
            b = first + j // each
            assert 16 - left.get(b, 16) == fill + (j % each) * length
            left[b] = left.get(b, 16) - length
    assert placed == histogram and sorted(left.values()) == plain_best_fit(lengths, 16)


def test_capacity_tree():
    tree = packing.CapacityTree(20)
    for c in (3, 9, 20):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    tree.add(20, -1)
    assert tree.tightest(10) is None


def test_op2_against_brute_force(spark, folder, unique, encoder):
    got = packing.op2_best_fit_packing(spark, folder).collect()
    expected = {}
    for i, text, *_ in unique:
        ids = [*direct(encoder, text), 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            expected[i, k // 2048] = (k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == expected and len(got) == len(expected)
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(2048 - v for v in bins.values()) == plain_best_fit([v[1] for v in expected.values()], 2048)
    assert packing.op2_best_fit_packing(spark, f"{folder}/none").count() == 0


def test_sequences(spark, docs, rows):
    packed = packing.pack_documents(docs, with_ids=True)
    assert packed.filter("piece = 0").count() == len(rows)
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048
