import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    bound = {s: 2 * sizes[s] for s in sizes}
    share = 1.5 * sum(sizes.values())
    target, open_ = {}, set(order)
    while open_:
        level = share / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > bound[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = bound[s]
            share -= bound[s]
        open_ -= over
    return target


def test_op3_against_brute_force(spark, folder, unique):
    got = mixing.op3_source_mixing(spark, folder).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in unique}
    source = {r[0]: r[3] for r in unique}
    sizes = defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    target = brute_targets(sizes)
    taken = defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK
    again = mixing.op3_source_mixing(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.op3_source_mixing(spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1001])
def test_shuffle_is_a_permutation(spark, n):
    got = spark.range(n).select(mixing.shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x")).collect()
    assert sorted(r["x"] for r in got) == list(range(n))
    if n > 60:
        assert [r["x"] for r in got] != list(range(n))


def test_plan_takes_exact_totals(spark):
    table = spark.createDataFrame([(0, 700, 1300), (1, 50, 10), (2, 3, 6), (3, 0, 0)], "sid long, n_blocks long, n_slots long")
    slots = mixing.plan(table).collect()
    per = defaultdict(list)
    for r in slots:
        per[r["sid"]].append(r)
    assert {k: len(v) for k, v in per.items()} == {0: 1300, 1: 10, 2: 6}
    assert sorted(r["slot"] for r in per[0]) == list(range(1300))
    for sid, blocks in ((0, 700), (2, 3)):
        for turn in {r["pass"] for r in per[sid]}:
            own = [r["block"] for r in per[sid] if r["pass"] == turn]
            assert len(own) == len(set(own)) and max(own) < blocks
    shards = defaultdict(int)
    for r in slots:
        shards[r["shard"]] += 1
    assert max(shards.values()) <= 1024 and sum(shards.values()) == 1316


def test_mixed_documents(spark, docs, rows, empty):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r["doc_id"], r["text"]] += 1
    assert counts and all(v <= 2 * sum((r[0], r[1]) == k for r in rows) for k, v in counts.items())
    assert all((k[1] or "").split() for k in counts)
    assert mixing.mix_documents(empty).count() == 0
