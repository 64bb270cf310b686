"""Components whose largest one is found first, against all pairs; anchors and nearest candidates in blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import graph, metric, nearest
from tests.test_metric import brute, hash_table, heaps, parts, signed


@pytest.mark.parametrize("strays,radius", [(2500, 18), (400, 18), (0, 14), (600, 24)])
def test_largest_component_first(spark, strays, radius):
    """One component of nearly all, several heaps, hardly any link."""
    values = heaps(random.Random(strays), 9, 30, 9, strays)
    want = parts([signed(x) for x in values], [(a, b) for a, b, _ in brute(values, radius)])
    got = {r["v"]: r["root"] for r in graph.linked(hash_table(spark, values), radius, many=0).collect()}
    assert got == {v: r for v, r in want.items() if v != r} and got


def test_a_large_component_is_not_compared_with_itself(spark):
    values = heaps(random.Random(4), 0, 0, 0, 30_000)
    count = spark.sparkContext.accumulator(0)
    got = graph.linked(hash_table(spark, values), 18, counter=count).collect()
    assert len(got) > 29_000 and count.value < 30_000**2 / 2 / 10


def test_links_between_two_sets(spark):
    rng = random.Random(8)
    left, right = heaps(rng, 6, 30, 9, 60), heaps(rng, 3, 10, 9, 30)
    right = sorted((set(right) | {left[i] ^ 7 for i in range(0, 200, 20)}) - set(left))
    every = [(signed(a), signed(b)) for a in left for b in right if (a ^ b).bit_count() <= 18]
    links = [(r["a"], r["b"]) for r in metric.between(hash_table(spark, left), hash_table(spark, right), 18, links=True).collect()]
    own = [signed(x) for x in left + right]
    assert every and parts(own, links) == parts(own, every)


def test_no_links_and_few_hashes(spark):
    for values in ([], [5], [1, 2**63 + 1], [0, 2**64 - 1]):
        want = parts([signed(x) for x in values], [(a, b) for a, b, _ in brute(values, 18)]) if values else {}
        got = {r["v"]: r["root"] for r in graph.linked(hash_table(spark, values), 18, many=0).collect()}
        assert got == {v: r for v, r in want.items() if v != r}


@pytest.mark.parametrize("width,k", [(5, 8), (1003, 3), (20_000, 8)])
def test_first_places(width, k):
    d = np.random.default_rng(width).integers(0, 64, (7, width)).astype(np.uint8)
    row, place = nearest.first_places(d, 24, k)
    for i in range(len(d)):
        want = [p for _, p in sorted((x, p) for p, x in enumerate(d[i].tolist()) if x <= 24)[:k]]
        assert place[row == i].tolist() == want


def test_members_without_anchors_are_left_out(spark, monkeypatch):
    """Blocks and lines, members that no anchor fits, missing hashes: what the join of a small component gives."""
    from tests.test_metric import group

    members = group(spark, 900, 3).withColumn("file_size", F.when(F.col("width") == 1200, 5000).otherwise(F.col("file_size")).cast("long"))
    want = {tuple(r) for r in graph.plan_pairs(members, small=1000).collect()}
    monkeypatch.setattr(graph, "HELD", 60)
    monkeypatch.setattr(graph, "ROWS", 7)
    assert {tuple(r) for r in graph.plan_pairs(members, small=10).collect()} == want and len(want) > 500


def counted(df, count):
    return df.mapInArrow(lambda batches: (count.add(b.num_rows) or b for b in batches), df.schema)


def test_roles_are_computed_once(spark):
    base = "component long, image_id long, width long, height long, file_size long, relative_path string, member_role string, reference_id long, score double"
    m = spark.createDataFrame([(i % 3, i, 100 + i, 100, 10, f"p{i}", "candidate", i % 3, None) for i in range(30)], base)
    count = spark.sparkContext.accumulator(0)
    assert len(graph.automatic_originals(counted(m, count)).collect()) == 30 and count.value == 30


def test_planned_scores_are_computed_once(spark):
    base = "component long, image_id long, width long, height long, file_size long, relative_path string, source string, effective_reference_id long, reference_path string, score double"
    m = spark.createDataFrame([(1, i, 100, 100, 10 + i, f"p{i}", "auto" if i < 2 else None, None, None, None) for i in range(12)], base)
    scores = spark.createDataFrame([(0, i, 0.9) for i in range(2, 7)], "left_id long, right_id long, score double")
    members, pairs = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {(r["image_id"], r["original_id"], r["way"]) for r in graph.assign_thumbnails(counted(m, members), counted(scores, pairs)).collect()}
    assert got == {(i, 0, 0) for i in range(2, 7)} | {(i, 1, 3) for i in range(7, 12)} and (members.value, pairs.value) == (12, 5)
