"""Metric partitions, components that grow, and the pair plan of large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import finder, graph, match, metric

MASK = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def heaps(rng, n_heaps, size, spread, strays=0):
    """Hashes that lie together in heaps, and some anywhere."""
    out = set()
    for _ in range(n_heaps):
        middle = rng.getrandbits(64)
        for _ in range(size):
            x = middle
            for _ in range(rng.randrange(spread + 1)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    out |= {rng.getrandbits(64) for _ in range(strays)}
    return sorted(out)


def hash_table(spark, values):
    return spark.createDataFrame([(signed(x),) for x in values], "hash long").repartition(3)


def brute(values, radius):
    v = np.array(values, np.uint64)
    d = metric.apart(v, v)
    return {(min(signed(values[i]), signed(values[j])), max(signed(values[i]), signed(values[j])), int(d[i, j])) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j}


def found(df):
    rows = [(min(r["a"], r["b"]), max(r["a"], r["b"]), r["distance"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def parts(values, pairs):
    root = {x: x for x in values}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in values}


@pytest.mark.parametrize("line", [4096, 50])
@pytest.mark.parametrize("radius,pivots", [(0, 16), (6, 256), (18, 16), (24, 1), (24, 64)])
def test_all_pairs_are_found_once(spark, monkeypatch, radius, pivots, line):
    """Heaps, strays, any number of pivots, whole cells and cells in lines; never more comparisons than pairs."""
    monkeypatch.setattr(metric, "LINE", line)
    values = heaps(random.Random(radius + pivots), 12, 25, 7, 150)
    count = spark.sparkContext.accumulator(0)
    assert found(metric.within(hash_table(spark, values), radius, counter=count, pivots=pivots)) == brute(values, radius)
    assert count.value <= len(values) * (len(values) - 1) // 2


def test_heaps_need_few_comparisons(spark):
    values = heaps(random.Random(1), 60, 30, 4)
    count = spark.sparkContext.accumulator(0)
    assert found(metric.within(hash_table(spark, values), 8, counter=count)) == brute(values, 8)
    assert count.value < len(values) ** 2 / 2 / 8


@pytest.mark.parametrize("radius,pivots", [(8, 256), (18, 16), (20, 1)])
def test_links_connect_what_pairs_connect(spark, radius, pivots):
    values = heaps(random.Random(3), 10, 40, 9, 120)
    every = [(a, b) for a, b, _ in brute(values, radius)]
    links = [(r["a"], r["b"]) for r in metric.within(hash_table(spark, values), radius, links=True, pivots=pivots).collect()]
    own = [signed(x) for x in values]
    assert parts(own, links) == parts(own, every)


def test_a_heap_costs_links_and_no_comparisons(spark):
    """All within the radius of one pivot: linked to it without a comparison."""
    values = heaps(random.Random(5), 1, 3000, 3)
    count = spark.sparkContext.accumulator(0)
    links = metric.within(hash_table(spark, values), 18, links=True, counter=count).collect()
    assert len(links) <= 8 * len(values) and count.value == 0


@pytest.mark.parametrize("line", [4096, 20])
@pytest.mark.parametrize("n_right,pivots", [(5, 256), (300, 256), (300, 8), (300, 1)])
def test_two_sets(spark, monkeypatch, n_right, pivots, line):
    monkeypatch.setattr(metric, "LINE", line)
    rng = random.Random(n_right)
    values = heaps(rng, 10, 50, 8, 100)
    right = sorted(rng.sample(values, n_right) + [rng.getrandbits(64)])
    for radius in (5, 16, 24):
        got = [(r["a"], r["b"], r["distance"]) for r in metric.between(hash_table(spark, values), hash_table(spark, right), radius, pivots=pivots).collect()]
        assert len(got) == len(set(got)) and set(got) == {(signed(a), signed(b), (a ^ b).bit_count()) for a in right for b in values if (a ^ b).bit_count() <= radius}


def test_empty_sets_and_nulls(spark):
    none, some = hash_table(spark, []), hash_table(spark, [1, 2])
    assert metric.within(none, 18).count() == 0 and metric.between(none, some, 18).count() == 0 and metric.between(some, none, 18).count() == 0
    images = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, None), (5, 7)], "image_id long, phash long")
    assert {tuple(r) for r in graph.similarity_components(images, 18).collect()} == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 2)}
    assert {tuple(r) for r in match.pairs_within(images, 18).collect()} == {(2, 3, 0), (2, 5, 1), (3, 5, 1)}
    assert graph.similarity_components(images.limit(0), 18).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_in_one_task_or_by_steps(spark, few):
    rng = random.Random(few)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["v"]: r["root"] for r in graph.roots(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    want = parts({x for e in edges for x in e}, edges)
    assert got == {x: r for x, r in want.items() if x != r}
    text = graph.roots(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"), few=few).collect()
    assert {tuple(r) for r in text} == {("b", "a"), ("c", "a")}
    pairs = graph.roots(spark.createDataFrame([((2, 1), (1, 9)), ((1, 10), (2, 1)), ((3, 3), (3, 3))], "a struct<x:long,y:long>, b struct<x:long,y:long>"), few=few).collect()
    assert {(tuple(r["v"]), tuple(r["root"])) for r in pairs} == {((2, 1), (1, 9)), ((1, 10), (1, 9))}


@pytest.mark.parametrize("radius", [6, 18])
def test_added_images_equal_a_run_over_all(spark, monkeypatch, radius):
    """Copies of known and of new hashes, ids below the known ones, bridges between known components, nulls; known
    hashes are never compared with each other."""
    rng = random.Random(radius)
    values = heaps(rng, 12, 12, 6, 60)
    rows = [(i * 7 % 1009, signed(rng.choice(values))) for i in range(300)] + [(5000 + i, None) for i in range(3)]
    known, added = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    table = lambda x: spark.createDataFrame(x, "image_id long, phash long")
    want = {tuple(r) for r in graph.similarity_components(table(rows), radius).collect()}
    before = table(known).join(graph.similarity_components(table(known), radius), "image_id")
    asked, real = [], match.links_within
    monkeypatch.setattr(match, "links_within", lambda distinct, most: asked.append({r[0] for r in distinct.collect()}) or real(distinct, most))
    got = graph.extend_components(before, table(added), radius)
    assert {(r["image_id"], r["component"]) for r in got.collect()} == want and got.count() == len(rows)
    assert asked == [{h for _, h in added if h is not None} - {h for _, h in known}]
    again = graph.extend_components(got, table([]), radius)
    assert {(r["image_id"], r["component"]) for r in again.collect()} == want


def group(spark, n, seed=0):
    """One component of odd members: no hash, equal qualities, no pixels."""
    rng = random.Random(seed)
    middle = rng.getrandbits(64)
    rows = []
    for i in range(n):
        h = middle
        for _ in range(rng.randrange(14)):
            h ^= 1 << rng.randrange(64)
        rows.append((9, i, None if i % 17 == 0 else signed(h), rng.choice([0, 800, 1000, 1200]), 900, rng.choice([1000, 1100, 4000, 5000]), f"p{i % 211:04d}/{i}"))
    return spark.createDataFrame(rows, "component long, image_id long, phash long, width long, height long, file_size long, relative_path string").repartition(4)


def test_lines_give_the_same_plan(spark, monkeypatch):
    members = group(spark, 700)
    one = {tuple(r) for r in graph.plan_pairs(members, small=1000).collect()}
    assert len(one) > 500
    assert {tuple(r) for r in graph.plan_pairs(members, small=10).collect()} == one
    monkeypatch.setattr(graph, "HELD", 40)
    assert {tuple(r) for r in graph.plan_pairs(members, small=10).collect()} == one


def test_plan_of_a_large_component(spark):
    plan = graph.plan_pairs(group(spark, 20_000))
    of = plan.select(F.explode(F.array("left_id", "right_id")).alias("i")).groupBy("i").count()
    assert plan.count() > 20_000 and of.count() > 15_000


@pytest.mark.parametrize("n_references", [3, 40])
def test_relations_need_no_nested_loop(spark, n_references):
    rng = random.Random(2)
    values = heaps(rng, 5, 20, 9, 30)
    rows = [(i, signed(x) if i % 9 else None, f"d{i % 50}" if i % 7 else None, 10, 10, f"p{i}") for i, x in enumerate(values)]
    images = spark.createDataFrame(rows, "image_id long, phash long, digest string, width long, height long, relative_path string")
    r, t = images.filter(F.col("image_id") < n_references), images.filter(F.col("image_id") >= n_references)
    df = finder.relations(t, r, F.lit(0.8))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    near = lambda a, b: a is not None and b is not None and ((a ^ b) & MASK).bit_count() <= 16
    want = {(x[0], y[0]) for x in rows[n_references:] for y in rows[:n_references] if near(x[1], y[1]) or (x[2] is not None and x[2] == y[2])}
    got = [(x["t_image_id"], x["r_image_id"]) for x in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
