"""The nearest candidates by lines, against all pairs."""

import random

import pytest

from kindred.config import Profile
from kindred.operators import match, nearest

COLUMNS = "image_id long, phash long, aspect double, relative_path string"


def images(spark, n, seed, aspects):
    """Heaps of hashes with copies; some without a hash or an aspect."""
    rng = random.Random(seed)
    middles = [random.Random(9).getrandbits(63) ^ rng.getrandbits(12) for _ in range(3)]
    rows = []
    for i in range(n):
        h = rng.choice(middles)
        for _ in range(rng.randrange(14)):
            h ^= 1 << rng.randrange(63)
        rows.append((i, None if i % 37 == 0 else h, None if i % 41 == 0 else rng.choice(aspects), f"p{rng.randrange(10**6):06d}/{i}"))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.mark.parametrize("held,passing,block", [(32768, 16384, 1 << 21), (40, 30, 500)])
@pytest.mark.parametrize("aspects", [[1.5], [1.5, 1.5008, 1.506, 1.4999, 4 / 3]])
def test_lines_give_the_nearest_of_all_pairs(spark, monkeypatch, held, passing, block, aspects):
    for name, value in (("HELD", held), ("PASSING", passing), ("BLOCK", block)):
        monkeypatch.setattr(nearest, name, value)
    c, b = images(spark, 220, 1, aspects), images(spark, 260, 2, aspects)
    profile = Profile(max_distance=16, top_k=5)
    columns = ["c_id", "b_id", "distance", "b_path", "rank", "n_found", "truncated"]
    want = {tuple(r) for r in match.top_candidates(match.candidates(c, b, profile), 5).select(columns).collect()}
    got = [tuple(r) for r in nearest.nearest(c, b, profile).select(columns).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_no_images(spark):
    some, none = images(spark, 10, 1, [1.0]), images(spark, 10, 1, [1.0]).limit(0)
    assert nearest.nearest(some, none).count() == 0 and nearest.nearest(none, some).count() == 0


def test_pairs_within_the_distance_are_no_rows(spark):
    """One heap: every pair is within the distance, and each image gives as many rows as are asked for."""
    plan = nearest.nearest(images(spark, 50, 1, [1.5]), images(spark, 60, 2, [1.5]), Profile(max_distance=64, top_k=2))
    assert {r["n_found"] for r in plan.collect()} == {57} and "bit_count" not in plan._jdf.queryExecution().executedPlan().toString()
