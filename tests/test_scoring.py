"""Scores by cells: one resize for an image and size, and the same scores as pair by pair."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import kernels, scoring
from kindred.progress import Counters
from tests.test_files import picture


def world(spark, n):
    rng = random.Random(3)
    images = {i: picture(i % 7, *rng.choice([(40, 30), (20, 15), (31, 17), (8, 8)])) for i in range(n)}
    rasters = spark.createDataFrame([(i, bytearray(a[..., ::-1].tobytes()), a.shape[0], a.shape[1], 3) for i, a in images.items()], "image_id long, data binary, h int, w int, n int")
    sizes = spark.createDataFrame([(i, a.shape[1], a.shape[0]) for i, a in images.items()], "image_id long, width long, height long")
    return images, rasters.repartition(3), sizes


@pytest.mark.parametrize("edge,line", [(None, 32), (16, 32), (None, 3)])
def test_scores_and_resizes(spark, edge, line):
    images, rasters, sizes = world(spark, 14)
    pairs = [(a, b) for a, b in itertools.combinations(range(10), 2)] + [(12, 13), (12, 12), (3, 1)]
    df = spark.createDataFrame([(*p, f"n{k}") for k, p in enumerate(pairs)], "c_id long, b_id long, row string").repartition(5)
    count = Counters(spark)
    got = {r["row"]: r for r in scoring.score(df, rasters, sizes, edge, count, line).collect()}
    assert len(got) == len(pairs)
    resized = set()
    for k, (a, b) in enumerate(pairs):
        assert got[f"n{k}"]["score"] == kernels.pair_ssim(images[a], images[b], edge) and got[f"n{k}"]["error"] is None
        target = kernels.target_size(images[a].shape[1::-1], images[b].shape[1::-1], edge)
        resized |= {(a, target), (b, target)}
    assert count["resized"].value == len(resized) and count["computed"].value == len(pairs)


def test_an_image_travels_once_in_a_small_component(spark):
    """Cells: one for a component of few images, whatever the number of pairs."""
    images, rasters, sizes = world(spark, 8)
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(8), 2)], "c_id long, b_id long")
    jobs = scoring.decode_jobs(scoring.sized_pairs(pairs, sizes, 8)).collect()
    targets = {(i, kernels.target_size(images[a].shape[1::-1], images[b].shape[1::-1], 8)) for a, b in itertools.combinations(range(8), 2) for i in (a, b)}
    assert {(r["image_id"], (s["w"], s["h"])) for r in jobs for s in r["sizes"]} == targets


def test_failures_and_empty(spark):
    images, rasters, sizes = world(spark, 4)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 9)], "c_id long, b_id long")
    got = {(r["c_id"], r["b_id"]): r for r in scoring.score(pairs, rasters.filter("image_id <> 2"), sizes, None).collect()}
    assert set(got) == {(0, 1), (0, 2)} and got[0, 2]["score"] is None and got[0, 2]["error"] and got[0, 1]["score"] is not None
    assert scoring.score(pairs.limit(0), rasters, sizes, None).count() == 0
    bad = rasters.withColumn("data", F.when(F.col("image_id") == 1, F.expr("X'00'")).otherwise(F.col("data")))
    got = {(r["c_id"], r["b_id"]): r for r in scoring.score(pairs, bad, sizes, None).collect()}
    assert got[0, 1]["score"] is None and got[0, 1]["error"]
