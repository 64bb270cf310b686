"""The nearest baseline images of each comparison image, and how many there are within the distance, in bounded memory.

All pairs within the distance may be a good part of all pairs, so they are counted where they are found and never become rows.
Images meet under the baseline's aspect bucket. A bucket is dealt into lines of comparison and of baseline images, and each line meets
each other line in a task, which holds one line of the baseline while the others pass by and gives the ``k`` nearest of it for each. The lines' results,
``k`` rows an image and line at most, are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import DEFAULT, Profile
from kindred.operators import match
from kindred.scratch import materialise

HELD, PASSING = 32768, 16384  # baseline and comparison images of a line, about
BLOCK = 1 << 19  # pairs that are compared at once
HEAD = 4096  # places of a row that bound its least distances

FOUND = "c_id long, b_id long, distance long, b_path string, n long"


def nearest(comparison: DataFrame, baseline: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """c_id, b_id, distance, b_path, rank, n_found, truncated: what ``match.top_candidates`` gives of ``match.candidates``. Of equal distances and
    paths the lesser id comes first."""
    tolerance, k = profile.aspect_tolerance, profile.top_k
    c = comparison.filter("phash is not null and aspect > 0").select(F.col("image_id").cast("long").alias("id"), "phash", "aspect", match.buckets_around(F.col("aspect"), tolerance).alias("bucket"))
    b = baseline.filter("phash is not null and aspect > 0").select(F.col("image_id").cast("long").alias("id"), "phash", "aspect", match.aspect_bucket(F.col("aspect"), tolerance).alias("bucket"), "relative_path")
    c, b = materialise(c, "passing"), materialise(b, "held")
    lines = b.groupBy("bucket").agg(F.ceil(F.count("*") / HELD).alias("b_lines")).join(c.groupBy("bucket").agg(F.ceil(F.count("*") / PASSING).alias("c_lines")), "bucket")
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    held = b.join(lines, "bucket").select("bucket", every(F.col("c_lines")).alias("i"), own(F.col("b_lines"), 1).alias("j"), F.lit(0).alias("side"), "id", "phash", "aspect", F.col("relative_path").alias("path"))
    passing = c.join(lines, "bucket").select("bucket", own(F.col("c_lines"), 2).alias("i"), every(F.col("b_lines")).alias("j"), F.lit(1).alias("side"), "id", "phash", "aspect", F.lit(None).cast("string").alias("path"))
    tasks = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(passing).repartition(tasks, "bucket", "i", "j")
    # the held ones come in the order of their paths, so their places tell which comes first; those that pass by come by aspect
    order = ["bucket", "i", "j", "side", F.when(F.col("side") == 1, F.col("aspect")), "path", "id"]
    found = dealt.sortWithinPartitions(*order).mapInArrow(_meet(profile.max_distance, tolerance, k), FOUND)
    each = Window.partitionBy("c_id")
    ranked = found.withColumn("rank", F.row_number().over(each.orderBy("distance", "b_path", "b_id")).cast("long")).withColumn("n_found", F.sum("n").over(each))
    return ranked.filter(F.col("rank") <= k).withColumn("truncated", F.col("n_found") > k).select("c_id", "b_id", "distance", "b_path", "rank", "n_found", "truncated")


def true_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a mask with few true values: eight of them are looked at in one step."""
    flat = mask.ravel()
    cut = len(flat) & ~7
    eights = np.flatnonzero(flat[:cut].view(np.uint64))
    i, j = np.nonzero(flat[:cut].reshape(-1, 8)[eights])
    return np.divmod(np.concatenate([eights[i] * 8 + j, cut + np.flatnonzero(flat[cut:])]), mask.shape[1])


def first_places(d: np.ndarray, most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the ``k`` least distances of each row (bytes) that are at most ``most``, by distance, the earlier place first where they are equal."""
    bound = np.full(len(d), most)
    if d.shape[1] > 2 * HEAD > 2 * k:  # what is beyond the k least of the first places is none of the k least
        bound = np.minimum(bound, np.partition(d[:, :HEAD], k - 1, axis=1)[:, k - 1])
    row, place = true_places(d <= bound.astype(np.uint8)[:, None])
    order = np.argsort(row << 8 | d[row, place], kind="stable")
    row, place = row[order], place[order]
    among = np.arange(len(row)) - np.searchsorted(row, np.arange(len(d)))[row]
    return row[among < k], place[among < k]


def _meet(most: int, tolerance: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(held: pa.Table, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, a = held["phash"].to_numpy().view(np.uint64), held["aspect"].to_numpy()
        ids, hashes, aspects = (part.column(x).to_numpy() for x in ("id", "phash", "aspect"))
        hashes, step = hashes.view(np.uint64), max(1, BLOCK // len(h))
        for at in range(0, len(ids), step):
            own = aspects[at : at + step, None]
            low, high = own * (1 - tolerance), own * (1 + tolerance)
            use = np.flatnonzero((a >= low.min()) & (a <= high.max()))
            if not len(use):
                continue
            d = np.bitwise_count(hashes[at : at + step, None] ^ h[None, use])
            if own.min() != own.max():
                d[(a[None, use] < low) | (a[None, use] > high)] = 65
            n = np.count_nonzero(d <= most, axis=1)
            row, place = first_places(d, most, k)
            if not len(row):
                continue
            first = np.concatenate([[True], row[1:] != row[:-1]])
            taken = pa.array(use[place])
            yield pa.record_batch([pa.array(ids[at : at + step][row]), held["id"].take(taken).combine_chunks(), pa.array(d[row, place].astype(np.int64)), held["path"].take(taken).combine_chunks(), pa.array(np.where(first, n[row], 0))], names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            key = np.stack([batch.column(x).to_numpy() for x in ("bucket", "i", "j")])
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if b == e:
                    continue
                if at is None or (key[:, b] != at).any():
                    at, parts, held = key[:, b], [], None
                mid = b + int(np.searchsorted(side[b:e], 1))
                if mid > b:
                    parts.append(batch.slice(b, mid - b))
                if e > mid and parts:
                    held = pa.Table.from_batches(parts).combine_chunks() if held is None else held
                    yield from of(held, batch.slice(mid, e - mid))

    return run
