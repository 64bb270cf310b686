"""Similarity scores of image pairs, with one resize for each image and size.

Pairs that hang together form a component; a component's images are dealt into lines, and a pair belongs to the cell of
its two lines. Each image is brought to each size that its pairs ask for once, as gray pixels in a written table, and travels once to
each cell that needs it: in a component of few images that is once in all, however many pairs it has. A task
holds one cell's images while the cell's pairs pass by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import measures
from kindred.operators import graph, kernels
from kindred.scratch import discard, materialise

LINE = 32  # images (at one size) of a line: a task holds two lines


def sized_pairs(pairs: DataFrame, sizes: DataFrame, edge: int | None) -> DataFrame:
    """``pairs`` (c_id, b_id, ...) with the size (w, h) at which the two images are compared: that of the smaller, its longest
    edge at most ``edge``. ``sizes``: image_id, width, height."""
    side = lambda s: sizes.select(F.col("image_id").alias(f"{s}_id"), F.col("width").alias(f"_{s}w"), F.col("height").alias(f"_{s}h"))
    x = pairs.join(side("c"), "c_id").join(side("b"), "b_id").withColumn("_t", measures.pair_target(*map(F.col, ("_cw", "_ch", "_bw", "_bh"))))
    w, h = measures.capped(F.col("_t.w"), F.col("_t.h"), edge) if edge else (F.col("_t.w"), F.col("_t.h"))
    return x.select(F.struct(*(F.col(f"`{c}`") for c in pairs.columns)).alias("row"), "c_id", "b_id", w.cast("int").alias("w"), h.cast("int").alias("h"))


def decode_jobs(sized: DataFrame) -> DataFrame:
    """(image_id, sizes): the distinct sizes that the pairs ask of each image."""
    size = F.struct("w", "h").alias("size")
    asked = sized.select(F.col("c_id").alias("image_id"), size).unionByName(sized.select(F.col("b_id").alias("image_id"), size))
    return asked.distinct().groupBy("image_id").agg(F.sort_array(F.collect_list("size")).alias("sizes"))


def prepared(rasters: DataFrame, jobs: DataFrame, counter=None) -> DataFrame:
    """(image_id, w, h, gray, error): each raster (image_id, data, h, w, n) at each size of its job. ``counter``, an
    accumulator, counts the resizes."""
    from kindred.sources.images import raster

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for size in r["sizes"]:
                    gray, error = None, None
                    try:
                        gray = kernels.prepare(raster(r["data"], r["h"], r["w"], r["n"]), size["w"], size["h"]).tobytes()
                    except ValueError as e:
                        error = str(e)
                    if counter is not None:
                        counter.add(1)
                    yield pa.record_batch([pa.array([r["image_id"]], pa.int64()), pa.array([size["w"]], pa.int32()), pa.array([size["h"]], pa.int32()), pa.array([gray], pa.binary()), pa.array([error], pa.string())], names=["image_id", "w", "h", "gray", "error"])

    found = rasters.select("image_id", "data", "h", "w", "n").join(jobs, "image_id")
    return found.mapInArrow(run, "image_id long, w int, h int, gray binary, error string")


def _compare(counters=None):
    """Scores of the pairs of one cell after another; rows are sorted by cell, the cell's images come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j")), strict=True))
            ids, others, w, h, errors = (batch.column(c).to_pylist() for c in ("image_id", "b_id", "w", "h", "error"))
            rows, scores, messages = [], [], []
            for k in range(batch.num_rows):
                if keys[k] != cell:
                    cell, held = keys[k], {}
                if others[k] is None:
                    gray = batch.column("gray")[k].as_py()
                    held[ids[k], w[k], h[k]] = (None if gray is None else np.frombuffer(gray, np.uint8).reshape(h[k], w[k]), errors[k])
                    continue
                a, b = (held.get((i, w[k], h[k]), (None, "the image has no pixels")) for i in (ids[k], others[k]))
                score, message = None, a[1] or b[1]
                if message is None:
                    try:
                        score = kernels.ssim(a[0], b[0])
                    except ValueError as e:
                        message = str(e)
                if counters is not None:
                    counters["computed" if message is None else "skipped"].add(1)
                rows.append(k)
                scores.append(score)
                messages.append(message)
            yield pa.record_batch([batch.column("row").take(pa.array(rows, pa.int64())), pa.array(scores, pa.float64()), pa.array(messages, pa.string())], names=["row", "score", "error"])

    return run


def score(pairs: DataFrame, rasters: DataFrame | Callable[[DataFrame], DataFrame], sizes: DataFrame, edge: int | None, counters=None, line: int = LINE) -> DataFrame:
    """Adds score and error to ``pairs`` (c_id, b_id, ...); a failed pair has a null score and its message. A written table.

    ``rasters`` are image_id, data, h, w, n, or a function that gives them for ids: it is asked for what the pairs need, and not at all where there are no pairs.
    ``counters`` (``progress.Counters``) get what is resized, computed and skipped.

    Pairs of images that are not in ``sizes`` (image_id, width, height) are left out; images without a raster fail. Repeated pairs each have their row.
    """
    sized = materialise(sized_pairs(pairs, sizes, edge), "pairs")
    if sized.isEmpty():
        return materialise(sized.select("row.*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("error")), "scores")
    jobs = materialise(decode_jobs(sized), "jobs")
    ready = materialise(prepared(rasters(jobs) if callable(rasters) else rasters, jobs, None if counters is None else counters["resized"]), "prepared")
    found = materialise(graph.roots(sized.select(F.col("c_id").alias("a"), F.col("b_id").alias("b"))), "components")
    of = lambda name: found.select(F.col("v").alias(name), "root")
    x = sized.join(of("c_id"), "c_id", "left").withColumn("component", F.coalesce("root", "c_id")).drop("root")
    n = x.select("component", F.explode(F.array("c_id", "b_id")).alias("image_id"), "w", "h").distinct().groupBy("component").agg(F.ceil(F.count("*") / line).alias("lines"))
    place = lambda c: F.pmod(F.xxhash64(c, "w", "h"), F.col("lines"))
    x = x.join(n, "component").withColumn("p", place("c_id")).withColumn("q", place("b_id"))
    x = x.select("component", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "c_id", "b_id", "w", "h", "row")
    needed = x.select("component", "i", "j", F.explode(F.array("c_id", "b_id")).alias("image_id"), "w", "h").distinct()
    kind = x.schema["row"].dataType
    images = needed.join(ready, ["image_id", "w", "h"]).select("component", "i", "j", "image_id", F.lit(None).cast("long").alias("b_id"), "w", "h", "gray", "error", F.lit(None).cast(kind).alias("row"))
    passing = x.select("component", "i", "j", F.col("c_id").alias("image_id"), "b_id", "w", "h", F.lit(None).cast("binary").alias("gray"), F.lit(None).cast("string").alias("error"), "row")
    dealt = images.unionByName(passing).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "i", "j")
    dealt = dealt.sortWithinPartitions("component", "i", "j", F.col("b_id").isNotNull())
    scored = dealt.mapInArrow(_compare(counters), f"row {kind.simpleString()}, score double, error string")
    out = materialise(scored.select("row.*", "score", "error"), "scores")
    for table in (ready, found, sized, jobs):
        discard(table)
    return out
