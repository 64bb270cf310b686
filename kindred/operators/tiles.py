"""Connected regions of masks that are too large for one worker: tiles are labelled by themselves and joined at their edges.

A region's name is (image, its first pixel in scan order). In a tile each region is named after its first pixel there;
regions that touch across an edge of tiles are edges of a graph, and the least name that a region reaches is its name in the
whole mask. Only regions' bounds and the pixels along the edges of tiles are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import graph, kernels
from kindred.scratch import materialise

EDGE = 1024

TILES = "image_id long, width long, y int, x int, h int, w int, bits binary"


def tiled(masks: DataFrame, edge: int = EDGE) -> DataFrame:
    """Tiles of masks (image_id, width, height, bits: a byte a pixel, row by row). Sources that read images in parts make
    such rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                mask = np.frombuffer(m["bits"], np.uint8).reshape(m["height"], m["width"])
                rows = [(m["image_id"], m["width"], y, x, part.shape[0], part.shape[1], part.tobytes()) for y in range(0, m["height"], edge) for x in range(0, m["width"], edge) for part in [mask[y : y + edge, x : x + edge]]]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()), strict=True)], names=["image_id", "width", "y", "x", "h", "w", "bits"])

    return masks.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "bits").mapInArrow(run, TILES)


PARTS = "image_id long, at long, area long, x0 int, y0 int, x1 int, y1 int, border array<struct<y:int,x:int>>"


def labelled(tiles: DataFrame) -> DataFrame:
    """The regions of each tile: first pixel (``at``, flat in the image), area, bounds, and their pixels along the tile's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PARTS.split(", ")[:7]] + ["border"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32())]))]
        for batch in batches:
            for t in batch.to_pylist():
                mask = np.frombuffer(t["bits"], np.uint8).reshape(t["h"], t["w"]) > 0
                rows = []
                for r in kernels.regions(mask, 1):
                    y, x = r["pixels"] // t["w"], r["pixels"] % t["w"]
                    on = (y == 0) | (x == 0) | (y == t["h"] - 1) | (x == t["w"] - 1)
                    border = [{"y": int(a), "x": int(b)} for a, b in zip(y[on] + t["y"], x[on] + t["x"], strict=True)]
                    first = int(((y + t["y"]) * t["width"] + x + t["x"]).min())
                    rows.append((t["image_id"], first, len(y), r["x0"] + t["x"], r["y0"] + t["y"], r["x1"] + t["x"], r["y1"] + t["y"], border))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return tiles.mapInArrow(run, PARTS)


def regions(tiles: DataFrame, least_area: int = 1) -> DataFrame:
    """(image_id, at, area, x0, y0, x1, y1) of the 8-connected regions of at least ``least_area`` pixels over all tiles;
    ``at`` is the first pixel in scan order. Equal to ``kernels.regions`` of the whole mask, whatever the tiles."""
    parts = materialise(labelled(tiles), "parts")
    pixels = parts.select("image_id", F.struct("image_id", "at").alias("name"), F.explode("border").alias("p")).select("image_id", "name", "p.y", "p.x")
    # half of the eight neighbours is enough: each touching pair is seen from one side
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    near = pixels.select("image_id", F.col("name").alias("a"), "y", "x", steps.alias("s")).select("image_id", "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    # pixels are many more than the rows of parts that they come from, which is what Spark goes by: merged, not broadcast
    touching = near.join(pixels.withColumnRenamed("name", "b").hint("merge"), ["image_id", "y", "x"]).filter("a <> b").select("a", "b")
    found = graph.roots(touching)
    whole = parts.drop("border").withColumn("v", F.struct("image_id", "at")).join(found.hint("merge"), "v", "left").withColumn("name", F.coalesce("root", "v"))
    out = whole.groupBy("name").agg(F.sum("area").alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.filter(F.col("area") >= least_area).select("name.image_id", "name.at", "area", "x0", "y0", "x1", "y1")
