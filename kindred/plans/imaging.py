"""Kernel queries over small arrays made of vectors: pixel = clamp(floor((x + 0.6) * 200), 0, 255), 8 by 8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import kernels, tiles
from kindred.plans.bindings import table
from kindred.plans.registry import query
from kindred.sources.images import gray_ssim, png_ssim

PIXELS = """
v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings),
px AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, least(greatest(floor((x::DOUBLE + 0.6::DOUBLE) * 200), 0), 255)::INT AS p FROM v)"""


def pixels(spark, sf_dir) -> DataFrame:
    p = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.6) * 200), F.lit(0)), F.lit(255)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))


def neighbours(spark, sf_dir) -> DataFrame:
    """Each vector beside the next one."""
    p = pixels(spark, sf_dir)
    return p.select(F.col("vec_id").alias("a"), F.col("p").alias("left")).join(p.select((F.col("vec_id") - 1).alias("a"), F.col("p").alias("right")), "a")


@query("ssim_small", f"""WITH {PIXELS}, w0 AS (SELECT range::INT AS o, exp(-(range * range)::DOUBLE / 4.5::DOUBLE) AS g FROM range(-5, 6)), w AS (SELECT o, g / (SELECT sum(g) FROM w0) AS g FROM w0),
r AS (SELECT c.range::INT AS c, CASE WHEN c.range + o < 0 THEN -(c.range + o) - 1 WHEN c.range + o > 7 THEN 15 - (c.range + o) ELSE c.range + o END::INT AS s, g FROM range(8) c, w),
q AS (SELECT a.vec_id AS a, a.y, a.x, a.p::DOUBLE AS l, b.p::DOUBLE AS r FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.x = a.x AND b.y = a.y),
h AS (SELECT q.a, q.y, r.c AS x, sum(g * l) AS ml, sum(g * q.r) AS mr, sum(g * l * l) AS sl, sum(g * q.r * q.r) AS sr, sum(g * l * q.r) AS c FROM q JOIN r ON r.s = q.x GROUP BY 1, 2, 3),
z AS (SELECT h.a, r.c AS y, h.x, sum(g * ml) AS ml, sum(g * mr) AS mr, sum(g * sl) AS sl, sum(g * sr) AS sr, sum(g * h.c) AS c FROM h JOIN r ON r.s = h.y GROUP BY 1, 2, 3)
SELECT a, round(avg((2 * ml * mr + 6.5025::DOUBLE) * (2 * (c - ml * mr) + 58.5225::DOUBLE) / ((ml * ml + mr * mr + 6.5025::DOUBLE) * (greatest(sl - ml * ml, 0) + greatest(sr - mr * mr, 0) + 58.5225::DOUBLE))), 6) AS score FROM z GROUP BY a""")
def ssim_small(spark, sf_dir):
    return neighbours(spark, sf_dir).select("a", F.round(gray_ssim("left", "right"), 6).alias("score"))


#: Larger test images from 64 pixels: fixed index formulas.
DCT_INDEX = "(x * x + 3 * y * x + 7 * y) % 64"
HASH_INDEX = "(5 * x + 3 * y + x * y) % 64"


@query("hash_small", f"""WITH RECURSIVE {PIXELS}, f AS (SELECT vec_id, y * 8 + x AS i, p FROM px), d AS (SELECT range AS d FROM range(1, 31)), zz0 AS (SELECT d, v.range AS v, d - v.range AS u FROM d, range(16) v WHERE d - v.range BETWEEN 0 AND 15),
zz AS (SELECT v, u, row_number() OVER (ORDER BY d, v) - 1 AS k FROM zz0 QUALIFY k < 32), g AS (SELECT x.range AS x, y.range AS y, {DCT_INDEX.replace("x", "x.range").replace("y", "y.range")} AS i FROM range(32) x, range(32) y),
b AS (SELECT zz.k, g.i, sum(cos((2 * g.x + 1) * zz.u * pi() / 64) * cos((2 * g.y + 1) * zz.v * pi() / 64)) * 0.25::DOUBLE * CASE WHEN u = 0 THEN 1 / sqrt(2.0::DOUBLE) ELSE 1 END * CASE WHEN v = 0 THEN 1 / sqrt(2.0::DOUBLE) ELSE 1 END AS w FROM zz, g GROUP BY zz.k, g.i, zz.u, zz.v),
c AS (SELECT vec_id, k, sum(w * p) AS c FROM b JOIN f USING (i) GROUP BY 1, 2), m AS (SELECT vec_id, list(c ORDER BY c)[17] AS m FROM c GROUP BY 1),
dct AS (SELECT vec_id, sum(CASE WHEN c > m THEN 1::BIGINT << k ELSE 0 END)::BIGINT AS dct FROM c JOIN m USING (vec_id) GROUP BY 1),
e AS (SELECT x.range AS x, y.range AS y, {HASH_INDEX.replace("x", "x.range").replace("y", "y.range")} AS i, (5 * (x.range + 1) + 3 * y.range + (x.range + 1) * y.range) % 64 AS j FROM range(16) x, range(16) y),
t AS (SELECT l.vec_id, (16 * e.y + e.x) % 32 AS bit, count(*) % 2 AS odd FROM e JOIN f l ON l.i = e.i JOIN f r ON r.i = e.j AND r.vec_id = l.vec_id WHERE l.p > r.p GROUP BY 1, 2),
dh AS (SELECT vec_id, sum(CASE WHEN odd = 1 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS dh FROM t GROUP BY 1)
SELECT vec_id, dct AS dct_hash, coalesce(dh, 0) AS difference_hash FROM dct LEFT JOIN dh USING (vec_id)""")
def hash_small(spark, sf_dir):
    x, y = np.meshgrid(np.arange(32), np.arange(32))
    dct_index = (x * x + 3 * y * x + 7 * y) % 64
    x, y = np.meshgrid(np.arange(17), np.arange(16))
    hash_index = (5 * x + 3 * y + x * y) % 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = [np.asarray(v, np.uint8) for v in b["p"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "dct_hash": [kernels.dct_hash(v[dct_index]) for v in flat], "difference_hash": [kernels.difference_hash(v[hash_index]) for v in flat]})

    return pixels(spark, sf_dir).mapInPandas(run, "vec_id long, dct_hash long, difference_hash long")


@query("diff_mask_small", f"""WITH RECURSIVE {PIXELS}, m AS (SELECT a.vec_id AS a, a.y * 8 + a.x AS i, a.y, a.x, b.p AS p FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.x = a.x AND b.y = a.y WHERE abs(a.p - b.p) > 32),
r AS (SELECT a, i, i AS s FROM m UNION SELECT r.a, r.i, n.i FROM r JOIN m c ON c.a = r.a AND c.i = r.s JOIN m n ON n.a = r.a AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1),
l AS (SELECT a, i, min(s) AS root FROM r GROUP BY 1, 2), g AS (SELECT a, root, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, sum((p * 45 + 255 * 55) // 100)::BIGINT AS red FROM l JOIN m USING (a, i) GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT a, count(*) AS n, sum(area) AS area, string_agg(x0 || ' ' || y0 || ' ' || x1 || ' ' || y1 || ' ' || area, ',' ORDER BY root) AS boxes, sum(red)::BIGINT AS red FROM g GROUP BY a), ch AS (SELECT a, count(*) AS n_changed FROM m GROUP BY a)
SELECT e.vec_id AS a, coalesce(n_changed, 0) AS n_changed, coalesce(n, 0) AS n_regions, coalesce(area, 0)::DOUBLE / 64 AS changed_ratio, coalesce(boxes, '') AS boxes, coalesce(red, 0) AS red FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1 LEFT JOIN ch ON ch.a = e.vec_id LEFT JOIN s ON s.a = e.vec_id""")
def diff_mask_small(spark, sf_dir):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for a, left, right in b.itertuples(index=False):
                x, y = (np.asarray(v, np.uint8).reshape(8, 8) for v in (left, right))
                mask = kernels.difference_mask(x, y, kernels.threshold(50))
                found = kernels.regions(mask, 2)
                at = np.concatenate([r["pixels"] for r in found]) if found else np.zeros(0, np.int64)
                red = kernels.overlay(y, at).reshape(-1, 4)[at, 0].astype(int).sum()
                boxes = ",".join(f"{r['x0']} {r['y0']} {r['x1']} {r['y1']} {len(r['pixels'])}" for r in found)
                rows.append((a, int(mask.sum()), len(found), len(at) / 64, boxes, int(red)))
            yield pd.DataFrame(rows, columns=["a", "n_changed", "n_regions", "changed_ratio", "boxes", "red"])

    return neighbours(spark, sf_dir).select("a", "left", "right").mapInPandas(run, "a long, n_changed long, n_regions long, changed_ratio double, boxes string, red long")


@query("diff_regions_tiled", f"""WITH RECURSIVE {PIXELS}, m AS (SELECT a.vec_id AS a, a.y * 8 + a.x AS i, a.y, a.x FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.x = a.x AND b.y = a.y WHERE abs(a.p - b.p) > 32),
r AS (SELECT a, i, i AS s FROM m UNION SELECT r.a, r.i, n.i FROM r JOIN m c ON c.a = r.a AND c.i = r.s JOIN m n ON n.a = r.a AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1),
l AS (SELECT a, i, min(s) AS root FROM r GROUP BY 1, 2) SELECT a AS image_id, root::BIGINT AS at, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM l JOIN m USING (a, i) GROUP BY 1, 2 HAVING count(*) >= 2""")
def diff_regions_tiled(spark, sf_dir):
    """The regions of each pair's difference, from tiles of three by three pixels."""
    apart = F.zip_with("left", "right", lambda x, y: F.when(F.abs(x - y) > kernels.threshold(50), F.lit("01")).otherwise(F.lit("00")))
    masks = neighbours(spark, sf_dir).select(F.col("a").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(apart, "")).alias("bits"))
    return tiles.regions(tiles.tiled(masks, 3), 2)


@query("kernels_files")
def kernels_files(spark, sf_dir):
    """Vectors as PNG files in memory, their hash, and their similarity to the next one's file; no SQL decodes a PNG."""

    @F.pandas_udf("binary")
    def as_png(p: pd.Series) -> pd.Series:
        return p.map(lambda v: kernels.png(np.asarray(v, np.uint8).reshape(8, 8)))

    @F.pandas_udf("string")
    def hashed(files: pd.Series) -> pd.Series:
        return files.map(lambda f: kernels.phash(kernels.read_png(bytes(f))))

    x = neighbours(spark, sf_dir).select("a", as_png("left").alias("left"), as_png("right").alias("right"))
    return x.select("a", hashed("left").alias("phash"), F.octet_length("left").cast("long").alias("size"), png_ssim("left", "right").alias("s")).select("a", "phash", "size", F.col("s.score").alias("score"), F.col("s.error").alias("error"))
