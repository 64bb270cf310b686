"""Image files as rows of features, and the kernels as vectorised functions of columns."""

from __future__ import annotations

import base64
import hashlib
import os
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import paths
from kindred.operators import blake3, kernels
from kindred.schema import EXCLUDES

FEATURES = "path string, size long, mtime long, width int, height int, format string, color_type string, digest string, phash string, error string"
_SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])
_COLORS = {1: "L8", 3: "Rgb8", 4: "Rgba8"}


def digest(content: bytes, algorithm: str = "sha256") -> str:
    return blake3.hexdigest(content) if algorithm == "blake3" else hashlib.new(algorithm, content).hexdigest()


def decoded(spark: SparkSession, root: str, excludes=EXCLUDES) -> DataFrame:
    """path, content, size, mtime and the decoded raster (h, w, n, pixels in BGR order) of the images below a root.

    Decoding is the image source's; a file that it can't decode has a null raster. Both reads list the same files.
    """
    from kindred.sources.listing import scan

    files = scan(spark, root, excludes, content=True)
    rasters = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    pixels = rasters.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data")).filter("h > 0")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.join(pixels.withColumn("key", plain(F.col("origin"))), plain(F.col("path")) == F.col("key"), "left").drop("key", "origin")


FEW_FILES = 1000  # files that are read by their names rather than with all of their root


def _pixels(spark: SparkSession, roots: list[str], names: list[str] | None = None) -> DataFrame:
    """key (plain path), h, w, n, data of what the image source can decode below ``roots``, or of the files ``names``."""
    reader = spark.read.format("image").option("dropInvalid", "false")
    images = reader.load(names) if names is not None else reader.option("recursiveFileLookup", "true").load(roots)
    i = F.col("image")
    return images.select(plain(i["origin"]).alias("key"), i["height"].alias("h"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("data")).filter("h > 0")


def plain(path) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def scan_features(spark: SparkSession, root: str, excludes=EXCLUDES, algorithm: str = "sha256", only: DataFrame | None = None, counters=None) -> DataFrame:
    """The rows of ``features`` for the image files below a root, or for those of ``only`` (path, size, mtime).

    Digests are taken where files are read and hashes where they are decoded; what is joined are rows of features, never contents or
    pixels.
    """
    from kindred.sources.listing import scan

    names = None
    if only is not None:
        few = [r["path"] for r in only.select("path").limit(FEW_FILES + 1).collect()]
        if not few:
            return spark.createDataFrame([], FEATURES)
        names = few if len(few) <= FEW_FILES else None
    if names is None:
        files = scan(spark, root, excludes, content=True)
        files = files if only is None else files.join(only.select("path"), "path", "left_semi")
    else:
        files = spark.read.format("binaryFile").load(names).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")
    taken = files.select("path", "size", "mtime", F.sha2("content", 256).alias("digest") if algorithm == "sha256" else _digests(algorithm)("content").alias("digest"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if counters is not None:
                counters["decoded"].add(len(b))
            hashes = [kernels.phash(raster(x.data, int(x.h), int(x.w), int(x.n))) for x in b.itertuples(index=False)]
            yield pd.DataFrame({"key": b["key"], "width": b["w"].astype("Int32"), "height": b["h"].astype("Int32"), "color_type": [_COLORS.get(int(n), str(int(n))) for n in b["n"]], "phash": hashes})

    pixels = _pixels(spark, [root], names)
    if names is None and only is not None:
        pixels = pixels.join(only.select(plain(F.col("path")).alias("key")), "key", "left_semi")
    hashed = pixels.mapInPandas(run, "key string, width int, height int, color_type string, phash string")
    x = taken.join(hashed, plain(F.col("path")) == F.col("key"), "left")
    failed = F.col("phash").isNull()
    return x.select("path", "size", "mtime", "width", "height", F.lower(paths.extension(F.col("path"))).alias("format"), "color_type", F.when(~failed, F.col("digest")).alias("digest"), "phash", F.when(failed, "the file can't be decoded").alias("error"))


def _digests(algorithm: str):
    @F.pandas_udf(T.StringType())
    def one(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: digest(bytes(c), algorithm))

    return one


def rasters_of(spark: SparkSession, images: DataFrame, roots: list[str], counters=None):
    """A function of image ids (image_id) that decodes these images and no others: image_id, data, h, w, n."""

    def of(ids: DataFrame) -> DataFrame:
        wanted = images.join(ids.select("image_id").distinct(), "image_id", "left_semi").select("image_id", "path")
        few = wanted.limit(FEW_FILES + 1).collect()
        pixels = _pixels(spark, roots, [r["path"] for r in few] if len(few) <= FEW_FILES else None) if few else None
        if pixels is None:
            return spark.createDataFrame([], "image_id long, data binary, h int, w int, n int")
        if counters is not None:
            counters.add(decoded=len(few) if len(few) <= FEW_FILES else wanted.count())
        keyed = (spark.createDataFrame([tuple(r) for r in few], "image_id long, path string") if len(few) <= FEW_FILES else wanted).select("image_id", plain(F.col("path")).alias("key"))
        return F.broadcast(keyed).join(pixels, "key").drop("key") if len(few) <= FEW_FILES else keyed.join(pixels, "key").drop("key")

    return of


def raster(data, h: int, w: int, n: int) -> np.ndarray:
    """An RGB(A) or gray array of the image source's bytes."""
    a = np.frombuffer(data, np.uint8).reshape(h, w, n)
    return a[..., 0] if n == 1 else a[..., [2, 1, 0, *range(3, n)]]


def features(images: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Size, dimensions, format, colour, digest and perceptual hash of decoded images; a failure is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                row = {"path": x.path, "size": x.size, "mtime": x.mtime, "width": None, "height": None, "format": x.format, "color_type": None, "digest": None, "phash": None, "error": None}
                if x.data is None:
                    row["error"] = "the file can't be decoded"
                else:
                    h, w, n = int(x.h), int(x.w), int(x.n)
                    row |= {"width": w, "height": h, "color_type": _COLORS.get(n, str(n)), "digest": digest(bytes(x.content), algorithm), "phash": kernels.phash(raster(x.data, h, w, n))}
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return images.withColumn("format", F.lower(paths.extension(F.col("path")))).mapInPandas(run, FEATURES)


@F.pandas_udf(_SCORE)
def png_ssim(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Similarity of two PNG files, capped for tasks; an error becomes a message beside a null score."""

    def one(a, b):
        try:
            return kernels.pair_ssim(kernels.read_png(bytes(a)), kernels.read_png(bytes(b)), 1600), None
        except ValueError as e:
            return None, str(e)

    return pd.DataFrame([one(a, b) for a, b in zip(left, right, strict=True)], columns=["score", "error"])


@F.pandas_udf(T.DoubleType())
def gray_ssim(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two square gray images given as flat arrays."""
    square = lambda v: np.asarray(v, np.uint8).reshape(int(len(v) ** 0.5), -1)
    return pd.Series([kernels.ssim(square(a), square(b)) for a, b in zip(left, right, strict=True)], dtype=float)


def scan_errors(found: DataFrame) -> DataFrame:
    """Files that could not be decoded; they are no images and no totals count them."""
    return found.filter("error is not null").select("path", "error")


def image_rows(found: DataFrame, run_id: str, role: str, root: str) -> DataFrame:
    """Feature rows as the images table holds them; ids follow the path, so reruns agree."""
    from kindred.operators.stats import numbered

    ok = numbered(found.filter("error is null"), "path", name="image_id")
    return ok.select(
        "image_id", F.lit(run_id).alias("run_id"), F.lit(role).alias("role"), "path", paths.relative(F.regexp_replace("path", "^file:/+", "/"), F.lit(root.rstrip("/"))).alias("relative_path"),
        F.col("size").alias("file_size"), "mtime", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "format", "color_type", "digest", F.conv("phash", 16, -10).cast("long").alias("phash"), (F.col("width").cast("double") / F.col("height")).alias("aspect"), F.lit("completed").alias("scan_status"),
    )


class FileChanged(ValueError):
    """A file is not what it was when it was chosen."""


_SINGLE = "path string, file_name string, file_size long, modified_at_ms long, width int, height int, phash string, thumbnail string, error string"


def load_single(spark: SparkSession, path: str, edge: int = 200) -> DataFrame:
    """One row of an image file: what ``features`` knows and a PNG thumbnail of at most ``edge`` pixels a side as a data URL.

    The file's real path is used; a path that is no file raises ValueError, an image that can't be decoded has an error.
    """
    path = os.path.realpath(path)
    if not os.path.isfile(path):
        raise ValueError(f"{path} is no file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                row = [x.path, os.path.basename(x.path), x.size, x.mtime]
                if x.data is None:
                    rows.append([*row, None, None, None, None, "the file can't be decoded"])
                    continue
                image = raster(x.data, int(x.h), int(x.w), int(x.n))
                small = kernels.resize(image, *kernels.target_size((int(x.w), int(x.h)), (int(x.w), int(x.h)), edge))
                url = "data:image/png;base64," + base64.b64encode(kernels.png(small)).decode()
                rows.append([*row, int(x.w), int(x.h), kernels.phash(image), url, None])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SINGLE.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return decoded(spark, path, excludes=()).mapInPandas(run, _SINGLE)


def check_unchanged(path: str, size: int, modified_at_ms: int) -> str:
    """The real path of a file with this size and time; raises FileChanged otherwise."""
    path = os.path.realpath(path)
    now = os.stat(path)
    if (now.st_size, now.st_mtime_ns // 10**6) != (size, modified_at_ms):
        raise FileChanged(path)
    return path


def measure_pair(spark: SparkSession, left: tuple[str, int, int], right: tuple[str, int, int]) -> dict:
    """distance of the hashes, score at full size and duration_ms of two files (path, size, time in ms) that must not have
    changed since."""
    started = time.monotonic()
    a, b = (decoded(spark, check_unchanged(*side), excludes=()).select(F.struct("data", "h", "w", "n").alias(name)) for side, name in ((left, "a"), (right, "b")))

    @F.pandas_udf("distance long, score double")
    def measure(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for sides in zip(x.itertuples(index=False), y.itertuples(index=False), strict=True):
            if any(s.data is None for s in sides):
                rows.append((None, None))
                continue
            one, two = (raster(s.data, int(s.h), int(s.w), int(s.n)) for s in sides)
            rows.append(((int(kernels.phash(one), 16) ^ int(kernels.phash(two), 16)).bit_count(), kernels.pair_ssim(one, two)))
        return pd.DataFrame(rows, columns=["distance", "score"]).astype({"distance": "Int64"})

    row = a.crossJoin(b).select(measure("a", "b").alias("m")).first()  # one row each
    if row["m"]["score"] is None:
        raise ValueError("a file can't be decoded")
    return row["m"].asDict() | {"duration_ms": int((time.monotonic() - started) * 1000)}
