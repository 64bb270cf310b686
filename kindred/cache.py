"""What is known of files and pairs by their content, so that a later run neither decodes nor scores them again.

``files`` maps (path, size, mtime) to a digest, ``features`` a digest to what decoding gave, ``scores`` a pair of digests (and the
edge at which they were compared) to its score. All are append only, keyed by content, and shared by all runs of a store; a changed
file has another time or size, and so another entry.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.sinks import file_system

TABLES = {
    "files": "algorithm string, path string, size long, mtime long, digest string, error string",
    "features": "algorithm string, digest string, width int, height int, color_type string, phash string",
    "scores": "edge int, low string, high string, score double",
}


class Cache:
    def __init__(self, spark: SparkSession, root: str, algorithm: str = "sha256"):
        self.spark, self.root, self.algorithm = spark, root.rstrip("/"), algorithm

    def read(self, table: str) -> DataFrame:
        fs, at = file_system(self.spark, f"{self.root}/{table}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(f"{TABLES[table]}, batch string").parquet(f"{self.root}/{table}").drop("batch")

    def append(self, table: str, df: DataFrame) -> None:
        """Written aside, then named: a reader takes whole batches only."""
        name = uuid.uuid4().hex
        aside = f"{self.root}/{table}/.{name}"
        typed = self.spark.createDataFrame([], TABLES[table]).schema
        df.select(*(F.col(f.name).cast(f.dataType) for f in typed)).write.option("compression", "zstd").parquet(aside)
        fs, at = file_system(self.spark, aside)
        if not fs.rename(at, file_system(self.spark, f"{self.root}/{table}/batch={name}")[1]):
            raise OSError(f"{table} could not be written")

    def known_files(self, listing: DataFrame) -> DataFrame:
        """Of ``listing`` (path, size, mtime, format) those whose content is known, with their features."""
        files = self.read("files").filter(F.col("algorithm") == self.algorithm).dropDuplicates(["path", "size", "mtime"]).drop("algorithm")
        features = self.read("features").filter(F.col("algorithm") == self.algorithm).dropDuplicates(["digest"]).drop("algorithm")
        return listing.join(files, ["path", "size", "mtime"]).join(features, "digest", "left")

    def keep_features(self, found: DataFrame) -> None:
        """New rows of ``images.scan_features``."""
        mark = F.lit(self.algorithm).alias("algorithm")
        self.append("features", found.filter("error is null").select(mark, "digest", "width", "height", "color_type", "phash").dropDuplicates(["digest"]))
        self.append("files", found.select(mark, "path", "size", "mtime", F.when(F.col("error").isNull(), F.col("digest")).alias("digest"), "error"))  # last: a file counts as known when its features stand

    def with_scores(self, pairs: DataFrame, images: DataFrame, edge: int | None) -> DataFrame:
        """``pairs`` (c_id, b_id, ...) with the digests (low, high) and the known score, or null."""
        d = lambda name, to: images.select(F.col("image_id").alias(name), F.col("digest").alias(to))
        x = pairs.join(d("c_id", "_c"), "c_id").join(d("b_id", "_b"), "b_id").withColumn("low", F.least("_c", "_b")).withColumn("high", F.greatest("_c", "_b")).drop("_c", "_b")
        known = self.read("scores").filter(F.col("edge") == (edge or 0)).groupBy("low", "high").agg(F.max("score").alias("score"))
        return x.join(known, ["low", "high"], "left")

    def keep_scores(self, scored: DataFrame, edge: int | None) -> None:
        """``scored``: low, high, score; failures are not kept."""
        self.append("scores", scored.filter("score is not null").select(F.lit(edge or 0).alias("edge"), "low", "high", "score").dropDuplicates(["low", "high"]))
