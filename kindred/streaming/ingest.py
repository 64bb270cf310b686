"""Structured Streaming: files as they arrive, and windows over an event stream.

The studied system has no streams; these carry its scan and its event log over to unbounded inputs. Each result
equals the batch result over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import paths
from kindred.scratch import materialise, scratch_path

#: What Spark's binary file source gives; a stream must be told.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """path, size, mtime, digest of supported files, as they appear below a root."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    kept = files.filter(paths.included(F.col("path")) & paths.supported(F.col("path")))
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("arrived"), F.sha2("content", 256).alias("digest"))


def match_arriving(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """Stream-static left join: which arriving files the baseline (digest, image_id) already has. The baseline is written
    once, so no batch scans and digests its files again."""
    first = baseline.groupBy("digest").agg(F.min("image_id").alias("primary_id"))
    first = materialise(first, "baseline")
    return files.join(first, "digest", "left").withColumn("analysis_type", F.when(F.col("primary_id").isNotNull(), "exact_duplicate").otherwise("not_evaluated"))


def first_of_each(files: DataFrame, late: str = "1 day") -> DataFrame:
    """One file for each digest within the watermark."""
    return files.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["digest"])


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def run_to_table(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None):
    """Run what is available now into a Parquet table. With ``keys``, each batch replaces the partitions it has."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True)
    if keys:

        def upsert(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

        query = writer.foreachBatch(upsert).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return spark.read.parquet(path)
