"""The operation log: append only; the state of a result is its latest event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.schema import ACTIONS

GONE = ("recycled", "permanently_deleted")
# Which operation may follow which state.
TRANSITIONS = {"prepared": ("none", "validating", "restored", "failed"), "recycled": ("prepared",), "restored": ("recycled",), "permanently_deleted": ("recycled",), "validating": ("none", "validating", "restored", "failed")}


def action_status(operation: Column) -> Column:
    """Log names as states: both kinds of failure are failed, unknown ones none."""
    return F.when(operation.isin("operation_failed", "validation_failed"), "failed").when(operation.isin(*ACTIONS), operation).otherwise("none")


def latest(events: DataFrame, *more: str) -> DataFrame:
    """The last event of each result by (created_at, id); a hash aggregation with one row a result from each task."""
    newest = F.max_by(F.struct("operation_type", "created_at", "id", *more), F.struct("created_at", "id"))
    return events.groupBy("result_id").agg(newest.alias("e")).select("result_id", "e.*")


def latest_of(events: DataFrame, operation: str, *more: str) -> DataFrame:
    return latest(events.filter(F.col("operation_type") == operation), *more)


def latest_of_images(results: DataFrame, events: DataFrame, *more: str) -> DataFrame:
    """The last event of each image's results: ``results`` (result_id, image_id) says whose a result is."""
    return latest(events, *more).join(results.select("result_id", "image_id"), "result_id")


def active(images: DataFrame, results: DataFrame, events: DataFrame) -> DataFrame:
    """Images of which no result was taken away by its latest operation."""
    gone = latest_of_images(results, events).filter(F.col("operation_type").isin(*GONE)).select("image_id")
    return images.join(gone, "image_id", "left_anti")


def recyclable(results: DataFrame, events: DataFrame) -> DataFrame:
    """The first result (result_id, image_id, analysis_type) of each image of a class that may go, of those whose latest
    operation did not take them away."""
    fit = results.filter(F.col("analysis_type").isin("exact_duplicate", "likely_compressed"))
    gone = latest(events).filter(F.col("operation_type").isin(*GONE)).select("result_id")
    left = fit.join(gone, "result_id", "left_anti")
    return left.groupBy("image_id").agg(F.min("result_id").alias("result"), F.min_by("analysis_type", "result_id").alias("analysis_type"))


def transitions(events: DataFrame) -> DataFrame:
    """Each event with the state before it and whether it is legal there; failures are always legal."""
    order = Window.partitionBy("result_id").orderBy("created_at", "id")
    state = action_status(F.col("operation_type"))
    before = F.coalesce(F.lag(state).over(order), F.lit("none"))
    legal = state == "failed"
    for operation, allowed in TRANSITIONS.items():
        legal = legal | ((state == operation) & before.isin(*allowed))
    return events.withColumn("state", state).withColumn("before", before).withColumn("legal", legal)


STARTS, ENDS = ("preflight", "indexing"), ("analysis_complete", "action_complete", "completed_with_errors", "failed")


def run_states(log: DataFrame) -> DataFrame:
    """One row a run of its status rows (run_id, id, status, created_at): the latest status, when the run was created, last
    started and last completed. Of every other column the latest value that is not null."""
    order = F.struct("created_at", "id")
    when = lambda names: F.max(F.when(F.col("status").isin(*names), F.col("created_at")))
    more = [c for c in log.columns if c not in ("run_id", "id", "status", "created_at")]
    kept = (F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in more)
    return log.groupBy("run_id").agg(F.max_by("status", order).alias("status"), F.min("created_at").alias("created_at"), when(STARTS).alias("started_at"), when(ENDS).alias("completed_at"), *kept)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """An upsert: of the rows with equal keys, the last one in order."""
    window = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def settings(rows: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """One row of settings from key, value rows: each key with its kind; missing or unreadable ones take the default."""
    picked = rows.agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in defaults))
    return picked.select(*(F.coalesce(F.col(k).try_cast(kind), F.lit(value).cast(kind)).alias(k) for k, (kind, value) in defaults.items()))


def delete_run(table: DataFrame, run: Column) -> DataFrame:
    """The table without the rows of a run (a row whose run is unknown stays)."""
    return table.filter(~F.coalesce(run, F.lit(False)))


def cache_context(active_images: DataFrame, events: DataFrame) -> DataFrame:
    """(active images, latest operation id): what a cached grouping is valid for."""
    last = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_operation"))
    return active_images.agg(F.count("*").alias("active_images")).select("active_images", last.scalar().alias("last_operation"))


def verify_recycle(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """The first reason why a file may not be recycled, or ok.

    ``manifest``: path, role, size, mtime, digest, primary_path, primary_digest. ``listing``: path, size, mtime, digest
    as they are now. The order of the reasons is fixed: role, missing, size, mtime, digest, primary_missing,
    primary_digest.
    """
    now = listing.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.col("digest").alias("n_digest"))
    match = listing.select(F.col("path").alias("primary_path"), F.col("digest").alias("m_digest"))
    x = manifest.join(now, "path", "left").join(match, "primary_path", "left")
    reason = (
        F.when(F.col("role") != "comparison", "role")
        .when(F.col("n_size").isNull(), "missing")
        .when(F.col("n_size") != F.col("size"), "size")
        .when(F.col("n_mtime") != F.col("mtime"), "mtime")
        .when(F.col("n_digest") != F.col("digest"), "digest")
        .when(F.col("primary_path").isNotNull() & F.col("m_digest").isNull(), "primary_missing")
        .when(F.col("m_digest") != F.col("primary_digest"), "primary_digest")
        .otherwise("ok")
    )
    return x.withColumn("verdict", reason)
