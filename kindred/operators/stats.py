"""Counts of a run, their conservation, histories and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kindred.functions import paths
from kindred.schema import ANALYSIS
from kindred.scratch import discard, materialise


def class_counts(results: DataFrame) -> DataFrame:
    """One row: a count for each class, 0 where there is none."""
    return results.agg(*(F.count_if(F.col("analysis_type") == c).alias(c) for c in ANALYSIS))


def conserved(counts: DataFrame, total: Column) -> DataFrame:
    """Adds whether the classes add up to the total."""
    classes = sum((F.col(c) for c in ANALYSIS[1:]), F.col(ANALYSIS[0]))
    return counts.withColumn("classified", classes).withColumn("conserved", classes == total)


def history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs first; the limit is held within 1 and 50, stored totals never fall below the counted ones."""
    shown = runs.withColumn("total", F.greatest("stored", "counted"))
    return shown.orderBy(F.desc("created_at"), F.desc("run_id")).limit(min(max(limit, 1), 50))


def page_of(index: Column, size: int = 100) -> Column:
    """1-based page of a 0-based position."""
    return F.floor(index / size) + 1


FEW = 100_000  # rows that one task may put in order


def running(df: DataFrame, value: Column, *order: Column | str, name: str, few: int = FEW) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each row in the order.

    Rows are written and counted once. Of more than ``few`` rows, each range of the order is summed by its own task, and the ranges'
    totals (one row a partition) give the offsets; no task sees the whole table.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    n, seen = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), Observation()
    rows = materialise(df.withColumn("_value", value).observe(seen, F.count("*").alias("n")), "rows")
    if seen.get["n"] <= few:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum("_value").over(upto).cast("long")).drop("_value")
    ranges = materialise(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    discard(rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_part").agg(F.sum("_value").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.withColumn(name, F.sum("_value").over(own))
    return summed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_value", "_before")


def numbered(df: DataFrame, *order: Column | str, name: str = "position", few: int = FEW) -> DataFrame:
    """Adds the 1-based position in an order."""
    return running(df, F.lit(1).cast("long"), *order, name=name, few=few)


def numbered_within(df: DataFrame, keys: list[str], *order: Column | str, name: str = "place", few: int = FEW) -> DataFrame:
    """Adds the 1-based position in an order among the rows with equal ``keys`` (none null): the position among all rows, less
    that before the first of its keys. A key with most of the rows is spread like any other."""
    x = numbered(df, *keys, *order, name="_position", few=few)
    first = x.groupBy(*keys).agg(F.min("_position").alias("_first"))
    return x.join(first, keys).withColumn(name, F.col("_position") - F.col("_first") + 1).drop("_position", "_first")


def reorder(position: Column, source: int, target: int) -> Column:
    """Positions after the element at ``source`` was moved to ``target`` (both 0-based)."""
    if source < target:
        between = (position > source) & (position <= target)
        return F.when(position == source, target).when(between, position - 1).otherwise(position)
    between = (position >= target) & (position < source)
    return F.when(position == source, target).when(between, position + 1).otherwise(position)


def evict(entries: DataFrame, budget: int) -> DataFrame:
    """Cache entries that stay: the most recently used while their bytes fit the budget."""
    return running(entries, F.col("bytes"), F.desc("tick"), "key", name="held").filter(F.col("held") <= budget)


def folder_counts(images: DataFrame, path: Column) -> DataFrame:
    """(role, folder, label, file_count): the folders that hold images themselves."""
    at = images.withColumn("folder", paths.folder(path))
    return at.groupBy("role", "folder").agg(F.count("*").alias("file_count")).select("role", "folder", paths.file_name(F.col("folder")).alias("label"), "file_count")


def batch_result(outcomes: DataFrame, *keys: str) -> DataFrame:
    """succeeded, skipped, failed of a batch, and whether it can be undone: something succeeded, by rename or move."""
    one = lambda s: F.count_if(F.col("status") == s)
    return outcomes.groupBy(*keys).agg(one("succeeded").alias("succeeded"), one("skipped").alias("skipped"), one("failed").alias("failed"), F.bool_or((F.col("status") == "succeeded") & F.col("operation").isin("rename", "move")).alias("reversible"))
