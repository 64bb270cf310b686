"""Selections as sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys, the first in order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def unordered_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (lo, hi) of two columns."""
    return rows.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).dropDuplicates(["lo", "hi"])


def selection_state(rows: DataFrame) -> DataFrame:
    """One row with state: all, some or none of the rows are selected."""
    return rows.agg(F.when(F.bool_and("selected"), "all").when(F.bool_or("selected"), "some").otherwise("none").alias("state"))
