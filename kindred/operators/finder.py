"""Difference finder: references against targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import DEFAULT, Profile
from kindred.functions import measures
from kindred.operators import metric
from kindred.operators.classify import RELATION_ORDER, rank_of, relation

NO_DISTANCE = 2**31 - 1


def related_pairs(t: DataFrame, r: DataFrame, most: int) -> DataFrame:
    """Pairs of a row of ``t`` (t_digest, t_phash, ...) and one of ``r`` (r_digest, r_phash, ...) with equal digests or hashes at most
    ``most`` bits apart, each pair once, with ``same``: whether the digests are equal.

    Two equi-joins: by digest, and by hash over the pairs of distinct hashes that meet in metric partitions around the references.
    Spark can't tell how many pairs there are, so what has a row a pair is merged, never broadcast.
    """
    same = F.coalesce(F.col("t_digest") == F.col("r_digest"), F.lit(False))
    equal = t.filter("t_digest is not null").join(r, F.col("t_digest") == F.col("r_digest")).withColumn("same", F.lit(True))
    near = metric.between(metric.table_of(t, "t_phash"), metric.table_of(r, "r_phash"), most).select(F.col("b").alias("t_phash"), F.col("a").alias("r_phash"))
    close = t.join(near.hint("merge"), "t_phash").join(r.hint("merge"), "r_phash").withColumn("same", same).filter("not same")
    return equal.unionByName(close)


def relations(targets: DataFrame, references: DataFrame, score, profile: Profile = DEFAULT, most: int = 16) -> DataFrame:
    """Relations of every target with every reference it is related to.

    ``score`` is a column over t_/r_ columns; it is evaluated only for pairs that differ in digest and are near.
    """
    r = references.select(*(F.col(c).alias(f"r_{c}") for c in ("image_id", "digest", "phash", "width", "height")))
    t = targets.select(*(F.col(c).alias(f"t_{c}") for c in ("image_id", "digest", "phash", "width", "height", "relative_path")))
    far = F.coalesce(F.bit_count(F.col("t_phash").bitwiseXOR(F.col("r_phash"))), F.lit(NO_DISTANCE)).cast("long")
    x = related_pairs(t, r, most).withColumn("distance", far)
    x = x.withColumn("score", F.when(F.col("same"), F.lit(1.0)).otherwise(score))
    ratio = measures.pixels(F.col("t_width"), F.col("t_height")).cast("double") / F.greatest(measures.pixels(F.col("r_width"), F.col("r_height")).cast("double"), F.lit(1.0))
    x = x.withColumn("classification", relation(F.col("same"), F.col("distance"), F.col("score"), ratio, profile, most))
    return x.filter("classification is not null").withColumn("class_rank", rank_of(F.col("classification"), RELATION_ORDER, 0))


def matches(found: DataFrame) -> DataFrame:
    """One row a target: its relations in order (class, similarity, distance, reference); the first is its class."""
    entry = F.struct("class_rank", (-F.col("score")).alias("worse"), "distance", F.col("r_image_id").alias("reference_id"), "classification", "score")
    return found.groupBy("t_image_id", "t_relative_path").agg(F.sort_array(F.collect_list(entry)).alias("relations")).select(
        "t_image_id", "t_relative_path", F.col("relations")[0]["classification"].alias("classification"), F.col("relations")[0]["reference_id"].alias("best_reference_id"),
        F.col("relations")[0]["class_rank"].alias("class_rank"), F.size("relations").cast("long").alias("n_relations"), "relations",
    )


def class_for(reference_id: int) -> Column:
    """A match's class relative to one reference; null where they aren't related."""
    return F.get(F.filter("relations", lambda r: r.reference_id == reference_id), F.lit(0))["classification"]


def filter_matches(found: DataFrame, reference_id: int | None = None, classification: str | None = None) -> DataFrame:
    """Targets related to the reference, with the class relative to it."""
    own = F.filter("relations", lambda r: r.reference_id == reference_id) if reference_id is not None else F.col("relations")
    out = found.withColumn("own", own).filter(F.size("own") > 0).withColumn("shown", F.col("own")[0]["classification"])
    return out.filter(F.col("shown") == classification) if classification else out
