"""The two decision lists, as ordered expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import DEFAULT, Profile
from kindred.functions import measures

SORT_ORDER = ("exact_duplicate", "likely_compressed", "variant", "inconclusive", "similar_keep", "no_baseline_match", "not_evaluated")
RELATION_ORDER = ("exact", "compressed_or_reencoded", "variant", "related_group", "weak_candidate")


def rank_of(column: Column, order: tuple[str, ...], first: int) -> Column:
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(order):
        out = out.when(column == name, i + first)
    return out.otherwise(len(order) + first).cast("long")


def classify(images: DataFrame, found: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """One class for each comparison image.

    ``images``: image_id, width, height, file_size. ``found`` (top candidates): c_id, b_id, b_path, distance, rank,
    truncated, score, exact, and the candidate's b_width, b_height, b_file_size. In the profile's scope "primary"
    all candidates get the nearest one's score; in "all" each has its own. The list, first match wins: truncated at
    the full count; none; exact; none scored; best below variant; a tie; compressed; variant; similar.
    """
    score = F.first_value("score").over(_nearest()) if profile.score_scope == "primary" else F.col("score")
    scored = found.withColumn("s", score)
    order = F.struct((-F.col("s")).alias("k1"), F.col("distance"), (-measures.pixels(F.col("b_width"), F.col("b_height"))).alias("k2"), F.col("b_path"), F.col("b_id"), F.col("b_width"), F.col("b_height"), F.col("b_file_size"), F.col("s"))
    per = scored.groupBy(F.col("c_id").alias("image_id")).agg(
        F.count("*").alias("n"), F.bool_or("truncated").alias("truncated"), F.min(F.when(F.col("exact"), F.struct("b_path", "b_id")))["b_id"].alias("exact_id"),
        F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), order))).alias("best"), F.min_by("b_id", "rank").alias("nearest_id"), F.min_by("distance", "rank").alias("nearest_distance"),
    )
    x = images.join(per, "image_id", "left").withColumn("b1", F.get("best", F.lit(0))).withColumn("b2", F.get("best", F.lit(1)))
    s1, s2 = F.col("b1.s"), F.col("b2.s")
    c = {k: F.col(k) for k in ("width", "height", "file_size")}
    b = {k: F.col(f"b1.b_{k}") for k in ("width", "height", "file_size")}
    ratio = measures.pixels(c["width"], c["height"]).cast("double") / measures.pixels(b["width"], b["height"])
    same = ((c["width"] == b["width"]) & (c["height"] == b["height"])) | ratio.between(0.95, 1.05)
    n = F.coalesce("n", F.lit(0))
    kind = (
        F.when(F.coalesce("truncated", F.lit(False)) & (n >= profile.top_k), "inconclusive")
        .when(n == 0, "no_baseline_match")
        .when(F.col("exact_id").isNotNull(), "exact_duplicate")
        .when(s1.isNull(), "not_evaluated")
        .when(s1 < profile.variant, "no_baseline_match")
        .when(s2.isNotNull() & (F.abs(s1 - s2) <= profile.tie), "inconclusive")
        .when((s1 >= profile.compressed) & measures.directional(c, b, profile.aspect_tolerance), "likely_compressed")
        .when((s1 >= profile.variant) & same & (s1 < profile.compressed), "variant")
        .otherwise("similar_keep")
    )
    out = x.withColumn("analysis_type", kind)
    chosen = F.when(F.col("exact_id").isNotNull(), F.col("exact_id")).when((F.col("analysis_type") == "no_baseline_match") | (F.coalesce("truncated", F.lit(False)) & (n >= profile.top_k)), F.lit(None)).otherwise(F.col("b1.b_id"))
    primary = F.col("nearest_id") if profile.score_scope == "primary" else chosen
    return out.select("image_id", "analysis_type", primary.alias("primary_id"), n.alias("n_candidates"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.col("nearest_distance").alias("phash_distance"), s1.alias("score"))


def _nearest():
    from pyspark.sql import Window

    return Window.partitionBy("c_id").orderBy("distance", "b_path")


def phase_three(images: DataFrame, top: DataFrame) -> DataFrame:
    """Before scoring: images without candidates are final, the others wait for their score."""
    per = top.groupBy(F.col("c_id").alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "b_id")))["b_id"].alias("candidate_ids"), F.bool_or("truncated").alias("truncated"), F.min("distance").alias("phash_distance"))
    out = images.select("image_id").join(per, "image_id", "left")
    return out.withColumn("analysis_type", F.when(F.col("candidate_ids").isNull(), "no_baseline_match").otherwise("not_evaluated"))


def relation(same_digest: Column, distance: Column, score: Column, ratio: Column, profile: Profile = DEFAULT, most: int = 16, strong: int = 10) -> Column:
    """Class of a reference and a target; null means no relation. A missing score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return (
        F.when(same_digest, "exact")
        .when(distance > most, F.lit(None))
        .when(s >= profile.compressed, "compressed_or_reencoded")
        .when((s >= profile.variant) & ratio.between(0.95, 1.05), "variant")
        .when((s >= profile.variant) | (distance <= strong), "related_group")
        .otherwise("weak_candidate")
    )
