"""Matching: by digest, by what is left, by aspect, by Hamming distance.

Images have image_id, role, relative_path, digest, phash (long), width, height, file_size.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import DEFAULT, Profile
from kindred.functions import bits, measures
from kindred.operators import metric


def exact_matches(comparison: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row for each comparison image whose digest the baseline has: all candidates by path, the first is primary.

    The baseline is grouped by digest before the join, so large groups of copies on both sides never multiply. Null
    digests match nothing.
    """
    ordered = F.sort_array(F.collect_list(F.struct("relative_path", "image_id")))
    known = baseline.filter(F.col("digest").isNotNull()).groupBy("digest").agg(ordered.alias("found"))
    out = comparison.join(known, "digest")
    return out.select("image_id", "relative_path", F.col("found.image_id").alias("candidate_ids"), F.col("found")[0]["image_id"].alias("primary_id"), F.lit("exact_duplicate").alias("analysis_type"), F.lit(0).cast("long").alias("phash_distance"), F.lit(1.0).alias("score"))


def internal_matches(images: DataFrame) -> DataFrame:
    """Exact matches of a set with itself, without each image's own path; the first other path is primary.

    Each digest keeps its count and its two least paths, which is all that any member needs: no self-join of rows, and
    nothing is collected.
    """
    known = images.filter(F.col("digest").isNotNull()).select("digest", "relative_path")
    groups = known.groupBy("digest").agg(F.count("*").alias("n"), F.min("relative_path").alias("first")).filter("n > 1")
    second = known.join(groups, "digest").filter(F.col("relative_path") > F.col("first")).groupBy("digest").agg(F.min("relative_path").alias("second"))
    other = F.when(F.col("first") != F.col("relative_path"), F.col("first")).otherwise(F.col("second"))
    found = images.join(groups, "digest").join(second, "digest", "left")
    return found.select("image_id", "relative_path", (F.col("n") - 1).alias("n_matches"), other.alias("primary_path"))


def duplicate_groups(images: DataFrame) -> DataFrame:
    """Digests with several images: the least id is the original, the others are its duplicates."""
    ids = F.sort_array(F.collect_list("image_id"))
    return images.groupBy("digest").agg(ids.alias("ids")).filter(F.size("ids") > 1).select("digest", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("original_id"), F.slice("ids", F.lit(2), F.size("ids")).alias("duplicate_ids"))


def unmatched(images: DataFrame, results: DataFrame) -> DataFrame:
    """Images without a result row yet."""
    return images.join(results.select("image_id"), "image_id", "left_anti")


def aspect_bucket(aspect: Column, tolerance: float) -> Column:
    """Logarithmic buckets as wide as the tolerance."""
    return F.floor(F.log(aspect) / F.lit(math.log1p(tolerance)))


def aspect_fits(c_aspect: Column, b_aspect: Column, tolerance: float) -> Column:
    return (b_aspect >= c_aspect * (1 - tolerance)) & (b_aspect <= c_aspect * (1 + tolerance))


def buckets_around(aspect: Column, tolerance: float) -> Column:
    """The buckets that can hold an aspect within the tolerance of this one."""
    own = aspect_bucket(aspect, tolerance)
    return F.explode(F.sequence(own - 2, own + 1))


def aspect_range_join(comparison: DataFrame, baseline: DataFrame, tolerance: float = DEFAULT.aspect_tolerance) -> DataFrame:
    """(c_id, b_id) with the baseline's aspect within the relative tolerance of the comparison's.

    A range join made equi: each comparison image looks into the few buckets around its own.
    """
    b = baseline.filter("aspect > 0").select(F.col("image_id").alias("b_id"), F.col("aspect").alias("b_aspect"), aspect_bucket(F.col("aspect"), tolerance).alias("bucket"))
    c = comparison.filter("aspect > 0").select(F.col("image_id").alias("c_id"), F.col("aspect").alias("c_aspect"), buckets_around(F.col("aspect"), tolerance).alias("bucket"))
    return c.join(b, "bucket").filter(aspect_fits(F.col("c_aspect"), F.col("b_aspect"), tolerance)).select("c_id", "b_id")


def _masks(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in chosen) for k in range(most + 1) for chosen in combinations(range(width), k)]


def indexable(most: int, blocks: int = 4) -> bool:
    """Whether the lookups of multi-index hashing are few: each is a row that is shuffled and sorted, for which metric partitions
    compare thousands of hashes. With four blocks that is up to a radius of 11 (548 lookups; 2,788 from 12 on)."""
    width = 64 // blocks
    return blocks * sum(math.comb(width, k) for k in range(most // blocks + 1)) <= 0.01 * 2**width


def hamming_join(left: DataFrame, right: DataFrame, most: int, blocks: int = 4, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of ``left`` (l_id, l_hash, ...) and ``right`` (r_id, r_hash, ...) that agree ``on`` further columns and
    are at most ``most`` bits apart, with distance. Callers pass ids, hashes and what they test; attributes join later.

    Always an equi-join. Small radii use multi-index hashing: of ``blocks`` parts of the hash one differs in at most
    ``most // blocks`` bits, so the left side looks up that part's neighbours. Where the lookups would cover a good
    part of all values no index helps: ``on`` alone is the key then; without ``on`` the distinct hashes of both sides meet
    in metric partitions, and rows join their hashes.

    Spark takes what is exploded, or found in Python, for as small as what it was made of, so these joins ask for a merge: one
    that is broadcast would pass the looked-up values, or all pairs, through the driver.
    """
    width = 64 // blocks
    masks = _masks(width, most // blocks)
    far = F.bit_count(F.col("l_hash").bitwiseXOR(F.col("r_hash")))
    if not indexable(most, blocks):
        if on:
            return left.join(right.hint("merge"), list(on)).filter(far <= most).withColumn("distance", far.cast("long"))
        near = metric.between(metric.table_of(left, "l_hash"), metric.table_of(right, "r_hash"), most)
        near = near.select(F.col("a").alias("r_hash"), F.col("b").alias("l_hash"), "distance")
        return left.join(near.hint("merge"), "l_hash").join(right.hint("merge"), "r_hash")
    part = lambda h: F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(h, width * i).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for i in range(blocks)))
    around = F.array(*map(F.lit, masks))
    l = left.withColumn("p", F.explode(part("l_hash"))).withColumn("m", F.explode(around)).select("*", F.col("p.block").alias("block"), F.col("p.value").bitwiseXOR(F.col("m").cast("long")).alias("value")).drop("p", "m")
    r = right.withColumn("p", F.explode(part("r_hash"))).select("*", "p.block", "p.value").drop("p")
    found = l.join(r.hint("merge"), [*on, "block", "value"]).withColumn("distance", far.cast("long")).filter(F.col("distance") <= most)
    return found.drop("block", "value").dropDuplicates(["l_id", "r_id"])


def hashes(images: DataFrame, side: str, *more: str) -> DataFrame:
    """id, hash and ``more`` of the images that have a hash, under the prefix of a side."""
    return images.filter(F.col("phash").isNotNull()).select(F.col("image_id").alias(f"{side}_id"), F.col("phash").alias(f"{side}_hash"), *(F.col(c).alias(f"{side}_{c}") for c in more))


def pairs_within(images: DataFrame, most: int, strict: bool = False) -> DataFrame:
    """(a, b, distance) of all pairs a < b within the distance (below it, if strict).

    Beyond the reach of an index the distinct hashes meet in metric partitions, and images join them: as many rows as are asked for.
    """
    most -= int(strict)
    l, r = hashes(images, "l"), hashes(images, "r")
    if indexable(most):
        found = hamming_join(l, r, most).filter("l_id < r_id")
        return found.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "distance")
    near = metric.within(metric.table_of(images), most).select(F.col("a").alias("l_hash"), F.col("b").alias("r_hash"), "distance")
    apart = l.join(near.hint("merge"), "l_hash").join(r.hint("merge"), "r_hash")
    equal = l.join(r.withColumnRenamed("r_hash", "l_hash"), "l_hash").filter("l_id < r_id").withColumn("distance", F.lit(0).cast("long"))
    return apart.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), "distance").unionByName(equal.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "distance"))


def links_within(distinct: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs of distinct hashes (a table with one column ``hash``) that connect what all pairs within the distance connect."""
    if not indexable(most):
        return metric.within(distinct, most, links=True).select("a", "b")
    side = lambda s: distinct.select(F.col("hash").alias(f"{s}_id"), F.col("hash").alias(f"{s}_hash"))
    return hamming_join(side("l"), side("r"), most).filter("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def links_between(fresh: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs within the distance of a hash of ``fresh`` and one of ``known``, both tables of distinct hashes."""
    if not indexable(most):
        return metric.between(known, fresh, most).filter("a <> b").select("a", "b")
    side = lambda df, s: df.select(F.col("hash").alias(f"{s}_id"), F.col("hash").alias(f"{s}_hash"))
    return hamming_join(side(fresh, "l"), side(known, "r"), most).filter("l_id <> r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def candidates(comparison: DataFrame, baseline: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """c_id, b_id, distance, b_path: candidates within the aspect tolerance and the distance.

    The aspect's bucket is part of the join key at every distance; paths join the pairs that are left.
    """
    t = profile.aspect_tolerance
    c = hashes(comparison.filter("aspect > 0"), "l", "aspect").withColumn("bucket", buckets_around(F.col("l_aspect"), t))
    b = hashes(baseline.filter("aspect > 0"), "r", "aspect").withColumn("bucket", aspect_bucket(F.col("r_aspect"), t))
    found = hamming_join(c, b, profile.max_distance, on=("bucket",)).filter(aspect_fits(F.col("l_aspect"), F.col("r_aspect"), t))
    paths = baseline.select(F.col("image_id").alias("b_id"), F.col("relative_path").alias("b_path"))
    return found.select(F.col("l_id").alias("c_id"), F.col("r_id").alias("b_id"), "distance").join(paths, "b_id").select("c_id", "b_id", "distance", "b_path")


def top_candidates(found: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """The ``k`` nearest of each comparison image by (distance, path), with rank and whether there were more."""
    each = Window.partitionBy("c_id")
    ranked = found.withColumn("rank", F.row_number().over(each.orderBy("distance", "b_path")).cast("long")).withColumn("n_found", F.count("*").over(each))
    return ranked.filter(F.col("rank") <= k).withColumn("truncated", F.col("n_found") > k)


def pair_metrics(pairs: DataFrame, tolerance: float = DEFAULT.aspect_tolerance) -> DataFrame:
    """Ratios and directions of pairs that carry c_/b_ width, height and file_size."""
    c, b = ({k: F.col(f"{s}_{k}") for k in ("width", "height", "file_size")} for s in "cb")
    return pairs.select(
        "*",
        (c["file_size"].cast("double") / b["file_size"]).alias("size_ratio"),
        (measures.pixels(c["width"], c["height"]).cast("double") / measures.pixels(b["width"], b["height"])).alias("resolution_ratio"),
        measures.aspect_difference(measures.aspect(c["width"], c["height"]), measures.aspect(b["width"], b["height"])).alias("aspect_diff"),
        ((c["width"] < b["width"]) & (c["height"] < b["height"])).alias("smaller_resolution"),
        (c["file_size"] < b["file_size"]).alias("smaller_filesize"),
        measures.directional(c, b, tolerance).alias("directional"),
    )


def with_phash_hex(images: DataFrame) -> DataFrame:
    return images.withColumn("phash_hex", bits.to_hex(F.col("phash")))
