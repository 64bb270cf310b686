"""The entry points over real folders: a comparison run, groups with their cross-check, and the difference search.

Everything is lazy but for what is written to the shared folder: the features of images and scores. Pixels are never written but at the
sizes at which they are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.cache import Cache
from kindred.config import DEFAULT, Profile
from kindred.functions import paths
from kindred.operators import classify, finder, graph, match, scoring
from kindred.progress import Counters
from kindred.schema import EXCLUDES
from kindred.scratch import materialise
from kindred.sources import images as image_source
from kindred.sources import listing


@dataclass
class Run:
    images: DataFrame
    results: DataFrame
    errors: DataFrame
    rasters: Callable[[DataFrame], DataFrame]  # of image ids
    cache: Cache | None = None


def load(spark: SparkSession, roots: list[tuple[str, str]], run_id: str, excludes=EXCLUDES, algorithm: str = "sha256", cache: Cache | None = None, counters: Counters | None = None) -> tuple[DataFrame, Callable, DataFrame]:
    """(images, rasters, errors) of (role, root) pairs; image ids count on from root to root. ``rasters`` decodes the images it is
    asked for. With a ``cache`` only files that it does not know are read."""
    parts, errors = [], []
    for i, (role, root) in enumerate(roots):
        if cache is None:
            found = materialise(image_source.scan_features(spark, root, excludes, algorithm, counters=counters), "features")
        else:
            listed = materialise(listing.scan(spark, root, excludes).withColumn("format", F.lower(paths.extension(F.col("path")))), "listing")
            known = materialise(cache.known_files(listed).select(*(c.split()[0] for c in image_source.FEATURES.split(", "))), "known")
            fresh = materialise(image_source.scan_features(spark, root, excludes, cache.algorithm, listed.join(known, "path", "left_anti"), counters), "features")
            if not fresh.isEmpty():
                cache.keep_features(fresh)
            found = known.unionByName(fresh)
        parts.append(image_source.image_rows(found, run_id, role, root).withColumn("image_id", F.col("image_id") + F.lit(i).cast("long") * 2**40))
        errors.append(image_source.scan_errors(found))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    images = materialise(union(parts), "images")
    return images, image_source.rasters_of(spark, images, [root for _, root in roots], counters), union(errors)


def score(pairs: DataFrame, rasters: DataFrame | Callable, images: DataFrame, edge: int | None, cache: Cache | None = None, counters: Counters | None = None) -> DataFrame:
    """Adds score and error to pairs (c_id, b_id, ...); a failed pair has a null score and its message. See ``scoring.score``.
    Pairs whose contents the ``cache`` has are not scored again, new ones are kept there."""
    sizes = images.select("image_id", "width", "height")
    if cache is None:
        if counters is not None:
            counters.add(total=pairs.count())
        return scoring.score(pairs, rasters, sizes, edge, counters)
    asked = materialise(cache.with_scores(pairs, images, edge), "asked")
    known = asked.filter("score is not null").withColumn("error", F.lit(None).cast("string"))
    if counters is not None:
        n = asked.agg(F.count("*").alias("total"), F.count("score").alias("hits")).first()
        counters.add(total=n["total"], hits=n["hits"])
    fresh = scoring.score(asked.filter("score is null").drop("score"), rasters, sizes, edge, counters)
    if not fresh.isEmpty():
        cache.keep_scores(fresh, edge)
    return materialise(known.unionByName(fresh).drop("low", "high").select(*pairs.columns, "score", "error"), "scores")


def compare(spark: SparkSession, baseline: str, comparisons: list[str], profile: Profile = DEFAULT, allow_internal: bool = False, run_id: str = "run", excludes=EXCLUDES, cache: Cache | None = None, counters: Counters | None = None) -> Run:
    """One class for each comparison image: exact matches first, then candidates, scores and the decision list.

    With ``allow_internal`` a comparison root may be the baseline itself: it is read once and compared with itself,
    without each image's own path. In the "primary" scope only the nearest candidate is scored; in "all" each one is.
    """
    errors, _ = listing.preflight(baseline, comparisons, allow_internal)
    if errors:
        raise ValueError("; ".join(errors))
    internal = allow_internal and any(listing.os.path.realpath(c) == listing.os.path.realpath(baseline) for c in comparisons)
    roots = [("baseline", baseline)] + [("comparison", c) for c in comparisons if not internal or listing.os.path.realpath(c) != listing.os.path.realpath(baseline)]
    images, rasters, failed = load(spark, roots, run_id, excludes, cache=cache, counters=counters)
    b = images.filter("role = 'baseline'")
    c = images if internal else images.filter("role = 'comparison'")
    if internal:
        inner = match.internal_matches(images.withColumn("relative_path", F.col("path")))
        primary = images.select(F.col("path").alias("primary_path"), F.col("image_id").alias("primary_id"))
        exact = inner.join(primary, "primary_path").select("image_id", "primary_id")
    else:
        exact = match.exact_matches(c, b).select("image_id", "primary_id")
    exact = exact.select("image_id", F.lit("exact_duplicate").alias("analysis_type"), "primary_id", F.lit(0).cast("long").alias("phash_distance"), F.lit(1.0).alias("score"))
    rest = match.unmatched(c, exact)
    if not profile.strict_null_hash:
        rest = rest.filter("phash is not null")
    found = match.candidates(rest, b, profile)
    top = materialise(match.top_candidates(found.filter("c_id <> b_id"), profile.top_k), "top")
    wanted = top if profile.score_scope == "all" else top.filter("rank = 1")
    scores = score(wanted.select("c_id", "b_id"), rasters, images, profile.longest_edge, cache, counters).select("c_id", "b_id", "score")
    sizes = b.select(F.col("image_id").alias("b_id"), F.col("width").alias("b_width"), F.col("height").alias("b_height"), F.col("file_size").alias("b_file_size"))
    scored = top.join(scores, ["c_id", "b_id"], "left").join(sizes, "b_id").withColumn("exact", F.lit(False))
    classes = classify.classify(rest, scored, profile).select("image_id", "analysis_type", "primary_id", "phash_distance", "score")
    results = materialise(classes.unionByName(exact).withColumn("algorithm_profile_id", F.lit(profile.profile_id)), "results")
    return Run(images, results, failed, rasters, cache)


def groups(run: Run, distance: int = DEFAULT.group_distance) -> DataFrame:
    """Members of the similarity groups of a run's images, with their roles; a written table."""
    components = graph.similarity_components(run.images, distance)
    return materialise(graph.member_roles(graph.groups(run.images, components), run.results, run.images), "members")


def group_scores(run: Run, members: DataFrame, edge: int = 900, counters: Counters | None = None) -> DataFrame:
    """(component, left_id, right_id, score, error) of the pairs inside groups that are worth a score; each is scored once."""
    pairs = graph.plan_pairs(members).select("component", F.col("left_id").alias("c_id"), F.col("right_id").alias("b_id"))
    scored = score(pairs, run.rasters, run.images, edge, run.cache, counters)
    return scored.select("component", F.col("c_id").alias("left_id"), F.col("b_id").alias("right_id"), "score", "error")


def originals(run: Run, members: DataFrame, scores: DataFrame, manual_originals: DataFrame | None = None, manual_thumbnails: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The originals of each group with their source, and the thumbnails with the original that each belongs to.

    ``members`` are those of ``groups``, ``scores`` those of ``group_scores``; failed pairs have no say. What a user has set
    (image_id) goes before what is found.
    """
    none = run.images.select("image_id").limit(0)
    chosen = graph.choose_originals(graph.automatic_originals(members), none if manual_originals is None else manual_originals, none if manual_thumbnails is None else manual_thumbnails)
    path = run.images.select(F.col("image_id").alias("effective"), F.col("relative_path").alias("reference_path"))
    chosen = chosen.withColumn("effective", F.coalesce("effective_reference_id", "image_id")).join(path, "effective", "left")
    chosen = materialise(chosen, "originals")
    return chosen.filter("source is not null"), graph.assign_thumbnails(chosen, scores.filter("score is not null"))


def search(spark: SparkSession, references: list[str], targets: list[str], profile: Profile = DEFAULT) -> DataFrame:
    """Difference search: every target file with its best relation to any reference. Needs a reference and a target."""
    if not references or not targets:
        raise ValueError("at least one reference and one root are needed")
    images, rasters, _ = load(spark, [("reference", r) for r in references] + [("target", t) for t in targets], "search", excludes=())
    r, t = images.filter("role = 'reference'"), images.filter("role = 'target'")
    # near pairs that differ in content are scored at full size; errors count as 0
    related = materialise(finder.relations(t, r, F.lit(0.0), profile), "relations")
    pairs = related.filter(~F.col("same")).select(F.col("t_image_id").alias("c_id"), F.col("r_image_id").alias("b_id"))
    scores = score(pairs, rasters, images, None).select(F.col("c_id").alias("t_image_id"), F.col("b_id").alias("r_image_id"), F.col("score").alias("found"))
    related = related.join(scores, ["t_image_id", "r_image_id"], "left")
    px = lambda s: F.col(f"{s}_width").cast("double") * F.col(f"{s}_height")
    value = F.when(F.col("same"), F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0)))
    related = related.withColumn("score", value).withColumn("classification", classify.relation(F.col("same"), F.col("distance"), F.col("score"), px("t") / F.greatest(px("r"), F.lit(1.0)), profile))
    related = related.withColumn("class_rank", classify.rank_of(F.col("classification"), classify.RELATION_ORDER, 0))
    return finder.matches(related).orderBy("class_rank", "t_relative_path")
