"""Matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import bits, measures, nested
from kindred.operators import classify, match, nearest, stats
from kindred.plans.bindings import FILES, IMAGES, PROFILE, SCORE, files, images, pair_score
from kindred.plans.registry import query


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("role = 'comparison'"), df.filter("role = 'baseline'")


@query("exact_duplicates", f"""WITH {FILES}, b AS (SELECT digest, string_agg(image_id::VARCHAR, ',' ORDER BY relative_path, image_id) AS candidate_ids, arg_min(image_id, relative_path) AS primary_id FROM files WHERE role = 'baseline' GROUP BY digest)
SELECT c.image_id, c.relative_path, b.candidate_ids, b.primary_id, 'exact_duplicate' AS analysis_type, 0::BIGINT AS phash_distance, 1.0::DOUBLE AS score FROM files c JOIN b USING (digest) WHERE c.role = 'comparison'""")
def exact_duplicates(spark, sf_dir):
    c, b = split(files(spark, sf_dir))
    return match.exact_matches(c, b).withColumn("candidate_ids", F.array_join("candidate_ids", ","))


@query("exact_internal", f"""WITH {FILES} SELECT a.image_id, a.relative_path, count(*) AS n_matches, min(b.relative_path) AS primary_path FROM files a JOIN files b ON a.digest = b.digest AND a.relative_path <> b.relative_path GROUP BY ALL""")
def exact_internal(spark, sf_dir):
    c, b = split(files(spark, sf_dir))
    return match.internal_matches(b.unionByName(c))


@query("duplicate_groups", f"""WITH {FILES} SELECT digest, count(*) AS n, min(image_id) AS original_id, array_to_string(list(image_id ORDER BY image_id)[2:], ',') AS duplicate_ids FROM files GROUP BY digest HAVING count(*) > 1""")
def duplicate_groups(spark, sf_dir):
    return match.duplicate_groups(files(spark, sf_dir)).withColumn("duplicate_ids", F.array_join("duplicate_ids", ","))


@query("unmatched_images", f"""WITH {FILES} SELECT image_id, relative_path, 'no_baseline_match' AS analysis_type FROM files c WHERE role = 'comparison' AND NOT EXISTS (SELECT 1 FROM files b WHERE b.role = 'baseline' AND b.digest = c.digest)""")
def unmatched_images(spark, sf_dir):
    c, b = split(files(spark, sf_dir))
    left = match.unmatched(c, match.exact_matches(c, b))
    none = classify.phase_three(left, left.limit(0).select(F.col("image_id").alias("c_id"), F.col("image_id").alias("b_id"), F.lit(1).alias("rank"), F.lit(False).alias("truncated"), F.lit(0).alias("distance")))
    return left.select("image_id", "relative_path").join(none.select("image_id", "analysis_type"), "image_id")


@query("hamming_pairs", f"""WITH {IMAGES} SELECT a.image_id AS a, b.image_id AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM images a JOIN images b ON a.image_id < b.image_id AND hamming(a.bits, b.bits) <= 20""")
def hamming_pairs(spark, sf_dir):
    return match.pairs_within(images(spark, sf_dir), 20)


@query("hamming_strict", f"""WITH {IMAGES} SELECT a.image_id AS a, b.image_id AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM images a JOIN images b ON a.image_id < b.image_id AND hamming(a.bits, b.bits) < 16""")
def hamming_strict(spark, sf_dir):
    """The strict form."""
    return match.pairs_within(images(spark, sf_dir), 16, strict=True)


@query("hash_views", f"""WITH {IMAGES} SELECT image_id, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', 1 + 8 * bits[4*i+1]::INT + 4 * bits[4*i+2]::INT + 2 * bits[4*i+3]::INT + bits[4*i+4]::INT, 1)), '') AS phash_hex, hamming(bits, '0000000000000000000000000000000000000000000000000000000000000011')::BIGINT AS to_three, NULL::BIGINT AS to_invalid FROM images""")
def hash_views(spark, sf_dir):
    h = bits.to_hex(F.col("phash"))
    return images(spark, sf_dir).select("image_id", h.alias("phash_hex"), bits.hex_distance(h, F.lit("0000000000000003")).alias("to_three"), bits.hex_distance(h, F.lit("invalid")).alias("to_invalid"))


@query("aspect_candidates", f"""WITH {IMAGES} SELECT c.image_id AS c_id, count(*) AS n, min(b.image_id) AS first_id, max(b.image_id) AS last_id FROM images c JOIN images b ON b.aspect >= c.aspect * (1 - 0.005::DOUBLE) AND b.aspect <= c.aspect * (1 + 0.005::DOUBLE) WHERE c.role = 'comparison' AND b.role = 'baseline' GROUP BY 1""")
def aspect_candidates(spark, sf_dir):
    c, b = split(images(spark, sf_dir))
    return match.aspect_range_join(c, b).groupBy("c_id").agg(F.count("*").alias("n"), F.min("b_id").alias("first_id"), F.max("b_id").alias("last_id"))


CANDIDATES = f"""{IMAGES},
found AS (SELECT c.image_id AS c_id, b.image_id AS b_id, b.relative_path AS b_path, hamming(c.bits, b.bits) AS distance, b.width AS b_width, b.height AS b_height, b.file_size AS b_size, c.digest = b.digest AS exact
  FROM images c JOIN images b ON hamming(c.bits, b.bits) <= 24 AND b.aspect >= c.aspect * (1 - 0.005::DOUBLE) AND b.aspect <= c.aspect * (1 + 0.005::DOUBLE) WHERE c.role = 'comparison' AND b.role = 'baseline'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY distance, b_path) AS rank, count(*) OVER (PARTITION BY c_id) AS n_found FROM found),
top AS (SELECT * FROM ranked WHERE rank <= 5)"""


def top(spark, sf_dir) -> DataFrame:
    c, b = split(images(spark, sf_dir))
    return nearest.nearest(c, b, PROFILE)


@query("topk_candidates", f"""WITH {CANDIDATES} SELECT c_id, b_id, distance::BIGINT AS distance, rank, n_found, n_found > 5 AS truncated FROM top""")
def topk_candidates(spark, sf_dir):
    return top(spark, sf_dir).select("c_id", "b_id", "distance", "rank", "n_found", "truncated")


@query("pending_results", f"""WITH {CANDIDATES} SELECT i.image_id, string_agg(t.b_id::VARCHAR, ',' ORDER BY t.rank) AS candidate_ids, min(t.distance)::BIGINT AS phash_distance, CASE WHEN count(t.b_id) = 0 THEN 'no_baseline_match' ELSE 'not_evaluated' END AS analysis_type FROM images i LEFT JOIN top t ON t.c_id = i.image_id WHERE i.role = 'comparison' GROUP BY i.image_id""")
def pending_results(spark, sf_dir):
    c, _ = split(images(spark, sf_dir))
    return classify.phase_three(c, top(spark, sf_dir)).select("image_id", F.array_join("candidate_ids", ",").alias("candidate_ids"), "phash_distance", "analysis_type")


@query("pair_metrics", f"""WITH {CANDIDATES} SELECT f.c_id, f.b_id, c.file_size::DOUBLE / f.b_size AS size_ratio, (c.width * c.height)::DOUBLE / (f.b_width * f.b_height) AS resolution_ratio,
abs(c.width::DOUBLE / c.height - f.b_width::DOUBLE / f.b_height) / greatest(c.width::DOUBLE / c.height, f.b_width::DOUBLE / f.b_height) AS aspect_diff, c.width < f.b_width AND c.height < f.b_height AS smaller_resolution, c.file_size < f.b_size AS smaller_filesize,
c.width < f.b_width AND c.height < f.b_height AND c.width * c.height < f.b_width * f.b_height AND c.file_size < f.b_size AND abs(c.width::DOUBLE / c.height - f.b_width::DOUBLE / f.b_height) / greatest(c.width::DOUBLE / c.height, f.b_width::DOUBLE / f.b_height) <= 0.005::DOUBLE AS directional
FROM found f JOIN images c ON c.image_id = f.c_id""")
def pair_metrics(spark, sf_dir):
    i = images(spark, sf_dir)
    return match.pair_metrics(sized_pairs(i, match.candidates(*split(i), PROFILE))).select("c_id", "b_id", "size_ratio", "resolution_ratio", "aspect_diff", "smaller_resolution", "smaller_filesize", "directional")


def sized_pairs(i: DataFrame, pairs: DataFrame) -> DataFrame:
    side = lambda s: i.select(*(F.col(k).alias(f"{s}_{v}") for k, v in (("image_id", "id"), ("width", "width"), ("height", "height"), ("file_size", "file_size"), ("digest", "digest"))))
    return pairs.join(side("c"), "c_id").join(side("b"), "b_id")


def scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Comparison images that exact matching left, and their scored top candidates."""
    i = images(spark, sf_dir)
    c, b = split(i)
    rest = match.unmatched(c, match.exact_matches(c, b))
    found = sized_pairs(i, nearest.nearest(rest, b, PROFILE))
    return rest, found.withColumn("score", pair_score(F.col("c_id"), F.col("b_id"))).withColumn("exact", F.lit(False))


def _classified(scope: str) -> str:
    score = SCORE.format(c="t.c_id", b="t.b_id")
    s = score if scope == "all" else f"first_value({score}) OVER (PARTITION BY t.c_id ORDER BY t.distance, t.b_path)"
    primary = "best_id" if scope == "all" else "nearest_id"
    fits = "w < b_width AND h < b_height AND w * h < b_width * b_height AND z < b_size AND abs(w::DOUBLE / h - b_width::DOUBLE / b_height) / greatest(w::DOUBLE / h, b_width::DOUBLE / b_height) <= 0.005::DOUBLE"
    same = "((w = b_width AND h = b_height) OR (w * h)::DOUBLE / (b_width * b_height) BETWEEN 0.95::DOUBLE AND 1.05::DOUBLE)"
    return f"""{CANDIDATES},
rest AS (SELECT * FROM images c WHERE role = 'comparison' AND NOT EXISTS (SELECT 1 FROM images b WHERE b.role = 'baseline' AND b.digest = c.digest)),
s0 AS (SELECT t.*, {s} AS s, first_value(t.b_id) OVER (PARTITION BY t.c_id ORDER BY t.rank) AS nearest_id, first_value(t.distance) OVER (PARTITION BY t.c_id ORDER BY t.rank) AS nearest_distance FROM top t),
s1 AS (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY s DESC, distance, b_width * b_height DESC, b_path) AS place, lead(s) OVER (PARTITION BY c_id ORDER BY s DESC, distance, b_width * b_height DESC, b_path) AS s2, count(*) OVER (PARTITION BY c_id) AS n FROM s0),
best AS (SELECT r.image_id, r.width AS w, r.height AS h, r.file_size AS z, r.relative_path, coalesce(n, 0) AS n, coalesce(n_found > 5, FALSE) AS truncated, s, s2, b_id AS best_id, nearest_id, nearest_distance, b_width, b_height, b_size FROM rest r LEFT JOIN s1 ON s1.c_id = r.image_id AND place = 1),
typed AS (SELECT *, CASE WHEN truncated AND n >= 5 THEN 'inconclusive' WHEN n = 0 THEN 'no_baseline_match' WHEN s IS NULL THEN 'not_evaluated' WHEN s < 0.75::DOUBLE THEN 'no_baseline_match' WHEN s2 IS NOT NULL AND abs(s - s2) <= 0.001::DOUBLE THEN 'inconclusive'
  WHEN s >= 0.995::DOUBLE AND {fits} THEN 'likely_compressed' WHEN s >= 0.75::DOUBLE AND {same} AND s < 0.995::DOUBLE THEN 'variant' ELSE 'similar_keep' END AS analysis_type FROM best),
results AS (SELECT image_id, analysis_type, {primary if scope != 'all' else "CASE WHEN analysis_type = 'no_baseline_match' OR (truncated AND n >= 5) THEN NULL ELSE best_id END"} AS primary_id, n AS n_candidates, truncated, nearest_distance::BIGINT AS phash_distance, s AS score FROM typed)"""


RESULTS_ALL, RESULTS_PRIMARY = _classified("all"), _classified("primary")


def results(spark, sf_dir, scope: str = "all") -> DataFrame:
    from dataclasses import replace

    rest, found = scored(spark, sf_dir)
    return classify.classify(rest, found, replace(PROFILE, score_scope=scope))


@query("classify_all", f"WITH {RESULTS_ALL} SELECT * FROM results")
def classify_all(spark, sf_dir):
    return results(spark, sf_dir, "all")


@query("classify_primary", f"WITH {RESULTS_PRIMARY} SELECT * FROM results")
def classify_primary(spark, sf_dir):
    return results(spark, sf_dir, "primary")


CLASS_RANK = "CASE r.analysis_type WHEN 'exact_duplicate' THEN 1 WHEN 'likely_compressed' THEN 2 WHEN 'variant' THEN 3 WHEN 'inconclusive' THEN 4 WHEN 'similar_keep' THEN 5 WHEN 'no_baseline_match' THEN 6 WHEN 'not_evaluated' THEN 7 ELSE 8 END"


@query("result_rows", f"""WITH {RESULTS_ALL} SELECT r.image_id, ci.relative_path AS comparison_path, bi.relative_path AS primary_path, r.analysis_type, r.score, row_number() OVER (ORDER BY {CLASS_RANK}, r.image_id) AS position, coalesce(bi.width * bi.height > ci.width * ci.height, FALSE) AS primary_larger
FROM results r JOIN images ci ON ci.image_id = r.image_id LEFT JOIN images bi ON bi.image_id = r.primary_id""")
def result_rows(spark, sf_dir):
    i = images(spark, sf_dir)
    px = measures.pixels(F.col("width"), F.col("height"))
    ci = i.select("image_id", F.col("relative_path").alias("comparison_path"), px.alias("c_px"))
    bi = i.select(F.col("image_id").alias("primary_id"), F.col("relative_path").alias("primary_path"), px.alias("b_px"))
    x = results(spark, sf_dir).join(ci, "image_id").join(bi, "primary_id", "left")
    x = stats.numbered(x, classify.rank_of(F.col("analysis_type"), classify.SORT_ORDER, 1), "image_id")
    return x.select("image_id", "comparison_path", "primary_path", "analysis_type", "score", "position", F.coalesce(F.col("b_px") > F.col("c_px"), F.lit(False)).alias("primary_larger"))


@query("target_sizes", f"""WITH {IMAGES}, p AS (SELECT a.image_id AS a, b.image_id AS b, a.width AS w1, a.height AS h1, b.width AS w2, b.height AS h2 FROM images a JOIN images b ON b.image_id = a.image_id + 1),
t AS (SELECT a, b, CASE WHEN (w1*h1, w1, h1) <= (w2*h2, w2, h2) THEN w1 ELSE w2 END AS w, CASE WHEN (w1*h1, w1, h1) <= (w2*h2, w2, h2) THEN h1 ELSE h2 END AS h FROM p)
SELECT a, b, w AS tool_w, h AS tool_h, CASE WHEN greatest(w,h) > 900 THEN greatest(round(w * (900.0::DOUBLE / greatest(w,h))), 1)::BIGINT ELSE w END AS task_w, CASE WHEN greatest(w,h) > 900 THEN greatest(round(h * (900.0::DOUBLE / greatest(w,h))), 1)::BIGINT ELSE h END AS task_h,
CASE WHEN greatest(w,h) > 200 THEN greatest(round(w * (200.0::DOUBLE / greatest(w,h))), 1)::BIGINT ELSE w END AS thumb_w, CASE WHEN greatest(w,h) > 200 THEN greatest(round(h * (200.0::DOUBLE / greatest(w,h))), 1)::BIGINT ELSE h END AS thumb_h FROM t""")
def target_sizes(spark, sf_dir):
    i = images(spark, sf_dir)
    a = i.select(F.col("image_id").alias("a"), F.col("width").alias("w1"), F.col("height").alias("h1"))
    b = i.select((F.col("image_id") - 1).alias("a"), F.col("image_id").alias("b"), F.col("width").alias("w2"), F.col("height").alias("h2"))
    x = a.join(b, "a").withColumn("t", measures.pair_target(*map(F.col, ("w1", "h1", "w2", "h2"))))
    task, thumb = measures.capped(F.col("t.w"), F.col("t.h"), 900), measures.capped(F.col("t.w"), F.col("t.h"), 200)
    return x.select("a", "b", F.col("t.w").alias("tool_w"), F.col("t.h").alias("tool_h"), task[0].alias("task_w"), task[1].alias("task_h"), thumb[0].alias("thumb_w"), thumb[1].alias("thumb_h"))


@query("json_roundtrip", """WITH g AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label)
SELECT label, array_to_string(ids, ',') AS sorted_ids, len(ids) AS n, 0::BIGINT AS n_bad, list_min(ids) || ':' || list_max(ids) AS pair, 'data:image/png;base64,' || to_base64(encode('L' || label)) AS url, sha256('L' || label) AS digest, md5(array_to_string(list_transform(ids, lambda i: i || ':' || (i // 4)), '|')) AS signature FROM g""")
def json_roundtrip(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.collect_list("vec_id").alias("ids"), F.collect_list(F.struct(F.col("vec_id").alias("image_id"), F.floor(F.col("vec_id") / 4).cast("string").alias("digest"))).alias("members"))
    back, bad = nested.longs_from_json(F.to_json("ids")), nested.longs_from_json(F.lit("no list"))
    name = F.concat(F.lit("L"), F.col("label").cast("string"))
    return e.select("label", nested.joined_ids(back).alias("sorted_ids"), F.size(back).cast("long").alias("n"), F.size(bad).cast("long").alias("n_bad"), nested.pair_key(F.array_max(back), F.array_min(back)).alias("pair"), nested.data_url(F.encode(name, "utf-8")).alias("url"), F.sha2(name, 256).alias("digest"), nested.member_signature(F.col("members")).alias("signature"))
