"""Group, pair-plan, original and finder queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import measures
from kindred.operators import finder, graph, stats
from kindred.plans.bindings import GROUPS, IMAGES, SCORE, images, operations, pair_score
from kindred.plans.matching import RESULTS_ALL, results
from kindred.plans.registry import query
from kindred.scratch import materialise

COMPONENTS = """
near AS (SELECT a.image_id AS a, b.image_id AS b FROM images a JOIN images b ON a.image_id <> b.image_id AND hamming(a.bits, b.bits) <= 18),
reach AS (SELECT image_id AS v, image_id AS r FROM images UNION SELECT reach.v, near.b FROM reach JOIN near ON near.a = reach.r),
components AS (SELECT v AS image_id, min(r) AS component FROM reach GROUP BY v)"""

GROUPED = """
m0 AS (SELECT i.*, c.component, count(*) OVER (PARTITION BY component) AS n, min(relative_path) OVER (PARTITION BY component) AS first_path,
  first_value(i.image_id) OVER (PARTITION BY component ORDER BY width * height DESC, file_size DESC, relative_path, i.image_id) AS reference_id FROM images i JOIN components c USING (image_id)),
gi AS (SELECT component, row_number() OVER (ORDER BY max(n) DESC, min(first_path), component) AS group_index FROM m0 GROUP BY component),
members AS (SELECT m0.*, group_index FROM m0 JOIN gi USING (component))"""

ROLES = """
ro AS (SELECT m.*, r.analysis_type, r.primary_id, r.score, r.image_id IS NOT NULL AS known, coalesce(p.width * p.height, g.width * g.height) AS e_px, CASE WHEN p.image_id IS NOT NULL THEN p.file_size ELSE g.file_size END AS e_size,
  CASE WHEN p.image_id IS NOT NULL THEN p.image_id ELSE g.image_id END AS e_id, CASE WHEN p.image_id IS NOT NULL THEN p.relative_path ELSE g.relative_path END AS e_path
  FROM members m LEFT JOIN results r ON r.image_id = m.image_id LEFT JOIN images p ON p.image_id = r.primary_id LEFT JOIN images g ON g.image_id = m.reference_id),
lo AS (SELECT *, known AND coalesce(analysis_type = 'likely_compressed' OR (coalesce(score, 0) >= 0.995::DOUBLE AND (e_px > width * height OR (e_px = width * height AND e_size > file_size))), FALSE) AS low_quality FROM ro),
roles AS (SELECT *, CASE WHEN image_id = reference_id THEN 'reference' WHEN low_quality THEN 'lower_quality' WHEN analysis_type = 'inconclusive' THEN 'needs_review' WHEN analysis_type = 'no_baseline_match' THEN 'standalone' ELSE 'candidate' END AS member_role,
  coalesce(primary_id, image_id)::VARCHAR AS cluster_key, CASE WHEN e_id <> image_id THEN e_id END AS effective_reference_id FROM lo)"""

RECURSIVE = "WITH RECURSIVE"


def components(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    i = images(spark, sf_dir)
    return i, graph.similarity_components(i, GROUPS)


def grouped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    i, c = components(spark, sf_dir)
    return i, graph.groups(i, c)


def roles(spark, sf_dir) -> DataFrame:
    i, g = grouped(spark, sf_dir)
    return graph.member_roles(g, results(spark, sf_dir), i)


@query("similarity_components", f"{RECURSIVE} {IMAGES}, {COMPONENTS} SELECT image_id, component FROM components")
def similarity_components(spark, sf_dir):
    return components(spark, sf_dir)[1]


@query("grown_components", f"{RECURSIVE} {IMAGES}, {COMPONENTS} SELECT image_id, component FROM components")
def grown_components(spark, sf_dir):
    """Four fifths of the images first, then the others are added."""
    i = images(spark, sf_dir).select("image_id", "phash")
    first = i.filter("image_id % 5 <> 2")
    known = first.join(graph.similarity_components(first, GROUPS), "image_id")
    return graph.extend_components(materialise(known, "components"), i.filter("image_id % 5 = 2"), GROUPS).select("image_id", "component")


@query("comparison_groups", f"{RECURSIVE} {IMAGES}, {COMPONENTS}, {GROUPED} SELECT group_index, max(n) AS n, min(first_path) AS first_path, min(reference_id) AS reference_id, string_agg(image_id::VARCHAR, ',' ORDER BY relative_path) AS member_ids FROM members GROUP BY group_index")
def comparison_groups(spark, sf_dir):
    _, g = grouped(spark, sf_dir)
    ids = F.array_join(F.sort_array(F.collect_list(F.struct("relative_path", F.col("image_id").cast("string").alias("id"))))["id"], ",")
    return g.groupBy("group_index").agg(F.max("n").alias("n"), F.min("first_path").alias("first_path"), F.min("reference_id").alias("reference_id"), ids.alias("member_ids"))


@query("group_members", f"{RECURSIVE} {RESULTS_ALL}, {COMPONENTS}, {GROUPED}, {ROLES} SELECT group_index, image_id, member_role, low_quality, cluster_key, effective_reference_id, score, row_number() OVER (PARTITION BY group_index ORDER BY cluster_key, member_role, relative_path) AS place FROM roles")
def group_members(spark, sf_dir):
    x = roles(spark, sf_dir).select("group_index", "image_id", "member_role", "low_quality", "cluster_key", "effective_reference_id", "score", "relative_path")
    return stats.numbered_within(x, ["group_index"], "cluster_key", "member_role", "relative_path").drop("relative_path")


PLAN = """
mx AS (SELECT *, width * height AS px, max(width * height) OVER (PARTITION BY component) AS most_px, max(file_size) OVER (PARTITION BY component) AS most_size FROM members),
pa AS (SELECT c.component, c.image_id AS c_id, a.image_id AS a_id, row_number() OVER (PARTITION BY c.image_id ORDER BY hamming(c.bits, a.bits), a.px DESC, a.file_size DESC, a.relative_path) AS rank
  FROM mx c JOIN mx a ON a.component = c.component AND a.image_id <> c.image_id WHERE (a.px >= a.most_px * 0.9::DOUBLE OR a.file_size >= a.most_size * 0.75::DOUBLE) AND (c.px < a.px * 0.98::DOUBLE OR c.file_size < a.file_size * 0.98::DOUBLE) AND hamming(c.bits, a.bits) <= 24),
planned AS (SELECT DISTINCT component, least(c_id, a_id) AS left_id, greatest(c_id, a_id) AS right_id FROM pa WHERE rank <= 8)"""


def planned(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    i, g = grouped(spark, sf_dir)
    return i, g, graph.plan_pairs(g)


@query("pair_plan", f"{RECURSIVE} {IMAGES}, {COMPONENTS}, {GROUPED}, {PLAN}, k AS (SELECT component, count(*) AS planned FROM planned GROUP BY component) SELECT p.component, left_id, right_id, n * (n - 1) // 2 - planned AS skipped FROM planned p JOIN k USING (component) JOIN (SELECT DISTINCT component, n FROM members) USING (component)")
def pair_plan(spark, sf_dir):
    _, g, p = planned(spark, sf_dir)
    sizes = g.groupBy("component").agg(F.max("n").alias("n"))
    count = p.groupBy("component").agg(F.count("*").alias("planned"))
    skipped = F.floor(F.col("n") * (F.col("n") - 1) / 2) - F.col("planned")
    return p.join(count, "component").join(sizes, "component").select("component", "left_id", "right_id", skipped.alias("skipped"))


@query("decode_jobs", f"""{RECURSIVE} {IMAGES}, {COMPONENTS}, {GROUPED}, {PLAN},
t AS (SELECT p.left_id, p.right_id, CASE WHEN (l.width*l.height, l.width, l.height) <= (r.width*r.height, r.width, r.height) THEN l.width ELSE r.width END AS w, CASE WHEN (l.width*l.height, l.width, l.height) <= (r.width*r.height, r.width, r.height) THEN l.height ELSE r.height END AS h FROM planned p JOIN images l ON l.image_id = left_id JOIN images r ON r.image_id = right_id),
u AS (SELECT left_id, right_id, CASE WHEN greatest(w,h) > 900 THEN greatest(round(w * (900.0::DOUBLE / greatest(w,h))), 1)::BIGINT ELSE w END AS tw, CASE WHEN greatest(w,h) > 900 THEN greatest(round(h * (900.0::DOUBLE / greatest(w,h))), 1)::BIGINT ELSE h END AS th FROM t),
e AS (SELECT DISTINCT left_id AS image_id, tw, th FROM u UNION SELECT DISTINCT right_id, tw, th FROM u) SELECT image_id, count(*) AS n_targets, string_agg(tw || 'x' || th, ',' ORDER BY tw, th) AS targets FROM e GROUP BY image_id""")
def decode_jobs(spark, sf_dir):
    i, _, p = planned(spark, sf_dir)
    side = lambda s: i.select(F.col("image_id").alias(f"{s}_id"), F.col("width").alias(f"{s}_w"), F.col("height").alias(f"{s}_h"))
    t = measures.pair_target(*map(F.col, ("left_w", "left_h", "right_w", "right_h")))
    tw, th = measures.capped(F.col("t.w"), F.col("t.h"), 900)
    x = p.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("t", t).select(F.explode(F.array("left_id", "right_id")).alias("image_id"), F.named_struct(F.lit("w"), tw, F.lit("h"), th).alias("s"))
    targets = F.sort_array(F.collect_set("s"))
    return x.groupBy("image_id").agg(targets.alias("s")).select("image_id", F.size("s").cast("long").alias("n_targets"), F.array_join(F.transform("s", lambda v: F.concat_ws("x", v.w, v.h)), ",").alias("targets"))


ORIGINALS = """
ob AS (SELECT *, max(width * height) OVER (PARTITION BY component) AS most_px, first_value(width::DOUBLE / height) OVER (PARTITION BY component ORDER BY width * height DESC, file_size DESC, relative_path, image_id) AS best_aspect FROM roles),
orig AS (SELECT *, image_id = reference_id OR member_role = 'reference' OR (width * height >= most_px * 0.9::DOUBLE AND abs(width::DOUBLE / height - best_aspect) / best_aspect <= 0.02::DOUBLE AND (score IS NULL OR score >= 0.985::DOUBLE)) AS is_original FROM ob)"""


@query("auto_originals", f"""{RECURSIVE} {RESULTS_ALL}, {COMPONENTS}, {GROUPED}, {ROLES}, {ORIGINALS} SELECT group_index, max(n) AS n, count(*) FILTER (WHERE is_original) AS n_originals, max(n) >= 2 AND greatest(count(*) FILTER (WHERE is_original), 1) < max(n) AS has_thumbnails,
CASE WHEN max(n) < 2 THEN 'empty' WHEN greatest(count(*) FILTER (WHERE is_original), 1) < max(n) THEN 'has' ELSE 'empty' END AS thumb_status FROM orig GROUP BY group_index""")
def auto_originals(spark, sf_dir):
    x = graph.automatic_originals(roles(spark, sf_dir)).groupBy("group_index").agg(F.max("n").alias("n"), F.count_if("is_original").alias("n_originals"))
    has = (F.col("n") >= 2) & (F.greatest("n_originals", F.lit(1)) < F.col("n"))
    return x.select("*", has.alias("has_thumbnails"), F.when(has, "has").otherwise("empty").alias("thumb_status"))


@query("thumbnail_assignment", f"""{RECURSIVE} {RESULTS_ALL}, {COMPONENTS}, {GROUPED}, {ROLES}, {ORIGINALS}, {PLAN},
ch AS (SELECT *, NOT (image_id % 11 = 0) AND (image_id % 13 = 0 OR is_original) AS chosen, row_number() OVER (PARTITION BY component ORDER BY width * height DESC, file_size DESC, relative_path, image_id) AS best_rank FROM orig),
so AS (SELECT *, CASE WHEN chosen AND image_id % 13 = 0 THEN 'manual' WHEN chosen THEN 'auto' WHEN NOT bool_or(chosen) OVER (PARTITION BY component) AND best_rank = 1 THEN 'fallback' END AS source FROM ch),
sc AS (SELECT left_id, right_id, {SCORE.format(c="left_id", b="right_id")} AS cross_score FROM planned),
x AS (SELECT m.component, m.image_id, m.relative_path, m.score, m.effective_reference_id, o.image_id AS o_id, o.width * o.height AS o_px, o.file_size AS o_size, o.relative_path AS o_path, sc.cross_score,
  CASE WHEN sc.cross_score IS NOT NULL THEN 0 WHEN o.image_id = m.effective_reference_id THEN 1 WHEN o.relative_path = m.e_path THEN 2 ELSE 3 END AS way
  FROM so m JOIN so o ON o.component = m.component AND o.source IS NOT NULL LEFT JOIN sc ON sc.left_id = least(m.image_id, o.image_id) AND sc.right_id = greatest(m.image_id, o.image_id) WHERE m.source IS NULL),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY way, cross_score DESC NULLS LAST, o_px DESC, o_size DESC, o_path) = 1),
z AS (SELECT *, coalesce(cross_score, CASE WHEN o_id = effective_reference_id THEN score END) AS similarity FROM y)
SELECT component, image_id, o_id AS original_id, way, similarity, row_number() OVER (PARTITION BY o_id ORDER BY coalesce(similarity, 0) DESC, relative_path) AS place FROM z""")
def thumbnail_assignment(spark, sf_dir):
    i = images(spark, sf_dir)
    m = graph.automatic_originals(roles(spark, sf_dir))
    chosen = graph.choose_originals(m, i.filter("image_id % 13 = 0"), i.filter("image_id % 11 = 0"))
    path = i.select(F.col("image_id").alias("effective"), F.col("relative_path").alias("reference_path"))
    effective = F.coalesce(F.col("effective_reference_id"), F.col("image_id"))
    chosen = chosen.withColumn("effective", effective).join(path, "effective", "left")
    scores = graph.plan_pairs(m).select("left_id", "right_id", pair_score(F.col("left_id"), F.col("right_id")).alias("score"))
    return graph.assign_thumbnails(chosen, scores)


@query("merged_groups", f"""{RECURSIVE} {IMAGES}, {COMPONENTS}, {GROUPED},
x AS (SELECT *, CASE WHEN group_index % 7 IN (2, 3) THEN 'm' || (group_index // 7) ELSE 'g' || group_index END AS display, group_index % 7 IN (2, 3) AS merged FROM members),
f AS (SELECT display, row_number() OVER (ORDER BY min(group_index), display) AS new_index FROM x GROUP BY display)
SELECT new_index, image_id, merged, first_value(image_id) OVER (PARTITION BY display ORDER BY width * height DESC, file_size DESC, relative_path, image_id) AS representative_id FROM x JOIN f USING (display)""")
def merged_groups(spark, sf_dir):
    _, g = grouped(spark, sf_dir)
    sets = g.select("group_index").distinct().filter("group_index % 7 in (2, 3)").select(F.floor(F.col("group_index") / 7).alias("merge_id"), "group_index")
    return graph.merge_groups(g, sets).select("new_index", "image_id", "merged", "representative_id")


@query("backfill_order", f"""{RECURSIVE} {IMAGES}, {COMPONENTS}, {GROUPED}, s AS (SELECT group_index, max(n) AS n, md5(string_agg(image_id || ':' || digest, '|' ORDER BY image_id)) AS signature FROM members GROUP BY group_index),
k AS (SELECT group_index, max(e.event_type = 'purchase') AS kept FROM members m LEFT JOIN (SELECT user_id, max(event_type) FILTER (WHERE event_type = 'purchase') AS event_type FROM events GROUP BY user_id) e ON e.user_id = m.image_id + 1 GROUP BY group_index),
o AS (SELECT group_index, row_number() OVER (ORDER BY CASE WHEN group_index > 3 THEN 0 ELSE 1 END, group_index) AS position FROM s WHERE n >= 2 AND group_index <> 3)
SELECT s.group_index, s.n, s.signature, o.position, CASE WHEN s.n < 2 OR kept THEN 'completed' WHEN s.group_index = 3 THEN 'running' ELSE 'pending' END AS status FROM s JOIN k USING (group_index) LEFT JOIN o USING (group_index)""")
def backfill_order(spark, sf_dir):
    """Groups with a member whose result was restored at some time count as scored: their signatures are in the store."""
    from kindred.functions import nested

    _, g = grouped(spark, sf_dir)
    s = g.groupBy("group_index").agg(F.max("n").alias("n"), F.collect_list(F.struct("image_id", "digest")).alias("members")).select("group_index", "n", nested.member_signature(F.col("members")).alias("signature"))
    restored = operations(spark, sf_dir).filter("operation_type = 'restored'").select((F.col("result_id") - 1).alias("image_id")).distinct()
    kept = g.join(restored, "image_id", "left_semi").select("group_index").distinct()
    cached = s.join(kept, "group_index", "left_semi").select("signature", F.lit(True).alias("cached"))
    x = s.join(cached, "signature", "left").join(graph.backfill_order(s, [3]).select("group_index", "position"), "group_index", "left")
    status = F.when(F.col("n") < 2, "completed").when(F.col("cached"), "completed").when(F.col("group_index") == 3, "running").otherwise("pending")
    return x.select("group_index", "n", "signature", "position", status.alias("status"))


@query("group_statuses", f"""{RECURSIVE} {IMAGES}, {COMPONENTS}, {GROUPED}
SELECT group_index, count(*) AS n, CASE WHEN count(*) < 2 OR NOT bool_or(image_id % 40 = 7) THEN 'completed' WHEN group_index = 3 THEN 'running' ELSE 'pending' END AS status FROM members GROUP BY group_index""")
def group_statuses(spark, sf_dir):
    """Groups were scored before some of the files changed: these have another signature now."""
    g = grouped(spark, sf_dir)[1].withColumn("mtime", F.lit(0).cast("long"))
    scored = graph.signatures(g)
    now = graph.signatures(g.withColumn("mtime", F.when(F.col("image_id") % 40 == 7, 1).otherwise(0).cast("long")))
    return graph.group_statuses(now, scored.filter("n > 1"), 3).select("group_index", "n", "status")


@query("page_groups", f"""{RECURSIVE} {IMAGES}, {COMPONENTS}, {GROUPED}, s AS (SELECT group_index, max(n) AS n, string_agg(relative_path, ', ' ORDER BY width * height DESC, file_size DESC, relative_path) FILTER (WHERE q <= 6) AS tooltip FROM (SELECT *, row_number() OVER (PARTITION BY group_index ORDER BY width * height DESC, file_size DESC, relative_path, image_id) AS q FROM members) GROUP BY group_index)
SELECT group_index, n, tooltip, (group_index - 1) // 100 + 1 AS page, CASE WHEN group_index - 1 = 2 THEN 6 WHEN group_index - 1 > 2 AND group_index - 1 <= 6 THEN group_index - 2 ELSE group_index - 1 END AS moved FROM s""")
def page_groups(spark, sf_dir):
    _, g = grouped(spark, sf_dir)
    first = F.sort_array(F.collect_list(F.when(F.col("q") <= 6, F.struct("q", "relative_path"))))
    s = stats.numbered_within(g, ["group_index"], *graph.quality_order(), name="q").groupBy("group_index").agg(F.max("n").alias("n"), F.array_join(first["relative_path"], ", ").alias("tooltip"))
    at = F.col("group_index") - 1
    return s.select("group_index", "n", "tooltip", stats.page_of(at).alias("page"), stats.reorder(at, 2, 6).cast("long").alias("moved"))


RELATIONS = f"""{IMAGES},
refs AS (SELECT * FROM images WHERE image_id % 25 = 0),
rel0 AS (SELECT t.image_id AS t_id, t.relative_path, r.image_id AS r_id, hamming(t.bits, r.bits)::BIGINT AS distance, t.digest = r.digest AS same, CASE WHEN t.digest = r.digest THEN 1.0::DOUBLE ELSE {SCORE.format(c="t.image_id", b="r.image_id")} END AS score, (t.width * t.height)::DOUBLE / greatest((r.width * r.height)::DOUBLE, 1.0::DOUBLE) AS ratio FROM images t, refs r WHERE t.image_id % 25 <> 0),
rel1 AS (SELECT *, CASE WHEN same THEN 'exact' WHEN distance > 24 THEN NULL WHEN score >= 0.995::DOUBLE THEN 'compressed_or_reencoded' WHEN score >= 0.75::DOUBLE AND ratio BETWEEN 0.95::DOUBLE AND 1.05::DOUBLE THEN 'variant' WHEN score >= 0.75::DOUBLE OR distance <= 10 THEN 'related_group' ELSE 'weak_candidate' END AS classification FROM rel0),
rel AS (SELECT *, CASE classification WHEN 'exact' THEN 0 WHEN 'compressed_or_reencoded' THEN 1 WHEN 'variant' THEN 2 WHEN 'related_group' THEN 3 ELSE 4 END::BIGINT AS class_rank FROM rel1 WHERE classification IS NOT NULL)"""


def related(spark, sf_dir) -> DataFrame:
    i = images(spark, sf_dir)
    return finder.relations(i.filter("image_id % 25 <> 0"), i.filter("image_id % 25 = 0"), pair_score(F.col("t_image_id"), F.col("r_image_id")), most=24)


@query("reference_relations", f"WITH {RELATIONS} SELECT t_id AS target_id, r_id AS reference_id, distance, score, classification, class_rank FROM rel")
def reference_relations(spark, sf_dir):
    return related(spark, sf_dir).select(F.col("t_image_id").alias("target_id"), F.col("r_image_id").alias("reference_id"), "distance", "score", "classification", "class_rank")


@query("finder_matches", f"""WITH {RELATIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY class_rank, score DESC, distance, r_id) AS place, count(*) OVER (PARTITION BY t_id) AS n FROM rel),
b AS (SELECT * FROM o WHERE place = 1), a AS (SELECT t_id, classification AS shown FROM o WHERE r_id = 100)
SELECT b.t_id AS target_id, b.classification, b.r_id AS best_reference_id, b.n AS n_relations, row_number() OVER (ORDER BY b.class_rank, b.relative_path) AS position, a.shown AS for_reference_100 FROM b LEFT JOIN a USING (t_id)""")
def finder_matches(spark, sf_dir):
    m = finder.matches(related(spark, sf_dir)).withColumn("for_reference_100", finder.class_for(100)).drop("relations")
    return stats.numbered(m, "class_rank", "t_relative_path").select(F.col("t_image_id").alias("target_id"), "classification", "best_reference_id", "n_relations", "position", "for_reference_100")


@query("selection_sets", f"""WITH {IMAGES}, sel AS (SELECT image_id FROM images WHERE image_id % 3 = 0), shown AS (SELECT image_id FROM images WHERE image_id % 2 = 0), d AS (SELECT label, relative_path, image_id, row_number() OVER (PARTITION BY label ORDER BY image_id) AS n FROM images)
SELECT 'union' AS kind, image_id FROM (SELECT image_id FROM sel UNION SELECT image_id FROM shown) UNION ALL SELECT 'except', image_id FROM sel WHERE image_id NOT IN (SELECT image_id FROM shown) UNION ALL SELECT 'intersect', image_id FROM sel WHERE image_id IN (SELECT image_id FROM shown)
UNION ALL SELECT 'first', image_id FROM d WHERE n = 1 UNION ALL SELECT CASE WHEN (SELECT bool_and(image_id % 3 = 0) FROM shown) THEN 'all' WHEN (SELECT bool_or(image_id % 3 = 0) FROM shown) THEN 'some' ELSE 'none' END, NULL""")
def selection_sets(spark, sf_dir):
    from kindred.operators import sets

    i = images(spark, sf_dir)
    selected, shown = i.filter("image_id % 3 = 0").select("image_id"), i.filter("image_id % 2 = 0").select("image_id")
    first = sets.first_wins(i, ["label"], ["image_id"]).select("image_id")
    flags = sets.selection_state(shown.join(selected.withColumn("s", F.lit(True)), "image_id", "left").select(F.coalesce("s", F.lit(False)).alias("selected")))
    parts = {"union": sets.union(selected, shown), "except": sets.minus(selected, shown), "intersect": sets.common(selected, shown), "first": first}
    out = flags.select(F.col("state").alias("kind"), F.lit(None).cast("long").alias("image_id"))
    for kind, part in parts.items():
        out = out.unionByName(part.select(F.lit(kind).alias("kind"), "image_id"))
    return out
