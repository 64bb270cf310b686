"""Operation log, statistics, history and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import measures, paths
from kindred.operators import events, match, stats
from kindred.plans.bindings import FILES, IMAGES, LATEST_IMAGE, OPERATIONS, files, images, operations, result_ids, table
from kindred.plans.matching import RESULTS_ALL, results, sized_pairs
from kindred.plans.registry import query
from kindred.schema import ANALYSIS, REVIEW
from kindred.sources import sinks

STATUS = "CASE WHEN {c} IN ('operation_failed', 'validation_failed', 'failed') THEN 'failed' WHEN {c} IN ('validating', 'prepared', 'recycled', 'restored', 'permanently_deleted', 'stale', 'reconciliation_required') THEN {c} ELSE 'none' END"


@query("active_images", f"WITH {IMAGES}, {OPERATIONS}, {LATEST_IMAGE} SELECT i.image_id, i.relative_path, row_number() OVER (ORDER BY i.relative_path, i.image_id) AS position FROM images i LEFT JOIN latest_image l ON l.image_id = i.image_id WHERE coalesce(l.operation_type, 'none') NOT IN ('recycled', 'permanently_deleted')")
def active_images(spark, sf_dir):
    i = images(spark, sf_dir)
    left = events.active(i, result_ids(i), operations(spark, sf_dir))
    return stats.numbered(left, "relative_path", "image_id").select("image_id", "relative_path", "position")


@query("listed_images", f"WITH {IMAGES} SELECT image_id, relative_path, row_number() OVER (ORDER BY relative_path, image_id) AS position FROM images WHERE image_id IN (SELECT min(image_id) FROM images GROUP BY label)")
def listed_images(spark, sf_dir):
    """The images of a list of ids, here the first of each label."""
    i = images(spark, sf_dir)
    asked = i.groupBy("label").agg(F.min("image_id").alias("image_id")).select("image_id")
    return stats.numbered(i.join(asked, "image_id", "left_semi").select("image_id", "relative_path"), "relative_path", "image_id")


@query("latest_action", f"WITH {OPERATIONS}, r AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY created_at DESC, id DESC) AS n FROM operations WHERE operation_type = 'restored') WHERE n = 1) SELECT l.result_id, l.operation_type, {STATUS.format(c='l.operation_type')} AS status, l.created_at, r.id AS last_restored FROM latest l LEFT JOIN r USING (result_id)")
def latest_action(spark, sf_dir):
    o = operations(spark, sf_dir)
    restored = events.latest_of(o, "restored").select("result_id", F.col("id").alias("last_restored"))
    return events.latest(o).join(restored, "result_id", "left").select("result_id", "operation_type", events.action_status(F.col("operation_type")).alias("status"), "created_at", "last_restored")


@query("recyclable_results", f"WITH {RESULTS_ALL}, {OPERATIONS}, ex AS (SELECT image_id, 'exact_duplicate' AS analysis_type FROM images c WHERE role = 'comparison' AND EXISTS (SELECT 1 FROM images b WHERE b.role = 'baseline' AND b.digest = c.digest)), al AS (SELECT image_id, analysis_type FROM results UNION ALL SELECT * FROM ex) SELECT a.image_id, a.image_id + 1 AS result, a.analysis_type FROM al a LEFT JOIN latest l ON l.result_id = a.image_id + 1 WHERE a.analysis_type IN ('exact_duplicate', 'likely_compressed') AND coalesce(l.operation_type, 'none') NOT IN ('recycled', 'permanently_deleted')")
def recyclable_results(spark, sf_dir):
    return events.recyclable(all_results(spark, sf_dir), operations(spark, sf_dir))


def all_results(spark, sf_dir) -> DataFrame:
    """Classified results with the exact ones of the earlier phase."""
    i = images(spark, sf_dir)
    exact = match.exact_matches(i.filter("role = 'comparison'"), i.filter("role = 'baseline'"))
    columns = ["image_id", "analysis_type", "primary_id", "phash_distance", "score"]
    return results(spark, sf_dir).select(columns).unionByName(exact.select(columns)).join(result_ids(i), "image_id")


@query("action_transitions", f"""WITH {OPERATIONS}, s AS (SELECT *, {STATUS.format(c='operation_type')} AS state FROM operations), b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY result_id ORDER BY created_at, id), 'none') AS before FROM s)
SELECT id, result_id, state, before, state = 'failed' OR (state IN ('prepared', 'validating') AND before IN ('none', 'restored', 'failed', 'validating')) OR (state = 'recycled' AND before = 'prepared') OR (state = 'restored' AND before = 'recycled') OR (state = 'permanently_deleted' AND before = 'recycled') AS legal FROM b""")
def action_transitions(spark, sf_dir):
    return events.transitions(operations(spark, sf_dir)).select("id", "result_id", "state", "before", "legal")


@query("cache_context", f"""WITH {IMAGES}, {OPERATIONS}, {LATEST_IMAGE}, a AS (SELECT i.* FROM images i LEFT JOIN latest_image l ON l.image_id = i.image_id WHERE coalesce(l.operation_type, 'none') NOT IN ('recycled', 'permanently_deleted'))
SELECT count(*) AS active_images, (SELECT max(id) FROM operations) AS last_operation, count(DISTINCT label) AS n_groups, count(*) AS members, count(DISTINCT image_id) AS distinct_members, TRUE AS valid FROM a""")
def cache_context(spark, sf_dir):
    o = operations(spark, sf_dir)
    i = images(spark, sf_dir)
    active = events.active(i, result_ids(i), o)
    context = events.cache_context(active, o)
    schema = "array<struct<group:bigint,count:bigint,members:array<bigint>>>"
    cached = active.groupBy("label").agg(F.count("*").alias("count"), F.collect_list("image_id").alias("members")).agg(F.to_json(F.collect_list(F.struct(F.col("label").alias("group"), "count", "members"))).alias("text"))
    read = cached.select(F.explode(F.from_json("text", schema)).alias("g")).select("g.group", "g.count", "g.members")
    ids = read.select("group", "count", F.size("members").alias("n"), F.explode("members").alias("id"))
    checked = ids.agg(F.count_distinct("group").alias("n_groups"), F.count("*").alias("members"), F.count_distinct("id").alias("distinct_members"), F.bool_and(F.col("count") == F.col("n")).alias("fit"))
    checked = checked.select("*", *(context.select(c).scalar().alias(c) for c in context.columns))
    return checked.select("active_images", "last_operation", "n_groups", "members", "distinct_members", (F.col("fit") & (F.col("members") == F.col("distinct_members")) & (F.col("members") == F.col("active_images"))).alias("valid"))


@query("upsert_last_wins", """WITH e AS (SELECT 'key' || user_id % 7 AS key, CAST(value AS VARCHAR) AS value, event_id FROM events), w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1)
SELECT coalesce(max(try_cast(value AS DOUBLE)) FILTER (WHERE key = 'key0'), 10.0::DOUBLE) AS key0, coalesce(max(value) FILTER (WHERE key = 'key1'), 'none') AS key1, coalesce(max(try_cast(value AS DOUBLE)) FILTER (WHERE key = 'key9'), 0.995::DOUBLE) AS key9, (SELECT count(*) FROM w) AS n_keys, (SELECT max(event_id) FROM w) AS last_event FROM w""")
def upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("key"), (F.col("user_id") % 7).cast("string")).alias("key"), F.col("value").cast("string").alias("value"), "event_id")
    kept = events.last_wins(e, ["key"], ["event_id"])
    n_keys, last = kept.agg(F.count("*")).scalar(), kept.agg(F.max("event_id")).scalar()
    return events.settings(kept, {"key0": ("double", 10.0), "key1": ("string", "none"), "key9": ("double", 0.995)}).select("*", n_keys.alias("n_keys"), last.alias("last_event"))


def review(spark, sf_dir) -> DataFrame:
    """Review states of two of three images."""
    k = F.col("image_id") % 3
    return images(spark, sf_dir).filter(k < 2).select("image_id", F.when(k == 0, "approved_for_recycle").otherwise("pending").alias("review_status"))


@query("run_stats", f"""WITH {RESULTS_ALL}, {OPERATIONS}, ex AS (SELECT image_id, 'exact_duplicate' AS analysis_type FROM images c WHERE role = 'comparison' AND EXISTS (SELECT 1 FROM images b WHERE b.role = 'baseline' AND b.digest = c.digest)),
al AS (SELECT a.*, CASE a.image_id % 3 WHEN 0 THEN 'approved_for_recycle' WHEN 1 THEN 'pending' END AS review_status, l.operation_type FROM (SELECT image_id, analysis_type FROM results UNION ALL SELECT * FROM ex) a LEFT JOIN latest l ON l.result_id = a.image_id + 1)
SELECT (SELECT count(*) FROM images WHERE role = 'baseline') AS baseline_total, (SELECT count(*) FROM images WHERE role = 'comparison') AS comparison_total, count(DISTINCT image_id) AS analysed, {", ".join(f"count(*) FILTER (WHERE analysis_type = '{c}') AS {c}" for c in ANALYSIS)},
{", ".join(f"count(*) FILTER (WHERE review_status = '{c}') AS review_{c}" for c in REVIEW)}, count(*) FILTER (WHERE operation_type = 'recycled') AS recycled, count(*) AS classified, TRUE AS conserved FROM al""")
def run_stats(spark, sf_dir):
    r = all_results(spark, sf_dir).join(review(spark, sf_dir), "image_id", "left").join(events.latest(operations(spark, sf_dir)).select("result_id", "operation_type"), "result_id", "left")
    totals = images(spark, sf_dir).agg(F.count_if(F.col("role") == "baseline").alias("baseline_total"), F.count_if(F.col("role") == "comparison").alias("comparison_total"))
    counts = r.agg(F.count_distinct("image_id").alias("analysed"), *(F.count_if(F.col("analysis_type") == c).alias(c) for c in ANALYSIS), *(F.count_if(F.col("review_status") == c).alias(f"review_{c}") for c in REVIEW), F.count_if(F.col("operation_type") == "recycled").alias("recycled"))
    counts = counts.select("*", *(totals.select(c).scalar().alias(c) for c in totals.columns))
    return stats.conserved(counts, F.col("comparison_total"))


@query("run_history", """SELECT o_custkey AS run_id, epoch_us(max(o_orderdate)) AS created_at, count(*) AS counted, count(*) FILTER (WHERE o_orderstatus = 'F') * 3 AS stored, greatest(count(*), count(*) FILTER (WHERE o_orderstatus = 'F') * 3) AS total FROM orders GROUP BY 1 ORDER BY created_at DESC, run_id DESC LIMIT 20""")
def run_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.unix_micros(F.max("o_orderdate").cast("timestamp")).alias("created_at"), F.count("*").alias("counted"), (F.count_if(F.col("o_orderstatus") == "F") * 3).alias("stored"))
    return stats.history(o, 20)


@query("delete_run", """WITH d AS (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0) SELECT 'orders' AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS checksum FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM d)""")
def delete_run(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    gone = F.col("o_custkey") % 10 == 0
    kept = events.delete_run(o, gone)
    lines = l.join(o.filter(gone).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    total = lambda df, name, key: df.agg(F.count("*").alias("n"), F.sum(key).alias("checksum")).select(F.lit(name).alias("part"), "n", "checksum")
    return total(kept, "orders", "o_orderkey").unionByName(total(lines, "lineitem", "l_orderkey"))


@query("order_classes", """SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS large_open, bool_or(o_orderstatus = 'P') AS any_pending, bool_and(o_totalprice > 0) AS all_priced FROM orders GROUP BY 1""")
def order_classes(spark, sf_dir):
    """Conditional counts and flags."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(s == "F").alias("f"), F.count_if((s == "O") & (F.col("o_totalprice") > 100000)).alias("large_open"), F.bool_or(s == "P").alias("any_pending"), F.bool_and(F.col("o_totalprice") > 0).alias("all_priced"))


@query("cache_eviction", """SELECT event_id AS key, tick, bytes, held FROM (SELECT *, sum(bytes) OVER (ORDER BY tick DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM (SELECT event_id, epoch_us(ts) AS tick, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events)) WHERE held <= 100000""")
def cache_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"), F.floor(F.col("value") * 100).alias("bytes"))
    return stats.evict(e, 100000)


@query("ordered_turns", """SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS position FROM conversations WHERE role = 'user'""")
def ordered_turns(spark, sf_dir):
    """1-based positions of selected rows in an order."""
    return stats.numbered(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn"), "conv_id", "turn")


def report(spark, sf_dir) -> DataFrame:
    """Report rows: result, paths, metrics, review and action."""
    i = images(spark, sf_dir)
    r = all_results(spark, sf_dir)
    pairs = r.filter("primary_id is not null").select(F.col("image_id").alias("c_id"), F.col("primary_id").alias("b_id"))
    metrics = match.pair_metrics(sized_pairs(i, pairs)).select(F.col("c_id").alias("image_id"), "size_ratio", "resolution_ratio", "aspect_diff", "smaller_resolution", "smaller_filesize")
    path = lambda name, key: i.select(F.col("image_id").alias(key), F.col("relative_path").alias(name))
    action = events.latest(operations(spark, sf_dir)).select("result_id", events.action_status(F.col("operation_type")).alias("action_status"))
    x = r.join(path("comparison_path", "image_id"), "image_id").join(path("primary_path", "primary_id"), "primary_id", "left").join(metrics, "image_id", "left").join(review(spark, sf_dir), "image_id", "left").join(action, "result_id", "left")
    return x.withColumn("smaller_resolution", F.coalesce("smaller_resolution", F.lit(False))).withColumn("smaller_filesize", F.coalesce("smaller_filesize", F.lit(False)))


@query("report_rows", f"""WITH {RESULTS_ALL}, {OPERATIONS}, ex AS (SELECT c.image_id, arg_min(b.image_id, b.relative_path) AS primary_id FROM images c JOIN images b USING (digest) WHERE c.role = 'comparison' AND b.role = 'baseline' GROUP BY 1),
al AS (SELECT image_id, analysis_type, primary_id, phash_distance, score FROM results UNION ALL SELECT image_id, 'exact_duplicate', primary_id, 0, 1.0 FROM ex),
j AS (SELECT a.*, c.relative_path AS c_path, b.relative_path AS b_path, c.file_size::DOUBLE / b.file_size AS sr, (c.width * c.height)::DOUBLE / (b.width * b.height) AS rr, abs(c.width::DOUBLE / c.height - b.width::DOUBLE / b.height) / greatest(c.width::DOUBLE / c.height, b.width::DOUBLE / b.height) AS ad,
  coalesce(c.width < b.width AND c.height < b.height, FALSE) AS d1, coalesce(c.file_size < b.file_size, FALSE) AS d2, CASE a.image_id % 3 WHEN 0 THEN 'approved_for_recycle' WHEN 1 THEN 'pending' END AS rev, {STATUS.format(c='l.operation_type')} AS act, l.operation_type IS NULL AS no_act
  FROM al a JOIN images c ON c.image_id = a.image_id LEFT JOIN images b ON b.image_id = a.primary_id LEFT JOIN latest l ON l.result_id = a.image_id + 1)
SELECT 'run-1' AS "runId", image_id::VARCHAR AS "comparisonImageId", c_path AS "comparisonPath", analysis_type AS "analysisType", coalesce(primary_id::VARCHAR, '') AS "primaryMatchImageId", coalesce(b_path, '') AS "primaryMatchPath", coalesce(phash_distance::VARCHAR, '') AS "phashDistance", coalesce(printf('%.6f', score), '') AS "ssimScore",
coalesce(printf('%.6f', sr), '') AS "sizeRatio", coalesce(printf('%.6f', rr), '') AS "resolutionRatio", coalesce(printf('%.6f', ad), '') AS "aspectDiff", d1::VARCHAR AS "directionSmallerResolution", d2::VARCHAR AS "directionSmallerFilesize", coalesce(rev, 'N/A') AS "reviewStatus", CASE WHEN no_act THEN 'N/A' ELSE act END AS "actionStatus", 'profile' AS "algorithmProfileId" FROM j""")
def report_rows(spark, sf_dir):
    return sinks.csv_rows(report(spark, sf_dir), "run-1", "profile")


@query("delete_list", f"WITH {IMAGES}, {OPERATIONS}, {LATEST_IMAGE} SELECT substr(i.relative_path, 4) AS path, row_number() OVER (ORDER BY l.created_at, i.relative_path) AS position FROM images i JOIN latest_image l ON l.image_id = i.image_id WHERE l.operation_type = 'recycled' AND starts_with(i.relative_path, 'L3/')")
def delete_list(spark, sf_dir):
    i = images(spark, sf_dir)
    gone = events.latest_of_images(result_ids(i), operations(spark, sf_dir)).filter("operation_type = 'recycled'").select("image_id", F.col("created_at").alias("recycled_at"))
    recycled = i.join(gone, "image_id").select(F.col("relative_path").alias("path"), "recycled_at")
    order = recycled.filter(F.startswith(F.col("path"), F.lit("L3/"))).select(paths.relative(F.col("path"), F.lit("L3")).alias("path"), "recycled_at")
    return sinks.delete_list(recycled, "L3").join(stats.numbered(order, "recycled_at", "path"), "path").select("path", "position")


@query("delete_report", f"WITH {RESULTS_ALL}, {OPERATIONS} SELECT i.relative_path AS path, b.relative_path AS kept_path, CASE r.analysis_type WHEN 'exact_duplicate' THEN 'Exact duplicate' WHEN 'likely_compressed' THEN 'Likely compressed' WHEN 'variant' THEN 'Variant' WHEN 'inconclusive' THEN 'Inconclusive' WHEN 'similar_keep' THEN 'Similar, keep' WHEN 'no_baseline_match' THEN 'No baseline match' ELSE 'Not evaluated' END AS reason, i.file_size, l.created_at AS recycled_at FROM results r JOIN images i ON i.image_id = r.image_id JOIN latest l ON l.result_id = r.image_id + 1 LEFT JOIN images b ON b.image_id = r.primary_id WHERE l.operation_type = 'recycled'")
def delete_report(spark, sf_dir):
    i = images(spark, sf_dir)
    gone = events.latest_of_images(result_ids(i), operations(spark, sf_dir)).filter("operation_type = 'recycled'").select("image_id", F.col("created_at").alias("recycled_at"))
    kept = i.select(F.col("image_id").alias("primary_id"), F.col("relative_path").alias("kept_path"))
    x = results(spark, sf_dir).join(i.select("image_id", F.col("relative_path").alias("path"), "file_size"), "image_id").join(gone, "image_id").join(kept, "primary_id", "left")
    return x.select("path", "kept_path", sinks.label(F.col("analysis_type")).alias("reason"), "file_size", "recycled_at")


RUN_EVENTS = {"view": "indexing", "click": "matching", "signup": "analysis_complete", "purchase": "paused", "error": "failed"}


@query("run_states", f"""WITH l AS (SELECT event_id AS id, user_id AS run_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RUN_EVENTS.items())} ELSE 'pending' END AS status, epoch_us(ts) AS created_at FROM events)
SELECT run_id, arg_max(status, (created_at, id)) AS status, min(created_at) AS created_at, max(created_at) FILTER (WHERE status IN ('preflight', 'indexing')) AS started_at, max(created_at) FILTER (WHERE status IN ('analysis_complete', 'action_complete', 'completed_with_errors', 'failed')) AS completed_at FROM l GROUP BY run_id""")
def run_states(spark, sf_dir):
    """Events as the status log of runs; a user is a run."""
    status = F.when(F.lit(False), "")
    for event, name in RUN_EVENTS.items():
        status = status.when(F.col("event_type") == event, name)
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), status.otherwise("pending").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))
    return events.run_states(log)


@query("folder_counts", f"WITH {FILES} SELECT role, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS folder, lang AS label, count(*) AS file_count FROM (SELECT f.*, d.lang FROM files f JOIN documents d ON d.doc_id = f.image_id) GROUP BY ALL")
def folder_counts(spark, sf_dir):
    return stats.folder_counts(files(spark, sf_dir), F.col("relative_path"))


@query("size_labels", """WITH b AS (SELECT o_orderkey AS image_id, CAST(round(o_totalprice * 100) AS BIGINT) * (1 + o_orderkey % 3 * 4095) // (1 + o_orderkey % 5 * 50000) AS bytes FROM orders),
u AS (SELECT *, CASE WHEN bytes >= 1073741824 THEN 1073741824 WHEN bytes >= 1048576 THEN 1048576 WHEN bytes >= 1024 THEN 1024 ELSE 1 END::BIGINT AS unit FROM b), h AS (SELECT *, (bytes * 200 + unit) // (2 * unit) AS hundredths FROM u)
SELECT image_id, bytes, CASE WHEN unit = 1 THEN bytes || ' B' ELSE (hundredths // 100) || '.' || lpad((hundredths % 100)::VARCHAR, 2, '0') || CASE unit WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS label FROM h""")
def size_labels(spark, sf_dir):
    key = F.col("o_orderkey")
    size = F.expr("cast(round(o_totalprice * 100) AS bigint) * (1 + o_orderkey % 3 * 4095) div (1 + o_orderkey % 5 * 50000)")
    return table(spark, sf_dir, "orders").select(key.alias("image_id"), size.alias("bytes")).withColumn("label", measures.size_label(F.col("bytes")))
