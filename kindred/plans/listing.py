"""Path, scan, listing and plan queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.functions import measures, naming, paths
from kindred.operators import events, fileplan, stats
from kindred.plans.bindings import FILES, PATHS, files, page_paths, table
from kindred.plans.registry import query
from kindred.sources import listing


@query("path_functions", f"""WITH {PATHS} SELECT page_id, lower(replace(path, '/', '\\')) AS normalised, regexp_extract(path, '[^/]*$') AS file_name,
regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1) AS extension, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder,
CASE WHEN starts_with(path, 'www.') THEN substr(path, 5) ELSE path END AS shortened, regexp_replace(path, '^[^/]*/', '') AS relative_path, TRUE AS same_place, FALSE AS same_other, chr((66 + page_id % 20)::INT) AS alias FROM paths""")
def path_functions(spark, sf_dir):
    p = F.col("path")
    host = F.substring_index("path", "/", 1)
    return page_paths(spark, sf_dir).select(
        "page_id", paths.normalised(p).alias("normalised"), paths.file_name(p).alias("file_name"), paths.extension(p).alias("extension"), paths.stem(p).alias("stem"), paths.folder(p).alias("folder"),
        F.regexp_replace(p, r"^www\.", "").alias("shortened"), paths.relative(p, host).alias("relative_path"), paths.same_location(p, F.upper(p)).alias("same_place"), paths.same_location(p, F.concat(p, F.lit("x"))).alias("same_other"), paths.alias(F.col("page_id") % 20).alias("alias"),
    )


@query("scan_filters", f"WITH {PATHS} SELECT page_id, path FROM paths WHERE NOT contains(path, '/en/') AND NOT contains(path, 'blog.') AND lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif')")
def scan_filters(spark, sf_dir):
    p = F.col("path")
    return page_paths(spark, sf_dir).filter(paths.included(p, ("/en/", "blog.")) & paths.supported(p))


@query("stale_files", f"""WITH {FILES}, b AS (SELECT digest, arg_min(relative_path, relative_path) AS primary_path FROM files WHERE role = 'baseline' GROUP BY digest),
m AS (SELECT f.*, b.primary_path, CASE WHEN b.primary_path IS NOT NULL THEN f.digest END AS primary_digest FROM files f LEFT JOIN b ON b.digest = f.digest AND f.role = 'comparison'),
l AS (SELECT relative_path, CASE WHEN image_id % 5 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN image_id % 9 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN image_id % 11 = 0 THEN md5(digest) ELSE digest END AS digest FROM files WHERE image_id % 7 <> 0)
SELECT m.image_id, CASE WHEN m.role <> 'comparison' THEN 'role' WHEN n.size IS NULL THEN 'missing' WHEN n.size <> m.size THEN 'size' WHEN n.mtime <> m.mtime THEN 'mtime' WHEN n.digest <> m.digest THEN 'digest' WHEN m.primary_path IS NOT NULL AND p.digest IS NULL THEN 'primary_missing' WHEN p.digest <> m.primary_digest THEN 'primary_digest' ELSE 'ok' END AS verdict
FROM m LEFT JOIN l n ON n.relative_path = m.relative_path LEFT JOIN l p ON p.relative_path = m.primary_path""")
def stale_files(spark, sf_dir):
    f = files(spark, sf_dir)
    b = f.filter("role = 'baseline'").groupBy("digest").agg(F.min("relative_path").alias("primary_path"))
    manifest = f.withColumn("key", F.when(F.col("role") == "comparison", F.col("digest"))).join(b.withColumnRenamed("digest", "key"), "key", "left")
    manifest = manifest.withColumn("path", F.col("relative_path")).withColumn("primary_digest", F.when(F.col("primary_path").isNotNull(), F.col("digest")))
    i = F.col("image_id")
    now = f.filter(i % 7 != 0).select(F.col("relative_path").alias("path"), F.when(i % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(i % 9 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(i % 11 == 0, F.md5("digest")).otherwise(F.col("digest")).alias("digest"))
    return events.verify_recycle(manifest, now).select("image_id", "verdict")


@query("preflight_conflicts", """WITH r AS (SELECT DISTINCT 'folder' AS role, source || '/' || lang AS root FROM documents UNION SELECT DISTINCT 'source', source FROM documents UNION SELECT DISTINCT 'other', source || '/en' FROM documents WHERE lang = 'en')
SELECT DISTINCT x.root AS a, y.root AS b, 'same' AS issue FROM r x JOIN r y ON x.root = y.root AND x.role < y.role UNION ALL SELECT DISTINCT x.root, y.root, 'nested' FROM r x JOIN r y ON starts_with(y.root, x.root || '/')""")
def preflight_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lang = F.concat_ws("/", "source", "lang")
    r = d.select(F.lit("folder").alias("role"), lang.alias("root")).unionByName(d.select(F.lit("source").alias("role"), F.col("source").alias("root"))).unionByName(d.filter("lang = 'en'").select(F.lit("other").alias("role"), F.concat(F.col("source"), F.lit("/en")).alias("root"))).distinct()
    return listing.conflicts(r)


@query("nested_roots", f"""WITH {PATHS}, r AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM paths UNION SELECT DISTINCT split_part(path, '/', 1) FROM paths WHERE contains(path, 'm.')),
g AS (SELECT root FROM r WHERE NOT contains(root, '.net')) SELECT 'root' AS kind, root, NULL AS message FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE starts_with(x.root, y.root || '/')) UNION ALL SELECT 'error', root, 'not a directory' FROM r WHERE contains(root, '.net')""")
def nested_roots(spark, sf_dir):
    p = page_paths(spark, sf_dir)
    r = p.select(paths.folder(F.col("path")).alias("root")).unionByName(p.filter(F.contains("path", F.lit("m."))).select(F.substring_index("path", "/", 1).alias("root"))).distinct()
    bad = F.contains(F.col("root"), F.lit(".net"))
    kept = listing.outermost(r.filter(~bad)).select(F.lit("root").alias("kind"), "root", F.lit(None).cast("string").alias("message"))
    return kept.unionByName(r.filter(bad).select(F.lit("error").alias("kind"), "root", F.lit("not a directory").alias("message")))


@query("directory_tree", f"""WITH {PATHS}, d AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM paths WHERE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif', 'tiff', 'svg') GROUP BY 1)
SELECT folder, regexp_extract(folder, '[^/]*$') AS label, regexp_extract(folder, '^(.*)/[^/]*$', 1) AS parent, n, row_number() OVER (PARTITION BY regexp_extract(folder, '^(.*)/[^/]*$', 1) ORDER BY regexp_extract(folder, '[^/]*$')) AS place FROM d""")
def directory_tree(spark, sf_dir):
    return listing.directory_tree(page_paths(spark, sf_dir))


NAME = "regexp_extract(path, '[^/]*$')"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]*$', '\\1')"
EXT = f"regexp_extract({NAME}, '^.+\\.([^.]*)$', 1)"


@query("rename_previews", f"""WITH {PATHS}, i AS (SELECT page_id, path, {NAME} AS original_name, {STEM} AS stem, {EXT} AS ext, 'ref' || page_id % 4 AS ref, page_id % 6 AS grp, row_number() OVER (PARTITION BY page_id % 6 ORDER BY page_id) AS ord FROM paths)
SELECT page_id, ref || '-' || CASE WHEN len(ord::VARCHAR) >= 3 THEN ord::VARCHAR ELSE lpad(ord::VARCHAR, 3, '0') END || '_' || grp || '.' || ext AS simple, original_name AS broken, 'InvalidName' AS broken_issue,
CASE WHEN original_name LIKE '%5%.%' THEN regexp_extract(original_name, '^((?:[^5])*)5(.*)$', 2) || '-' || regexp_extract(original_name, '^((?:[^5])*)5(.*)$', 1) || '.' || ord ELSE original_name END AS advanced, CASE WHEN original_name LIKE '%5%.%' THEN NULL ELSE 'RuleUnmatched' END AS advanced_issue,
'shot_' || ord || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS quick FROM i""")
def rename_previews(spark, sf_dir):
    order = Window.partitionBy("group_index").orderBy("page_id")
    i = page_paths(spark, sf_dir).select("page_id", "path", F.concat(F.lit("ref"), (F.col("page_id") % 4).cast("string")).alias("reference_name"), (F.col("page_id") % 6).alias("group_index"))
    i = i.withColumn("order", F.row_number().over(order).cast("long"))
    simple = fileplan.rename_preview(i, "$ref-$n:03_$group.$ext").select("page_id", F.col("proposed_name").alias("simple"))
    broken = fileplan.rename_preview(i, "$unknown").select("page_id", F.col("proposed_name").alias("broken"), F.col("rule_issue").alias("broken_issue"))
    fits = fileplan.rename_preview(i, "$2-$1.$n", pattern="*5*.*")
    # of three stars the last two are shown as one
    advanced = fileplan.rename_preview(i, "$2-$1.$n", pattern="*5*").select("page_id", F.col("proposed_name").alias("two"), "original_name").join(fits.select("page_id", F.col("rule_issue").alias("advanced_issue")), "page_id").select("page_id", F.when(F.col("advanced_issue").isNull(), F.col("two")).otherwise(F.col("original_name")).alias("advanced"), "advanced_issue")
    quick = fileplan.rename_preview(i, first_name="shot.raw").select("page_id", F.col("proposed_name").alias("quick"))
    return simple.join(broken, "page_id").join(advanced, "page_id").join(quick, "page_id")


@query("name_issues", """WITH n AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_name || '.png' WHEN 1 THEN upper(p_name) || '.PNG' WHEN 2 THEN 'con.txt' WHEN 3 THEN p_name || '.' WHEN 4 THEN p_name || '?' WHEN 5 THEN ' ' WHEN 6 THEN 'lpt' || p_partkey % 12 || '.jpg' WHEN 7 THEN '..' ELSE p_name || '.png' END AS name FROM part),
i AS (SELECT *, CASE WHEN trim(name, ' ') = '' OR name IN ('.', '..') THEN 'empty' WHEN ends_with(name, ' ') OR ends_with(name, '.') THEN 'ending' WHEN regexp_matches(name, '[\\x00-\\x1F<>:"/\\\\|?*]') THEN 'character' WHEN regexp_full_match(upper(regexp_replace(name, '^(.+)\\.[^.]*$', '\\1')), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN 'reserved' END AS issue,
CASE WHEN trim(name, ' ') = '' OR name IN ('.', '..') THEN 'empty' WHEN ends_with(name, ' ') OR ends_with(name, '.') THEN 'ending' WHEN regexp_matches(name, '[\\x00-\\x1F<>:"/\\\\|?*]') THEN 'character' WHEN regexp_full_match(upper(split_part(name, '.', 1)), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN 'reserved' END AS folder_issue, count(*) OVER (PARTITION BY lower(name)) AS same_target FROM n)
SELECT p_partkey, name, issue, folder_issue, same_target, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'SourceMissing' WHEN p_partkey % 5 = 0 THEN 'SourceChanged' END, CASE WHEN issue IS NOT NULL THEN 'InvalidName' END, CASE WHEN same_target > 1 THEN 'BatchDuplicate' END], lambda x: x IS NOT NULL), ',') AS issues FROM i""")
def name_issues(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    made = F.when(k % 9 == 0, F.concat(name, F.lit(".png"))).when(k % 9 == 1, F.concat(F.upper(name), F.lit(".PNG"))).when(k % 9 == 2, "con.txt").when(k % 9 == 3, F.concat(name, F.lit("."))).when(k % 9 == 4, F.concat(name, F.lit("?"))).when(k % 9 == 5, " ")
    made = made.when(k % 9 == 6, F.concat(F.lit("lpt"), (k % 12).cast("string"), F.lit(".jpg"))).when(k % 9 == 7, "..").otherwise(F.concat(name, F.lit(".png")))
    p = table(spark, sf_dir, "part").select("p_partkey", made.alias("proposed_name"), F.concat(F.lit("part-"), k.cast("string"), F.lit(".bin")).alias("path"), F.lit("f").alias("expected"))
    now = p.filter(k % 4 != 0).select("path", F.when(k % 5 == 0, "g").otherwise("f").alias("fingerprint"), F.lit("d").alias("digest"))
    x = fileplan.explicit_issues(p, now)
    return x.select("p_partkey", F.col("proposed_name").alias("name"), naming.invalid_name(F.col("proposed_name")).alias("issue"), naming.invalid_folder(F.col("proposed_name")).alias("folder_issue"), "same_target", F.array_join("issues", ",").alias("issues"))


@query("transfer_conflicts", f"""WITH {FILES}, l AS (SELECT relative_path AS path, mtime AS fingerprint, digest FROM files WHERE image_id % 7 <> 0 UNION ALL SELECT 'out/kept/' || image_id || '.txt', 0, CASE WHEN image_id % 2 = 0 THEN digest ELSE 'x' END FROM files WHERE image_id % 10 < 2)
SELECT f.image_id, 'out/kept/' || f.image_id || '.txt' AS target_path, array_to_string(list_filter([CASE WHEN s.path IS NULL THEN 'SourceMissing' WHEN f.image_id % 6 = 0 OR s.fingerprint <> f.mtime THEN 'SourceChanged' END, CASE WHEN t.path IS NOT NULL THEN CASE WHEN s.digest = t.digest THEN 'SameContentExists' ELSE 'TargetExists' END END], lambda x: x IS NOT NULL), ',') AS issues
FROM files f LEFT JOIN l s ON s.path = f.relative_path LEFT JOIN l t ON t.path = 'out/kept/' || f.image_id || '.txt'""")
def transfer_conflicts(spark, sf_dir):
    f = files(spark, sf_dir)
    i = F.col("image_id")
    target = F.concat(F.lit("out/kept/"), i.cast("string"), F.lit(".txt"))
    now = f.filter(i % 7 != 0).select(F.col("relative_path").alias("path"), F.col("mtime").alias("fingerprint"), "digest").unionByName(f.filter(i % 10 < 2).select(target.alias("path"), F.lit(0).cast("long").alias("fingerprint"), F.when(i % 2 == 0, F.col("digest")).otherwise("x").alias("digest")))
    items = f.select("image_id", F.col("relative_path").alias("path"), F.when(i % 6 != 0, F.col("mtime")).alias("expected"))
    return fileplan.transfer_issues(items, now, naming.destination(F.lit("out"), F.lit(" kept "))).select("image_id", "target_path", F.array_join("issues", ",").alias("issues"))


@query("batch_outcomes", """WITH o AS (SELECT o_custkey AS batch, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'skipped' ELSE 'succeeded' END AS status, CASE WHEN o_custkey % 3 = 0 THEN 'copy' ELSE 'rename' END AS operation FROM orders)
SELECT batch, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed, bool_or(status = 'succeeded' AND operation IN ('rename', 'move')) AS reversible,
round(count(*) FILTER (WHERE status = 'succeeded')::DOUBLE / count(*) * 100)::BIGINT AS done_percent, string_agg(CASE WHEN status = 'succeeded' THEN 'new/' ELSE 'old/' END || o_orderkey, ',' ORDER BY o_orderkey) AS paths FROM o GROUP BY batch""")
def batch_outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("succeeded").alias("status"), F.when(F.col("o_custkey") % 3 == 0, "copy").otherwise("rename").alias("operation"))
    key = F.col("o_orderkey").cast("string")
    o = o.withColumn("path", F.concat(F.lit("old/"), key))
    moved = o.filter("status = 'succeeded'").select("path", F.concat(F.lit("new/"), key).alias("new_path"))
    listed = fileplan.apply_paths(o, moved).groupBy("batch").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", "path")))["path"], ",").alias("paths"))
    r = stats.batch_result(o, "batch")
    return r.join(listed, "batch").withColumn("done_percent", measures.percent(F.col("succeeded"), F.col("succeeded") + F.col("skipped") + F.col("failed")))


@query("slider_maps", """WITH t AS (SELECT p_partkey, p_partkey % 191 AS t FROM part)
SELECT p_partkey, t, CASE WHEN t <= 40 THEN (9500 + 10 * t) / 10000.0::DOUBLE ELSE (9900 + t - 40) / 10000.0::DOUBLE END AS precise, t AS precise_back, CASE WHEN t <= 90 THEN (9000 + 10 * t) / 10000.0::DOUBLE ELSE (9900 + t - 90) / 10000.0::DOUBLE END AS setting, t AS setting_back,
round(least(greatest(coalesce(try_cast(CASE WHEN t % 3 = 0 THEN '0.9' || t WHEN t % 3 = 1 THEN 'bad' END AS DOUBLE), try_cast(CASE WHEN t % 2 = 0 THEN t::VARCHAR END AS DOUBLE) / 100, 0.985::DOUBLE), 0.95::DOUBLE), 1.0::DOUBLE), 4) AS threshold,
56 - (48 * least(t, 100) + 50) // 100 AS sensitivity, greatest(9, t * 50000 // 100000)::BIGINT AS least_area, least(greatest(round(t / 4.0::DOUBLE - 3), 0), 24)::BIGINT AS grouping, least(greatest(t - 1, 2), 16)::BIGINT AS workers FROM t""")
def slider_maps(spark, sf_dir):
    """Each part's key as a position of the sliders."""
    t = F.col("t")
    current = F.when(t % 3 == 0, F.concat(F.lit("0.9"), t.cast("string"))).when(t % 3 == 1, "bad")
    legacy = F.when(t % 2 == 0, t.cast("string"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), (F.col("p_partkey") % 191).cast("long").alias("t"))
    return parts.select(
        "p_partkey", "t", measures.slider_precise(t).alias("precise"), measures.slider_precise_inverse(measures.slider_precise(t)).alias("precise_back"), measures.slider_settings(t).alias("setting"), measures.slider_settings_inverse(measures.slider_settings(t)).alias("setting_back"),
        measures.recognition_threshold(current, legacy).alias("threshold"), measures.sensitivity_threshold(t).alias("sensitivity"), measures.least_area(t * 50000).alias("least_area"), measures.grouping_distance(t / 4 - 3).alias("grouping"), measures.workers(t).alias("workers"),
    )
