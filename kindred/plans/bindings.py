
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import Profile
from kindred.functions import bits, measures

#: The distances of random-like vectors are large, so the profile of the bound queries has wider limits.
PROFILE = Profile(max_distance=24, top_k=5)
GROUPS = 18
EVENT_TYPES = {"view": "validating", "click": "prepared", "signup": "recycled", "purchase": "restored", "error": "operation_failed"}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark, sf_dir: str) -> DataFrame:
    """Vectors as images."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("label"), bits.sign_bits(F.col("embedding")).alias("phash"))
    width = (800 + 200 * (F.floor(F.col("image_id") / 2) % 3)).cast("long")
    e = e.withColumn("width", width)
    height = F.when(F.col("label") % 2 == 0, F.floor(F.col("width") * 3 / 4)).otherwise(F.floor(F.col("width") * 2 / 3))
    return e.select(
        "image_id", F.when(F.col("image_id") % 2 == 0, "baseline").otherwise("comparison").alias("role"), "phash", "width", height.cast("long").alias("height"),
        (F.floor(F.col("width") * F.col("width") / 2) + F.col("image_id") % 97).cast("long").alias("file_size"),
        F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("/img_"), F.col("image_id").cast("string"), F.lit(".png")).alias("relative_path"),
        F.md5(F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("image_id") / 4).cast("string"))).alias("digest"), "label",
    ).withColumn("aspect", measures.aspect(F.col("width"), F.col("height")))


IMAGES = """
img0 AS (SELECT vec_id AS image_id, label, 800 + 200 * ((vec_id // 2) % 3) AS width, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings),
images AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'baseline' ELSE 'comparison' END AS role, bits, CAST(width AS BIGINT) AS width,
  CAST(CASE WHEN label % 2 = 0 THEN width * 3 // 4 ELSE width * 2 // 3 END AS BIGINT) AS height, CAST(width * width // 2 + image_id % 97 AS BIGINT) AS file_size,
  'L' || label || '/img_' || image_id || '.png' AS relative_path, md5(label || '-' || (image_id // 4)) AS digest, label,
  CAST(width AS DOUBLE) / CASE WHEN label % 2 = 0 THEN width * 3 // 4 ELSE width * 2 // 3 END AS aspect FROM img0)"""


def files(spark, sf_dir: str) -> DataFrame:
    """Documents as files: the first ten sources are the baseline."""
    d = table(spark, sf_dir, "documents")
    baseline = F.col("source").rlike("^src[0-9]$")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("image_id"), path.alias("relative_path"), F.md5("text").alias("digest"), F.when(baseline, "baseline").otherwise("comparison").alias("role"), F.col("source").alias("folder"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime"))


FILES = """
files AS (SELECT doc_id AS image_id, source || '/' || lang || '/' || doc_id || '.txt' AS relative_path, md5(text) AS digest,
  CASE WHEN regexp_full_match(source, 'src[0-9]') THEN 'baseline' ELSE 'comparison' END AS role, source AS folder, CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000 AS mtime FROM documents)"""


def operations(spark, sf_dir: str) -> DataFrame:
    """Events as the operation log; a user is a result."""
    kind = F.when(F.lit(False), "")
    for event, operation in EVENT_TYPES.items():
        kind = kind.when(F.col("event_type") == event, operation)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("result_id"), kind.otherwise("none").alias("operation_type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))


OPERATIONS = """
operations AS (SELECT event_id AS id, user_id AS result_id, CASE event_type WHEN 'view' THEN 'validating' WHEN 'click' THEN 'prepared' WHEN 'signup' THEN 'recycled'
  WHEN 'purchase' THEN 'restored' WHEN 'error' THEN 'operation_failed' ELSE 'none' END AS operation_type, epoch_us(ts) AS created_at FROM events),
latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY created_at DESC, id DESC) AS n FROM operations) WHERE n = 1)"""


def result_ids(i: DataFrame) -> DataFrame:
    """(result_id, image_id): each comparison image has one result, with an id of its own."""
    return i.filter("role = 'comparison'").select((F.col("image_id") + 1).alias("result_id"), "image_id")


LATEST_IMAGE = """
latest_image AS (SELECT i.image_id, l.* FROM latest l JOIN images i ON i.image_id + 1 = l.result_id WHERE i.role = 'comparison')"""


def page_paths(spark, sf_dir: str) -> DataFrame:
    """URLs without their scheme, query and fragment as paths, with one of five endings."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    ending = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".txt", ".webp", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(path, ending).alias("path"))


PATHS = """
paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.webp' ELSE '' END AS path FROM pages)"""


def pair_score(c, b):
    """The synthetic similarity of a pair of ids."""
    return F.lit(1.0) - ((c * 31 + b * 17) % 25) * 16 / F.lit(1000.0)


SCORE = "1.0::DOUBLE - (({c} * 31 + {b} * 17) % 25) * 16 / 1000.0::DOUBLE"
