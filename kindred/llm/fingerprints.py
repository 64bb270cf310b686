"""Document fingerprints with DataFrame functions only: SimHash, and permuted block tables to search them.

Terms are pairs of neighbouring words; each occurrence votes with the weight of its length. The 64 signed votes are
kept as 32 long sums of two 32-bit lanes, so one hash aggregation inside generated code adds them all, and only one
row a document leaves each task. A bit is set where more than half of the weight has it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialise, partitions, whole_text

BITS, LANE, LOWEST = 64, 0x0000000100000001, -(2**63)
#: Ids divisible by this are the queries of the search for neighbours.
QUERIES = 100


def terms(text: Column) -> Column:
    """Array of (hash, weight) of a text's terms: neighbouring pairs of words, or its only word."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one = lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).cast("long").alias("w"))
    pair = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), (F.length(a) + F.length(b)).cast("long").alias("w")))
    return F.when(F.size(words) > 1, pair).otherwise(F.transform(words, one))


def simhash(rows: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """``rows`` has one row a term (null: none); gives ``keys`` and fp, the 64 bits as a signed long."""
    lanes = [F.sum(F.shiftrightunsigned(f"{term}.h", k).bitwiseAND(F.lit(LANE)) * F.col(f"{term}.w")).alias(f"s{k}") for k in range(32)]
    summed = rows.groupBy(*keys).agg(*lanes, F.sum(f"{term}.w").alias("total"))
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{k}", 32)
        fp = fp.bitwiseOR(F.when(2 * low > F.col("total"), F.lit(1 << k)).otherwise(F.lit(0)))
        bit = (1 << (k + 32)) - (1 << 64 if k == 31 else 0)
        fp = fp.bitwiseOR(F.when(2 * high > F.col("total"), F.lit(bit)).otherwise(F.lit(0)))
    return summed.select(*keys, fp.alias("fp"))


def hex16(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fp of each row. A null or word-less text has fp 0; equal texts have equal ones; repeats each give a row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("n"), whole_text().alias("text"))
    return simhash(rows.select("doc_id", "n", F.explode_outer(terms(F.col("text"))).alias("term")), ["n", "doc_id"]).drop("n")


def block_keys(fp: Column, radius: int) -> Column:
    """Keys of the permuted tables: with ``radius`` + 3 blocks, any ``radius`` differing bits leave 3 blocks untouched;
    there is one table for each choice of 3 blocks, keyed by their bits (and the table's number)."""
    n = radius + 3
    cuts = [BITS * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*(F.struct(F.lit(t).alias("t"), *(block[i].alias(f"b{k}") for k, i in enumerate(chosen))) for t, chosen in enumerate(combinations(range(n), 3))))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct pairs (query, fp) of differing fingerprints at most ``radius`` bits apart, by permuted block tables.

    Both inputs are reduced to distinct fingerprints (column fp) first, so copies are never paired with each other.
    Complete for any radius: the tables cover every choice of untouched blocks. Spark takes the exploded tables for as small as
    what they are made of; they are merged, never broadcast.
    """
    left = queries.select(F.col("fp").alias("query")).distinct().withColumn("key", F.explode(block_keys(F.col("query"), radius)))
    right = fps.select("fp").distinct().withColumn("key", F.explode(block_keys(F.col("fp"), radius)))
    near = left.join(right.hint("merge"), "key").filter((F.col("query") != F.col("fp")) & (F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius))
    return near.select("query", "fp").distinct()


def successors(docs: DataFrame) -> DataFrame:
    """key, next, need: each distinct key's next one in descending order (the largest after the least), with half of
    the longest text under the key. Keys are range-partitioned; ranges are then linked through their ends, one row
    a range, so no task sees all keys."""
    spark = docs.sparkSession
    keys = docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).alias("need"))
    ranged = materialise(keys.repartitionByRange(partitions(spark), "key").select(F.spark_partition_id().alias("part"), "key", "need"), "keys")
    ends = ranged.groupBy("part").agg(F.max("key").alias("most"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("most").over(Window.orderBy("part")), F.max("most").over(whole)).alias("below"))
    inside = ranged.withColumn("own", F.lag("key").over(Window.partitionBy("part").orderBy("key")))
    return materialise(inside.join(ends, "part").select("key", F.coalesce("own", "below").alias("next"), "need"), "successors")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and their likenesses; see ``op6_document_fingerprints``.

    Null texts are empty. A null doc_id counts as the least. Repeated rows each give a row; where a doc_id has several
    texts, the least of their heads (and fingerprints) stands for the next document. A lone document follows itself.
    n_near is the number of other fingerprints within the radius of three, found by the block tables, for the documents
    that are taken as queries (ids divisible by 100); null for the others.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.monotonically_increasing_id().alias("n"), whole_text().alias("text"))
    following = successors(rows)
    # both joins read one and the same exchange of the texts by key, so they must ask for the same columns
    heads = rows.join(following.withColumnsRenamed({"key": "of", "next": "key"}).hint("merge"), "key").select(F.col("of").alias("key"), "n", F.substring("text", F.lit(1), F.col("need").cast("int")).alias("head"))
    heads = heads.groupBy("key").agg(F.min(F.struct("head", "n")).getField("head").alias("head"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    both = rows.join(heads.hint("merge"), "key").select("key", "n", "text", size.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), size - half), F.substring("head", F.lit(1), half)).alias("edited"))
    two = F.array(F.struct(F.lit(False).alias("changed"), F.col("text").alias("t")), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("t")))
    texts = both.select("key", "n", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(two).alias("x"))
    exploded = texts.select("key", "n", "n_chars", "sha", "x.changed", F.explode_outer(terms(F.col("x.t"))).alias("term"))
    fps = simhash(exploded, ["n", "key", "n_chars", "sha", "changed"])
    pick = lambda changed: F.max(F.when(F.col("changed") == changed, F.col("fp")))
    per_row = materialise(fps.groupBy("n", "key", "n_chars", "sha").agg(pick(False).alias("fp"), pick(True).alias("edited_fp")), "fingerprints")
    near = within_radius(per_row.filter(F.col("key") % QUERIES == 0), per_row).groupBy(F.col("query").alias("fp")).agg(F.count("*").alias("n_near"))
    asked = F.when(F.col("key") % QUERIES == 0, F.coalesce("n_near", F.lit(0)))
    ahead = per_row.groupBy("key").agg(F.min("fp").alias("next_fp")).withColumnRenamed("key", "next")
    # successors are a row a document, in files that compress to a small part of it
    return per_row.join(near.hint("merge"), "fp", "left").withColumn("n_near", asked).join(following.select("key", "next").hint("merge"), "key").join(ahead.hint("merge"), "next")


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.nullif(F.col("key"), F.lit(LOWEST)).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), hex16("fp").alias("fingerprint"),
        hex16("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_near",
    )
