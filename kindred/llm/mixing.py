"""Mixing sources to target weights, with DataFrame functions only.

The words of a source's documents, one after another, form a stream that is cut into blocks of ``BLOCK`` words. Each
output shard draws a multinomial number of blocks from each source. The n-th block drawn from a source, counted over
all shards, is slot n of that source, and a pseudorandom permutation of the source's block numbers (another one for
each pass over the source) maps slots to blocks; blocks join documents by source and number. Draws beyond a source's
share give their places to sources that were drawn too seldom, so every source's total is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import WORD, materialise, partitions

BLOCK, SEED, ROUNDS, CELLS = 128, 20_240_117, 12, 4096
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0


def sized(docs: DataFrame, item: Column, place: Column | None = None) -> DataFrame:
    """item, place, source, size (number of words; null text: 0). ``place``, the item itself unless given, decides where in its source a row stands."""
    return docs.select(item.alias("item"), (item if place is None else place).alias("place"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """sid, source, source_size, target: water-filling of ``SHARE`` of all words by weight under the bound ``MOST``.

    One row a source; the windows without partition run over sources only. Sources are ordered by code point, null
    last. Sharing the excess again and again ends where all sources below their bound have one level a weight.
    """
    sources = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*map(F.lit, WEIGHTS))
    s = sources.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(weights, (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("bound", F.lit(MOST) * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    rising = Window.orderBy("ratio", "sid")
    total = F.lit(SHARE) * F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum("bound").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (total - before) / open_)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("found", level.getField("level"))
    target = F.least("bound", F.col("found") * F.col("weight"))
    return materialise(s.select("sid", "source", "source_size", target.alias("target")), "targets")


def shuffled(i: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0..n-1 applied to ``i``: a swap-or-not shuffle, each of whose rounds is a bijection for any n."""

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit(SEED)), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other), F.lit(SEED + 1)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, one)


def plan(table: DataFrame) -> DataFrame:
    """The mix: shard, sid, slot, pass, block; one row for each block that a shard takes.

    ``table`` has sid, n_blocks and n_slots, one row a source. Shards have about the square root of all slots each
    (1,024 at least), so windows over the shards of a source and over all shards stay small.
    """
    spark = table.sparkSession
    n = table.agg(F.sum("n_slots")).first()[0] or 0
    per_shard = max(1024, math.isqrt(n) + 1)
    upto = F.sum("n_slots").over(Window.orderBy("sid"))
    ranges = table.filter("n_slots > 0").select("sid", ((upto - F.col("n_slots")) / F.lit(max(n, 1))).alias("lo"), (upto / F.lit(max(n, 1))).alias("hi"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    draws = spark.range(n).select(F.floor(F.col("id") / per_shard).alias("shard"), (F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED)), 11) * F.lit(2.0**-53)).alias("u"))
    drawn = draws.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").filter("lo <= u and u < hi").groupBy("shard", "sid").agg(F.count("*").alias("n"))
    counts = materialise(drawn, "counts").join(table, "sid")
    base = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    kept = counts.withColumn("base", base).withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("n_slots") - F.col("base"))))
    # a small table that is about to grow to all slots: dealt out first, so that the tasks grow with it
    kept = materialise(kept.select("shard", "sid", "n", "base", "kept"), "kept").repartition(partitions(spark), "shard")

    def each(first: Column, many: Column) -> Column:
        return F.explode(F.sequence(first, first + many - 1))

    own = kept.filter("kept > 0").select("shard", "sid", each(F.col("base"), F.col("kept")).alias("slot"))
    left = kept.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("free"))
    left = left.select("shard", "free", (F.sum("free").over(Window.orderBy("shard")) - F.col("free")).alias("rank"))
    short = table.join(kept.groupBy("sid").agg(F.sum("kept").alias("kept")), "sid", "left").select("sid", F.coalesce("kept", F.lit(0)).alias("kept"), "n_slots")
    short = short.withColumn("lack", F.col("n_slots") - F.col("kept"))
    short = short.withColumn("rank", F.sum("lack").over(Window.orderBy("sid")) - F.col("lack"))
    holes = left.filter("free > 0").select("shard", each(F.col("rank"), F.col("free")).alias("rank"))
    lacks = short.filter("lack > 0").select("sid", "kept", F.col("rank").alias("first"), each(F.col("rank"), F.col("lack")).alias("rank"))
    filled = holes.join(lacks, "rank").select("shard", "sid", (F.col("kept") + F.col("rank") - F.col("first")).alias("slot"))
    slots = own.unionByName(filled).join(table.select("sid", "n_blocks"), "sid")
    turn = F.floor(F.col("slot") / F.col("n_blocks"))
    return slots.select("shard", "sid", "slot", turn.alias("pass"), shuffled(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid"), turn).alias("block"))


def mix(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, source, size, source_size, target, taken) for each row of ``sizes``, and the plan of the mix.

    ``sizes`` (item, place, source, size) must be a table. Empty documents are never taken. Where a source is in one word
    or empty its target is at most twice its size, as for all. An empty table gives no rows. Repeated rows are
    documents of their own. Reruns agree: order, draws and permutations all come from hashes.

    A document's place in its source's stream is a prefix sum in two steps: within lanes (hash groups of about the
    square root of the number of rows, so that no source fills one task), then over the lanes of each source.
    """
    table = targets(sizes)
    per_block = F.ceil(F.col("source_size") / BLOCK).cast("long")
    slots = F.least(2 * per_block, F.round(F.col("target") * per_block / F.col("source_size")).cast("long"))
    table = materialise(table.select("*", per_block.alias("n_blocks"), F.when(F.col("source_size") > 0, slots).otherwise(0).alias("n_slots")), "blocks")
    lanes = math.isqrt(sizes.count()) + 1
    rows = sizes.join(table.select("sid", F.col("source").alias("s")), sizes["source"].eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("lane", F.pmod(F.xxhash64(F.when(F.col("size") > 0, F.col("place").cast("string")).otherwise(F.col("item").cast("string")), F.lit(SEED)), F.lit(lanes)))
    lane = Window.partitionBy("sid", "lane").orderBy("place", "size", "item")
    placed = rows.select("*", F.row_number().over(lane).alias("nth"), (F.sum("size").over(lane.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("inside"))
    placed = materialise(placed, "placed")
    sums = placed.groupBy("sid", "lane").agg(F.sum("size").alias("n"))
    bases = sums.select("sid", "lane", (F.sum("n").over(Window.partitionBy("sid").orderBy("lane")) - F.col("n")).alias("base"))
    placed = placed.join(bases, ["sid", "lane"]).withColumn("start", F.col("base") + F.col("inside"))
    chosen = materialise(plan(table.select("sid", "n_blocks", "n_slots")), "plan")
    times = chosen.groupBy("sid", "block").agg(F.count("*").alias("times"))
    reach = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)))
    parts = placed.select("sid", "lane", "nth", "start", "size", F.explode(reach).alias("block")).join(times, ["sid", "block"])
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)
    got = parts.groupBy("sid", "lane", "nth").agg(F.sum(overlap * F.col("times")).alias("taken"))
    whole = placed.select("sid", "lane", "nth", "item", "source", "size").join(got, ["sid", "lane", "nth"], "left")
    out = whole.join(table.select("sid", "source_size", "target"), "sid")
    return out.select("item", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")), chosen


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` in the mix's proportions: a row appears as often as the mix takes it, rounded by a hash, 0 to 2 times.

    Empty documents have no words to take and are not in the mix. All columns come through, whatever their names. Where
    a row stands in its source, and how it is rounded, follows from two hashes of its content: the mix is the same however the rows are laid out.
    """
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")), {"ignoreNullFields": "false"})
    own = F.struct(F.xxhash64("text", rest).alias("h0"), F.xxhash64(F.lit(SEED), rest, "text").alias("h1"))
    # n, a row's place in the written table, only tells apart rows that are equal in all else
    written = materialise(docs.select(F.struct("*").alias("row"), own.alias("place"), F.monotonically_increasing_id().alias("n")), "rows")
    slim = written.select("row.source", "row.text", "place", "n")
    item = F.struct("place", "n")
    taken, _ = mix(materialise(sized(slim, item, F.col("place")), "sizes"))
    dither = F.shiftrightunsigned(F.xxhash64("item.place.h0", "item.place.h1", F.lit(SEED + 2)), 11) * F.lit(2.0**-53)
    copies = F.least(F.lit(2), F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + dither)).cast("int")
    times = taken.select("item.n", copies.alias("copies")).filter("copies > 0")
    return written.join(times, "n").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, _ = mix(materialise(sized(docs, F.col("doc_id").cast("long")), "sizes"))
    return out.select(F.col("item").alias("doc_id"), "size", "source_size", "target", "taken")
