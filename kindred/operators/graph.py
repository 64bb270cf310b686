"""Connected components and the groups that come of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kindred.functions import measures
from kindred.operators import match, metric, nearest, stats
from kindred.scratch import discard, materialise


FEW = 200_000  # edges that one task can settle at once


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of few edges, in one task. Vertices that are no longs are numbered in their order."""
    held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if held is None:
        return
    kind = held["a"].type
    if pa.types.is_int64(kind):
        v, root = metric.least_reached(held["a"].to_numpy(), held["b"].to_numpy())
        yield pa.record_batch([pa.array(v[v != root]), pa.array(root[v != root])], names=["v", "root"])
        return
    key = lambda x: tuple(x.values()) if isinstance(x, dict) else x
    ends = [held[c].to_pylist() for c in ("a", "b")]
    values = {key(x): x for side in ends for x in side}
    order = sorted(values)
    number = {k: i for i, k in enumerate(order)}
    v, root = metric.least_reached(*(np.array([number[key(x)] for x in side], np.int64) for side in ends))
    moved = v != root
    yield pa.record_batch([pa.array([values[order[i]] for i in x[moved].tolist()], kind) for x in (v, root)], names=["v", "root"])


def roots(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b, any orderable type) that reaches a lesser one; root is the least that it reaches.

    Alternating large-star and small-star steps until nothing moves; each writes its edges to the shared folder, so a
    lost executor costs one step, and deletes those of the step before. What a step has changed is seen while it is
    written. The number of steps grows with the logarithm of the longest path. At most ``few`` edges are settled in one task instead.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialise(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")), "edges")
        return out, (seen.get["n"], seen.get["mark"])

    e, last = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if last[0] <= few:
        kind = e.schema["a"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(settled, f"v {kind}, root {kind}")
    while last[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        before, (e, now) = e, written(small)
        discard(before)
        if now == last:
            break
        last = now
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, component) for all ``vertices``; component is the least id reached over ``edges`` (a, b)."""
    return vertices.select("image_id").join(roots(edges), F.col("image_id") == F.col("v"), "left").select("image_id", F.coalesce("root", "image_id").alias("component"))


def similarity_components(images: DataFrame, most: int) -> DataFrame:
    """(image_id, component) of ``images`` (image_id, phash): those within ``most`` bits are linked. Components are found over
    distinct hashes, so copies never multiply; an image without a hash is a component of its own."""
    return _by_hash(images, linked(metric.table_of(images), most))


MANY = 20_000  # hashes from which on the largest component is looked for first


def linked(distinct: DataFrame, most: int, many: int = MANY, counter=None) -> DataFrame:
    """(v, root) of ``distinct`` hashes, as ``roots`` gives it of all pairs within ``most`` bits.

    Many hashes that are all far from each other still hang together in one large component. It is found first, from pairs that a few sorted
    orders show; its members are linked already and are not compared with each other again, only all others with each other and with it.
    """
    if match.indexable(most) or distinct.count() < many:
        return roots(match.links_within(distinct, most))
    first = materialise(roots(metric.beside(distinct, most)), "first")
    top = first.groupBy("root").count().orderBy(F.desc("count"), "root").select("root").first()
    if top is None:
        return roots(match.links_within(distinct, most))
    large = first.filter(F.col("root") == top[0]).select(F.col("v").alias("hash")).unionByName(distinct.filter(F.col("hash") == top[0]))
    large = materialise(large, "large")
    rest = materialise(distinct.join(large.hint("merge"), "hash", "left_anti"), "rest")
    more = metric.within(rest, most, links=True, counter=counter).unionByName(metric.between(large, rest, most, counter=counter, links=True))
    return roots(more.select("a", "b").unionByName(first.select(F.col("v").alias("a"), F.col("root").alias("b"))))


def _by_hash(images: DataFrame, reached: DataFrame) -> DataFrame:
    """Components of images, from (v, root) over their hashes."""
    first = images.filter("phash is not null").groupBy("phash").agg(F.min("image_id").alias("first"))
    rooted = first.join(reached, F.col("phash") == F.col("v"), "left").select("phash", "first", F.coalesce("root", "phash").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    component = rooted.join(heads, "root").select("phash", "head")
    return images.select("image_id", "phash").join(component, "phash", "left").select("image_id", F.coalesce("head", "image_id").alias("component"))


def extend_components(known: DataFrame, added: DataFrame, most: int) -> DataFrame:
    """(image_id, phash, component) after images ``added`` (image_id, phash) came to ``known`` (image_id, phash, component).

    Equal to a run over all of them, but no edge between known images is looked for: only hashes that are new are
    compared, with each other and with the known ones; each known component is one vertex.
    """
    old = materialise(known.filter("phash is not null").groupBy("phash").agg(F.min("component").alias("component")), "known")
    fresh = materialise(added.filter("phash is not null").groupBy("phash").agg(F.min("image_id").alias("first")).join(old.withColumnRenamed("component", "held"), "phash", "left"), "fresh")
    table = lambda df: materialise(df.select(F.col("phash").alias("hash")), "hashes")
    new, before = table(fresh.filter("held is null")), table(old)
    links = match.links_within(new, most).unionByName(match.links_between(new, before, most))
    # a known hash stands for its component, a new one for the first image that has it
    of = old.select("phash", F.col("component").alias("vertex")).unionByName(fresh.filter("held is null").select("phash", F.col("first").alias("vertex")))
    ends = links.join(of.select(F.col("phash").alias("a"), F.col("vertex").alias("from")), "a").join(of.select(F.col("phash").alias("b"), F.col("vertex").alias("to")), "b")
    # the same hash under a smaller id, too: the component takes the least id
    same = fresh.filter("held is not null").select(F.col("held").alias("a"), F.col("first").alias("b"))
    reached = materialise(roots(ends.select(F.col("from").alias("a"), F.col("to").alias("b")).unionByName(same)), "reached")
    whole = known.select("image_id", "phash", "component").unionByName(added.select("image_id", "phash").join(of, "phash", "left").select("image_id", "phash", F.coalesce("vertex", "image_id").alias("component")))
    return whole.join(reached, F.col("component") == F.col("v"), "left").select("image_id", "phash", F.coalesce("root", "component").alias("component"))


def quality_order():
    """Best first: pixels, bytes, then the smaller path."""
    return [measures.pixels(F.col("width"), F.col("height")).desc(), F.col("file_size").desc(), F.col("relative_path"), F.col("image_id")]


def best_first(px: Column, size: Column, path: Column, image_id: Column) -> Column:
    """The quality order as one value, the least is the best; it lets an aggregation find the best member of a group."""
    last = F.lit(2**63 - 1)
    return F.struct(F.coalesce(-px, last).alias("px"), F.coalesce(-size, last).alias("size"), path.alias("path"), image_id.alias("id"))


def own_quality() -> Column:
    return best_first(measures.pixels(F.col("width"), F.col("height")), F.col("file_size"), F.col("relative_path"), F.col("image_id"))


def groups(images: DataFrame, components: DataFrame) -> DataFrame:
    """Images with component, n, first_path, reference_id and the dense 1-based group_index by (size desc, first path).

    What a group knows is aggregated and joined back, so no task holds a large group; the groups are numbered by ranges.
    """
    member = images.join(components, "image_id")
    keys = member.groupBy("component").agg(F.count("*").alias("n"), F.min("relative_path").alias("first_path"), F.min_by("image_id", own_quality()).alias("reference_id"))
    return member.join(stats.numbered(keys, F.desc("n"), "first_path", "component", name="group_index"), "component")


def member_roles(grouped: DataFrame, results: DataFrame, images: DataFrame) -> DataFrame:
    """Adds the analysis and the role of each member: reference, lower_quality, needs_review, standalone, candidate.

    The member's primary match stands for the group's reference where it is an active image.
    """
    r = results.select("image_id", "analysis_type", "primary_id", "score")
    p = images.select(F.col("image_id").alias("primary_id"), measures.pixels(F.col("width"), F.col("height")).alias("p_pixels"), F.col("file_size").alias("p_size"), F.col("relative_path").alias("p_path"))
    g = images.select(F.col("image_id").alias("reference_id"), measures.pixels(F.col("width"), F.col("height")).alias("g_pixels"), F.col("file_size").alias("g_size"), F.col("relative_path").alias("g_path"))
    x = grouped.join(r, "image_id", "left").join(p, "primary_id", "left").join(g, "reference_id", "left")
    own = measures.pixels(F.col("width"), F.col("height"))
    pixels, size = F.coalesce("p_pixels", "g_pixels"), F.when(F.col("p_pixels").isNotNull(), F.col("p_size")).otherwise(F.col("g_size"))
    better = (pixels > own) | ((pixels == own) & (size > F.col("file_size")))
    low = F.coalesce((F.col("analysis_type") == "likely_compressed") | ((F.coalesce("score", F.lit(0.0)) >= 0.995) & better & F.col("analysis_type").isNotNull()), F.lit(False))
    role = (
        F.when(F.col("image_id") == F.col("reference_id"), "reference")
        .when(low, "lower_quality")
        .when(F.col("analysis_type") == "inconclusive", "needs_review")
        .when(F.col("analysis_type") == "no_baseline_match", "standalone")
        .otherwise("candidate")
    )
    effective = F.when(F.col("p_pixels").isNotNull(), F.col("primary_id")).otherwise(F.col("reference_id"))
    return x.withColumn("low_quality", low).withColumn("member_role", role).withColumn("cluster_key", F.coalesce("primary_id", "image_id").cast("string")).withColumn("effective_reference_id", F.when(effective != F.col("image_id"), effective))


SMALL, HELD, ROWS = 256, 32768, 1024  # members of a component that is joined as it is; anchors that a task holds, about; members that look at the same anchors


def plan_pairs(members: DataFrame, anchor_pixels: float = 0.9, anchor_size: float = 0.75, lower: float = 0.98, most: int = 24, k: int = 8, small: int = SMALL) -> DataFrame:
    """(component, left_id, right_id): pairs worth a similarity score inside each group.

    ``members``: component, image_id, phash, width, height, file_size, relative_path. A pair joins a possible
    lower-quality copy to one of its ``k`` best anchors within ``most`` bits (an unknown distance passes, last).

    Components of more than ``small`` members are dealt into lines of members and of anchors, so that a task holds a bounded number of
    anchors while members pass by, and gives the ``k`` best of these for each; the best of all lines are merged.
    """
    px = measures.pixels(F.col("width"), F.col("height"))
    m = members.select("component", "image_id", "phash", "file_size", "relative_path", px.alias("px"))
    m = m.join(m.groupBy("component").agg(F.count("*").alias("n"), F.max("px").alias("most_px"), F.max("file_size").alias("most_size")), "component")
    anchor = (F.col("most_px") == 0) | (F.col("px") >= F.col("most_px") * anchor_pixels) | (F.col("most_size") <= 0) | (F.col("file_size") >= F.col("most_size") * anchor_size)
    m = materialise(m.select("component", "image_id", "phash", "file_size", "relative_path", "px", "n", anchor.alias("anchor")), "members")
    few = m.filter(F.col("n") <= small)
    a = few.filter("anchor").select("component", *(F.col(c).alias(f"a_{c}") for c in ("image_id", "phash", "file_size", "relative_path", "px")))
    far = F.bit_count(F.col("phash").bitwiseXOR(F.col("a_phash")))
    pairs = few.join(a, "component").filter("image_id <> a_image_id").filter((F.col("px") < F.col("a_px") * lower) | (F.col("file_size") < F.col("a_file_size") * lower))
    pairs = pairs.withColumn("distance", F.coalesce(far, F.lit(UNKNOWN))).filter(far.isNull() | (far <= most)).select(*BEST)
    if not m.filter(F.col("n") > small).isEmpty():
        pairs = pairs.unionByName(_best_of_lines(m.filter(F.col("n") > small), lower, most, k))
    nearest = Window.partitionBy("image_id").orderBy("distance", F.desc("a_px"), F.desc("a_file_size"), "a_relative_path")
    kept = pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return kept.select("component", F.least("image_id", "a_image_id").alias("left_id"), F.greatest("image_id", "a_image_id").alias("right_id")).dropDuplicates(["left_id", "right_id"])


UNKNOWN = 2147483647
BEST = ["component", "image_id", "a_image_id", "distance", "a_px", "a_file_size", "a_relative_path"]


def _best_of_lines(m: DataFrame, lower: float, most: int, k: int) -> DataFrame:
    """For each member the ``k`` best anchors of each line of anchors, with what ranks them. Members that are no lower-quality copy of the largest
    anchors have none and are left out."""
    m = m.withColumn("component", F.col("component").cast("long"))
    largest = m.filter("anchor").groupBy("component").agg(F.ceil(F.count("*") / HELD).alias("a_lines"), F.max("px").alias("a_px"), F.max("file_size").alias("a_size"))
    none = (F.col("px") >= F.col("a_px") * lower) & (F.col("file_size") >= F.col("a_size") * lower)
    passing = m.join(largest, "component").filter(F.coalesce(~none, F.lit(True))).drop("a_px", "a_size")
    lines = passing.groupBy("component", "a_lines").agg(F.ceil(F.count("*") / HELD).alias("m_lines"))
    own = lambda n, seed: F.pmod(F.xxhash64("image_id", F.lit(seed)), n)
    columns = ["component", "image_id", "phash", "file_size", "px"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    anchors = m.filter("anchor").join(lines, "component").select(*columns, "relative_path", F.lit(0).alias("side"), every(F.col("m_lines")).alias("i"), own(F.col("a_lines"), 1).alias("j"))
    passing = passing.join(lines.drop("a_lines"), "component").select(*columns, F.lit(None).cast("string").alias("relative_path"), F.lit(1).alias("side"), own(F.col("m_lines"), 2).alias("i"), every(F.col("a_lines")).alias("j"))
    dealt = anchors.unionByName(passing).repartition(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "i", "j")
    # the best anchors come first, so their places tell which is better; members come by quality, so that those of a block look at nearly the same anchors
    dealt = dealt.sortWithinPartitions("component", "i", "j", "side", F.desc("px"), F.desc("file_size"), "relative_path", "image_id")
    return dealt.mapInArrow(_probe(lower, most, k), "component long, image_id long, a_image_id long, distance int, a_px long, a_file_size long, a_relative_path string")


def _probe(lower: float, most: int, k: int):
    value = lambda t, c, fill=0: (t[c].combine_chunks() if isinstance(t, pa.Table) else t.column(c)).fill_null(fill).to_numpy(zero_copy_only=False)
    unknown, never = most + 1, 255  # in place of a distance: of a missing hash, of no pair

    def looked_at(a: pa.Table) -> dict:
        a = a.combine_chunks()
        held = {c: value(a, c) for c in ("px", "file_size", "image_id", "phash")} | {"rows": a, "none": a["phash"].is_null().to_numpy()}
        return held | {"by_id": np.argsort(held["image_id"])}

    def best(a: dict, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        px, size, id_, hash_ = (value(part, c) for c in ("px", "file_size", "image_id", "phash"))
        none = part.column("phash").is_null().to_numpy(zero_copy_only=False)
        fits = lambda px, size, use: (px < a["px"][use] * lower) | (size < a["file_size"][use] * lower)
        use = np.flatnonzero(fits(px.min(), size.min(), slice(None)))  # all others fit no member of the part
        if not len(use):
            return
        some = np.flatnonzero(~fits(px.max(), size.max(), use))  # these don't fit all of them
        hashes, missing = a["phash"][use].view(np.uint64), np.flatnonzero(a["none"][use])
        step = max(1, nearest.BLOCK // len(use))
        for at in range(0, len(id_), step):
            to = slice(at, at + step)
            d = np.bitwise_count(hash_[to].view(np.uint64)[:, None] ^ hashes[None, :])
            d[d == unknown] = never
            d[:, missing], d[none[to]] = unknown, unknown
            if len(some):
                d[:, some] = np.where(fits(px[to][:, None], size[to][:, None], use[some][None, :]), d[:, some], never)
            found = np.minimum(np.searchsorted(a["image_id"], id_[to], sorter=a["by_id"]), len(a["by_id"]) - 1)
            own = a["by_id"][found]
            spot = np.minimum(np.searchsorted(use, own), len(use) - 1)
            same = (a["image_id"][own] == id_[to]) & (use[spot] == own)
            d[np.flatnonzero(same), spot[same]] = never
            row, place = nearest.first_places(d, unknown, k)
            if len(row):
                of, far = pa.array(use[place]), d[row, place].astype(np.int32)
                far[far == unknown] = UNKNOWN
                yield pa.record_batch([part.column("component").take(pa.array(row + at)), pa.array(id_[to][row]), pa.array(a["image_id"][use[place]]), pa.array(far), *(a["rows"][c].take(of).combine_chunks() for c in ("px", "file_size", "relative_path"))], names=BEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, anchors = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("component", "i", "j")])
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if b == e:
                    continue
                if at is None or (key[:, b] != at).any():
                    at, parts, anchors = key[:, b], [], None
                mid = b + int(np.searchsorted(side[b:e], 1))
                if mid > b:
                    parts.append(batch.slice(b, mid - b))
                if e > mid and parts:
                    anchors = looked_at(pa.Table.from_batches(parts)) if anchors is None else anchors
                    for start in range(mid, e, ROWS):
                        yield from best(anchors, batch.slice(start, min(ROWS, e - start)))

    return run


def automatic_originals(members: DataFrame, threshold: float = 0.985, pixels: float = 0.9, shape: float = 0.02) -> DataFrame:
    """Adds is_original: the representative or reference, or large, of the best member's shape, and similar enough."""
    px, own = measures.pixels(F.col("width"), F.col("height")), measures.aspect(F.col("width"), F.col("height"))
    members = materialise(members, "members")  # read twice
    x = members.join(members.groupBy("component").agg(F.max(px).alias("most_px"), F.min_by(own, own_quality()).alias("best_aspect")), "component")
    fits = (px >= F.col("most_px") * pixels) & (F.abs(own - F.col("best_aspect")) / F.col("best_aspect") <= shape) & (F.col("score").isNull() | (F.col("score") >= threshold))
    return x.withColumn("is_original", (F.col("image_id") == F.col("reference_id")) | (F.col("member_role") == "reference") | fits)


def choose_originals(members: DataFrame, manual_originals: DataFrame, manual_thumbnails: DataFrame) -> DataFrame:
    """Originals of each group with their source: manual, auto, or the best member where none is left."""
    x = members.join(manual_originals.select("image_id", F.lit(True).alias("mo")), "image_id", "left").join(manual_thumbnails.select("image_id", F.lit(True).alias("mt")), "image_id", "left")
    x = x.withColumn("chosen", F.col("mt").isNull() & (F.col("mo").isNotNull() | F.col("is_original")))
    x = x.join(x.groupBy("component").agg(F.bool_or("chosen").alias("any_chosen"), F.min_by("image_id", own_quality()).alias("best_id")), "component")
    source = F.when(F.col("chosen") & F.col("mo").isNotNull(), "manual").when(F.col("chosen"), "auto").when(~F.col("any_chosen") & (F.col("image_id") == F.col("best_id")), "fallback")
    return x.withColumn("source", source).drop("mo", "mt", "chosen", "any_chosen", "best_id")


def assign_thumbnails(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Each member that is no original gets one: the best cross score (a tie goes to the better image), else its stored
    reference, else the reference of its path, else the best original. Similarity: cross score, else the stored one.

    ``members``: component, image_id, source, effective_reference_id, reference_path, score and the quality columns.
    ``scores``: left_id, right_id, score of unordered pairs. Each way is a lookup of its own that finds at most one original
    for a member, so members and originals of a large group never multiply.
    """
    rank = best_first(F.col("o_px"), F.col("o_size"), F.col("o_path"), F.col("o_id"))
    members, scores = materialise(members, "members"), materialise(scores, "scores")  # read for each way
    o = members.filter("source is not null").select("component", F.col("image_id").alias("o_id"), measures.pixels(F.col("width"), F.col("height")).alias("o_px"), F.col("file_size").alias("o_size"), F.col("relative_path").alias("o_path"))
    o = o.select("component", "o_id", "o_path", rank.alias("rank"))
    m = members.filter("source is null").select("component", "image_id", "relative_path", "score", "effective_reference_id", "reference_path")
    s = scores.filter("score is not null").select(F.col("left_id").alias("image_id"), F.col("right_id").alias("o_id"), F.col("score").alias("cross"))
    s = s.unionByName(s.select(F.col("o_id").alias("image_id"), F.col("image_id").alias("o_id"), "cross"))
    crossed = s.join(m.select("component", "image_id"), "image_id").join(o, ["component", "o_id"])
    crossed = crossed.groupBy("image_id").agg(F.min_by(F.struct("o_id", "cross"), F.struct(-F.col("cross"), "rank")).alias("scored"))
    referred = o.select("component", F.col("o_id").alias("effective_reference_id"), F.col("o_id").alias("referred"))
    named = o.groupBy("component", F.col("o_path").alias("reference_path")).agg(F.min_by("o_id", "rank").alias("named"))
    best = o.groupBy("component").agg(F.min_by("o_id", "rank").alias("best"))
    x = m.join(crossed, "image_id", "left").join(referred, ["component", "effective_reference_id"], "left").join(named, ["component", "reference_path"], "left").join(best, "component")
    way = F.when(F.col("scored").isNotNull(), 0).when(F.col("referred").isNotNull(), 1).when(F.col("named").isNotNull(), 2).otherwise(3)
    x = x.withColumn("way", way).withColumn("cross", F.col("scored.cross")).withColumn("o_id", F.coalesce("scored.o_id", "referred", "named", "best"))
    stored = F.when(F.col("o_id") == F.col("effective_reference_id"), F.col("score"))
    out = x.withColumn("similarity", F.coalesce("cross", stored))
    out = stats.numbered_within(out, ["o_id"], F.coalesce("similarity", F.lit(0.0)).desc(), "relative_path", name="place")
    return out.select("component", "image_id", F.col("o_id").alias("original_id"), "way", "similarity", "place")


def merge_groups(members: DataFrame, merges: DataFrame) -> DataFrame:
    """Members under user merges. ``merges``: merge_id, group_index. Merged groups sort where their first source stood.

    Returns members with group_index (new, 1-based), merged, and the representative chosen anew by quality.
    """
    x = members.join(merges, "group_index", "left").withColumn("merged", F.col("merge_id").isNotNull())
    key = F.when(F.col("merged"), F.concat(F.lit("m"), F.col("merge_id").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("group_index").cast("string")))
    x = x.withColumn("display", key)
    firsts = x.groupBy("display").agg(F.min("group_index").alias("first_source"))
    places = stats.numbered(firsts, "first_source", "display", name="new_index").select("display", "new_index")
    best = x.groupBy("display").agg(F.min_by("image_id", own_quality()).alias("representative_id"))
    return x.join(places, "display").join(best, "display")


def backfill_order(groups_: DataFrame, after: list[int]) -> DataFrame:
    """Order in which the remaining groups are scored: those after the current one, then from the start; singletons
    and, if it is the only one, the current group are left out."""
    last = max(after, default=0)
    x = groups_.filter("n >= 2")
    if len(set(after)) == 1:
        x = x.filter(F.col("group_index") != last)
    return stats.numbered(x, F.when(F.col("group_index") > last, 0).otherwise(1), "group_index")


def signatures(members: DataFrame) -> DataFrame:
    """(component, group_index, n, signature) of groups: two sums of the members' hashes over id, content digest, size and
    time, so the order has no say and no group is gathered. Null where a member's file is gone (its size is null)."""
    own = ("image_id", "digest", "file_size", "mtime")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *own).cast("decimal(20,0)")).cast("string")
    whole = F.when(F.count_if(F.col("file_size").isNull()) == 0, F.concat_ws(":", F.count("*").cast("string"), total(1), total(2)))
    return members.groupBy("component", "group_index").agg(F.count("*").alias("n"), whole.alias("signature"))


def group_statuses(signed: DataFrame, scored: DataFrame, running: int | None = None) -> DataFrame:
    """Adds the status: groups of one and groups whose signature is among the scored are completed, then the running one,
    all others are pending."""
    x = signed.join(scored.select("signature").distinct().withColumn("_known", F.lit(True)), "signature", "left")
    status = F.when((F.col("n") < 2) | F.col("_known"), "completed").when(F.col("group_index") == F.lit(running), "running").otherwise("pending")
    return x.select(*signed.columns, status.alias("status"))
