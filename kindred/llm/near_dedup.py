"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets its Hamming distances to ``PIVOTS`` reference fingerprints once. Two fingerprints whose
distances to any pivot differ by more than the radius cannot be within it: such pairs are discarded, and only survivors
are compared.

``near_duplicates`` links fingerprints at a radius of two. They meet where they agree on two of four 16-bit blocks (two
bits leave two blocks untouched, so no link is lost). A group of more than ``MOST`` is dealt out by the bands of one
pivot distance after the other, each a little wider than the radius, so that pairs within it still meet. A group gives
at most one edge a member (to the least fingerprint it reaches there), never all its pairs. Components come from
alternating large-star and small-star steps.

``drop_near_duplicates`` removes copies whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Their fingerprints differ in about ten bits, too many for blocks, so texts meet where ``ROWS`` least hashes agree in
one of ``BANDS`` bands (0.998 of the pairs at 0.8, more above); pivots and fingerprints discard, and survivors are verified
on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialise, mix64, partitions, tidily, utf8
from kindred.llm.repeats import MULTIPLIER, SLICE, word_units
from kindred.llm.tokens import text_slices
from kindred.operators.graph import roots
from kindred.operators.stats import numbered
from kindred.scratch import discard

RADIUS, SHINGLE, SEED, PIVOTS = 2, 3, 42, 16
MOST = 4096  # fingerprints or texts of one key that are compared together
WIDE_SHINGLE, SIMILARITY, WIDE_RADIUS, BANDS, ROWS = 5, 0.8, 20, 20, 6
WIDE_MOST = 512  # texts of one band that are compared in one task
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Reference fingerprints: scrambled counting numbers.
PIVOT_VALUES = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def simhash(text: bytes) -> int:
    """64 bits; bit i is set if more than half of the shingles' hashes have it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(x + 1 for x in ends)]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)], dtype=np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` has row (any struct) and text; gives row and fp (the fingerprint's bits as a signed long). Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(map(simhash, utf8(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("row"), pa.array(fp.view(np.int64))], names=["row", "fp"])

    return rows.mapInArrow(tidily(run), f"row {rows.schema['row'].dataType.simpleString()}, fp long")


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least index that each of ``n`` items reaches over the links a-b.

    Only roots are hooked, and labels are roots whenever links are looked at, so a link whose ends agree stays settled.
    """
    label = _compressed(np.arange(n) if label is None else label)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _compressed(label)
    return label


def _compressed(label: np.ndarray) -> np.ndarray:
    while True:
        next_ = label[label]
        if (next_ == label).all():
            return next_
        label = next_


def pivot_distances(fp: Column) -> list[Column]:
    """The distances to all pivots, a byte each, in as many longs as they need."""
    far = [F.bit_count(fp.bitwiseXOR(F.lit(int(v)))).cast("long") for v in PIVOT_VALUES.view(np.int64)]
    return [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(d, 8 * i) for i, d in enumerate(far[at : at + 8])]).alias(f"pivots{at // 8}") for at in range(0, PIVOTS, 8)]


TABLE = [f"pivots{i}" for i in range(PIVOTS // 8)]


def pivot_distance(i: int) -> Column:
    return F.shiftrightunsigned(TABLE[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(0xFF))


def _table(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack(columns, axis=1).astype(np.int64).view(np.int8).reshape(-1, PIVOTS)


def _within(fp, table, a, b, radius: int):
    """The pairs a-b within the radius: discarded by the pivots first, verified then."""
    for j in range(0, PIVOTS, 4):
        keep = np.abs(table[a, j : j + 4] - table[b, j : j + 4]).max(1, initial=0) <= radius
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    return a[keep], b[keep]


def link_sorted(key: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int = RADIUS, wide: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member it reaches) of every run of equal keys. ``table`` has the pivot distances. Runs of up to ``wide`` are compared by
    offset, all at once; longer ones in the order of the first pivot's distance, in blocks of bounded memory."""
    n = len(key)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    of = np.repeat(np.arange(len(begins)), sizes)
    label = np.arange(n)
    left, right = [], []
    small = sizes[of] <= wide if n else np.zeros(0, bool)
    i = np.flatnonzero(small & (sizes[of] > 1)) if n else np.zeros(0, np.int64)
    for d in range(1, wide):
        i = i[i + d < n]
        i = i[of[i + d] == of[i]]
        if not len(i):
            break
        a, b = _within(fp, table, i, i + d, radius)
        left.append(a)
        right.append(b)
    if left:
        label = _labels(n, np.concatenate(left), np.concatenate(right), label)
    for g in np.flatnonzero(sizes > wide).tolist():
        own = np.arange(begins[g], begins[g] + sizes[g])
        own = own[np.argsort(table[own, 0], kind="stable")]
        first = table[own, 0]
        until = np.searchsorted(first, first + radius, "right")
        for at in range(0, len(own), 256):
            to = min(at + 256, len(own))
            rows = np.arange(at, to)
            count = until[rows] - rows - 1
            a = np.repeat(rows, count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1
            a, b = _within(fp, table, own[a], own[b], radius)
            if len(a):
                label = _labels(n, a, b, label)
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def dealt_by_pivots(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """``rows`` (key, fp, pivots) with the keys of more than ``most`` rows cut into bands of pivot distances.

    A band is one wider than the radius and a row enters the bands of its distance and of its distance plus the radius, so rows
    that differ by the radius at most share one. Keys that are still large after that are cut by the next pivot.
    """
    done = None
    for i in range(PIVOTS):
        large = materialise(rows.groupBy("key").count().filter(F.col("count") > most).select("key"), "large")
        if not large.count():
            break
        large = small(large)
        rest = rows.join(large, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        band = F.explode(F.array_distinct(F.array(*(F.floor((pivot_distance(i) + x) / (radius + 1)) for x in (0, radius))))).alias("band")
        cut = rows.join(large, "key", "left_semi").select("key", "fp", *TABLE, band)
        rows = materialise(cut.select(F.xxhash64("key", F.lit(i), "band").alias("key"), "fp", *TABLE), "bands")
    return rows if done is None else done.select("key", "fp", *TABLE).unionByName(rows)


def by_whole_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, regrouped so that no key is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("key").to_numpy()
        if held and values[0] != held[-1].column("key")[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (a, b), a != b, over distinct fingerprints ``fp`` that connect exactly what pairs within the radius connect."""
    if radius > 2:
        raise ValueError("four blocks serve a radius of two at most")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*(F.lit(t << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for t, (i, j) in enumerate(pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_whole_key(batches):
            a, b = link_sorted(x["key"].to_numpy(), x["fp"].to_numpy().view(np.uint64), _table([x[c].to_numpy() for c in TABLE]), radius)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    known = materialise(distinct.select("fp", *pivot_distances(F.col("fp"))), "pivots")
    rows = dealt_by_pivots(known.select(F.explode(keys).alias("key"), "fp", *TABLE), radius, most)
    dealt = rows.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidily(run), "a long, b long")


def components(written: DataFrame, least: str = "row.doc_id") -> DataFrame:
    """``written`` (row, fp) with ``head``: the least value of ``least`` (nulls last) over all rows that links reach."""
    classes = materialise(written.groupBy("fp").agg(F.min(least).alias("head")), "classes")
    found = roots(links(classes.select("fp")))
    rooted = classes.join(found, classes["fp"] == found["v"], "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    heads = rooted.join(rooted.groupBy("root").agg(F.min("head").alias("least")), "root").select("fp", F.col("least").alias("head"))
    return written.join(heads, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Null and word-less texts have fingerprint zero and are linked like any other. Repeated rows fall into one
    component. A null doc_id never becomes a component_id unless the component has no other. Empty tables give none.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text"))
    found = components(materialise(fingerprints(rows), "fingerprints"))
    return found.select("row.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("head").alias("component_id"))


def shingle_sets(texts: list[bytes], k: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each text's distinct shingles of ``k`` lower-cased words, ascending; bounds of the texts). Fewer
    words are one shingle, no words none."""
    values, bounds = word_units([x.translate(LOWER) for x in texts])
    n = np.diff(bounds)
    starts = len(values) - k + 1
    h = np.zeros(max(starts, 0), np.uint64)
    for j in range(k):
        h = h * MULTIPLIER + values[j : j + len(h)]
    owner = np.repeat(np.arange(len(texts)), n)
    inside = np.flatnonzero(owner[: len(h)] == owner[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    own = []
    for i in short.tolist():
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for v in values[bounds[i] : bounds[i + 1]]:
                x = x * MULTIPLIER + v
        own.append(x)
    h = mix64(np.concatenate([h[inside], np.array(own, np.uint64)]))
    owner = np.concatenate([owner[inside], short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    h, owner = h[fresh], owner[fresh]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


_MIX = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketches(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of hashes: SimHash fingerprint, two hashes of the whole set, and a key for each band of least hashes."""
    n = len(bounds) - 1
    fp, same, bands = np.zeros(n, np.uint64), np.zeros((n, 2), np.uint64), np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[full]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        fp[full] = np.packbits(2 * total > np.diff(bounds)[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        for i in range(2):
            same[full, i] = np.add.reduceat(mix64(h ^ _MIX[i]), at)
        for b in range(BANDS):
            key = np.full(len(full), _MIX[b], np.uint64)
            for r in range(ROWS):
                j = 2 * (b * ROWS + r)
                key = mix64(key ^ np.minimum.reduceat((h ^ _MIX[j]) * (_MIX[j + 1] | np.uint64(1)), at))
            bands[full, b] = key
    return fp, same, bands


def verified(fp: np.ndarray, table: np.ndarray, h: np.ndarray, bounds: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """For the texts of one key: the least index that each is linked to, over pairs of at least ``similarity``. Pairs
    that are linked already are not looked at again, so a group of copies takes one comparison a member."""
    n = len(fp)
    label, size = np.arange(n), np.diff(bounds)
    for i in range(n - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[(np.abs(table[j].astype(np.int16) - table[i]).max(1, initial=0) <= radius)]
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= radius]
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])]
        for x in j.tolist():
            if label[x] != label[i]:
                both = len(np.intersect1d(h[bounds[i] : bounds[i + 1]], h[bounds[x] : bounds[x + 1]], assume_unique=True))
                if both >= similarity * (size[i] + size[x] - both):
                    low, high = sorted((label[i], label[x]))
                    label[label == high] = low
    return label


def small(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few longs a row, to be broadcast if it has ``most`` rows at most (8 MB) and joined otherwise."""
    return F.broadcast(table) if table.count() <= most else table


HELD, PASSING = 1024, 16_384  # texts of a large key that a task holds, and that pass by them


def nearby(fp: np.ndarray, table: np.ndarray, size: np.ndarray, one: tuple, similarity: float, radius: int) -> np.ndarray:
    """Which texts can be similar to the text ``one`` (fp, pivot distances, size)."""
    keep = np.bitwise_count(fp ^ one[0]) <= radius
    keep &= np.abs(table.astype(np.int16) - one[1]).max(1, initial=0) <= radius
    return keep & (np.minimum(size, one[2]) >= similarity * np.maximum(size, one[2]))


def cross_links(similarity: float, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges between texts with different labels, of rows sorted by cell (key, i, j) and side: side 0 is held, side 1 passes by. Labels that
    an edge joins are one from then on."""

    def columns(t):
        t = pa.Table.from_batches(t).combine_chunks()
        sets = t["shingles"].combine_chunks()
        h, bounds = sets.flatten().to_numpy().view(np.uint64), sets.offsets.to_numpy().astype(np.int64)
        return t["id"].to_numpy(), t["label"].to_numpy().copy(), t["fp"].to_numpy().view(np.uint64), _table([t[c].to_numpy() for c in TABLE]), h, bounds - bounds[0]

    def met(held, passing) -> Iterator[pa.RecordBatch]:
        id_, label, fp, table, h, bounds = held
        size, left, right = np.diff(bounds), [], []
        ids, labels, fps, tables, hs, at = columns([passing])
        for p in range(len(ids)):
            own = hs[at[p] : at[p + 1]]
            name = joined.get(labels[p], labels[p])
            open_ = np.flatnonzero((label != name) & nearby(fp, table, size, (fps[p], tables[p], len(own)), similarity, radius))
            for x in open_.tolist():
                if label[x] == name:
                    continue
                both = len(np.intersect1d(h[bounds[x] : bounds[x + 1]], own, assume_unique=True))
                if both >= similarity * (size[x] + len(own) - both):
                    left.append(ids[p])
                    right.append(id_[x])
                    old, name = max(label[x], name), min(label[x], name)
                    label[label == old] = name
                    for k in [k for k, v in joined.items() if v == old]:
                        joined[k] = name
                    joined[old] = name
        if left:
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal joined
        cell, parts, held = None, [], None
        for batch in batches:
            key, side = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")]), batch.column("side").to_numpy()
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if b == e:
                    continue
                if cell is None or (key[:, b] != cell).any():
                    cell, parts, held, joined = key[:, b], [], None, {}
                mid = b + int(np.searchsorted(side[b:e], 1))
                if mid > b:
                    parts.append(batch.slice(b, mid - b))
                if e > mid and parts:
                    held = columns(parts) if held is None else held
                    yield from met(held, batch.slice(mid, e - mid))

    joined: dict[int, int] = {}
    return run


def similar_links(classes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, most: int = WIDE_MOST) -> DataFrame:
    """Edges (a, b) between ids of ``classes`` (id, at, fp, bands) that connect what similar shingle sets of one key connect;
    ``texts`` has at and text. The edges' components are the same for any ``most``.

    Keys that hold the same texts count once. The texts of a key with at most ``most`` are compared in one task. In a
    larger one each text is compared with the key's least first. Where that leaves texts in different
    components (by all links found so far, under any key), those outside of the largest are held, in lines of bounded size, while all
    texts of the key pass by: every pair with different components is looked at. A heap of near copies of any size has one component and costs one
    comparison a text.
    """
    spark = classes.sparkSession
    pairs = classes.select("id", F.explode("bands").alias("key"))
    keys = pairs.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("all"), F.min("id").alias("least")).filter("n > 1")
    once = materialise(keys.groupBy("n", "all", "least").agg(F.min("key").alias("key")).select("key", "n", "least"), "keys")
    members = materialise(pairs.join(small(once.select("key")), "key", "left_semi"), "members")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in text_slices(whole, most=SLICE):
                h, bounds = shingle_sets(utf8(part.column("text")))
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))], names=["id", "shingles"])

    ids = materialise(members.select("id").distinct().join(classes.select("id", "at"), "id"), "ids")
    wanted = texts.join(small(ids, 500_000), "at").select("id", "text")
    sets = wanted.mapInArrow(tidily(measure), "id long, shingles array<long>").join(classes.select("id", "fp", *pivot_distances(F.col("fp"))), "id")
    sets = materialise(sets, "sets")
    discard(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_whole_key(batches):
            x = x.combine_chunks()
            key, id_, fp = x["key"].to_numpy(), x["id"].to_numpy(), x["fp"].to_numpy().view(np.uint64)
            table, sets_of = _table([x[c].to_numpy() for c in TABLE]), x["shingles"].combine_chunks()
            bounds, h = sets_of.offsets.to_numpy().astype(np.int64), sets_of.values.to_numpy().view(np.uint64)
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=True):
                label = verified(fp[b:e], table[b:e], h, bounds[b : e + 1], similarity, radius)
                moved = np.flatnonzero(label != np.arange(e - b))
                if len(moved):
                    yield pa.record_batch([pa.array(id_[b:e][moved]), pa.array(id_[b:e][label[moved]])], names=["a", "b"])

    large = materialise(once.filter(F.col("n") > most), "large")
    any_large = not large.isEmpty()
    low = members.join(small(large.select("key")), "key", "left_anti") if any_large else members
    dealt = low.join(sets, "id").select("key", "id", "fp", *TABLE, "shingles").repartition(partitions(spark), "key").sortWithinPartitions("key", "id")
    edges = materialise(dealt.mapInArrow(tidily(run), "a long, b long"), "links")
    if not any_large:
        return edges
    # every text of a large key with the key's least one; near copies mostly ask for the same one, which counts once
    high = members.join(small(large, 300_000), "key")
    asked = high.filter("id <> least").select("id", "least").distinct()
    first = sets.select(F.col("id").alias("least"), F.col("shingles").alias("theirs")).join(large.select("least").distinct(), "least")
    both = F.size(F.array_intersect("shingles", "theirs"))
    near = both >= similarity * (F.size("shingles") + F.size("theirs") - both)
    led = asked.join(sets.select("id", "shingles"), "id").join(first, "least").filter(near)
    edges = edges.unionByName(materialise(led.select(F.col("id").alias("a"), F.col("least").alias("b")), "links"))
    return edges.unionByName(_links_in_large(high, sets, materialise(roots(edges), "labels"), similarity, radius))


def _links_in_large(high: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Edges between the components (``labels``: v, root) that meet in a large key; ``high``: key, n, id."""
    x = high.select("key", "id").join(labels, F.col("id") == F.col("v"), "left").select("key", "id", F.coalesce("root", "id").alias("label"))
    x = materialise(x, "labelled")
    per = x.groupBy("key", "label").agg(F.count("*").alias("n"))
    top = per.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("label")).alias("label"))).alias("top"))
    top = top.select("key", (-F.col("top.label")).alias("top"), F.ceil((F.col("n") - F.col("top.n")) / HELD).alias("h_lines"), F.ceil(F.col("n") / PASSING).alias("p_lines"))
    x = x.join(small(materialise(top.filter("h_lines > 0"), "open"), 200_000), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    held = x.filter("label <> top").select("key", own("h_lines", 1).alias("i"), every("p_lines").alias("j"), F.lit(0).alias("side"), "id", "label")
    passing = x.select("key", every("h_lines").alias("i"), own("p_lines", 2).alias("j"), F.lit(1).alias("side"), "id", "label")
    dealt = held.unionByName(passing).join(sets, "id").select("key", "i", "j", "side", "id", "label", "fp", *TABLE, "shingles")
    dealt = dealt.repartition(partitions(high.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
    return dealt.mapInArrow(tidily(cross_links(similarity, radius)), "a long, b long")


def drop_near_duplicates(docs: DataFrame, most: int = WIDE_MOST) -> DataFrame:
    """One row of each component of near copies stays: the one with the least doc_id (nulls last), a repeated one once.

    Two texts are near copies if their sets of five-word shingles (lower-cased; fewer words are one shingle) have a
    Jaccard similarity of 0.8 or more. Null and word-less texts have no shingles and are copies of one another. All columns of
    ``docs`` come through, whatever their names; exact copies form one class before anything is compared.

    What stays depends on the rows' content alone: classes are numbered in the order of their hashes, and of rows with one doc_id that with
    the least hash of its text and its other columns stays. How the rows are laid out has no say.
    """
    rest = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")), {"ignoreNullFields": "false"}))
    row = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("id"), F.xxhash64("text").alias("h0"), rest.alias("h1"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in text_slices(whole, most=SLICE):
                fp, same, bands = sketches(*shingle_sets(utf8(part.column("text"))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
                yield pa.record_batch([*(part.column(c) for c in ("row", "id", "h0", "h1")), pa.array(fp.view(np.int64)), *(pa.array(np.ascontiguousarray(same[:, i]).view(np.int64)) for i in range(2)), lists], names=["row", "id", "h0", "h1", "fp", "same0", "same1", "bands"])

    kind = row.schema["row"].dataType.simpleString()
    written = materialise(row.mapInArrow(tidily(sketch), f"row {kind}, id long, h0 long, h1 long, fp long, same0 long, same1 long, bands array<long>"), "sketches")
    # id, a row's place in the written table, only tells apart rows that are equal in all else
    order = F.struct(F.col("row.doc_id").isNull().alias("unknown"), F.col("row.doc_id").alias("doc_id"), "h0", "h1", "id")
    slim = written.select(order.alias("order"), "id", "fp", "same0", "same1")
    heads = slim.groupBy("same0", "same1").agg(F.min("order").alias("head"))
    heads = numbered(heads, "same0", "same1", name="id", few=0).select("id", "head", F.col("head.id").alias("at"))
    classes = materialise(heads.join(written.select(F.col("id").alias("at"), "fp", "bands"), "at"), "classes")
    texts = written.select(F.col("id").alias("at"), F.coalesce("row.text", F.lit("")).alias("text"))
    found = roots(similar_links(classes.select("id", "at", "fp", "bands"), texts, most=most))
    rooted = classes.select("id", "head").join(found, F.col("id") == F.col("v"), "left")
    stays = rooted.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("head").alias("head")).select(F.col("head.id").alias("id"))
    goes = materialise(written.select("id").join(stays, "id", "left_anti"), "goes")
    return written.join(small(goes), "id", "left_anti").select("row.*")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
