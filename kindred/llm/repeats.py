"""Windows that repeat across a corpus, found through winnowed anchors.

Units are words or bytes, a window is ``width`` consecutive units of one document. Each window has one anchor: the
least-hashed ``gram`` inside it, the leftmost on a tie. It depends on the window's content alone, so equal windows
have equal anchors at equal places. Neighbouring windows mostly share an anchor and form a run; only runs travel:

1. Each task sends one row a run: anchor, hash of the run's whole span, document, place. Runs with equal anchor and
   span contain equal windows, so all but the earliest are covered. That is settled in the task for the runs it holds;
   of an anchor with one span it sends one row, and of an anchor with several it sends one note that says so. No
   anchor, however common, gets more than a few rows from a task.
2. Rows of one anchor meet. All but the earliest of a span are covered. If the anchor has several spans, the earliest
   of each go on, since parts of them may be equal: the ends of shared passages.
3. For these runs alone the documents are read again and their windows are compared one by one, in each task first and
   then by hash, again with at most one row a window and task.

Spans are compared among those with one anchor, by a hash of 64 bits; windows by two hashes with different bases, 128
bits. What comes out are covered ranges of window starts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import chunks_by_bytes, materialise, mix64, partitions, tidily, utf8

LOWEST = -(2**63)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD1342543DE82EF95)
SPACE = re.compile(rb"[ \t-\r]")
PLACE = 24  # bits of a place inside a slice
SLICE, HELD = 1 << 20, 1 << 20  # bytes of text in a slice; runs that a task holds before it sends
_powers: dict[int, list[np.ndarray]] = {}

Units = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # texts -> (a 64-bit value a unit, bounds of the texts)


def powers(n: int, base: np.uint64 = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and those of its inverse, modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 2**64))
        known = _powers[int(base)] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, x, np.uint64))]) for x in (base, inverse)]
    return known[0], known[1]


def prefix_hash(values: np.ndarray, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    """H with H[b] - H[a], times the inverse power of a, the hash of values[a:b]."""
    up, _ = powers(len(values), base)
    return np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])


def spans_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    _, down = powers(len(prefix), base)
    return mix64((prefix[b] - prefix[a]) * down[a])


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's 64-bit hash."""
    parts = [x.split() for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    coded = pa.array([w for x in parts for w in x], pa.binary()).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return (mix64(known)[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)), bounds


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def anchor_runs(values: np.ndarray, bounds: np.ndarray, width: int, gram: int, places: bool = False):
    """Arrays (text, first window's start in the text, windows, anchor hash, span hash), one entry a run; with ``places``
    also where in ``values`` the anchor is."""
    n, reach = len(values), width - gram + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    none += (np.zeros(0, np.int64),) * places
    if n < width:
        return none
    if n >= 1 << PLACE:
        raise ValueError("a slice is too long")
    prefix = prefix_hash(values)
    _, down = powers(n)
    grams = mix64((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    low = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < reach:  # least of ``have`` neighbours, doubled until it spans a window
        step = min(have, reach - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    sizes = np.diff(bounds)
    long = np.flatnonzero(sizes >= width)
    count = sizes[long] - width + 1
    if not len(long):
        return none
    text = np.repeat(long, count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[long], count)
    own = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(first, len(own)))
    s = start[first]
    return text[first], s - bounds[text[first]], windows, grams[own[first]], spans_hash(prefix, s, s + windows - 1 + width), *((own[first],) * places)


def slices(texts: list[bytes], width: int, units: Units):
    """(values, bounds, index of each text, its first unit) for slices of bounded size. A longer text goes in stretches
    that share ``width`` - 1 units, so that each window lies in exactly one of them."""
    for a, b in chunks_by_bytes(texts, SLICE):
        if b - a > 1 or len(texts[a]) <= 4 * SLICE:
            values, bounds = units(texts[a:b])
            yield values, bounds, np.arange(a, b), np.zeros(b - a, np.int64)
            continue
        kept, at = np.zeros(0, np.uint64), 0
        for part in cut_at_space(texts[a], 4 * SLICE):
            values = np.concatenate([kept, units([part])[0]])
            yield values, np.array([0, len(values)]), np.array([a]), np.array([at])
            kept = values[max(0, len(values) - width + 1) :]
            at += len(values) - len(kept)


def cut_at_space(text: bytes, most: int):
    """Parts of about ``most`` bytes that end before white space, or where a word is longer than that, after it."""
    at = 0
    while at < len(text):
        to = min(at + most, len(text))
        if to < len(text):
            space = SPACE.search(text, to)
            to = space.start() if space else len(text)
        yield text[at:to]
        at = to


class Runs:
    """Runs of one task, settled among themselves and handed on when there are many."""

    names = ("kind", "anchor", "span", "doc", "version", "start", "windows")
    types = (pa.int32(), *[pa.int64()] * 6)
    COVERED, ASKED, SENT = 0, 1, 2

    def __init__(self, across: bool):
        self.across, self.parts, self.n = across, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """anchor, span, doc, version, start, windows."""
        self.parts.append(columns)
        self.n += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        anchor, span, doc, version, start, windows = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((start, version, doc, span, anchor))
        anchor, span, doc, version, start, windows = (x[order] for x in (anchor, span, doc, version, start, windows))
        later, several = settle(anchor, span, (doc, version, start), self.across)
        note = np.flatnonzero(several & np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        covered = np.flatnonzero(later)
        if len(covered):
            ranges = joined_ranges(doc[covered], version[covered], start[covered], windows[covered])
            yield self.batch(self.COVERED, mix64(ranges[0].view(np.uint64)).view(np.int64), np.zeros(len(ranges[0]), np.int64), *ranges)
        ask = np.flatnonzero(several & ~later)
        yield self.batch(self.ASKED, span[ask], span[ask], doc[ask], version[ask], start[ask], windows[ask])
        zero = np.zeros(len(note), np.int64)
        yield self.batch(self.SENT, anchor[note], zero, zero, zero, zero, zero)
        send = np.flatnonzero(~several & ~later)
        yield self.batch(self.SENT, anchor[send], span[send], doc[send], version[send], start[send], windows[send])

    def batch(self, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        first = pa.array(np.full(len(columns[0]), kind, np.int32))
        return pa.record_batch([first, *(pa.array(np.ascontiguousarray(x)).cast(pa.int64()) for x in columns)], names=list(self.names))


RUNS = "kind int, anchor long, span long, doc long, version long, start long, windows long"


def settle(key: np.ndarray, part: np.ndarray, place: tuple[np.ndarray, ...], across: bool, notes: np.ndarray | None = None):
    """For rows sorted by key, part, place (doc, version, start): which repeat an earlier one of their (key, part), and
    which have a key with several parts. ``across``: only one
    in a smaller document counts. A note stands for further parts."""
    n = len(key)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_part = new_key | np.concatenate([[True], part[1:] != part[:-1]])
    first = np.maximum.accumulate(np.where(new_part, np.arange(n), 0))
    later = place[0] > place[0][first] if across else np.any([x != x[first] for x in place], axis=0)
    group = np.cumsum(new_key) - 1
    parts = np.bincount(group, weights=new_part)
    if notes is not None:
        parts = parts + np.bincount(group, weights=notes)
    return later, (parts > 1)[group]


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, version, text of each row, and of each distinct row. A null doc_id is the least. version is 0, or a hash of
    the text where the table has a doc_id twice: rows with equal doc_id and text then are one document, and each gets
    its result."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    twice = docs.groupBy(doc.alias("doc")).count().filter("count > 1").limit(1).count() > 0
    text = F.coalesce(F.col("text"), F.lit(""))
    version = F.xxhash64(text) if twice else F.lit(0).cast("long")
    rows = docs.select(doc.alias("doc"), version.alias("version"), text.alias("text"))
    return rows, rows.dropDuplicates(["doc", "version"]) if twice else rows


def joined_ranges(doc: np.ndarray, version: np.ndarray, start: np.ndarray, windows: np.ndarray):
    """The same window starts with neighbouring ranges of a document as one, sorted."""
    order = np.lexsort((start, version, doc))
    doc, version, start, windows = (x[order] for x in (doc, version, start, windows))
    if not len(doc):
        return doc, version, start, windows
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] != start[:-1] + windows[:-1])]))
    return doc[at], version[at], start[at], np.add.reduceat(windows, at)


def by_key(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches, regrouped so that no value of ``column`` is split."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        key = now[column]
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        held = {c: x[cut:] for c, x in now.items()}
        if cut:
            yield {c: x[:cut] for c, x in now.items()}
    if held is not None:
        yield held


def find_runs(docs: DataFrame, units: Units, width: int, gram: int, across: bool) -> DataFrame:
    """Steps 1 and 2: kind (covered or asked), doc, version, start, windows; a written table."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(across)
        for batch in batches:
            doc, version = batch.column("doc").to_numpy(), batch.column("version").to_numpy()
            for values, bounds, index, at in slices(utf8(batch.column("text")), width, units):
                text, start, windows, anchor, span = anchor_runs(values, bounds, width, gram)
                runs.add(anchor.view(np.int64), span.view(np.int64), doc[index[text]], version[index[text]], start + at[text], windows)
                if runs.n >= HELD:
                    yield from runs.flush()
        yield from runs.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_key(batches, "anchor"):
            known = x["kind"] != Runs.SENT
            real = ~known & (x["windows"] > 0)
            note = ~known & ~real
            later, several = settle(x["anchor"], x["span"], (x["doc"], x["version"], x["start"]), across, notes=note)
            kind = np.where(known, x["kind"], np.where(later, Runs.COVERED, Runs.ASKED))
            keep = known | (real & (later | several))
            yield pa.record_batch([pa.array(kind[keep].astype(np.int32)), *(pa.array(x[c][keep]) for c in ("doc", "version", "start", "windows"))], names=["kind", "doc", "version", "start", "windows"])

    sent = docs.select("doc", "version", "text").mapInArrow(tidily(send), RUNS)
    dealt = sent.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "span", "doc", "version", "start")
    return materialise(dealt.mapInArrow(tidily(meet), "kind int, doc long, version long, start long, windows long"), "runs")


def listed(ranges: DataFrame) -> DataFrame:
    """doc, version, ranges: all of a document's ranges (start, windows) in one array."""
    return ranges.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))


def window_starts(ranges) -> np.ndarray:
    """All window starts of a list of ranges, ascending and distinct."""
    if not len(ranges):
        return np.zeros(0, np.int64)
    start = np.array([r["start"] for r in ranges], np.int64)
    n = np.array([r["windows"] for r in ranges], np.int64)
    return np.unique(np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))


def compare_windows(docs: DataFrame, asked: DataFrame, units: Units, width: int, across: bool) -> DataFrame:
    """Step 3: covered windows of the asked runs (doc, version, start, windows); a written table."""
    names = ["key", "check", "doc", "version", "start", "windows"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            doc, version = batch.column("doc").to_numpy(), batch.column("version").to_numpy()
            asked_of = [window_starts(r) for r in batch.column("ranges").to_pylist()]
            for values, bounds, index, at in slices(utf8(batch.column("text")), width, units):
                own = [asked_of[i][slice(*np.searchsorted(asked_of[i], [x, x + max(0, n_units - width + 1)]))] - x for i, x, n_units in zip(index, at, np.diff(bounds), strict=True)]
                of = np.repeat(np.arange(len(index)), [len(s) for s in own])
                s = np.concatenate(own)
                a = s + bounds[of]
                key = spans_hash(prefix_hash(values), a, a + width)
                check = spans_hash(prefix_hash(mix64(values), SECOND), a, a + width, SECOND)
                held.append((key.view(np.int64), check.view(np.int64), doc[index[of]], version[index[of]], s + at[of]))
                n += len(s)
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held) -> Iterator[pa.RecordBatch]:
        key, check, doc, version, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, version, doc, check, key))
        key, check, doc, version, start = (x[order] for x in (key, check, doc, version, start))
        later, _ = settle(key, check, (doc, version, start), across)
        yield batch(*(x[~later] for x in (key, check, doc, version, start)), np.zeros(int((~later).sum()), np.int64))
        if later.any():  # neighbours as one range, under a key that spreads them
            doc, version, start, n = joined_ranges(doc[later], version[later], start[later], np.ones(int(later.sum()), np.int64))
            yield batch(mix64(doc.view(np.uint64) ^ start.view(np.uint64)).view(np.int64), np.zeros(len(doc), np.int64), doc, version, start, n)

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in columns], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_key(batches, "key"):
            known = x["windows"] > 0
            open_ = np.flatnonzero(~known)
            later, _ = settle(x["key"][open_], x["check"][open_], tuple(x[c][open_] for c in ("doc", "version", "start")), across)
            keep = known.copy()
            keep[open_[later]] = True
            yield pa.record_batch([*(pa.array(x[c][keep]) for c in ("doc", "version", "start")), pa.array(np.maximum(x["windows"][keep], 1))], names=["doc", "version", "start", "windows"])

    needed = docs.select("doc", "version", "text").join(listed(asked), ["doc", "version"])
    found = needed.mapInArrow(tidily(windows), ", ".join(f"{c} long" for c in names))
    dealt = found.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "check", "doc", "version", "start")
    return materialise(dealt.mapInArrow(tidily(meet), "doc long, version long, start long, windows long"), "windows")


def covered_ranges(docs: DataFrame, units: Units, width: int, gram: int, across: bool) -> DataFrame:
    """doc, version, ranges of covered window starts, for the documents that have any; ``docs`` has no row twice."""
    runs = find_runs(docs, units, width, gram, across)
    asked = runs.filter(F.col("kind") == Runs.ASKED).select("doc", "version", "start", "windows")
    ends = compare_windows(docs, asked, units, width, across)
    return listed(runs.filter(F.col("kind") == Runs.COVERED).select("doc", "version", "start", "windows").unionByName(ends))


def covered_units(ranges, width: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    if ranges:
        start = np.array([r["start"] for r in ranges], np.int64)
        end = start + np.array([r["windows"] for r in ranges], np.int64) - 1 + width
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
    return np.cumsum(edge)[:n] > 0
