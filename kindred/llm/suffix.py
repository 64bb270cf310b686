"""Removal of long repeated byte strings by bucket-pointer refinement.

A suffix array over the whole corpus would need eight bytes or more for every byte. Here winnowed anchors (32-byte
grams, the least of each window; see ``repeats``) only choose which suffixes enter, and buckets decide:

1. An anchor that occurs once in the corpus cannot lie in a repeated string. Each task sends one row for an anchor that
   it has once and one note for an anchor that it has more often; windows around anchors that occur again go on.
2. The suffixes at those windows are bucketed slice by slice: the initial buckets are the 8-byte grams; a bucket is
   refined by the bucket identifiers at a later offset, and the identifiers that come of it are reused for the next
   refinement, at twice the depth, until all windows of a bucket agree in ``width`` bytes. The first of a bucket goes
   on, the others are covered. What goes on carries its bytes.
3. Across slices, stretches of windows meet under their anchor, the initial bucket, and are refined there in the same
   way, on the bytes themselves; no hash decides. An initial bucket of more than ``MOST`` stretches is first dealt out
   by longer grams (all bytes that its windows of near offsets share), again and again down to single windows, where a
   bucket holds only equal strings, of which a task sends one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import chunks_by_bytes, materialise, mix64, partitions, tidily, utf8
from kindred.llm.repeats import BYTE_VALUES, LOWEST, SLICE, anchor_runs, by_key, covered_units, joined_ranges, keyed, listed

WIDTH, GRAM, BUCKET = 100, 32, 8
STRETCH = 4 * SLICE  # a longer text goes in stretches
HELD, HELD_ROWS = 1 << 20, 1 << 18  # runs, and stretches of windows, that a task holds before it sends
MOST = 4096  # stretches of one initial bucket that are refined together
FINER = 4  # each time a bucket is dealt out anew, into so many times more offsets
COVERED, ASKED, SENT = 0, 1, 2


def refine(buckets: np.ndarray, offset: int) -> np.ndarray:
    """Bucket identifiers ``offset`` deeper: each bucket with several members is sorted on the members' bucket pointers
    ``offset`` later and split; a bucket with one member is final and is not sorted again. Order is kept."""
    a, b = buckets[:-offset], buckets[offset:]
    members = np.bincount(a)
    open_ = np.flatnonzero(members[a] > 1)
    parts, of = np.unique(a[open_].astype(np.uint64) << np.uint64(32) | b[open_].astype(np.uint64), return_inverse=True)
    owner = (parts >> np.uint64(32)).astype(np.int64)
    splits = np.minimum(members, 1) + np.bincount(owner, minlength=len(members)) - (members > 1)
    ids = (np.cumsum(splits) - splits)[a]
    ids[open_] += of - np.searchsorted(owner, owner)[of]
    return ids


def rank_suffixes(data: np.ndarray, depth: int, bucket: int = BUCKET) -> np.ndarray:
    """For every place with ``depth`` bytes left: the rank of the string of ``depth`` bytes there; equal strings tie."""
    if len(data) < depth:
        return np.zeros(0, np.int64)
    have = min(bucket, depth)
    packed = np.zeros(len(data) - have + 1, np.uint64)
    for j in range(have):
        packed = packed << np.uint64(8) | data[j : j + len(packed)].astype(np.uint64)
    _, ids = np.unique(packed, return_inverse=True)
    while have < depth:
        step = min(have, depth - have)
        ids = refine(ids, step)
        have += step
    return ids


def first_of_buckets(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of ascending window starts in ``data``: which are the first of their bucket at depth ``width``."""
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts] += 1
    inside[starts + width] -= 1
    used = np.cumsum(inside)[:-1] > 0
    place = np.cumsum(used) - 1  # stretches move together; each window stays whole
    own = rank_suffixes(data[used], width)[place[starts]]
    first = np.empty(int(own.max()) + 1 if len(own) else 0, np.int64)
    first[own[::-1]] = np.arange(len(own))[::-1]
    out = np.zeros(len(starts), bool)
    out[first[own]] = True
    return out


def pieces(doc: np.ndarray, version: np.ndarray, texts: list[bytes], width: int):
    """(bytes, bounds, index of each text, its first byte) of bounded size, texts in the order of (doc, version). A
    longer text goes in stretches that share ``width`` - 1 bytes, so that each window lies in exactly one of them."""
    order = np.lexsort((version, doc))
    texts = [texts[i] for i in order.tolist()]
    for a, b in chunks_by_bytes(texts, SLICE):
        if b - a > 1 or len(texts[a]) <= STRETCH:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts[a:b]])]).astype(np.int64)
            yield np.frombuffer(b"".join(texts[a:b]), np.uint8), bounds, order[a:b], np.zeros(b - a, np.int64)
            continue
        whole = np.frombuffer(texts[a], np.uint8)
        for at in range(0, len(whole) - width + 1, STRETCH):
            part = whole[at : at + STRETCH + width - 1]
            yield part, np.array([0, len(part)]), order[a:b], np.array([at])


def repeated_anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Step 1: doc, version, start, windows around anchors that occur again; a written table."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            doc, version = batch.column("doc").to_numpy(), batch.column("version").to_numpy()
            for data, bounds, index, at in pieces(doc, version, utf8(batch.column("text")), width):
                text, start, windows, anchor, _ = anchor_runs(BYTE_VALUES[data], bounds, width, gram)
                held.append((anchor.view(np.int64), doc[index[text]], version[index[text]], start + at[text], windows))
                n += len(text)
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held) -> Iterator[pa.RecordBatch]:
        anchor, doc, version, start, windows = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(anchor, kind="stable")
        new = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])
        again = ~new | np.concatenate([~new[1:], [False]])
        note = anchor[order[again & new]]
        zero = np.zeros(len(note), np.int64)
        yield batch(SENT, note, zero, zero, zero, zero)
        asked = np.zeros(len(anchor), bool)
        asked[order[again]] = True
        ranges = joined_ranges(doc[asked], version[asked], start[asked], windows[asked])
        yield batch(ASKED, mix64(ranges[0].view(np.uint64)).view(np.int64), *ranges)
        yield batch(SENT, *(x[~asked] for x in (anchor, doc, version, start, windows)))

    def batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names=["kind", "anchor", "doc", "version", "start", "windows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_key(batches, "anchor"):
            sent = x["kind"] == SENT
            _, group, counts = np.unique(x["anchor"][sent], return_inverse=True, return_counts=True)
            keep = ~sent
            keep[sent] = (counts[group] > 1) & (x["windows"][sent] > 0)
            yield pa.record_batch([pa.array(x[c][keep]) for c in ("doc", "version", "start", "windows")], names=["doc", "version", "start", "windows"])

    sent = docs.mapInArrow(tidily(send), "kind int, anchor long, doc long, version long, start long, windows long")
    dealt = sent.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    return materialise(dealt.mapInArrow(tidily(meet), "doc long, version long, start long, windows long"), "anchors")


#: key: the initial bucket. at: where its anchor is, from start. Covered rows have neither, and no text.
STRETCHES = "kind int, key long, doc long, version long, start long, windows long, at int, text binary"
NAMES = ["kind", "key", "doc", "version", "start", "windows", "at", "text"]


def covered_rows(doc, version, start, windows) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch([pa.array(np.full(n, COVERED, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(doc), pa.array(version), pa.array(start), pa.array(windows), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary())], names=NAMES)


def combined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches with equal bytes the earliest goes on, the others are covered: one row a task and string."""
    if not held:
        return
    whole = pa.Table.from_batches(held).combine_chunks()
    doc, version, start, windows = (whole.column(c).to_numpy() for c in ("doc", "version", "start", "windows"))
    code = whole.column("text").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((start, version, doc, code))
    fresh = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    later = order[~fresh]
    if len(later):
        yield covered_rows(*joined_ranges(doc[later], version[later], start[later], windows[later]))
    yield from whole.take(pa.array(np.sort(order[fresh]))).to_batches(max_chunksize=1 << 14)


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings data[begin : begin + size] as one Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(int(offsets[-1])) + np.repeat(begin - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def local_buckets(docs: DataFrame, asked: DataFrame, width: int, gram: int) -> DataFrame:
    """Step 2; a written table of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            doc, version, ranges = batch.column("doc").to_numpy(), batch.column("version").to_numpy(), batch.column("ranges")
            begins, counts = ranges.offsets.to_numpy(), np.diff(ranges.offsets.to_numpy())
            r_start, r_windows = (ranges.values.field(c).to_numpy() for c in ("start", "windows"))
            for data, bounds, index, at in pieces(doc, version, utf8(batch.column("text")), width):
                text, start, windows, anchor, _, place = anchor_runs(BYTE_VALUES[data], bounds, width, gram, places=True)
                mark = np.zeros(len(data) + 1, np.int64)
                of = np.repeat(np.arange(len(index)), counts[index])
                which = np.arange(len(of)) - np.repeat(np.cumsum(counts[index]) - counts[index], counts[index]) + begins[index][of]
                low, high = bounds[of], bounds[of + 1]
                np.add.at(mark, np.clip(bounds[of] + r_start[which] - at[of], low, high), 1)
                np.add.at(mark, np.clip(bounds[of] + r_start[which] + r_windows[which] - at[of], low, high), -1)
                in_range = np.cumsum(mark)[:-1] > 0
                begin = bounds[text] + start
                open_ = np.flatnonzero(in_range[begin])
                text, start, windows, anchor, place, begin = (x[open_] for x in (text, start, windows, anchor, place, begin))
                if not len(text):
                    continue
                run_of = np.repeat(np.arange(len(text)), windows)
                starts = np.arange(len(run_of)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[run_of]
                first = first_of_buckets(data, starts, width)
                head = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (run_of[1:] != run_of[:-1])]))
                size = np.diff(np.append(head, len(starts)))
                r, s, goes_on = run_of[head], starts[head], first[head]
                d, v, place_in = doc[index[text[r]]], version[index[text[r]]], s - bounds[text[r]] + at[text[r]]
                if not goes_on.all():
                    yield covered_rows(*joined_ranges(d[~goes_on], v[~goes_on], place_in[~goes_on], size[~goes_on]))
                r, s, size, d, v, place_in = (x[goes_on] for x in (r, s, size, d, v, place_in))
                kind = np.full(len(r), SENT, np.int32)
                held.append(pa.record_batch([pa.array(kind), pa.array(anchor[r].view(np.int64)), pa.array(d), pa.array(v), pa.array(place_in), pa.array(size), pa.array((place[r] - s).astype(np.int32)), gathered(data, s, size + width - 1)], names=NAMES))
                n += len(r)
                if n >= HELD_ROWS:
                    yield from combined(held)
                    held, n = [], 0
        yield from combined(held)

    needed = docs.join(listed(asked), ["doc", "version"]).select("doc", "version", "text", "ranges")
    return materialise(needed.mapInArrow(tidily(run), STRETCHES), "stretches")


def finer(rows: DataFrame, width: int, part: int) -> DataFrame:
    """Stretches dealt out anew: windows whose anchor lies in the same ``part`` of offsets, under all bytes that every
    such window has. At ``part`` 1 that is the whole window. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            doc, version, start, windows, at = (batch.column(c).to_pylist() for c in ("doc", "version", "start", "windows", "at"))
            out: list[tuple] = []
            for d, v, s, w, a, text in zip(doc, version, start, windows, at, batch.column("text").to_pylist(), strict=True):
                for j in range((a - w + 1) // part, a // part + 1):  # a window that begins x later has its anchor at a - x
                    x, y = max(0, a - j * part - part + 1), min(w - 1, a - j * part)
                    shared = a - j * part
                    key = xxhash.xxh64_intdigest(text[shared : shared - part + 1 + width], j) - 2**63
                    out.append((SENT, key, d, v, s + x, y - x + 1, a - x, text[x : y + width]))
            types = (pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.binary())
            held.append(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=NAMES))
            n += len(out)
            if n >= HELD_ROWS:
                yield from combined(held)
                held, n = [], 0
        yield from combined(held)

    return materialise(rows.select(*NAMES).mapInArrow(tidily(run), STRETCHES), "finer")


def meet_buckets(rows: DataFrame, width: int) -> DataFrame:
    """Step 3: covered windows among stretches of each initial bucket; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key")
            if held and key[0].as_py() != held[-1].column("key")[-1].as_py():
                yield from settle_buckets(held)
                held = []
            values = key.to_numpy()
            cut = int(np.searchsorted(values, values[-1]))
            if cut:
                yield from settle_buckets([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        yield from settle_buckets(held)

    def settle_buckets(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        whole = pa.Table.from_batches(held)
        key, doc, version, start, windows = (whole.column(c).to_numpy() for c in ("key", "doc", "version", "start", "windows"))
        code = whole.column("text").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((start, version, doc, code))
        fresh = np.concatenate([[True], code[order][1:] != code[order][:-1]])
        later = order[~fresh]  # the same bytes as an earlier stretch
        if len(later):
            yield ranges(doc[later], version[later], start[later], windows[later])
        rest = order[fresh]
        _, group, count = np.unique(key[rest], return_inverse=True, return_counts=True)
        rest = rest[count[group] > 1]
        rest = rest[np.lexsort((start[rest], version[rest], doc[rest]))]
        if not len(rest):
            return
        text = whole.column("text").combine_chunks().take(pa.array(rest))
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
        begin = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text)].astype(np.int64)
        w = windows[rest]
        row = np.repeat(np.arange(len(rest)), w)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
        gone = np.flatnonzero(~first_of_buckets(data, begin[row] + shift, width))
        if len(gone):
            at = rest[row[gone]]
            yield ranges(doc[at], version[at], start[at] + shift[gone], np.ones(len(gone), np.int64))

    def ranges(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in joined_ranges(*columns)], names=["doc", "version", "start", "windows"])

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return materialise(dealt.mapInArrow(tidily(run), "doc long, version long, start long, windows long"), "buckets")


def covered_ranges(docs: DataFrame, width: int, most: int = MOST) -> DataFrame:
    """doc, version, ranges of covered window starts, for the documents that have any; ``docs`` has no row twice."""
    gram = min(GRAM, width)
    columns = ["doc", "version", "start", "windows"]
    found = local_buckets(docs, repeated_anchors(docs, width, gram), width, gram)
    covered = found.filter(F.col("kind") == COVERED).select(columns)
    rows, part = found.filter(F.col("kind") == SENT), width - gram + 1
    while part > 1:
        counts = materialise(rows.groupBy("key").count().filter(F.col("count") > most).select("key"), "large")
        n = counts.count()
        if not n:
            break
        if n <= 100_000:
            counts = F.broadcast(counts)
        part = max(1, part // FINER)
        again = finer(rows.join(counts, "key", "left_semi"), width, part)
        covered = covered.unionByName(meet_buckets(rows.join(counts, "key", "left_anti").select(NAMES), width)).unionByName(again.filter(F.col("kind") == COVERED).select(columns))
        rows = again.filter(F.col("kind") == SENT)
    return listed(covered.unionByName(meet_buckets(rows, width)))


def repeated_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, repeats (array of start, end in bytes) and kept (binary): maximal stretches covered by strings of
    ``width`` bytes that also start earlier (smaller doc_id, or earlier in the same document), and the other bytes.

    A null text is empty; a null doc_id counts as the least; rows with equal doc_id and text are one document, each
    with its row; with equal doc_id and other texts they are ordered by a hash. Strings are judged on the input.
    """
    rows, distinct = keyed(docs)
    found = rows.join(covered_ranges(distinct, width), ["doc", "version"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, ranges in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                sizes.append(len(text))
                if not ranges:
                    spans.append([])
                    kept.append(text)
                    continue
                gone = covered_units(ranges, width, len(text))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.record_batch([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "repeats", "kept"])

    out = found.select("doc", "text", "ranges").mapInArrow(tidily(cut), "doc long, n_bytes long, repeats array<struct<start:long,end:long>>, kept binary")
    return out.select(F.nullif(F.col("doc"), F.lit(LOWEST)).alias("doc_id"), "n_bytes", "repeats", "kept")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS k FROM d, unnest(range(1, n - 98)) AS t(i)),
firsts AS (SELECT k, min(doc_id::HUGEINT * 4294967296 + i) AS first_place FROM strings GROUP BY k),
gone AS (SELECT doc_id, i FROM strings JOIN firsts USING (k) WHERE doc_id::HUGEINT * 4294967296 + i > first_place),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM gone),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM numbered GROUP BY doc_id, g),
lists AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_spans IS NULL THEN sha256(unhex(h)) ELSE sha256(unhex(array_to_string(list_transform(range(len(a) + 1),
  lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE b[j] END) + 1, 2 * ((CASE WHEN j = len(a) THEN n + 1 ELSE a[j + 1] END) - 1 - (CASE WHEN j = 0 THEN 0 ELSE b[j] END)))), ''))) END AS kept_sha256 FROM d LEFT JOIN lists USING (doc_id)
"""


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, r: a + r.end - r.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("repeats").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
