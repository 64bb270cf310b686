"""Benchmark decontamination by a distributed positional inverted index.

The corpus is cut into shards of bounded size. A shard's index is one row of a table: its terms and, for each term, the
ascending positions at which it occurs (positions run through the shard; between two documents some are left out, so that no match
crosses). The table is written once and answers any number of searches.

A search takes the test windows to every shard, in blocks of bounded size. In a shard a window starts from its rarest
term, the one with the shortest list; its positions, less the term's offset in the window, are the possible starts. The
lists of the other terms, from the next rarest on, are intersected with them, adjusted by their own offsets. What is
left are exact phrases. For proximity, the rarest term's positions are followed to the nearest positions of all
other terms: every stretch of at most ``reach`` words that begins and ends with a term of the window and holds all.

No posting list of the corpus, however long, meets in one place: lists are as long as a shard at most, nothing but
matches is shuffled, and of these only those of texts that were too long for one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import chunks_by_bytes, materialise, partitions, tidily, utf8
from kindred.llm.repeats import cut_at_space

WINDOW = 10
SHARD = 1 << 20  # bytes of text in a shard
BLOCK = 200_000  # windows that a task holds at once
CANDIDATES = 1 << 21  # possible starts that are looked at together
#: Letters in small, digits and all that is not ASCII stay; the rest is white space.
TERMS = bytes(x if x > 127 or 48 <= x <= 57 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


# ---- the windows


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item and terms of each window of ``items`` (item_id, text), a written table: ``width`` consecutive words, or all of an item that has fewer.
    Items without a word have none. ``item`` is the item_id as text, the empty text for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, found = [], []
            for i, text in zip(batch.column("item").to_pylist(), utf8(batch.column("text")), strict=True):
                words = terms_of(text)
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    item.append(i)
                    found.append(words[at : at + width])
            yield pa.record_batch([pa.array(item, pa.string()), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return materialise(rows.mapInArrow(tidily(run), "item string, terms array<binary>").distinct(), "windows")


class Block:
    """Some of the windows, as a task needs them: distinct sequences of term numbers, and the items of each."""

    def __init__(self, rows: list):
        sequences: dict[tuple, int] = {}
        pairs = sorted({(sequences.setdefault(tuple(map(bytes, r["terms"])), len(sequences)), r["item"]) for r in rows})
        self.items = sorted({i for _, i in pairs})
        number = {x: i for i, x in enumerate(self.items)}
        self.item = np.array([number[i] for _, i in pairs], np.int64)
        self.item_begins = np.searchsorted(np.array([s for s, _ in pairs]), np.arange(len(sequences) + 1))
        self.vocabulary = sorted({t for s in sequences for t in s})
        of = {x: i for i, x in enumerate(self.vocabulary)}
        self.length = np.array([len(s) for s in sequences], np.int64)
        self.term = np.full((len(sequences), int(self.length.max(initial=0))), -1, np.int64)
        for s, i in sequences.items():
            self.term[i, : len(s)] = [of[t] for t in s]


def blocks(table: DataFrame, most: int = BLOCK) -> Iterator[Block]:
    """All windows, ``most`` at a time (about): a driver or task holds one block, whatever the benchmark's size. Windows
    are dealt out by their terms, so that equal ones of several items are in one block."""
    n = -(-table.count() // most)
    part = table.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(max(n, 1))))
    for i in range(n):
        yield Block(part.filter(F.col("block") == i).select("item", "terms").collect())


# ---- the index

INDEX = "docs array<struct<id:bigint,doc_id:bigint,first:bigint,fresh:bigint,begin:int,n:int,whole:boolean>>, terms array<binary>, ends array<int>, positions array<int>"


def shards(ids, doc_ids, texts: list[bytes], overlap: int, shard: int = SHARD):
    """(documents, their term lists) of each shard. A text longer than four shards goes in stretches that share ``overlap`` words,
    each a shard of its own; ``first`` is a stretch's first word in the text, ``fresh`` the number of words that are no earlier stretch's."""
    for a, b in chunks_by_bytes(texts, shard):
        if b - a > 1 or len(texts[a]) <= 4 * shard:
            found = [terms_of(x) for x in texts[a:b]]
            yield [(ids[i], doc_ids[i], 0, len(x), True) for i, x in zip(range(a, b), found, strict=True)], found
            continue
        kept, first = [], 0
        for part in cut_at_space(texts[a].translate(TERMS), 4 * shard):
            words = kept + part.split()
            yield [(ids[a], doc_ids[a], first, len(words) - len(kept), False)], [words]
            kept = words[max(0, len(words) - overlap) :] if overlap else []
            first += len(words) - len(kept)


def posted(found: list[list[bytes]], gap: int, wanted: pa.Array | None):
    """(begin and length of each document, terms, end of each term's list, positions)."""
    n = np.array([len(x) for x in found], np.int64)
    begin = np.cumsum(n + gap) - (n + gap)
    coded = pa.array([w for x in found for w in x], pa.binary()).dictionary_encode()
    position = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    term, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if wanted is not None:
        keep = pc.is_in(names, value_set=wanted).to_numpy(zero_copy_only=False)
        rank = np.cumsum(keep) - 1
        on = keep[term] if len(term) else np.zeros(0, bool)
        term, position, names = rank[term[on]], position[on], names.filter(pa.array(keep))
    order = np.argsort(term, kind="stable")
    return begin, n, names, np.cumsum(np.bincount(term, minlength=len(names))).astype(np.int32), position[order].astype(np.int32)


def build_index(docs: DataFrame, overlap: int = WINDOW - 1, terms: list[bytes] | None = None) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), a written table with a row a shard: all terms, or those that
    searches will ask for. Matches of up to ``overlap`` + 1 words are found in texts that span several shards. Null texts have no words."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = None if wanted is None else pa.array(wanted.value, pa.binary())
        for batch in batches:
            for known, found in shards(batch.column("id").to_pylist(), batch.column("doc_id").to_pylist(), utf8(batch.column("text")), overlap):
                begin, n, names, ends, positions = posted(found, overlap + 1, filter_)
                id_, doc_id, first, fresh, whole = zip(*known, strict=True)
                columns = [pa.array(id_, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(first, pa.int64()), pa.array(fresh, pa.int64()), pa.array(begin, pa.int32()), pa.array(n, pa.int32()), pa.array(whole)]
                docs_ = pa.StructArray.from_arrays(columns, names=["id", "doc_id", "first", "fresh", "begin", "n", "whole"])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs_, names, pa.array(ends), pa.array(positions))]
                yield pa.record_batch(lists, names=["docs", "terms", "ends", "positions"])

    return materialise(rows.mapInArrow(tidily(run), INDEX), "index")


# ---- searches in a shard


class Shard:
    """One row of the index, for a block of windows: which of its terms the block asks for, and where they are."""

    def __init__(self, row: pa.StructScalar, block: Block):
        names, self.ends, self.positions = row["terms"].values, row["ends"].values.to_numpy(), row["positions"].values.to_numpy().astype(np.int64)
        here = pc.index_in(pa.array(block.vocabulary, pa.binary()), value_set=names)
        self.list_of = pc.fill_null(here, -1).to_numpy().astype(np.int64)  # term number -> list, -1: none
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.ends)), self.ends - self.begins) << 32 | self.positions  # ascending
        self.sizes = np.append(self.ends - self.begins, 0)  # the last is that of -1
        self.block = block
        self.lists = np.where(block.term >= 0, self.list_of[block.term], -1)
        full = np.arange(block.term.shape[1])[None, :] < block.length[:, None]
        self.open = np.flatnonzero(((self.lists >= 0) | ~full).all(1) & (block.length > 0))
        size = np.where(full[self.open], self.sizes[self.lists[self.open]], np.iinfo(np.int64).max)
        self.rarest = np.argsort(size, axis=1, kind="stable")  # offsets in a window, by the length of their lists

    def postings(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``lists``, position) of all their entries."""
        n = self.sizes[lists]
        at = np.repeat(np.arange(len(lists)), n)
        return at, self.positions[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + self.begins[lists[at]]]

    def groups(self):
        """Runs of the open windows whose rarest lists add up to a bounded number of entries, one window at least."""
        total = np.cumsum(self.sizes[self.lists[self.open, self.rarest[:, 0]]])
        a = 0
        while a < len(self.open):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CANDIDATES, "right")))
            yield np.arange(a, b)
            a = b

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        out = [(np.zeros(0, np.int64),) * 2]
        for rows in self.groups():
            window, offset = self.open[rows], self.rarest[rows]
            at, position = self.postings(self.lists[window, offset[:, 0]])
            start = position - offset[at, 0]
            for r in range(1, offset.shape[1]):
                inside = r < self.block.length[window[at]]
                o = offset[at, r]
                key = self.lists[window[at], o] << 32 | (start + o)
                keep = ~inside | ((start >= 0) & self.has(key))
                at, start = at[keep], start[keep]
                if not len(at):
                    break
            out.append((window[at], start))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def has(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def near(self, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first, last position) of every stretch of at most ``slop`` words more than the window that begins and
        ends with one of its terms and holds them all, each in any place; of those with the same begin the shortest."""
        out = [(np.zeros(0, np.int64),) * 3]
        far = np.iinfo(np.int64).max >> 1
        for rows in self.groups():
            window, offset = self.open[rows], self.rarest[rows]
            reach = self.block.length[window] + slop
            at, position = self.postings(self.lists[window, offset[:, 0]])
            # a stretch begins at an entry of one of the lists, at most its length before the rarest term
            begins = []
            for r in range(offset.shape[1]):
                inside = np.flatnonzero(r < self.block.length[window[at]])
                lists = self.lists[window[at[inside]], offset[at[inside], r]]
                low = np.searchsorted(self.keys, lists << 32 | np.maximum(position[inside] - reach[at[inside]] + 1, 0))
                high = np.searchsorted(self.keys, lists << 32 | position[inside], "right")
                n = high - low
                which = np.repeat(inside, n)
                begins.append((at[which], self.positions[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]))
            w, s = (np.concatenate(x) for x in zip(*begins, strict=True))
            w, s = np.unique(np.stack([w, s]), axis=1)
            last = s.copy()
            for r in range(offset.shape[1]):
                inside = np.flatnonzero(r < self.block.length[window[w]])
                lists = self.lists[window[w[inside]], offset[w[inside], r]]
                i = np.searchsorted(self.keys, lists << 32 | s[inside])
                found = i < self.ends[lists]
                last[inside] = np.maximum(last[inside], np.where(found, self.positions[np.minimum(i, len(self.positions) - 1)], far))
            keep = last - s < reach[w]
            out.append((window[w[keep]], s[keep], last[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges, sorted by begin, with those that touch as one."""
    if not len(begin):
        return begin, end
    top = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > top[:-1]]))
    return begin[first], top[np.append(first[1:], len(begin)) - 1]


def matched(block: Block, shard: Shard, slop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position, end) of exact matches, or with a ``slop`` of the stretches that hold a window."""
    if slop is None:
        window, start = shard.phrases()
        return window, start, start + block.length[window]
    window, start, last = shard.near(slop)
    return window, start, last + 1


HITS = "id long, doc_id long, n_words long, whole boolean, ranges array<struct<begin:bigint,end:bigint>>, items array<string>"


def hits(index: DataFrame, block: Block, slop: int | None = None) -> DataFrame:
    """A row a document and stretch of the index: its own words, covered ranges of words, and the items found."""
    known = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = known.value
        for batch in batches:
            for row in pa.StructArray.from_arrays(batch.columns, names=batch.schema.names):
                docs = row["docs"].values
                window, begin, end = matched(block, Shard(row, block), slop)
                starts = docs.field("begin").to_numpy()
                of = np.searchsorted(starts, begin, "right") - 1
                order = np.lexsort((begin, of))
                window, begin, end, of = window[order], begin[order], end[order], of[order]
                # ranges of different documents never touch: some positions between them are left out
                a, b = joined(begin, end)
                at = np.searchsorted(starts, a, "right") - 1
                shift = docs.field("first").to_numpy()[at] - starts[at]
                ranges = pa.StructArray.from_arrays([pa.array(a + shift), pa.array(b + shift)], names=["begin", "end"])
                n = block.item_begins[window + 1] - block.item_begins[window]
                flat = np.repeat(np.arange(len(window)), n)
                item = block.item[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + block.item_begins[window[flat]]]
                pair = np.unique(of[flat] * len(block.items) + item) if len(flat) else np.zeros(0, np.int64)
                width = max(len(block.items), 1)
                names = pa.array(block.items, pa.string()).take(pa.array(pair % width))
                cut = lambda x: pa.array(np.searchsorted(x, np.arange(len(docs) + 1)), pa.int32())
                yield pa.record_batch([docs.field("id"), docs.field("doc_id"), docs.field("fresh"), docs.field("whole"), pa.ListArray.from_arrays(cut(at), ranges), pa.ListArray.from_arrays(cut(pair // width), names)], names=["id", "doc_id", "n_words", "whole", "ranges", "items"])

    return index.mapInArrow(tidily(run), HITS)


def covered(ranges: Column) -> Column:
    """How many numbers lie in the ranges (begin, end), which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, r: F.struct(F.greatest(s.end, r.end).alias("end"), (s.n + F.greatest(r.end - F.greatest(s.end, r.begin), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(ranges), start, step, lambda s: s.n)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None, most: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit (words in an occurrence of a window), items (ascending as texts), contaminated; a row a document.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are not looked at. Null texts have no words, nor
    have texts of punctuation alone. Items of fewer than ``width`` words are one window, items without a word none. Repeated rows of ``docs`` are
    documents of their own; repeated items count once, a null item_id as the empty text. With a ``slop`` a window is
    also found where its words are spread over that many words more, in any order. Empty tables: no rows, or no hits.
    """
    table = windows(items, width)
    terms = table.select(F.explode("terms").alias("term")).distinct()
    some = [bytes(r["term"]) for r in terms.collect()] if table.count() <= most else None  # too many: index all terms
    index = build_index(docs, width - 1 + (slop or 0), some)
    parts = None
    for block in blocks(table, most):
        found = materialise(hits(index, block, slop), "hits")
        parts = found if parts is None else parts.unionByName(found.withColumn("n_words", F.lit(0).cast("long")))
    if parts is None:
        empty = F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("ranges"), F.array().cast("array<string>").alias("items")
        parts = index.select(F.inline("docs")).select("id", "doc_id", F.col("fresh").alias("n_words"), "whole", *empty)
    alone = F.col("whole") if table.count() <= most else F.lit(False)
    gathered = parts.filter(~alone).groupBy("id").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
    every = parts.filter(alone).select(*gathered.columns).unionByName(gathered)
    n_hit = covered(F.col("ranges"))
    return every.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), (n_hit > 0).alias("contaminated"))


def matches(index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None, most: int = BLOCK) -> DataFrame:
    """doc_id, item, begin, n_words: every exact phrase match of the items' windows in an index, or with a ``slop`` every
    stretch that holds one. The index must have been built with an overlap of ``width`` + ``slop`` - 1 words at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = known.value
        for batch in batches:
            for row in pa.StructArray.from_arrays(batch.columns, names=batch.schema.names):
                docs = row["docs"].values
                window, begin, end = matched(block, Shard(row, block), slop)
                n = block.item_begins[window + 1] - block.item_begins[window]
                flat = np.repeat(np.arange(len(window)), n)
                item = block.item[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + block.item_begins[window[flat]]]
                starts = docs.field("begin").to_numpy()
                of = np.searchsorted(starts, begin[flat], "right") - 1
                place = begin[flat] - starts[of] + docs.field("first").to_numpy()[of]
                yield pa.record_batch([docs.field("id").take(pa.array(of)), docs.field("doc_id").take(pa.array(of)), pa.array(block.items, pa.string()).take(pa.array(item)), pa.array(place), pa.array(end[flat] - begin[flat])], names=["id", "doc_id", "item", "begin", "n_words"])

    out = None
    for block in blocks(windows(items, width), most):
        known = index.sparkSession.sparkContext.broadcast(block)
        found = materialise(index.mapInArrow(tidily(run), "id long, doc_id long, item string, begin long, n_words long"), "matches")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.select(F.inline("docs")).select("doc_id", F.lit("").alias("item"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("n_words")).limit(0)
    return out.distinct().drop("id")  # stretches share some words


def op11_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS g FROM bw, range(0, greatest(len(w) - {WINDOW - 1}, 1)) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM q),
g AS (SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
h AS (SELECT r, i, g.k, item_id FROM g JOIN q ON q.g = g.g AND q.k = g.k),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""
