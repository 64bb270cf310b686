"""Best-fit-decreasing packing of token pieces into sequences of bounded length.

Pieces of one length are interchangeable, so the whole packing follows from the histogram of lengths, which has at
most ``capacity`` rows at any input size. The driver packs the histogram: from the longest length down, a segment tree
over the remaining capacities finds the tightest open bin, and a run of equal pieces that meets a run of equal bins is
placed in one step. The result is the packing that plain best-fit decreasing makes document by document. Each piece
then finds its bin from its rank among the pieces of its length; ranks come from counts per task and a prefix sum.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialise, tidily
from kindred.llm.tokens import default_vocabulary, text_slices, tokenizer

CAPACITY = 2048


class CapacityTree:
    """Which remaining capacities have open bins; the smallest one of at least ``n`` in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i //= 2

    def tightest(self, n: int) -> int | None:
        i = n + self.leaves
        if self.count[i]:
            return n
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, first bin, pieces a bin, offset of the first in its bin), by length and rank."""
    tree, open_bins, bins, plan = CapacityTree(capacity), defaultdict(list), 0, []

    def keep(left: int, first: int, n: int) -> None:
        if n:
            open_bins[left].append((first, n))
            tree.add(left, 1)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        rank, rest = 0, histogram[length]
        while rest:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = bins, -(-rest // each)
                bins += n
            else:
                first, n = open_bins[left].pop()
                tree.add(left, -1)
                each = left // length
            full = min(n, rest // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - left))
                keep(left - each * length, first, full)
                rank, rest = rank + full * each, rest - full * each
            if full < n and rest and rest < each:
                plan.append((length, rank, rest, first + full, each, capacity - left))
                keep(left - rest * length, first + full, 1)
                rank, rest, full = rank + rest, 0, full + 1
            keep(left, first + full, n - full)
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (with ``end_id`` last) into pieces of at most ``capacity``.

    Columns: doc_id, piece, start, length, ids_crc32, part and nth (the task, and the piece's number among those of its
    length there; stable once written), and ids (binary, little-endian unsigned 32-bit) on request. A null text is
    empty and gives one piece with the end id. Repeated rows each give their pieces.
    """
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), tokenizer(vocabulary), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in text_slices(whole):
                ids, bounds = encoder.encode(batch.column("text"))
                flat = np.insert(ids, bounds[1:], end_id).astype("<u4")
                sizes = np.diff(bounds) + 1
                begins = np.cumsum(sizes) - sizes
                pieces = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered, "left")
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - first + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                at = begins[of] + start
                raw = [flat[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(np.full(len(of), part, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.record_batch([*columns, pa.array(raw, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidily(cut), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each written piece its sequence_id and offset. ``pieces`` must be a table, since part and nth are per task.

    Only the histogram (at most ``capacity`` rows) comes to the driver, and only the plan that follows from it, whose
    size does not depend on the number of documents, goes back.
    """
    counts = pieces.groupBy("part", "length").agg(F.max("nth").alias("last")).withColumn("n", F.col("last") + 1)
    plan = plan_packing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    by_task = Window.partitionBy("length").orderBy("part")
    before = counts.select("part", "length", (F.sum("n").over(by_task) - F.col("n")).alias("base"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    lengths, ranks = plan[:, 0], plan[:, 1]
    first_of = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                a, b = first_of[x], first_of[x + 1]
                own = length == x
                row[own] = a + np.searchsorted(ranks[a:b], rank[own], "right") - 1
            _, base, _, first, each, fill = plan[row].T if len(row) else np.zeros((6, 0), np.int64)
            bin_, slot = np.divmod(rank - base, np.maximum(each, 1))
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(first + bin_), pa.array(fill + slot * length)], names=[*kept, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(tidily(place), f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Best-fit-decreasing packing of whole documents; see ``token_pieces`` for nulls, empties and repeats.

    An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    return pack(materialise(token_pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), n_tokens, doc_ids. A group has ``capacity`` ids at most."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p"), F.sum("length").alias("n_tokens")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "n_tokens", F.col("p.doc_id").alias("doc_ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
