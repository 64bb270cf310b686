"""Hashes within a Hamming distance of one another, exactly, by metric partitions.

Some hashes of the table are pivots; every hash lives in the cell of its nearest pivot. A hash y can only have a partner
that lives in the cell of pivot q if it is no farther from q than from its own pivot plus twice the radius (the hyperplane
between two pivots), and no farther from q than the cell's own extent plus the radius. Into these cells it goes as a guest. In one set,
two cells have one meeting place, so each pair meets once at most. In a cell, distances to the pivot are sorted: only
hashes whose distances differ by the radius at most are compared.

Where pivots don't tell hashes apart (a large radius over hashes that are all far from each other), guests would go nearly
everywhere. A sample shows how many cells a hash would enter, and fewer pivots are taken until that is about what
dealing both sides into a grid costs; with one pivot it is that grid. Cells with many residents or guests are cut into
lines, and each line of residents meets each line of guests in a task's bounded share. No pair is lost and none compared twice.

For components a link is enough: whatever lies within the radius of a pivot is linked to it and not compared with its like,
and of the pairs that are found only a forest is returned. So in a dense heap a hash costs a link for each cell that it enters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.scratch import materialise

PIVOTS = 256
LINE, SHARE = 4096, 1 << 20  # rows of a line that is worth a task of its own, and most rows of a line
BLOCK = 1 << 20  # pairs that are compared at once

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]).astype(np.int16)


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) of all nodes of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # only roots are hooked
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label = next_
    return nodes, nodes[label]


class Cells:
    """The pivots and how the cells are cut; it travels to the tasks."""

    def __init__(self, pivots: np.ndarray, radius: int, one_set: bool):
        self.pivots, self.radius, self.one_set = pivots, radius, one_set
        n = len(pivots)
        self.extent = np.full(n, 64, np.int16)
        p, q = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        #: whether a resident of cell p is a guest in cell q, rather than the other way round
        self.visits = (np.where((p + q) % 2 == 0, np.minimum(p, q), np.maximum(p, q)) == q) & (p != q) if one_set else np.ones((n, n), bool)

    def home(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = apart(h, self.pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(h)), cell]

    def guests(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, cell, distance to its pivot) of the cells that each hash has to visit."""
        d = apart(h, self.pivots)
        cell = d.argmin(1)
        near = d[np.arange(len(h)), cell]
        i, q = np.nonzero((d <= near[:, None] + 2 * self.radius) & (d <= self.extent[None, :] + self.radius) & self.visits[cell])
        return i, q, d[i, q]

    def cut(self, residents: np.ndarray, guests: np.ndarray, tasks: int) -> Cells:
        lines = lambda n: np.maximum(-(-n // SHARE), np.minimum(-(-n // LINE), math.isqrt(2 * tasks) + 1))
        self.lines, self.guest_lines = lines(residents), np.where(residents > 0, lines(guests), 0)
        return self


def cell_key(q: np.ndarray, kind: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (q.astype(np.int64) * 2 + kind) << 40 | i.astype(np.int64) << 20 | j.astype(np.int64)


def line_of(h: np.ndarray, lines: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.maximum(lines, 1).astype(np.uint64)).astype(np.int64)


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of n, 0..n-1) for each."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def residents_out(c: Cells, h: np.ndarray) -> Iterator[tuple]:
    """(key, side, hash, distance to the pivot): where residents go. Side 0 is held, side 1 passes by."""
    q, d = c.home(h)
    m = c.lines[q]
    i = line_of(h, m)
    if c.one_set:  # each line meets itself and all later ones
        at, j = spread(m - i)
        yield cell_key(q[at], 0, i[at], i[at] + j), 0, h[at], d[at]
        at, k = spread(i)
        yield cell_key(q[at], 0, k, i[at]), 1, h[at], d[at]
    at, j = spread(c.guest_lines[q])
    yield cell_key(q[at], 1, i[at], j), 0, h[at], d[at]


def guests_out(c: Cells, h: np.ndarray) -> Iterator[tuple]:
    i, q, d = c.guests(h)
    j = line_of(h[i], c.guest_lines[q])
    at, k = spread(np.where(c.guest_lines[q] > 0, c.lines[q], 0))
    yield cell_key(q[at], 1, k, j[at]), 1, h[i[at]], d[at]


def compare(held: np.ndarray, near: np.ndarray, others: np.ndarray, their: np.ndarray, radius: int, links: bool, triangle: bool, count: Callable[[int], None]) -> Iterator[Pairs]:
    """Pairs (held, other, distance) within the radius; ``near`` and ``their`` are the distances to the pivot, ``near`` ascends."""
    low, high = np.searchsorted(near, their - radius), np.searchsorted(near, their + radius, "right")
    if triangle:
        low = np.maximum(low, np.arange(len(others)) + 1)
    if links:  # both within the radius of the pivot: linked through it
        low = np.where(their <= radius, np.maximum(low, np.searchsorted(near, radius, "right")), low)
    n = np.maximum(high - low, 0)
    total = np.cumsum(n)
    a = 0
    while a < len(others):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK, "right")))
        at, k = spread(n[a:b])
        x, y = held[k + low[a:b][at]], others[a:b][at]
        count(len(x))
        d = np.bitwise_count(x ^ y)
        keep = d <= radius
        if keep.any():
            yield x[keep], y[keep], d[keep]
        a = b


def meet(c: Cells, links: bool, counter=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with rows sorted by key, side and distance: residents of a key are held, all others pass by."""
    through = links and c.one_set  # linked through the pivot; of two sets only those that pass by would be

    def out(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        if links:
            x, y = least_reached(x, y)
            x, y = x[x != y], y[x != y]
            d = np.zeros(len(x))
        return pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(d.astype(np.int64))], names=["a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (lambda n: None) if counter is None else counter.add

        def to_pivot(h, d, own):
            h = h[(d <= c.radius) & (h != c.pivots[own])]
            if len(h):
                yield out(h, np.full(len(h), c.pivots[own]), np.zeros(len(h)))

        def close():
            h, d = held()
            q, i, j = key >> 41, key >> 20 & 0xFFFFF, key & 0xFFFFF
            if key >> 40 & 1 == 0 and i == j:
                if through:
                    yield from to_pivot(h, d, q)
                for found in compare(h, d, h, d, c.radius, through, True, count):
                    yield out(*found)

        def held():
            if len(parts) > 1:
                parts[:] = [tuple(np.concatenate(x) for x in zip(*parts, strict=True))]
            return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        key, parts = None, []
        for batch in batches:
            k, side, h, d = (batch.column(x).to_numpy() for x in ("key", "side", "hash", "far"))
            h = h.view(np.uint64)
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                if a == b:
                    continue
                if k[a] != key:
                    if key is not None:
                        yield from close()
                    key, parts = int(k[a]), []
                mid = a + int(np.searchsorted(side[a:b], 1))
                if mid > a:
                    parts.append((h[a:mid], d[a:mid]))
                if b > mid:
                    if through and key >> 40 & 1 and key >> 20 & 0xFFFFF == 0:
                        yield from to_pivot(h[mid:b], d[mid:b], key >> 41)
                    for found in compare(*held(), h[mid:b], d[mid:b], c.radius, through, False, count):
                        yield out(*found)
        if key is not None:
            yield from close()

    return run


def _mapped(df: DataFrame, f: Callable, c: Cells) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("hash").to_numpy().view(np.uint64)
            for at in range(0, len(h), 8192):
                for key, side, x, d in f(c, h[at : at + 8192]):
                    yield pa.record_batch([pa.array(key), pa.array(np.full(len(key), side, np.int32)), pa.array(x.view(np.int64)), pa.array(d.astype(np.int64))], names=["key", "side", "hash", "far"])

    return df.select("hash").mapInArrow(run, "key long, side int, hash long, far long")


def _per_cell(df: DataFrame, c: Cells, guests: bool) -> dict[int, tuple[int, int]]:
    """(rows, largest distance) by cell: a row a cell and task travels, at most ``PIVOTS`` come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(len(c.pivots), np.int64), np.zeros(len(c.pivots), np.int64)
        for batch in batches:
            h = batch.column("hash").to_numpy().view(np.uint64)
            for at in range(0, len(h), 8192):
                q, d = c.guests(h[at : at + 8192])[1:] if guests else c.home(h[at : at + 8192])
                n += np.bincount(q, minlength=len(n))
                np.maximum.at(far, q, d)
        yield pa.record_batch([pa.array(np.arange(len(n))), pa.array(n), pa.array(far)], names=["cell", "n", "far"])

    found = df.select("hash").mapInArrow(run, "cell long, n long, far long").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    return {r["cell"]: (r["n"], r["far"]) for r in found.collect()}


def cells(distinct: DataFrame, visitors: DataFrame, radius: int, one_set: bool, pivots: int = PIVOTS) -> Cells:
    """Pivots for residents ``distinct`` and guests ``visitors``, and how their cells are cut. The sample is the hashes of the
    least scrambled value, so reruns agree."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("hash"), "hash").limit(2 * pivots).collect()], np.int64).view(np.uint64)
    probes = sample if one_set else np.array([r[0] for r in visitors.orderBy(F.xxhash64("hash"), "hash").limit(pivots).collect()], np.int64).view(np.uint64)
    n = min(pivots, len(sample), math.isqrt(len(sample) * 16) if one_set else pivots)
    while n > 1:
        c = Cells(sample[:n], radius, one_set)
        c.extent = np.zeros(n, np.int16)
        np.maximum.at(c.extent, *c.home(sample))
        test = probes[n:] if one_set and len(probes) > n else probes
        if len(c.guests(test)[0]) <= 2 * (math.isqrt(tasks) + 1) * max(len(test), 1):
            break
        n //= 2
    c = Cells(sample[:n], radius, one_set)
    if not n:
        return c
    own = _per_cell(distinct, c, False)
    residents = np.array([own.get(q, (0, 0))[0] for q in range(n)])
    c.extent = np.array([own.get(q, (0, 0))[1] if own.get(q, (0, 0))[0] else -radius - 1 for q in range(n)], np.int16)
    guests = _per_cell(visitors, c, True)
    return c.cut(residents, np.array([guests.get(q, (0, 0))[0] for q in range(n)]), tasks)


def _run(c: Cells, residents: DataFrame, visitors: DataFrame, links: bool, counter) -> DataFrame:
    if not len(c.pivots):
        return residents.limit(0).select(F.col("hash").alias("a"), F.col("hash").alias("b"), F.col("hash").alias("distance"))
    dealt = _mapped(residents, residents_out, c).unionByName(_mapped(visitors, guests_out, c))
    tasks = int(residents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "key").sortWithinPartitions("key", "side", "far").mapInArrow(meet(c, links, counter), "a long, b long, distance long")


def within(distinct: DataFrame, radius: int, links: bool = False, counter=None, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, distance) of all pairs of different hashes at most ``radius`` apart, each pair once; ``distinct`` is a table of
    distinct longs ``hash``. With ``links`` only pairs that connect what all pairs connect (distance is then 0). ``counter``, an accumulator, adds up the
    pairs that were compared; without links that is never more than each pair once."""
    return _run(cells(distinct, distinct, radius, True, pivots), distinct, distinct, links, counter)


def between(left: DataFrame, right: DataFrame, radius: int, counter=None, pivots: int = PIVOTS, links: bool = False) -> DataFrame:
    """(a, b, distance): the pairs of a hash of ``right`` (a) and one of ``left`` (b), both tables of distinct longs ``hash``. The
    pivots are hashes of ``right``, best the smaller one. With ``links`` only pairs that connect what all pairs connect (in any order, distance 0)."""
    return _run(cells(right, left, radius, False, pivots), right, left, links, counter)


TURNS, BESIDE = 8, 64  # orders in which hashes are looked at, and how many that follow are compared with each


def beside(distinct: DataFrame, radius: int, turns: int = TURNS, near: int = BESIDE) -> DataFrame:
    """(a, b): some pairs within the radius, found in time that grows with the rows alone: the hashes are sorted by their bits, begun at each of
    ``turns`` places, and each is compared with the ``near`` that follow it in its task."""
    h, n = F.col("hash"), 64 // turns
    turned = F.array(*(F.struct(F.lit(t).alias("turn"), (F.shiftleft(h, n * t).bitwiseOR(F.shiftrightunsigned(h, 64 - n * t)) if t else h).alias("key")) for t in range(turns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_turn, last = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        for batch in batches:
            turn = np.concatenate([last_turn, batch.column("turn").to_numpy()])
            key = np.concatenate([last, batch.column("key").to_numpy().view(np.uint64)])
            found = []
            for step in range(1, min(near, len(key) - 1) + 1):
                found.append(np.flatnonzero((np.bitwise_count(key[step:] ^ key[:-step]) <= radius) & (turn[step:] == turn[:-step])))
            first = np.concatenate([np.zeros(0, np.int64), *found])
            back = (n * turn).astype(np.uint64)
            h = np.where(turn > 0, key >> back | key << (np.uint64(64) - back) % np.uint64(64), key)
            x, y = least_reached(h[first], h[first + np.repeat(np.arange(1, len(found) + 1), [len(f) for f in found])])
            yield pa.record_batch([pa.array(x[x != y].view(np.int64)), pa.array(y[x != y].view(np.int64))], names=["a", "b"])
            last_turn, last = turn[-near:], key[-near:]

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select(F.explode(turned).alias("t")).select("t.turn", "t.key").repartitionByRange(tasks, "turn", "key").sortWithinPartitions("turn", "key")
    return rows.mapInArrow(run, "a long, b long")


def table_of(df: DataFrame, column: str = "phash") -> DataFrame:
    """The distinct hashes of a column, nulls left out, as a written table."""
    return materialise(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("hash")).distinct(), "hashes")
