"""Centroid clustering of vectors in whole numbers, with Hamerly bounds.

A vector's components become integers, so that distances, sums and centroids are exact and reruns agree on any layout.
Each vector keeps one upper bound of the distance to its own centroid and one lower bound of the distance to the
second-nearest. When centroids have moved, the bounds are loosened by the drift (the own centroid's, and the largest of
the others). A vector stays where it is without a look at the other centroids if its upper bound is below its lower bound
or below half the way from its centroid to the nearest other one; if not, the upper bound is measured anew; what is
still ambiguous gets a full scan over all centroids, in exact integers, where the smaller number wins a tie. Bounds are
rounded outwards and compared strictly, so neither rounding nor a tie changes a result.

One pass over the vectors is one round. Its state is a written table, so a lost executor costs a part of one round.
Centroids, and the sums that replace them, are as many as asked for; only they reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialise, tidily
from kindred.scratch import discard

WIDTH, SCALE, SEED = 64, 256, 2
CENTROIDS, ROUNDS = 40, 5
#: Integers up to this size have squared distances over 64 components that a long holds.
LARGEST = 1 << 27
ROWS = 4096  # vectors that are compared with all centroids at once


def vectors(table: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v (``width`` integers) of the vectors that have ``width`` components, none null, NaN or infinite."""
    x = F.col("embedding")
    whole = (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return table.filter(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def seed_order(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``v`` to all centroids. Doubles hold the whole numbers as long as they stay below
    2**53, and their products are much faster; larger components are counted in integers."""
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * v.shape[1] * largest * largest < 2**53:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(v), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = ((v - c) ** 2).sum(1)
    return out


def above(squared: np.ndarray) -> np.ndarray:
    """A bound that the root of an exact square does not exceed."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf) * (1 + 1e-12)


def below(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)), 0) * (1 - 1e-12)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, its squared distance, that of the second-nearest) by full scans."""
    own, near, second = np.empty(len(v), np.int32), np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for at in range(0, len(v), ROWS):
        d = distances(v[at : at + ROWS], centroids)
        k, i = d.argmin(1), np.arange(len(d))
        own[at : at + ROWS], near[at : at + ROWS] = k, d[i, k]
        d[i, k] = np.iinfo(np.int64).max
        second[at : at + ROWS] = d.min(1)
    return own, near, second


class Moved:
    """What a round has to know of its centroids: where they are, how far they went, how far apart they lie."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        apart = distances(centroids, centroids)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.half = below(apart.min(1)) / 2
        self.drift = np.zeros(len(centroids)) if before is None else above(((centroids - before) ** 2).sum(1))
        order = np.argsort(-self.drift, kind="stable")
        self.others = np.full(len(centroids), self.drift[order[0]])
        self.others[order[0]] = self.drift[order[1]] if len(order) > 1 else 0.0

    def step(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(centroid, upper, lower, which were scanned) after the move."""
        own, upper, lower = own.copy(), (upper + self.drift[own]) * (1 + 1e-12), np.maximum(lower - self.others[own], 0) * (1 - 1e-12)
        safe = np.maximum(lower, self.half[own])
        open_ = np.flatnonzero(upper >= safe)
        upper[open_] = above(((v[open_] - self.centroids[own[open_]]) ** 2).sum(1))
        open_ = open_[upper[open_] >= safe[open_]]
        own[open_], near, second = scan(v[open_], self.centroids)
        upper[open_], lower[open_] = above(near), below(second)
        return own, upper, lower, open_


def _matrix(column) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


STATE = "vec_id long, v array<int>, own int, upper double, lower double, scans int"


def started(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The first assignment: every vector is scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            if np.abs(v).max(initial=0) > LARGEST:
                raise OverflowError(f"components beyond {LARGEST} have no squared distance that a long holds")
            own, near, second = scan(v, centroids)
            yield _state(batch.column("vec_id"), pa.ListArray.from_arrays(batch.column("v").offsets, batch.column("v").values.cast(pa.int32())), own, above(near), below(second), np.ones(len(v), np.int32))

    return kept.mapInArrow(tidily(run), STATE)


def _state(vec_id, v, own, upper, lower, scans) -> pa.RecordBatch:
    return pa.record_batch([vec_id, v, pa.array(own, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())], names=["vec_id", "v", "own", "upper", "lower", "scans"])


def moved(state: DataFrame, centroids: np.ndarray, before: np.ndarray) -> DataFrame:
    """The state after the centroids went from ``before`` to where they are."""
    to = Moved(centroids, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            own, upper, lower, scanned = to.step(v, *(batch.column(c).to_numpy() for c in ("own", "upper", "lower")))
            scans = batch.column("scans").to_numpy().copy()
            scans[scanned] += 1
            yield _state(batch.column("vec_id"), batch.column("v"), own, upper, lower, scans)

    return state.mapInArrow(tidily(run), STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floors of the clusters' exact means; an empty cluster keeps its centroid. Sums are made by the tasks
    first, so a cluster of any size sends one row a task."""
    width = centroids.shape[1]
    sums = state.groupBy("own").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)))
    out = centroids.copy()
    for row in sums.collect():
        out[row["own"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def with_distance(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, scans and the exact squared distance to the own centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            d = ((_matrix(batch.column("v")) - centroids[own]) ** 2).sum(1)
            yield pa.record_batch([batch.column("vec_id"), batch.column("own"), pa.array(d), batch.column("scans")], names=["vec_id", "cluster", "distance", "scans"])

    return state.mapInArrow(tidily(run), "vec_id long, cluster int, distance long, scans int")


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, scans of each kept row; the centroids). ``table`` has vec_id and embedding.

    Null or short vectors and those with a null, NaN or infinite component are left out. Centroids start as the ``k``
    vectors of the least hash of seed and id (equal ids: the lesser vector); with fewer vectors there are fewer
    centroids, with none there are no rows. Repeated rows are vectors of their own, a null vec_id counts as the empty text
    in the hash. Further columns are not looked at. ``scans`` is how often a row was compared with all centroids.
    Components whose integers exceed ``LARGEST`` have no distance that a long holds, and raise OverflowError.
    """
    kept = vectors(table, width, scale)
    first = kept.withColumn("_hash", seed_order(F.col("vec_id"), seed)).orderBy("_hash", "v").limit(k).select("v").collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("scans")), np.zeros((0, width), np.int64)
    centroids = np.array([r["v"] for r in first], np.int64)
    if np.abs(centroids).max() > LARGEST:
        raise OverflowError(f"components beyond {LARGEST} have no squared distance that a long holds")
    state = materialise(started(kept, centroids), "assigned")
    for _ in range(rounds):
        before, centroids = centroids, means(state, centroids)
        last, state = state, materialise(moved(state, centroids, before), "assigned")
        discard(last)
    return with_distance(state, centroids), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    out, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()  # a row a centroid
    whole = sum(r["n"] for r in each)
    known = [(r["cluster"], r["n"], whole, digest(centroids[r["cluster"]])) for r in each]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same rows for DuckDB: plain rounds, each with all distances."""
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {WIDTH} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE))))",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, v AS c FROM kept ORDER BY sha256('{SEED}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT vec_id, v, cluster, {far} AS d FROM kept, c{r}) GROUP BY vec_id, v)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT cluster, list(s ORDER BY i) AS c FROM (SELECT cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS s FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))")
    return f"WITH {', '.join(parts)} SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"


ORACLE_SQL = oracle_sql()
