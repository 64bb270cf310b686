import hashlib
import math

import numpy as np
import pytest

from kindred.llm import centroids as ce


def brute(rows, k=ce.CENTROIDS, rounds=ce.ROUNDS):
    """Plain rounds with Python's integers. rows: (vec_id, list); gives (vec_id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for j in range(len(c)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(i, nearest(v), far(v, c[nearest(v)])) for i, v in kept], c


def odd_vectors():
    """Blobs, ties, repeats, extremes, and rows that are left out."""
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (6, 64))
    rows = [(i, (middle[i % 6] + rng.normal(0, 0.05, 64)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.0] * 64) for i in range(30)] + [(2000 + i, [float(i % 2)] + [0.0] * 63) for i in range(20)]
    rows += [rows[0], rows[1], (None, [1.0] * 64), (None, [-1.0] * 64), (7000, [-1e-9] * 64), (7001, [900.0] + [0.0] * 63)]
    return rows + [(9000, None), (9001, []), (9002, [0.0] * 63), (9003, [0.0] * 65), (9004, [None] + [0.0] * 63), (9005, [float("nan")] + [0.0] * 63), (9006, [float("-inf")] + [0.0] * 63)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, own int, upper double").repartition(5)


def test_clusters_against_plain_rounds(spark):
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in odd_vectors()]
    out, c = ce.cluster(table(spark, rows))
    want, centres = brute(rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:3] for r in out.collect()), key=key) == sorted(want, key=key)
    assert c.tolist() == centres


def test_the_bounds_save_scans_and_change_nothing(spark, monkeypatch):
    """Separate blobs are scanned once and hardly again; without bounds every round scans all."""
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 3, (40, 64))
    rows = [(i, (middle[i % 40] + rng.normal(0, 0.01, 64)).tolist()) for i in range(800)]
    out = ce.cluster(table(spark, rows))[0].collect()
    scans = sum(r["scans"] for r in out)
    assert 800 <= scans < 0.5 * 800 * (ce.ROUNDS + 1)
    v = np.array([r[1] for r in rows])
    state = np.zeros(800, np.int32), np.zeros(800), np.zeros(800)
    c = np.floor(256 * v[:40]).astype(np.int64)
    to = ce.Moved(c + 1, c)
    whole = np.floor(256 * v).astype(np.int64)
    own, near, second = ce.scan(whole, c)
    after = to.step(whole, own, ce.above(near), ce.below(second))
    assert (after[0] == ce.scan(whole, c + 1)[0]).all() and len(after[3]) < 800
    loose = to.step(whole, state[0], np.full(800, np.inf), np.zeros(800))
    assert (loose[0] == after[0]).all() and len(loose[3]) > len(after[3])


def test_bounds_hold_after_many_moves():
    """Upper and lower bounds are never passed by the true distances, whatever the centroids do."""
    rng = np.random.default_rng(9)
    v = rng.integers(-40, 40, (500, 8))
    c = v[:12].copy()
    own, near, second = ce.scan(v, c)
    upper, lower = ce.above(near), ce.below(second)
    for r in range(30):
        before, c = c, c + rng.integers(-(r % 5), r % 5 + 1, c.shape)
        own, upper, lower, _ = ce.Moved(c, before).step(v, own, upper, lower)
        d = np.sort(np.sqrt(ce.distances(v, c)), axis=1)
        assert (own == ce.distances(v, c).argmin(1)).all()
        assert (upper >= d[:, 0]).all() and (lower <= d[:, 1]).all()


def test_integers_and_doubles_give_equal_distances():
    rng = np.random.default_rng(4)
    v, c = rng.integers(-(2**20), 2**20, (50, 64)), rng.integers(-(2**26), 2**26, (5, 64))
    exact = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in c] for a in v]
    assert ce.distances(v, c).tolist() == exact
    assert ce.distances(v, v[:3]).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in v[:3]] for a in v]


def test_few_or_no_vectors_and_huge_ones(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    out, c = ce.cluster(table(spark, rows))
    assert len(c) == 5 and sorted(tuple(r)[:3] for r in out.collect()) == sorted(brute(rows)[0])
    none, c = ce.cluster(table(spark, [(1, None)]))
    assert none.collect() == [] and len(c) == 0
    with pytest.raises(OverflowError):
        ce.cluster(table(spark, [(1, [1e9] * 64)]))


def test_op13_columns(spark, tmp_path):
    rows = [(i, v) for i, v in odd_vectors() if i is not None]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, centres = brute(rows)
    inertia = {}
    for _, j, d in want:
        inertia[j] = inertia.get(j, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    got = sorted(tuple(r) for r in ce.op13_centroid_clustering(spark, str(tmp_path)).collect())
    assert got == sorted((i, j, d, inertia[j], sum(inertia.values()), names[j]) for i, j, d in want)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert ce.op13_centroid_clustering(spark, f"{tmp_path}/none").count() == 0
