"""Masks in tiles, the latest event over a stream, background jobs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.backfill import Backfill
from kindred.config import Profile
from kindred.operators import events, kernels, tiles
from kindred.requests import Requests
from kindred.store import Store
from kindred.streaming import state
from tests.test_files import picture, put


@pytest.mark.parametrize("edge", [1, 3, 7, 64])
@pytest.mark.parametrize("least", [1, 4])
def test_tiles_equal_the_flood_fill(spark, edge, least):
    rng = np.random.default_rng(edge)
    masks = {i: (rng.random((rng.integers(1, 24), rng.integers(1, 24))) < p).astype(np.uint8) for i, p in enumerate((0.05, 0.3, 0.45, 0.6, 0.95, 0.0))}
    spiral = np.zeros((21, 21), np.uint8)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[20 - k, k : 21 - k] = spiral[k : 21 - k, k] = spiral[k : 21 - k, 20 - k] = 1
    masks[9] = spiral
    df = spark.createDataFrame([(i, m.shape[1], m.shape[0], bytearray(m.tobytes())) for i, m in masks.items()], "image_id long, width int, height int, bits binary")
    got = sorted(tuple(r) for r in tiles.regions(tiles.tiled(df, edge), least).collect())
    want = sorted((i, int(r["pixels"].min()), len(r["pixels"]), r["x0"], r["y0"], r["x1"], r["y1"]) for i, m in masks.items() for r in kernels.regions(m > 0, least))
    assert got == want and tiles.regions(tiles.tiled(df.limit(0)), 1).count() == 0


def test_latest_events_of_a_stream(spark, tmp_path):
    """Equal to the batch form after any split into batches; late and tied events included; state leaves in time."""
    kinds = ["prepared", "recycled", "restored", "operation_failed"]
    rows = [(i * 13 % 7, kinds[i * 5 % 4], i * 37 % 50, i) for i in range(120)]
    path = str(tmp_path / "events")
    for part in range(4):
        spark.createDataFrame(rows[part::4], "result_id long, operation_type string, created_at long, id long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("result_id long, operation_type string, created_at long, id long").option("maxFilesPerTrigger", 1).parquet(path)
    seen = []
    query = state.latest_events(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n: seen.append((n, df.collect()))).start()
    query.awaitTermination()
    last = {}
    for _, found in sorted(seen):
        for r in found:
            assert r["result_id"] not in last or (r["created_at"], r["id"]) > last[r["result_id"]][1:]
            last[r["result_id"]] = (r["operation_type"], r["created_at"], r["id"])
    want = {r["result_id"]: (r["operation_type"], r["created_at"], r["id"]) for r in events.latest(spark.read.parquet(path)).collect()}
    assert len(seen) >= 4 and last == want


def test_backfill_gives_way_and_resumes(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for k in range(6):
        put(f"{a}/big{k}.png", picture(k, 96, 72))
        put(f"{b}/small{k}.png", kernels.resize(picture(k, 96, 72), 48, 36))
    store = Store(spark, f"file://{tmp_path / 'store'}", profile=Profile(max_distance=12))
    run_id, run = store.compare(a, [b], "run-1")
    from kindred import pipeline

    members = pipeline.groups(run, 8)
    n = members.groupBy("group_index").count().filter("count > 1").count()
    assert n >= 3
    requests = Requests(spark)
    jobs = Backfill(store, requests, part=2)
    with jobs.foreground():
        first = jobs.start(run_id, run, members, 8)
        assert jobs.start(run_id, run, members, 8) == first  # one job a (run, distance)
        time.sleep(1)
        assert store.group_statuses(run_id, members).filter("status = 'pending'").count() == n  # nothing runs meanwhile
    time.sleep(1.5)
    with jobs.foreground():
        assert spark.range(10).agg(F.sum("id")).first()[0] == 45
    assert jobs.wait(run_id, 8, 240)
    assert requests.progress(first)["status"] == "completed"
    assert store.group_statuses(run_id, members).filter("status = 'pending'").count() == 0
    assert store.group_scores(run_id, members).count() >= n
    second = jobs.start(run_id, run, members, 8)
    assert second != first and jobs.wait(run_id, 8, 120)
