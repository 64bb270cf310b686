"""Later runs reuse what earlier ones know; counters add up and are read while jobs run."""

import os
import threading
import time

import pytest

from kindred import pipeline
from kindred.cache import Cache
from kindred.config import Profile
from kindred.operators import kernels
from kindred.progress import Counters
from kindred.requests import Requests
from kindred.store import Store
from tests.test_files import picture, put

PROFILE = Profile(max_distance=12, score_scope="all")


@pytest.fixture
def folders(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(f"{a}/big.png", picture(1, 96, 72))
    put(f"{a}/two.png", picture(2))
    put(f"{b}/copy.png", picture(2))
    put(f"{b}/deep/small.png", kernels.resize(picture(1, 96, 72), 48, 36))
    put(f"{b}/broken.png", b"no image")
    return a, b


def outcome(run):
    names = {r["image_id"]: os.path.basename(r["path"]) for r in run.images.collect()}
    return {(names[r["image_id"]], r["analysis_type"], names.get(r["primary_id"]), r["score"]) for r in run.results.collect()}


def test_a_second_run_decodes_and_scores_nothing(spark, folders, tmp_path):
    a, b = folders
    store = Store(spark, f"file://{tmp_path / 'store'}", profile=PROFILE)
    counts = [Counters(spark) for _ in range(4)]
    plain = pipeline.compare(spark, a, [b], PROFILE, counters=counts[0])
    first = store.compare(a, [b], "one", counters=counts[1])[1]
    second = store.compare(a, [b], "two", counters=counts[2])[1]
    assert outcome(plain) == outcome(first) == outcome(second) and second.errors.count() == 1
    one, two = counts[1].values(), counts[2].values()
    assert one["decoded"] >= 4 and one["computed"] == one["total"] > 0 and one["hits"] == 0
    assert two["decoded"] == two["resized"] == two["computed"] == 0 and two["hits"] == two["total"] == one["total"]
    put(f"{b}/deep/small.png", kernels.resize(picture(1, 96, 72), 52, 39))
    os.utime(f"{b}/deep/small.png", (1, 1))
    third = store.compare(a, [b], "three", counters=counts[3])[1]
    now = counts[3].values()
    assert outcome(third) == outcome(pipeline.compare(spark, a, [b], PROFILE))
    assert now["computed"] + now["hits"] == now["total"] and now["computed"] > 0
    assert now["decoded"] == 1 + 2 * (now["computed"] > 0)  # the changed file's features, then the pair's two images
    assert store.compare(a, [b], "four", cache=None)[1].cache is None


def test_scores_are_kept_by_content(spark, folders, tmp_path):
    """A copy under another name hits the score of its content; failures are not kept."""
    cache = Cache(spark, f"file://{tmp_path / 'cache'}")
    images = spark.createDataFrame([(1, "x", 10, 10), (2, "y", 10, 10), (3, "x", 10, 10), (4, None, 10, 10)], "image_id long, digest string, width int, height int")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "c_id long, b_id long")
    scored = cache.with_scores(pairs.limit(0), images, 900)
    assert scored.count() == 0
    cache.keep_scores(spark.createDataFrame([("x", "y", 0.5), ("x", "z", None)], "low string, high string, score double"), 900)
    got = {(r["c_id"], r["b_id"]): r["score"] for r in cache.with_scores(pairs, images, 900).collect()}
    assert got == {(1, 2): 0.5, (2, 3): 0.5, (1, 4): None}
    assert {r["score"] for r in cache.with_scores(pairs, images, 1600).collect()} == {None} and cache.read("scores").count() == 1


def test_counters_are_read_while_jobs_run(spark):
    requests, seen, go = Requests(spark), [], threading.Event()

    def slow(batches):
        for b in batches:
            time.sleep(0.3)
            count["computed"].add(len(b))
            yield b

    def work(check):
        nonlocal count
        count = check.counters
        count.add(total=40)
        go.set()
        return spark.range(0, 40, 1, 20).mapInPandas(slow, "id long").count()

    count = None
    t = threading.Thread(target=lambda: requests.run("scan", work, "r1"))
    t.start()
    go.wait()
    while t.is_alive():
        seen.append(requests.progress("r1")["counters"])
        time.sleep(0.1)
    t.join()
    last = requests.progress("r1")["counters"]
    assert last["total"] == last["processed"] == last["computed"] == 40 and last["skipped"] == 0
    assert any(0 < s["processed"] < 40 for s in seen)
