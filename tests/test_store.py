"""The store over real folders: runs, operations, scored groups; requests, single files."""

import base64
import csv
import datetime
import json
import os
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from kindred import pipeline
from kindred.config import Profile
from kindred.functions import measures, nested
from kindred.operators import events, kernels
from kindred.requests import Cancelled, Requests
from kindred.sources import images, listing
from kindred.store import NotFound, Store, new_run_id
from tests.test_files import picture, put


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("world")
    a, b = str(top / "a"), str(top / "b")
    put(f"{a}/big.png", picture(1, 96, 72))
    put(f"{a}/two.png", picture(2))
    put(f"{b}/copy.png", picture(2))
    put(f"{b}/again.png", picture(2))
    put(f"{b}/deep/small.png", kernels.resize(picture(1, 96, 72), 48, 36))
    put(f"{b}/broken.png", b"no image")
    store = Store(spark, f"file://{top / 'store'}", str(top / "trash"), Profile(max_distance=12))
    run_id, run = store.compare(a, [b], "run-1")
    return store, run_id, run, a, b


def results_by_name(store, run_id):
    i = store.read("images", run_id).select("image_id", "path")
    return {os.path.basename(r["path"]): r["result_id"] for r in store.read("results", run_id).join(i, "image_id").collect()}


def test_run_ids():
    assert re.fullmatch(r"20240102-030405-[0-9a-f]{8}", new_run_id(datetime.datetime(2024, 1, 2, 3, 4, 5)))
    assert new_run_id() != new_run_id()


def test_run_log(world):
    store, run_id, run, a, _ = world
    s = store.status(run_id)
    assert s["status"] == "completed_with_errors" and s["created_at"] <= s["started_at"] <= s["completed_at"]
    assert (s["baseline_total"], s["comparison_total"], s["error_count"], s["baseline"]) == (2, 3, 1, a)
    assert store.read("images", run_id).count() == 5 and store.read("results", run_id).count() == 3
    assert {(r["role"], r["label"], r["file_count"]) for r in store.folders(run_id).collect()} == {("baseline", "a", 2), ("comparison", "b", 2), ("comparison", "deep", 1)}
    with pytest.raises(NotFound):
        store.status("none")
    with pytest.raises(ValueError):
        store.set_status(run_id, "no status")
    with pytest.raises(ValueError):
        store.start(a, [a], run_id)
    with pytest.raises(ValueError):
        store.start(a, [a], "../other")


def test_reports_of_a_stored_run(spark, world, tmp_path):
    """All three files from stored tables, by another session's store; conserved; reviews and actions show."""
    store, run_id, run, a, b = world
    other = Store(spark, store.root, profile=store.profile)
    ids = results_by_name(store, run_id)
    other.review(run_id, [ids["copy.png"], ids["again.png"]], "pending")
    other.review(run_id, [ids["copy.png"]], "approved_for_recycle")
    with pytest.raises(ValueError):
        other.review(run_id, [ids["copy.png"]], "maybe")
    with pytest.raises(NotFound):
        other.review(run_id, [10**9], "pending")
    rows = {os.path.basename(r["comparison_path"]): r for r in other.results(run_id).collect()}
    assert sorted(r["position"] for r in rows.values()) == [1, 2, 3] and rows["small.png"]["position"] == 3
    assert rows["copy.png"]["analysis_type"] == "exact_duplicate" and rows["copy.png"]["primary_path"] == "two.png" and rows["copy.png"]["review_status"] == "approved_for_recycle"
    small = rows["small.png"]
    assert small["resolution_ratio"] == 0.25 and small["smaller_resolution"] and small["review_status"] is None and small["action_status"] == "none"
    assert other.results(run_id, "exact_duplicate").count() == 2
    s = other.stats(run_id)
    assert (s["baseline_total"], s["comparison_total"], s["analysed"], s["classified"], s["exact_duplicate"], s["error_count"]) == (2, 3, 3, 3, 2, 1)
    assert s["conserved"] and (s["review_pending"], s["review_approved_for_recycle"]) == (1, 1)
    detail = other.result(run_id, ids["small.png"])
    assert detail["primary_path"] == "big.png" and detail["score"] > 0.9 and detail["operations"] == []
    with pytest.raises(NotFound):
        other.result(run_id, 10**9)
    out = str(tmp_path)
    names = other.write_reports(run_id, out)
    doc = json.load(open(names[0]))
    assert doc["header"]["run_id"] == run_id and sum(doc["stats"].values()) == 3 and len(doc["results"]) == 3
    lines = list(csv.DictReader(open(names[1])))
    assert len(lines) == 3 and {x["reviewStatus"] for x in lines} == {"approved_for_recycle", "pending", "N/A"}
    assert "small.png" in open(names[2]).read()
    with pytest.raises(NotFound):
        other.write_reports("none", out)


def test_saved_settings(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path / 'store'}")
    assert store.settings()["default_phash_max_distance"] == 10 and store.saved_profile() == store.profile
    store.save_settings(default_phash_max_distance=12, max_candidate_per_image=7)
    store.save_settings(default_phash_max_distance=6, default_variant_review_lower_bound="nothing")
    again = Store(spark, store.root)
    assert again.settings()["default_phash_max_distance"] == 6 and again.settings()["default_variant_review_lower_bound"] == 0.75
    assert (again.saved_profile().max_distance, again.saved_profile().top_k) == (6, 7)
    with pytest.raises(ValueError):
        store.save_settings(no_such=1)


def test_failed_runs_and_history_and_delete(world):
    store, run_id, _, a, b = world
    with pytest.raises(ValueError):
        store.compare(a, [a], "bad")
    assert store.status("bad")["status"] == "failed" and store.status("bad")["completed_at"]
    other = store.start(a, [b], "empty-run")
    rows = {r["run_id"]: r for r in store.history().collect()}
    assert list(rows) == ["empty-run", "bad", run_id]
    assert (rows[run_id]["comparison_total"], rows[run_id]["result_count"], rows[other]["comparison_total"]) == (3, 3, 0)
    assert store.history(1).count() == 1
    for gone in (other, "bad"):
        store.delete(gone)
    assert [r["run_id"] for r in store.history().collect()] == [run_id] and store.read("images").count() == 5
    with pytest.raises(NotFound):
        store.delete(other)


def test_recycle_restore_purge(world):
    store, run_id, _, a, b = world
    ids = results_by_name(store, run_id)
    copy, again, small = ids["copy.png"], ids["again.png"], ids["small.png"]
    with pytest.raises(NotFound):
        store.recycle(run_id, [copy, 10**6])
    assert store.restore(run_id, [copy]) == {copy: (False, "can't follow none")}
    put(f"{b}/deep/small.png", b"changed")
    out = store.recycle(run_id, [copy, again, small])
    assert out[copy][0] and out[again][0] and out[small] == (False, "size")
    put(f"{b}/deep/small.png", kernels.resize(picture(1, 96, 72), 48, 36))
    assert not os.path.exists(f"{b}/copy.png") and os.path.exists(f"{b}/deep/small.png")
    assert store.recycle(run_id, [copy])[copy] == (False, "can't follow recycled")
    log = store.read("operations", run_id)
    assert [r["operation_type"] for r in log.filter(F.col("result_id") == copy).orderBy("id").collect()] == ["prepared", "recycled"]
    assert events.transitions(log).filter("not legal").isEmpty() and log.filter(F.col("result_id") == small).isEmpty()
    assert store.active_images(run_id).count() == 3
    put(f"{b}/copy.png", b"another")
    assert not store.restore(run_id, [copy])[copy][0]
    os.remove(f"{b}/copy.png")
    assert store.restore(run_id, [copy])[copy] == (True, "") and os.path.exists(f"{b}/copy.png")
    assert store.purge(run_id, [copy])[copy] == (False, "can't follow restored")
    assert store.purge(run_id, [again])[again] == (True, "") and not [f for _, _, fs in os.walk(store.trash) for f in fs]
    state = {r["result_id"]: r["operation_type"] for r in events.latest(store.read("operations", run_id)).collect()}
    assert state == {copy: "restored", again: "permanently_deleted"}


def test_missing_match_stops_a_recycle(world):
    store, run_id, _, a, b = world
    copy = results_by_name(store, run_id)["copy.png"]
    os.rename(f"{a}/two.png", f"{a}/two.gone")
    try:
        assert store.recycle(run_id, [copy])[copy] == (False, "primary_missing")
    finally:
        os.rename(f"{a}/two.gone", f"{a}/two.png")
    with pytest.raises(ValueError):
        Store(store.spark, store.root).recycle(run_id, [copy])


def test_scores_of_groups_are_kept(spark, world):
    store, run_id, run, a, b = world
    members = pipeline.groups(run, 8)
    before = {r["group_index"]: (r["n"], r["status"]) for r in store.group_statuses(run_id, members).collect()}
    assert {s for n, s in before.values() if n > 1} == {"pending"} and {s for n, s in before.values() if n < 2} <= {"completed"}
    first = store.fill_groups(run_id, run, members, most=1)
    done = [r["status"] for r in store.group_statuses(run_id, members).filter("n > 1").collect()]
    assert sorted(done) == sorted(["completed"] + ["pending"] * (len(done) - 1))
    rest = store.fill_groups(run_id, run, members)
    assert {r["status"] for r in store.group_statuses(run_id, members).collect()} == {"completed"}
    assert store.fill_groups(run_id, run, members).isEmpty()
    key = lambda df: {(r["left_id"], r["right_id"], r["score"]) for r in df.collect()}
    assert key(store.group_scores(run_id, members)) == key(first) | key(rest) == key(pipeline.group_scores(run, members))
    now = members.select("path", F.col("file_size").alias("size"), F.when(F.col("path").endswith("small.png"), F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    touched = members.filter("path like '%small.png'").first()["group_index"]
    status = lambda files, running=None: {r["group_index"]: r["status"] for r in store.group_statuses(run_id, members, files, running).filter("n > 1").collect()}
    assert {g for g, s in status(now).items() if s == "pending"} == {touched} and status(now, touched)[touched] == "running"
    assert status(now.filter("path not like '%small.png'"))[touched] == "pending"
    real = listing.scan(spark, a).unionByName(listing.scan(spark, b))
    assert set(status(real)) == set(status(now))




def test_score_lists(spark):
    rows = [([(1, 2, 0.5, None)], True, True), ([(1, 2, None, "e")], False, False), ([(1, 2, 0.5, None), (2, 1, 0.5, None)], True, False), ([(1, 9, 0.5, None)], True, False), ([(1, 1, 0.5, None)], True, False), ([], True, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s array<struct<left:long,right:long,score:double,error:string>>, complete boolean, valid boolean")
    got = df.select("complete", "valid", nested.scores_complete(F.col("s")).alias("c"), nested.scores_valid(F.col("s"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("v"))
    assert all((r["complete"], r["valid"]) == (r["c"], r["v"]) for r in got.collect())


def test_size_labels(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 1152: "1.13 KB", 1048576: "1.00 MB", 5 * 2**30: "5.00 GB"}
    df = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", measures.size_label(F.col("s")).alias("l"))
    assert {r["s"]: r["l"] for r in df.collect()} == sizes


def test_single_files(spark, tmp_path):
    p, q = str(tmp_path / "p.png"), str(tmp_path / "q.png")
    put(p, picture(1, 300, 150))
    put(q, picture(1, 300, 150))
    row = images.load_single(spark, p).first()
    assert (row["width"], row["height"], row["file_name"], row["phash"]) == (300, 150, "p.png", kernels.phash(picture(1, 300, 150)))
    assert kernels.read_png(base64.b64decode(row["thumbnail"].split(",")[1])).shape[:2] == (100, 200)
    side = lambda f: (f, os.stat(f).st_size, os.stat(f).st_mtime_ns // 10**6)
    got = images.measure_pair(spark, side(p), side(q))
    assert got["score"] == pytest.approx(1.0) and got["distance"] == 0
    old = side(q)
    put(q, picture(3))
    with pytest.raises(images.FileChanged):
        images.measure_pair(spark, side(p), old)
    with pytest.raises(ValueError):
        images.load_single(spark, str(tmp_path))
    put(q, b"none")
    assert images.load_single(spark, q).first()["error"]
    with pytest.raises(ValueError):
        images.measure_pair(spark, side(p), side(q))


def test_requests(spark):
    r = Requests(spark)
    assert r.run("count", lambda check: spark.range(100).count(), "one") == 100
    p = r.progress("one")
    assert p["status"] == "completed" and p["jobs"] >= 1 and p["percent"] == 100
    assert not r.cancel("one") and not r.cancel("unknown")
    r.forget("one")
    with pytest.raises(KeyError):
        r.progress("one")
    with pytest.raises(ZeroDivisionError):
        r.run("count", lambda check: 1 // 0, "bad")
    assert r.progress("bad")["status"] == "failed"
    seen = []

    def slow(check):
        wait = F.udf(lambda x: (time.sleep(0.2), x)[1], "long")
        seen.append("started")
        return spark.range(0, 4000, 1, 4).select(F.sum(wait("id"))).collect()

    def in_thread():
        try:
            r.run("score", slow, "old")
        except Cancelled:
            seen.append("cancelled")

    t = threading.Thread(target=in_thread)
    t.start()
    while not seen or not r.progress("old")["jobs"]:
        time.sleep(0.05)
    assert r.run("score", lambda check: spark.range(10).count(), "new") == 10  # cancels the old one
    t.join(60)
    assert not t.is_alive() and seen == ["started", "cancelled"] and r.progress("old")["status"] == "cancelled"
