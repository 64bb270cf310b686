"""Real files: scans, runs, searches, reports, file operations, streams."""

import csv
import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import pipeline
from kindred.config import Profile
from kindred.operators import fileops, kernels
from kindred.sources import images, listing, sinks
from kindred.streaming import ingest


def picture(seed, w=48, h=36):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    a = np.stack([(x * (3 + seed) + y * 5) % 256, (x * y // (2 + seed)) % 256, (x + y * (7 + 2 * seed)) % 256], axis=2)
    return a.astype(np.uint8)


def put(path, image):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(image if isinstance(image, bytes) else kernels.png(image))


@pytest.fixture
def roots(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(f"{a}/one.png", picture(1))
    put(f"{a}/two.png", picture(2))
    put(f"{b}/copy.png", picture(1))
    put(f"{b}/deep/other.PNG", picture(9))
    put(f"{b}/broken.png", b"no image")
    put(f"{b}/.git/x.png", picture(3))
    put(f"{b}/note.txt", b"text")
    return a, b


def test_scan(spark, roots):
    _, b = roots
    names = {os.path.basename(r["path"]) for r in listing.scan(spark, b).collect()}
    assert names == {"copy.png", "other.PNG", "broken.png"}


def test_decoding_agrees_with_the_kernels(spark, roots):
    a, b = roots
    rows = {os.path.basename(r["path"]): r for r in images.features(images.decoded(spark, b)).collect()}
    assert rows["copy.png"]["phash"] == kernels.phash(picture(1)) and (rows["copy.png"]["width"], rows["copy.png"]["height"]) == (48, 36)
    assert rows["broken.png"]["error"] and rows["broken.png"]["phash"] is None
    assert rows["copy.png"]["color_type"] == "Rgb8" and rows["other.PNG"]["format"] == "png"


def test_run(spark, roots):
    a, b = roots
    run = pipeline.compare(spark, a, [b], Profile(max_distance=4))
    paths = {r["image_id"]: os.path.basename(r["path"]) for r in run.images.collect()}
    got = {paths[r["image_id"]]: r for r in run.results.collect()}
    assert got["copy.png"]["analysis_type"] == "exact_duplicate" and got["copy.png"]["score"] == 1.0
    assert got["other.PNG"]["analysis_type"] in ("no_baseline_match", "variant", "similar_keep")
    assert run.errors.count() == 1 and len(got) == 2
    members = pipeline.groups(run, 2).collect()
    assert len(members) == 4 and sum(m["member_role"] == "reference" for m in members) >= 2


def test_internal_run(spark, tmp_path):
    a = str(tmp_path / "a")
    put(f"{a}/x.png", picture(1, 16, 16))
    put(f"{a}/y.png", picture(5, 16, 16))
    run = pipeline.compare(spark, a, [a], allow_internal=True)
    assert run.images.count() == 2 and run.results.count() == 2
    with pytest.raises(ValueError):
        pipeline.compare(spark, a, [a])


def test_scored_candidates(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(f"{a}/big.png", picture(1, 96, 72))
    put(f"{b}/small.png", kernels.resize(picture(1, 96, 72), 48, 36))
    run = pipeline.compare(spark, a, [b], Profile(max_distance=12, score_scope="all"))
    (row,) = run.results.collect()
    assert row["score"] is not None and row["score"] > 0.99


def test_originals_of_groups(spark, tmp_path):
    """Small copies of a picture become thumbnails of the large one, by their cross-check score."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(f"{a}/big.png", picture(1, 96, 72))
    put(f"{b}/small.png", kernels.resize(picture(1, 96, 72), 48, 36))
    put(f"{b}/other.png", picture(9, 96, 72))
    run = pipeline.compare(spark, a, [b], Profile(max_distance=12))
    names = {r["image_id"]: os.path.basename(r["path"]) for r in run.images.collect()}
    members = pipeline.groups(run, 8)
    scores = pipeline.group_scores(run, members)
    (pair,) = scores.collect()
    assert {names[pair["left_id"]], names[pair["right_id"]]} == {"big.png", "small.png"} and pair["score"] > 0.99 and pair["error"] is None
    first, thumbnails = pipeline.originals(run, members, scores)
    assert sorted(names[r["image_id"]] for r in first.collect()) == ["big.png", "other.png"]
    (thumb,) = thumbnails.collect()
    assert (names[thumb["image_id"]], names[thumb["original_id"]], thumb["way"]) == ("small.png", "big.png", 0) and thumb["similarity"] == pair["score"]
    small = run.images.filter("path like '%small.png'").select("image_id")
    first, _ = pipeline.originals(run, members, scores, manual_originals=small)
    assert {names[r["image_id"]]: r["source"] for r in first.collect()}["small.png"] == "manual"


def test_search(spark, roots):
    a, b = roots
    found = {os.path.basename(r["t_relative_path"]): r["classification"] for r in pipeline.search(spark, [a], [b]).collect()}
    assert found["copy.png"] == "exact"
    with pytest.raises(ValueError):
        pipeline.search(spark, [], [b])


def test_discovery_and_preflight(spark, roots, tmp_path):
    a, b = roots
    files, errors = listing.discover(spark, [str(tmp_path), a, str(tmp_path / "none")])
    assert len(errors) == 1 and files.count() == 5  # hidden folders are not listed
    assert listing.discover(spark, [])[0] is None
    assert listing.preflight(a, [b])[0] == []
    assert listing.preflight(a, [])[0] and listing.preflight(a, [a])[0] and listing.preflight(str(tmp_path), [a])[0]
    assert listing.preflight(a, [a], allow_internal=True)[0] == []


def test_reports(spark, roots, tmp_path):
    results = spark.createDataFrame([(1, "variant"), (2, "exact_duplicate")], "image_id long, analysis_type string")
    report = results.select("image_id", F.concat(F.lit("x/"), F.col("image_id").cast("string"), F.lit("<.png")).alias("comparison_path"), "analysis_type", F.lit(None).cast("long").alias("primary_id"), F.lit(None).cast("string").alias("primary_path"), F.lit(3).alias("phash_distance"), F.lit(0.5).alias("score"), *(F.lit(None).cast("double").alias(c) for c in ("size_ratio", "resolution_ratio", "aspect_diff")), F.lit(True).alias("smaller_resolution"), F.lit(False).alias("smaller_filesize"), F.lit(None).cast("string").alias("review_status"), F.lit("none").alias("action_status"))
    out = str(tmp_path)
    paths = sinks.write_all(report, results, 2, {"run_id": "r1", "profile_id": "p"}, out)
    doc = json.load(open(paths[0]))
    assert doc["stats"]["variant"] == 1 and [r["image_id"] for r in doc["results"]] == [1, 2]
    rows = list(csv.DictReader(open(paths[1])))
    assert rows[0]["ssimScore"] == "0.500000" and rows[0]["reviewStatus"] == "N/A" and rows[0]["primaryMatchImageId"] == ""
    assert "1&lt;.png" in open(paths[2]).read()
    assert not [f for f in os.listdir(out) if f.startswith(".")]
    with pytest.raises(sinks.ConservationError):
        sinks.write_json(report, results, 3, {"run_id": "r1"}, out)


def test_partition_upserts(spark, tmp_path):
    path = str(tmp_path / "cache")
    sinks.append(spark.createDataFrame([("a", 1), ("b", 2)], "run string, n long"), path, "run")
    sinks.overwrite_partitions(spark.createDataFrame([("b", 3)], "run string, n long"), path, "run")
    assert {(r["run"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_file_operations(tmp_path):
    a, b, c = (str(tmp_path / x) for x in ("a.png", "b.png", "c.png"))
    for p, data in ((a, b"A"), (b, b"B"), (c, b"C")):
        open(p, "wb").write(data)
    swap = fileops.rename([(a, b), (b, a)])
    assert swap.count("succeeded") == 2 and open(a, "rb").read() == b"B" and open(b, "rb").read() == b"A" and swap.reversible
    undone = fileops.undo(swap, {p: fileops.fingerprint(p) for p in (a, b)})
    assert undone.count("succeeded") == 2 and open(a, "rb").read() == b"A"
    failed = fileops.rename([(a, str(tmp_path / "new.png")), (b, c)])
    assert failed.count("failed") == 2 and open(a, "rb").read() == b"A" and open(b, "rb").read() == b"B"
    copied = fileops.copy([(a, str(tmp_path / "d.png")), (b, c)])
    assert (copied.count("succeeded"), copied.count("skipped"), copied.reversible) == (1, 1, False)
    assert fileops.copy([(a, str(tmp_path / "d.png"))]).count("skipped") == 1
    with pytest.raises(ValueError):
        fileops.undo(copied, {})
    seen = {p: fileops.fingerprint(p) for p in (a, b)}
    with open(b, "ab") as f:
        f.write(b" changed")
    assert fileops.rename([(a, f"{a}.new"), (b, f"{b}.new")], expected=seen).count("failed") == 2 and os.path.exists(a)
    moved = fileops.move([(a, str(tmp_path / "e.png")), (b, str(tmp_path / "f.png"))], expected=seen)
    assert [o.status for o in moved.outcomes] == ["succeeded", "failed"] and not os.path.exists(a) and os.path.exists(b) and moved.reversible


def test_streams_equal_batches(spark, roots, tmp_path):
    a, b = roots
    baseline = listing.scan(spark, a, content=True).select(F.sha2("content", 256).alias("digest"), F.monotonically_increasing_id().alias("image_id"))
    got = ingest.run_to_table(ingest.match_arriving(ingest.arriving_files(spark, b), baseline), str(tmp_path / "matches"))
    assert {(os.path.basename(r["path"]), r["analysis_type"]) for r in got.collect()} == {("copy.png", "exact_duplicate"), ("other.PNG", "not_evaluated"), ("broken.png", "not_evaluated")}
    src = str(tmp_path / "events")
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(t0 + datetime.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    done = {tuple(r) for r in ingest.run_to_table(ingest.event_counts(stream), str(tmp_path / "counts")).collect()}
    whole = {tuple(r) for r in batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total").collect()}
    assert done and done <= whole
