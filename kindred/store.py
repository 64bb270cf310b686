"""What outlives a session: runs, their images, results and reviews, the operation log, settings, and the scores of groups.

All tables are append only, below one root that driver and executors reach. Each append is written aside and takes its name
when it is whole, in a folder of its own below its run's: writers don't disturb each other, and a failed one leaves nothing
that a reader takes. A run is deleted with its folders. State is never stored, it is folded from what was appended.
"""

from __future__ import annotations

import datetime
import os
import re
import threading
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import pipeline
from kindred.cache import Cache
from kindred.config import DEFAULT, Profile, guard_ids
from kindred.operators import classify, events, fileops, graph, match, stats
from kindred.schema import ANALYSIS, REVIEW, RUN_STATUS, SETTINGS
from kindred.sources import sinks
from kindred.sources.sinks import file_system

# The tables and their columns; all have run_id, by which they are laid out.
TABLES = {
    "runs": "id long, status string, created_at long, baseline string, comparisons array<string>, profile_id string, baseline_total long, comparison_total long, error_count long",
    "images": "image_id long, role string, path string, relative_path string, file_size long, mtime long, width long, height long, format string, color_type string, digest string, phash long, aspect double, scan_status string",
    "results": "result_id long, image_id long, analysis_type string, primary_id long, phash_distance long, score double, algorithm_profile_id string",
    "errors": "path string, error string",
    "operations": "id long, result_id long, operation_type string, source_path string, target_path string, error_message string, created_at long",
    "reviews": "id long, result_id long, review_status string, created_at long",
    "settings": "id long, key string, value string",
    "group_scores": "profile_id string, signature string, left_id long, right_id long, score double",
    "scored_groups": "profile_id string, signature string, n_pairs long, computed_at long",
}


#: Where tables lie that belong to no run.
EVERYWHERE = "all-runs"


class NotFound(KeyError):
    """A run or a result that the store does not have."""


def new_run_id(now: datetime.datetime | None = None) -> str:
    """The time to the second and eight random characters."""
    now = now or datetime.datetime.now(datetime.UTC)
    return f"{now:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:8]}"


def local_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


class Store:
    """``trash`` is the folder that recycled files go to; without it nothing can be recycled."""

    def __init__(self, spark: SparkSession, root: str, trash: str | None = None, profile: Profile = DEFAULT):
        self.spark, self.root, self.trash, self.profile = spark, root.rstrip("/"), trash, profile
        self.cache = Cache(spark, f"{self.root}/cache")
        self._lock, self._last = threading.Lock(), 0

    # tables

    def _tick(self) -> int:
        """Nanoseconds, each later than the one before it."""
        with self._lock:
            self._last = max(time.time_ns(), self._last + 1)
            return self._last

    def _folder(self, table: str, run_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run_id):
            raise ValueError("a run id has letters, digits, points, dashes and underscores")
        return f"{self.root}/{table}/run_id={run_id}"

    def append(self, table: str, df: DataFrame, run_id: str) -> None:
        folder, name = self._folder(table, run_id), uuid.uuid4().hex
        aside = f"{folder}/.{name}"
        typed = self.spark.createDataFrame([], TABLES[table]).schema
        df.select(*(F.col(f.name).cast(f.dataType) for f in typed)).write.option("compression", "zstd").parquet(aside)
        fs, at = file_system(self.spark, aside)
        if not fs.rename(at, file_system(self.spark, f"{folder}/batch={name}")[1]):
            raise OSError(f"{table} of {run_id} could not be written")

    def _append_rows(self, table: str, rows: list[dict], run_id: str) -> None:
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        self.append(table, self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema), run_id)

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """The rows of a table, or of one run; an absent table is empty."""
        schema = f"{TABLES[table]}, run_id string"
        top = f"{self.root}/{table}"
        wanted = top if run_id is None else self._folder(table, run_id)
        fs, at = file_system(self.spark, wanted)
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(f"{schema}, batch string").option("basePath", top).parquet(wanted)
        return found.drop("batch")

    # runs

    def start(self, baseline: str, comparisons: list[str], run_id: str | None = None) -> str:
        run_id = run_id or new_run_id()
        if run_id == EVERYWHERE:
            raise ValueError(f"{run_id} is no run id")
        if not self.read("runs", run_id).isEmpty():
            raise ValueError(f"{run_id} exists")
        now = self._tick()
        self._append_rows("runs", [{"id": now, "status": "pending", "created_at": now // 10**6, "baseline": baseline, "comparisons": comparisons, "profile_id": self.profile.profile_id}], run_id)
        return run_id

    def set_status(self, run_id: str, status: str, **counts: int) -> None:
        """A new status, and optionally baseline_total, comparison_total and error_count."""
        if status not in RUN_STATUS:
            raise ValueError(f"{status} is no status")
        self.status(run_id)
        now = self._tick()
        self._append_rows("runs", [{"id": now, "status": status, "created_at": now // 10**6, **counts}], run_id)

    def runs(self) -> DataFrame:
        return events.run_states(self.read("runs"))

    def status(self, run_id: str) -> dict:
        """run_id, status, started_at and completed_at; raises NotFound."""
        row = events.run_states(self.read("runs", run_id)).first()
        if row is None:
            raise NotFound(run_id)
        return row.asDict()

    def history(self, limit: int = 20) -> DataFrame:
        """The newest runs; totals are never below what is counted."""
        images = self.read("images").groupBy("run_id").agg(F.count_if(F.col("role") == "baseline").alias("n_baseline"), F.count_if(F.col("role") == "comparison").alias("n_comparison"))
        results = self.read("results").groupBy("run_id").agg(F.count("*").alias("result_count"))
        x = self.runs().join(images, "run_id", "left").join(results, "run_id", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0).cast("long")))
        x = x.withColumn("baseline_total", F.greatest(F.coalesce("baseline_total", F.lit(0)), F.coalesce("n_baseline", F.lit(0))))
        x = x.withColumn("stored", F.coalesce("comparison_total", F.lit(0))).withColumn("counted", F.greatest(F.coalesce("n_comparison", F.lit(0)), "result_count"))
        return stats.history(x, limit).drop("stored", "counted", "comparison_total", "n_baseline", "n_comparison").withColumnRenamed("total", "comparison_total")

    def delete(self, run_id: str) -> None:
        """The run and all that belongs to it; the run's own rows go last, so that a broken delete can be repeated."""
        self.status(run_id)
        for table in (*(t for t in TABLES if t != "runs"), "runs"):
            fs, at = file_system(self.spark, self._folder(table, run_id))
            if fs.exists(at) and not fs.delete(at, True):
                raise OSError(f"{table} of {run_id} could not be deleted")

    def compare(self, baseline: str, comparisons: list[str], run_id: str | None = None, **options) -> tuple[str, pipeline.Run]:
        """``pipeline.compare`` with its status, images, results and errors kept. A failure is a status too. What earlier runs
        have decoded and scored is not done again (``cache=None`` does it anew)."""
        run_id = self.start(baseline, comparisons, run_id)
        try:
            self.set_status(run_id, "indexing")
            options.setdefault("cache", self.cache)
            run = pipeline.compare(self.spark, baseline, comparisons, self.profile, run_id=run_id, **options)
            self.append("images", run.images, run_id)
            self.append("results", stats.numbered(run.results, "image_id", name="result_id"), run_id)
            self.append("errors", run.errors, run_id)
            counts = run.images.groupBy("role").count().collect()
            totals = {f"{r['role']}_total": r["count"] for r in counts}
            failed = run.errors.count()
            self.set_status(run_id, "completed_with_errors" if failed else "analysis_complete", error_count=failed, **totals)
        except BaseException:
            self.set_status(run_id, "failed")
            raise
        return run_id, run

    def folders(self, run_id: str) -> DataFrame:
        """(role, folder, label, file_count) of a run's images."""
        return stats.folder_counts(self.read("images", run_id), F.col("path"))

    def active_images(self, run_id: str) -> DataFrame:
        return events.active(self.read("images", run_id), self.read("results", run_id), self.read("operations", run_id))

    # results, reviews and reports

    def review(self, run_id: str, result_ids: list[int], status: str) -> None:
        """A review status for results; the last one counts."""
        if status not in REVIEW:
            raise ValueError(f"{status} is no review status")
        self._picked(run_id, result_ids)
        rows = [{"id": self._tick(), "result_id": i, "review_status": status} for i in dict.fromkeys(result_ids)]
        self._append_rows("reviews", [r | {"created_at": r["id"] // 10**6} for r in rows], run_id)

    def report(self, run_id: str) -> DataFrame:
        """One row a result: both files, the class, the measures of the pair, the review and the action status. From
        stored tables only: the run may be another session's."""
        images = self.read("images", run_id)
        own = images.select("image_id", F.col("relative_path").alias("comparison_path"), *(F.col(c).alias(f"c_{c}") for c in ("width", "height", "file_size")))
        other = images.select(F.col("image_id").alias("primary_id"), F.col("relative_path").alias("primary_path"), *(F.col(c).alias(f"b_{c}") for c in ("width", "height", "file_size")))
        reviewed = self.read("reviews", run_id).groupBy("result_id").agg(F.max_by("review_status", "id").alias("review_status"))
        acted = events.latest(self.read("operations", run_id)).select("result_id", events.action_status(F.col("operation_type")).alias("action_status"))
        x = self.read("results", run_id).join(own, "image_id").join(other, "primary_id", "left").join(reviewed, "result_id", "left").join(acted, "result_id", "left")
        x = match.pair_metrics(x, self.profile.aspect_tolerance)
        return x.select(
            "result_id", "image_id", "comparison_path", "analysis_type", "primary_id", "primary_path", "phash_distance", "score", "size_ratio", "resolution_ratio", "aspect_diff", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("smaller_resolution", "smaller_filesize")),
            "review_status", F.coalesce("action_status", F.lit("none")).alias("action_status"), "algorithm_profile_id",
        )

    def results(self, run_id: str, analysis_type: str | None = None) -> DataFrame:
        """The report's rows in the order of their classes and images, with their position; of one class on request."""
        self.status(run_id)
        x = self.report(run_id)
        x = x if analysis_type is None else x.filter(F.col("analysis_type") == analysis_type)
        return stats.numbered(x, classify.rank_of(F.col("analysis_type"), classify.SORT_ORDER, 1), "image_id")

    def result(self, run_id: str, result_id: int) -> dict:
        """The detail of one result, with its operations in order; raises NotFound."""
        row = self.report(run_id).filter(F.col("result_id") == result_id).first()
        if row is None:
            raise NotFound(result_id)
        log = self.read("operations", run_id).filter(F.col("result_id") == result_id).orderBy("id").limit(800).collect()
        return row.asDict() | {"operations": [r.asDict() for r in log]}

    def stats(self, run_id: str) -> dict:
        """Totals of the run, a count for each class and each review status, how many are recycled, and whether the
        classes add up to the comparison images."""
        self.status(run_id)
        totals = self.read("images", run_id).agg(F.count_if(F.col("role") == "baseline").alias("baseline_total"), F.count_if(F.col("role") == "comparison").alias("comparison_total")).first().asDict()
        r = self.report(run_id)
        counts = r.agg(
            F.count_distinct("image_id").alias("analysed"), *(F.count_if(F.col("analysis_type") == c).alias(c) for c in ANALYSIS),
            *(F.count_if(F.col("review_status") == c).alias(f"review_{c}") for c in REVIEW), F.count_if(F.col("action_status") == "recycled").alias("recycled"),
        )
        found = stats.conserved(counts, F.lit(totals["comparison_total"])).first().asDict()
        return totals | found | {"error_count": self.read("errors", run_id).count()}

    def write_reports(self, run_id: str, folder: str) -> list[str]:
        """The JSON, CSV and HTML reports of a stored run; raises ConservationError where images have no class."""
        status = self.status(run_id)
        total = self.read("images", run_id).filter("role = 'comparison'").count()
        header = {"run_id": run_id, "profile_id": status["profile_id"], "status": status["status"], "created_at": status["created_at"]}
        report = self.report(run_id)
        return sinks.write_all(report.drop("result_id", "algorithm_profile_id"), report.select("image_id", "analysis_type"), total, header, folder)

    # settings

    def save_settings(self, **values: object) -> None:
        """Keeps settings (``schema.SETTINGS``); the last value of each counts."""
        unknown = set(values) - set(SETTINGS)
        if unknown:
            raise ValueError(f"{', '.join(sorted(unknown))}: no such setting")
        self._append_rows("settings", [{"id": self._tick(), "key": k, "value": str(v)} for k, v in values.items()], EVERYWHERE)

    def settings(self) -> dict:
        """All settings; what is not saved or can't be read has its default."""
        last = self.read("settings", EVERYWHERE).groupBy("key").agg(F.max_by("value", "id").alias("value"))
        return events.settings(last, SETTINGS).first().asDict()

    def saved_profile(self) -> Profile:
        """The store's profile with the saved settings in place of its own thresholds."""
        s = self.settings()
        return replace(
            self.profile, compressed=s["default_compressed_ssim_threshold"], variant=s["default_variant_review_lower_bound"], max_distance=s["default_phash_max_distance"],
            aspect_tolerance=s["default_aspect_ratio_tolerance"], top_k=s["max_candidate_per_image"],
        )

    # operations

    def _picked(self, run_id: str, result_ids: list[int]) -> list[dict]:
        """The asked results with their file, their match's file, and their state; at most as many as one request has."""
        asked = self.spark.createDataFrame([(i,) for i in guard_ids(list(dict.fromkeys(result_ids)))], "result_id long")
        images, log = self.read("images", run_id), self.read("operations", run_id)
        own = images.select("image_id", "path", "role", "file_size", "mtime", "digest")
        match = images.select(F.col("image_id").alias("primary_id"), F.col("path").alias("primary_path"), F.col("digest").alias("primary_digest"))
        last = events.latest(log.join(F.broadcast(asked), "result_id")).select("result_id", events.action_status(F.col("operation_type")).alias("state"))
        taken = events.latest_of(log.join(F.broadcast(asked), "result_id"), "recycled", "source_path", "target_path").select("result_id", F.col("source_path").alias("was"), F.col("target_path").alias("lies"))
        x = self.read("results", run_id).join(F.broadcast(asked), "result_id").join(own, "image_id").join(match, "primary_id", "left").join(last, "result_id", "left").join(taken, "result_id", "left")
        found = {r["result_id"]: r.asDict() | {"state": r["state"] or "none"} for r in x.collect()}
        missing = [i for i in result_ids if i not in found]
        if missing:
            raise NotFound(missing)
        return [found[i] for i in dict.fromkeys(result_ids)]

    def _log(self, run_id: str, rows: list[dict]) -> None:
        if rows:
            for r in rows:
                r["id"] = self._tick()
                r["created_at"] = r["id"] // 10**6
            self._append_rows("operations", rows, run_id)

    def _verdicts(self, rows: list[dict]) -> dict[int, str]:
        """Whether each file is still what the run saw, and so is the file that it matches."""
        now = {}
        for path in {p for r in rows for p in (r["path"], r["primary_path"]) if p}:
            at = local_path(path)
            if os.path.isfile(at):
                now[path] = (path, os.stat(at).st_size, os.stat(at).st_mtime_ns // 10**6, fileops.fingerprint(at)[0])
        listing = self.spark.createDataFrame(list(now.values()), "path string, size long, mtime long, digest string")
        manifest = self.spark.createDataFrame(
            [(r["result_id"], r["path"], r["role"], r["file_size"], r["mtime"], r["digest"], r["primary_path"], r["primary_digest"]) for r in rows],
            "result_id long, path string, role string, size long, mtime long, digest string, primary_path string, primary_digest string",
        )
        return {r["result_id"]: r["verdict"] for r in events.verify_recycle(manifest, listing).select("result_id", "verdict").collect()}

    def recycle(self, run_id: str, result_ids: list[int]) -> dict[int, tuple[bool, str]]:
        """Moves files of comparison images to the trash: (ok, message) by result.

        What the run did not see just so is left alone and not logged. ``prepared`` is logged before a file moves, what
        came of it after, so a break in between shows in the log.
        """
        if self.trash is None:
            raise ValueError("the store has no trash folder")
        rows, out, ready = self._picked(run_id, result_ids), {}, []
        verdicts = self._verdicts(rows)
        for r in rows:
            if r["state"] not in events.TRANSITIONS["prepared"]:
                out[r["result_id"]] = (False, f"can't follow {r['state']}")
            elif verdicts[r["result_id"]] != "ok":
                out[r["result_id"]] = (False, verdicts[r["result_id"]])
            else:
                ready.append(r)
        self._log(run_id, [{"result_id": r["result_id"], "operation_type": "prepared", "source_path": r["path"]} for r in ready])
        done = []
        for r in ready:
            source = local_path(r["path"])
            target = f"{self.trash}/{run_id}/{r['result_id']}-{uuid.uuid4().hex[:8]}-{os.path.basename(source)}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            (moved,) = fileops.move([(source, target)]).outcomes
            ok = moved.status == "succeeded" and not os.path.exists(source)
            message = "" if ok else moved.message or "the file is still there"
            out[r["result_id"]] = (ok, message)
            done.append({"result_id": r["result_id"], "operation_type": "recycled", "source_path": r["path"], "target_path": target} if ok else {"result_id": r["result_id"], "operation_type": "operation_failed", "source_path": r["path"], "error_message": message})
        self._log(run_id, done)
        return out

    def _undo(self, run_id: str, result_ids: list[int], operation: str, act) -> dict[int, tuple[bool, str]]:
        """For results whose state is recycled; what fails leaves the state as it is."""
        out, done = {}, []
        for r in self._picked(run_id, result_ids):
            if r["state"] not in events.TRANSITIONS[operation]:
                out[r["result_id"]] = (False, f"can't follow {r['state']}")
                continue
            try:
                act(r)
            except OSError as e:
                out[r["result_id"]] = (False, str(e))
                continue
            out[r["result_id"]] = (True, "")
            done.append({"result_id": r["result_id"], "operation_type": operation, "source_path": r["lies"], "target_path": r["was"] if operation == "restored" else None})
        self._log(run_id, done)
        return out

    def restore(self, run_id: str, result_ids: list[int]) -> dict[int, tuple[bool, str]]:
        """Recycled files back to where they were; a file that has the name now stays, and so does the recycled one."""

        def back(r):
            target = local_path(r["was"])
            if os.path.exists(target):
                raise FileExistsError(f"{target} exists")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            (moved,) = fileops.move([(r["lies"], target)]).outcomes
            if moved.status != "succeeded":
                raise OSError(moved.message)

        return self._undo(run_id, result_ids, "restored", back)

    def purge(self, run_id: str, result_ids: list[int]) -> dict[int, tuple[bool, str]]:
        """Recycled files are deleted for good."""
        return self._undo(run_id, result_ids, "permanently_deleted", lambda r: os.remove(r["lies"]))

    # scores of groups

    def group_statuses(self, run_id: str, members: DataFrame, listing: DataFrame | None = None, running: int | None = None) -> DataFrame:
        """(group_index, n, signature, status). ``listing`` (path, size, mtime) says how the files are now; a changed or
        missing file concerns its own group only."""
        if listing is not None:
            now = listing.select("path", F.col("size").alias("file_size"), "mtime")
            members = members.drop("file_size", "mtime").join(now, "path", "left")
        known = self.read("scored_groups", run_id).filter(F.col("profile_id") == self.profile.profile_id).select("signature")
        return graph.group_statuses(graph.signatures(members), known, running)

    def fill_groups(self, run_id: str, run: pipeline.Run, members: DataFrame, after: list[int] = (), most: int | None = None, counters=None) -> DataFrame:
        """Scores the groups that have none yet, in their order after the current ones (``most`` at a time), and keeps those
        without a failed pair. Returns (component, left_id, right_id, score, error) of what was scored now."""
        todo = self.group_statuses(run_id, members).filter("status = 'pending'")
        todo = graph.backfill_order(todo, list(after))
        todo = todo if most is None else todo.filter(F.col("position") <= most)
        mine = members.join(todo.select("group_index", "signature"), "group_index")
        scores = pipeline.group_scores(run, mine, counters=counters)
        of = mine.groupBy("component").agg(F.first("signature").alias("signature"))
        failed = scores.filter("score is null or error is not null").select("component").distinct()
        whole = of.join(failed, "component", "left_anti")
        mark = F.lit(self.profile.profile_id).alias("profile_id")
        rows = scores.join(whole, "component")
        self.append("group_scores", rows.select(mark, "signature", "left_id", "right_id", "score"), run_id)
        n = rows.groupBy("signature").agg(F.count("*").alias("n_pairs"))
        groups = whole.join(n, "signature", "left").select(mark, "signature", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.lit(self._tick() // 10**6).alias("computed_at"))
        self.append("scored_groups", groups, run_id)  # last: a group counts as scored when its scores stand
        return scores

    def group_scores(self, run_id: str, members: DataFrame) -> DataFrame:
        """(component, left_id, right_id, score) that were kept for the groups as they are."""
        s = graph.signatures(members).select("component", "signature")
        done = self.read("scored_groups", run_id).filter(F.col("profile_id") == self.profile.profile_id).select("signature").distinct()
        kept = self.read("group_scores", run_id).filter(F.col("profile_id") == self.profile.profile_id)
        kept = kept.join(done, "signature", "left_semi").groupBy("signature", "left_id", "right_id").agg(F.max("score").alias("score"))
        return s.join(kept, "signature").select("component", "left_id", "right_id", "score")
