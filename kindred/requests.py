"""Requests: jobs that a user asked for, with progress and cancellation. A request is a job group of Spark."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from kindred.progress import Counters


class Cancelled(RuntimeError):
    """The request was cancelled before it was done."""


@dataclass
class Request:
    request_id: str
    kind: str
    cancelled: threading.Event = field(default_factory=threading.Event)
    status: str = "running"  # running, completed, cancelled, failed
    counters: Counters | None = None


class Requests:
    """Of the foreground requests of one kind the latest wins: it cancels the one before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock = spark, threading.Lock()
        self._known: dict[str, Request] = {}
        self._foreground: dict[str, str] = {}

    def run(self, kind: str, work: Callable, request_id: str | None = None, foreground: bool = True):
        """``work(check)`` in this thread; ``check()`` raises between its jobs once the request is cancelled, and what the work hands to
        ``check.counters`` shows in the progress."""
        request = Request(request_id or uuid.uuid4().hex, kind, counters=Counters(self.spark))
        with self._lock:
            if request.request_id in self._known:
                raise ValueError(f"{request.request_id} exists")
            before = self._foreground.get(kind) if foreground else None
            self._known[request.request_id] = request
            if foreground:
                self._foreground[kind] = request.request_id
        if before:
            self.cancel(before)
        sc = self.spark.sparkContext
        old = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description"), sc.getLocalProperty("spark.job.interruptOnCancel")

        def check() -> None:
            if request.cancelled.is_set():
                raise Cancelled(request.request_id)

        check.counters = request.counters
        try:
            sc.setJobGroup(request.request_id, kind, interruptOnCancel=True)
            check()
            out = work(check)
            check()
            request.status = "completed"
            return out
        except BaseException as e:
            if request.cancelled.is_set():
                request.status = "cancelled"
                raise Cancelled(request.request_id) from e
            request.status = "failed"
            raise
        finally:
            for key, value in zip(("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"), old, strict=True):
                sc.setLocalProperty(key, value)
            with self._lock:
                if self._foreground.get(kind) == request.request_id:
                    del self._foreground[kind]

    def cancel(self, request_id: str) -> bool:
        """Stops the jobs of a running request, those to come included; False where none runs under the id."""
        with self._lock:
            request = self._known.get(request_id)
            if request is None or request.status != "running":
                return False
            request.cancelled.set()
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(request_id)
        return True

    def forget(self, request_id: str) -> None:
        """Drops what is known of a request that has ended."""
        with self._lock:
            if self._known[request_id].status == "running":
                raise ValueError(f"{request_id} is running")
            del self._known[request_id]

    def progress(self, request_id: str) -> dict:
        """kind, status, the counters, and the jobs and tasks that Spark still knows of: tasks, done, failed and the percentage done."""
        request, tracker = self._known[request_id], self.spark.sparkContext.statusTracker()
        jobs = [j for j in (tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(request_id)) if j]
        stages = {i: j.status for j in jobs for i in j.stageIds}
        known = [(s, stages[i]) for i, s in ((i, tracker.getStageInfo(i)) for i in stages) if s]
        # a stage that a finished job did not need has no tasks of its own
        parts = [s for s, status in known if status == "RUNNING" or s.numCompletedTasks or s.numFailedTasks]
        tasks, done = sum(s.numTasks for s in parts), sum(s.numCompletedTasks for s in parts)
        return {"kind": request.kind, "status": request.status, "jobs": len(jobs), "tasks": tasks, "done": done, "failed": sum(s.numFailedTasks for s in parts), "percent": round(done / tasks * 100) if tasks else 0, "counters": request.counters.values()}
