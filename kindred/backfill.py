"""Background jobs that score a run's groups, a part after another, and give way to what a user waits for."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from kindred.pipeline import Run
from kindred.requests import Cancelled, Requests
from kindred.store import Store

POOL = "background"


class Backfill:
    """One job a (run, distance) at most. A foreground request stops the part that is being scored; what was stored stays, and the
    job goes on from there when no foreground request is left. Jobs run in the fair scheduler's pool ``background``, where the session has that scheduler."""

    def __init__(self, store: Store, requests: Requests, part: int = 50):
        self.store, self.requests, self.part = store, requests, part
        self._lock = threading.Condition()
        self._waiting = 0  # foreground requests
        self._jobs: dict[tuple[str, int], tuple[str, threading.Thread]] = {}
        self.preempted = 0

    def start(self, run_id: str, run: Run, members: DataFrame, distance: int, after: list[int] = ()) -> str:
        """Starts the job and gives its request id; that of the running one if there is one."""
        key = run_id, distance
        with self._lock:
            known = self._jobs.get(key)
            if known and known[1].is_alive():
                return known[0]
            request_id = f"backfill-{run_id}-{distance}-{len(self.requests._known)}"
            thread = InheritableThread(target=self._work, args=(request_id, run_id, run, members, list(after)), daemon=True)
            self._jobs[key] = request_id, thread
        thread.start()
        return request_id

    def wait(self, run_id: str, distance: int, timeout: float | None = None) -> bool:
        """Whether the job ended in time."""
        thread = self._jobs[run_id, distance][1]
        thread.join(timeout)
        return not thread.is_alive()

    @contextmanager
    def foreground(self) -> Iterator[None]:
        """While this is open no background job runs."""
        with self._lock:
            self._waiting += 1
            running = [r for r, t in self._jobs.values() if t.is_alive()]
        for request_id in running:
            self.requests.spark.sparkContext.cancelJobGroup(request_id)
        try:
            yield
        finally:
            with self._lock:
                self._waiting -= 1
                self._lock.notify_all()

    def _work(self, request_id: str, run_id: str, run: Run, members: DataFrame, after: list[int]) -> None:
        def parts(check) -> None:
            self.requests.spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
            while True:
                with self._lock:
                    while self._waiting:
                        self._lock.wait()
                check()
                try:
                    left = self.store.group_statuses(run_id, members).filter("status = 'pending'").limit(self.part).count()
                    if not left:
                        return
                    self.store.fill_groups(run_id, run, members, after, self.part, check.counters)
                    if left == self.store.group_statuses(run_id, members).filter("status = 'pending'").limit(self.part).count() < self.part:
                        return  # what is left has failed pairs
                except Exception:
                    check()
                    with self._lock:
                        if not self._waiting:
                            raise
                        self.preempted += 1

        try:
            self.requests.run("backfill", parts, request_id, foreground=False)
        except Cancelled:
            pass
