"""Counters of a request: tasks add to them, and the driver reads them while jobs run."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

NAMES = ("total", "processed", "hits", "computed", "skipped", "decoded", "resized")


class Counters:
    """``total`` items were asked for; ``hits`` were known, ``computed`` are new, ``skipped`` failed or had nothing to do; ``processed``
    is their sum. ``decoded`` and ``resized`` count images.

    They are accumulators of Spark: a task's share arrives when the task is done, and the share of a lost task does not count.
    """

    def __init__(self, spark: SparkSession):
        self._of = {name: spark.sparkContext.accumulator(0) for name in NAMES if name != "processed"}
        self._lock = threading.Lock()

    def __getstate__(self) -> dict:
        return {"_of": self._of}  # tasks need no lock

    def __getitem__(self, name: str):
        return self._of[name]

    def add(self, **counts: int) -> None:
        """From the driver."""
        with self._lock:
            for name, n in counts.items():
                self._of[name].add(n)

    def values(self) -> dict[str, int]:
        found = {name: a.value for name, a in self._of.items()}
        found["processed"] = found["hits"] + found["computed"] + found["skipped"]
        return {name: found[name] for name in NAMES}
