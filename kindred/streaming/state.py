"""The latest event of each result over a stream of events: what ``events.latest`` is over a table.

State is one event a result. An event that comes late, after newer ones, changes nothing, as in the batch form; one with
the same time goes by its id. With ``keep_ms`` a result without events for so long leaves the state; that is for streams
that run on, since the engine looks for timeouts without end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "result_id long, operation_type string, created_at long, id long"


def latest_events(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """An update for each result whose latest event (result_id, operation_type, created_at, id) has changed."""

    def follow(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        best = before
        for part in rows:
            newest = part.sort_values(["created_at", "id"]).iloc[-1]
            found = (int(newest["created_at"]), int(newest["id"]), newest["operation_type"])
            if best is None or found[:2] > tuple(best[:2]):
                best = found
        state.update(tuple(best))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        if before is None or tuple(best[:2]) > tuple(before[:2]):
            yield pd.DataFrame({"result_id": [key[0]], "operation_type": [best[2]], "created_at": [best[0]], "id": [best[1]]})

    picked = stream.select("result_id", "operation_type", "created_at", "id")
    return picked.groupBy("result_id").applyInPandasWithState(follow, LATEST, "created_at long, id long, operation_type string", "update", GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout)
