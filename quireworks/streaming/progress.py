"""Progress of jobs as a stream: a state for each job, which fails when nothing is heard of it and goes when it is old."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after which a running job without news has failed, and after which the state of a finished one is dropped.
TIME_TO_LIVE, MOST_AGE = 1800, 3600

_STATE = "status string, count long, total long, started double, heard double, finished double, error string"
_OUT = "job string, status string, count long, total long, started double, finished double, error string"


def after(state: tuple | None, kind: str, at: float, count: float | None, total: float | None, error: str | None) -> tuple | None:
    """The state (status, count, total, started, heard, finished, error) after a change: register begins anew, update counts only while the job runs, done and failed end it, of unknown jobs too."""
    number = lambda x, other: other if x is None or pd.isna(x) else int(x)
    if kind == "register":
        return ("running", 0, 0, at, at, None, None)
    if kind == "update":
        if state is None or state[0] != "running":
            return state
        return ("running", number(count, state[1]), number(total, state[2]), state[3], at, None, None)
    known = state or ("", 0, 0, None, None, None, None)
    if kind == "done":
        n = number(count, 0)
        return ("done", n, n, known[3], at, at, None)
    if kind == "failed":
        return ("failed", known[1], known[2], known[3], at, at, error or "")
    return state


def progress(changes: DataFrame, delay: str = "10 minutes", time_to_live: int = TIME_TO_LIVE, most_age: int = MOST_AGE) -> DataFrame:
    """job, status, count, total, started, finished, error after each batch that changes a job, from a stream of changes(job, at timestamp, kind, count, total, error).

    Changes of one batch are taken in the order of their times, and registrations before other changes of one time. When
    the watermark is `time_to_live` seconds beyond the last news of a running job, it fails as expired; when it is `most_age`
    beyond the end of a finished job, its state is dropped, and it is reported once more as unknown.
    """
    order = {"register": 0, "update": 1}

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else None
        out = lambda s: pd.DataFrame([[key[0], s[0], s[1], s[2], s[3], s[5], s[6]]], columns=["job", "status", "count", "total", "started", "finished", "error"])
        if held.hasTimedOut:
            if state[0] == "running":
                at = state[4] + time_to_live
                state = ("failed", state[1], state[2], state[3], at, at, "expired")
                yield out(state)
            else:
                held.remove()
                yield out(("unknown", 0, 0, None, None, None, None))
                return
        else:
            rows = pd.concat(list(frames))
            rows["o"] = rows["kind"].map(order).fillna(2)
            for r in rows.sort_values(["at", "o"], kind="stable").itertuples():
                state = after(state, r.kind, r.at.timestamp(), r.count_, r.total, r.error)
            if state is None:
                return
            yield out(state)
        held.update(state)
        due = state[4] + time_to_live if state[0] == "running" else state[5] + most_age
        held.setTimeoutTimestamp(max(int(due * 1000), held.getCurrentWatermarkMs() + 1))

    ready = changes.withColumnRenamed("count", "count_").withWatermark("at", delay)
    return ready.groupBy("job").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
