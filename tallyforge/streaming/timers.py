"""Stale jobs by a timer of each job, for streams whose jobs are watched one by one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_RESULT = "job_id {}, active_from long, stale_at long, steps long"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State with timers needs this store; the session's setting is put back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Runs(StatefulProcessor):
    """The open runs of a job: steps less than ``gap`` microseconds apart.  When the watermark passes a run's end, nothing can join the run
    any more, so it is written and forgotten.  A job has one timer, at the first end of its runs.

    Steps out of order join or link runs as long as they aren't later than the watermark; later ones never arrive here.
    """

    def __init__(self, gap: int, key: str):
        self.gap, self.key = gap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long, steps long")

    def _timer(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = sorted(tuple(r) for r in self.runs.get()) if self.runs.exists() else []
        old = min((self._timer(r[1]) for r in held), default=None)
        for frame in rows:
            held += [(t, t, 1) for t in frame["us"].tolist()]
        held.sort()
        runs: list[tuple[int, int, int]] = []
        for first, last, steps in held:
            if runs and first < runs[-1][1] + self.gap:
                a, b, n = runs[-1]
                runs[-1] = (a, max(b, last), n + steps)
            else:
                runs.append((first, last, steps))
        self.runs.put(runs)
        new = min(self._timer(r[1]) for r in runs)
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = sorted(tuple(r) for r in self.runs.get()) if self.runs.exists() else []
        over = [r for r in held if self._timer(r[1]) <= due]
        left = [r for r in held if self._timer(r[1]) > due]
        if left:
            self.runs.put(left)
            self.handle.registerTimer(min(self._timer(r[1]) for r in left))
        else:
            self.runs.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(over), "active_from": [r[0] for r in over], "stale_at": [r[1] + self.gap for r in over], "steps": [r[2] for r in over]})

    def close(self) -> None:
        pass


def stale_jobs_by_timer(steps: DataFrame, gap_seconds: int = 120, delay: str = "10 minutes") -> DataFrame:
    """(job_id, active_from, stale_at, steps): as ``streams.stale_jobs``, from steps (job_id, created_at).

    State follows the jobs with an open run and not all jobs there were.  Steps without a job or a time are left out.
    """
    kind = steps.schema["job_id"].dataType.simpleString()
    known = steps.where("job_id is not null and created_at is not null").select("job_id", "created_at", F.unix_micros("created_at").alias("us")).withWatermark("created_at", delay)
    out = known.groupBy("job_id").transformWithStateInPandas(Runs(gap_seconds * 1_000_000, "job_id"), _RESULT.format(kind), "append", "eventTime")
    return out.select("job_id", F.timestamp_micros("active_from").alias("active_from"), F.timestamp_micros("stale_at").alias("stale_at"), "steps")
