"""Jobs watched through a stream of status snapshots: keyed state with event-time timers.

Each job's snapshots are held until the watermark has passed them and then taken in order, so what comes late, but within the
watermark, changes nothing. A change of status is a row, also where a job returns to a status it had. A final status ends a job
with exit code 0 or 2; a job of which nothing is heard for its waiting time (which grows with every snapshot, as a poll loop's
does), or that has not ended in all the time it has, ends with 3. What comes of an ended job is passed over until it is forgotten.
Jobs are dealt over shards by their names' hash, and a shard's jobs are one entry of the state.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..common import importable
from .snapshots import GOOD, TERMINAL

OUT = "job_id string, at timestamp, status string, previous string, exit_code int"
TIMED_OUT = "timeout"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Patience:
    """Seconds: the first wait, its growth with each snapshot, its bound, all the time a job has, and after how long an ended one is
    forgotten."""

    interval: float = 30.0
    backoff: float = 1.3
    most: float = 120.0
    all_: float = 7200.0
    forget: float = 7 * 86400.0

    def deadline(self, first: int, last: int, polls: int) -> int:
        """Milliseconds at which a job counts as late, from its first and last snapshot and how many there were."""
        wait = self.interval
        for _ in range(polls - 1):
            wait = min(self.most, wait * self.backoff)
            if wait >= self.most:
                break
        return min(first + int(self.all_ * 1000), last + int(min(self.most, wait) * 1000))


class JobWatch(StatefulProcessor):
    """The jobs of one shard: their states, snapshots not yet taken (an entry for each batch that brought some), and the one timer that
    is set, for whichever job is due first."""

    def __init__(self, patience: Patience):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "job_id array<string>, status array<string>, first array<long>, last array<long>, polls array<long>, ended array<long>")
        self.waiting = handle.getListState("waiting", "job_id array<string>, at array<long>, status array<string>")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, new = timerValues.getCurrentWatermarkInMs(), []
        for f in rows:
            new += [x for x in zip(f["job_id"].tolist(), f["ms"].tolist(), f["status"].tolist(), strict=True) if x[1] > now]  # else too late
        if new:
            self._hold(new)
            at, had = min(x[1] for x in new), self.timer.get()
            if had is None or at < had[0]:
                if had is not None:
                    self.handle.deleteTimer(had[0])
                self._wake(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, left, due, ready = timerValues.getCurrentWatermarkInMs(), [], [], [], {}
        had, jobs = self.jobs.get(), {}
        if had is not None:
            jobs = {job: state for job, *state in zip(*had, strict=True)}
        for entry in self.waiting.get():
            for x in zip(*entry, strict=True):
                if x[1] > now:
                    left.append(x)
                else:
                    ready.setdefault(x[0], []).append(x[1:])
        for job in [*jobs, *(j for j in ready if j not in jobs)]:
            state, rows = self._advance(jobs.get(job), sorted(ready.get(job, ())), now)
            out += [(job, *r) for r in rows]
            if state is None:
                jobs.pop(job, None)
                continue
            jobs[job] = state
            _, first, last, polls, ended = state
            due.append(max(now, self.patience.deadline(first, last, polls) if ended is None else ended + int(self.patience.forget * 1000)) + 1)
        self.waiting.clear()
        if left:
            self._hold(left)
            due.append(min(x[1] for x in left))
        if jobs:
            self.jobs.update(tuple([list(jobs), *(list(c) for c in zip(*jobs.values(), strict=True))]))
        else:
            self.jobs.clear()
        if due:
            self._wake(min(due))
        else:
            self.timer.clear()
        if out:
            job, at, status, previous, code = zip(*out, strict=True)
            yield pd.DataFrame({"job_id": job, "ms": at, "status": status, "previous": previous, "exit_code": pd.array(code, "Int32")})

    def _advance(self, state, held, now: int):
        """A job's state (None: nothing to remember) after what the watermark has passed, and its rows."""
        out, (status, first, last, polls, ended) = [], state or (None, 0, 0, 0, None)
        for at, new in [*held, (now, None)]:
            if ended is not None and at - ended > self.patience.forget * 1000:
                status, polls, ended = None, 0, None
            if ended is None and polls and at > (late := self.patience.deadline(first, last, polls)):
                out.append((late, TIMED_OUT, status, 3))
                ended = late
            if new is None or ended is not None:
                continue
            if new != status or not polls:
                code = None if new not in TERMINAL else 0 if new in GOOD else 2
                out.append((at, new, status, code))
                ended = at if code is not None else None
            status, first, last, polls = new, first if polls else at, at, polls + 1
        return ((status, first, last, polls, ended) if polls or ended is not None else None), out

    def _hold(self, rows) -> None:
        self.waiting.appendValue(tuple(list(c) for c in zip(*rows, strict=True)))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def watched(stream: DataFrame, patience: Patience | None = None, late: str = "1 hour", shards: int = 4096) -> DataFrame:
    """OUT rows of a stream of snapshots: each job's changes of status in order, and its end.

    A call to the state's server takes about a millisecond, whatever it carries, so jobs share the calls of their shard: of a batch's calls
    there are at most so many as ``shards``, and a call holds the jobs of one. As the number of shuffle partitions, that of shards must
    stay what it was when the stream first began.
    """
    importable(stream.sparkSession)
    at, shard = F.col("captured_at").try_cast("timestamp"), F.pmod(F.xxhash64("job_id"), F.lit(shards)).alias("shard")
    named = stream.select(at.alias("at"), F.unix_millis(at).alias("ms"), "job_id", shard, F.coalesce(F.lower("status"), F.lit("unknown")).alias("status")).where("at is not null and job_id is not null")
    rows = "job_id string, ms long, status string, previous string, exit_code int"
    got = named.withWatermark("at", late).groupBy("shard").transformWithStateInPandas(JobWatch(patience or Patience()), rows, "Append", "EventTime")
    return got.select("job_id", F.timestamp_millis("ms").alias("at"), "status", "previous", "exit_code")


@contextlib.contextmanager
def keyed_state(spark):
    """Streams that are started in here keep their state in a store that knows timers."""
    had = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if had is None else spark.conf.set(_STORE, had)
