"""External model steps as pluggable partition functions. The default provider is a deterministic mock.

Each task keeps a bounded number of calls in flight, gives every call a deadline, hands rows on as calls end, and cancels
what is still running when it stops.
"""

from __future__ import annotations

import queue
import random
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import importable
from ..functions.prompts import judge_messages
from ..functions.text import json_object, optional_float

#: Takes a list of (system, user, max_tokens), returns texts or raises. It may look at :func:`cancelled` now and then.
Provider = Callable[[list[tuple[str, str, int]]], list[str]]

#: Calls of a task in flight, seconds for each.
IN_FLIGHT, TIMEOUT = 16, 240.0
#: Rows are handed on when so many are done, or after so many seconds.
HAND_ON, PAUSE = 256, 1.0

_call = threading.local()


class Cancelled(RuntimeError):
    pass


def cancelled() -> threading.Event:
    """Set when nobody waits for the running call any more (its time is up, or its task ends)."""
    if not hasattr(_call, "event"):
        _call.event = threading.Event()
    return _call.event


# Parts of messages of errors that are worth another try.
RETRYABLE = ("502", "503", "504", "429", "bad gateway", "service unavailable", "gateway timeout", "rate limit", "too many requests", "connection", "timeout", "reset")


def mock(requests: list[tuple[str, str, int]]) -> list[str]:
    """An empty but well-formed response for each request."""
    body = "Substitution Plan:\n{0}\n\nAdapted Ingredients:\n- 1 cup water\n\nAdapted Steps:\n1. Mix.\n\nFlavor Preservation Notes:\n- mild\n\nConstraint Check:\n- ok"
    return [body.format("Keep as is.") for _ in requests]


def with_retry(provider: Provider, tries: int = 3, base: float = 5.0, most: float = 60.0, sleep=None) -> Provider:
    """Try again with doubling, jittered waits where the error looks passing. A cancelled call neither waits nor tries again."""

    def call(requests):
        over = cancelled()
        pause = sleep or over.wait
        for k in range(tries):
            if over.is_set():
                raise Cancelled("call cancelled by caller")
            try:
                return provider(requests)
            except Exception as e:
                if k + 1 == tries or not any(t in str(e).lower() for t in RETRYABLE):
                    raise
                pause(min(most, base * 2**k) * (1 + random.random() / 4))
        return []

    return call


class Calls:
    """Calls in flight, each in a thread that nothing else runs in (a hanging one keeps no other from its turn). A thread whose
    call has ended takes the next one."""

    def __init__(self, provider: Provider, timeout: float):
        self.provider, self.timeout = provider, timeout
        self.done: queue.SimpleQueue = queue.SimpleQueue()
        self.running: dict[int, tuple[float, threading.Event, object]] = {}
        self.started = 0
        self.inboxes: list[queue.SimpleQueue] = []
        self.idle: list[queue.SimpleQueue] = []

    def start(self, requests: list[tuple[str, str, int]], what) -> None:
        key, over = self.started, threading.Event()
        self.started += 1

        if not self.idle:
            self.inboxes.append(inbox := queue.SimpleQueue())
            self.idle.append(inbox)
            threading.Thread(target=self._run, args=(inbox,), daemon=True).start()
        self.running[key] = (time.monotonic() + self.timeout, over, what)
        self.idle.pop().put((key, over, requests))

    def _run(self, inbox: queue.SimpleQueue) -> None:
        while (call := inbox.get()) is not None:
            key, _call.event, requests = call
            try:
                ended = key, self.provider(requests), None
            except BaseException as e:
                ended = key, None, str(e)
            self.done.put((*ended, inbox))

    def wait(self, most: float) -> Iterator[tuple[object, list[str] | None, str | None]]:
        """(what, texts, error) of the calls that end, or whose time is up, within ``most`` seconds; waits for one at least."""
        until = time.monotonic() + most
        first = min((t for t, _, _ in self.running.values()), default=until)
        try:
            key, texts, error, inbox = self.done.get(timeout=max(0.0, min(until, first) - time.monotonic()))
            while True:
                self.idle.append(inbox)
                if key in self.running:  # else its time was up before
                    yield self.running.pop(key)[2], texts, error
                key, texts, error, inbox = self.done.get_nowait()
        except queue.Empty:
            pass
        now = time.monotonic()
        for key in [k for k, (t, _, _) in self.running.items() if t <= now]:
            _, over, what = self.running.pop(key)
            over.set()
            yield what, None, f"timeout after {self.timeout:g} seconds"

    def cancel(self) -> None:
        for _, over, _ in self.running.values():
            over.set()
        for inbox in self.inboxes:  # a thread ends with the call that it is in
            inbox.put(None)


def call_model(df: DataFrame, provider: Provider = mock, batch: int = 32, in_flight: int = IN_FLIGHT, timeout: float = TIMEOUT) -> DataFrame:
    """``df`` (system, user, max_tokens and others) with ``output`` and ``error``: one of them is null.

    Filters belong before this step: Catalyst does not move them across it. A call asks for ``batch`` rows; a task has up to ``in_flight``
    calls running and reads on only as they end. A call that takes over ``timeout`` seconds, or answers for another number of rows, gives
    error rows. Rows come out in the order in which calls end.
    """
    importable(df.sparkSession)
    out = df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("output", "error")]).schema
    at = [df.columns.index(c) for c in ("system", "user", "max_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls, ready, held = Calls(provider, timeout), [], 0
        last = time.monotonic()

        def each():
            for b in batches:
                asked = list(zip(*(b.column(i).to_pylist() for i in at), strict=True))
                for i in range(0, b.num_rows, batch):
                    yield b.slice(i, batch), asked[i : i + batch]

        chunks = each()

        def finished(rows: pa.RecordBatch, texts, error) -> tuple[pa.RecordBatch, list, list]:
            n = rows.num_rows
            if error is None and len(texts) != n:
                texts, error = None, f"{len(texts)} answers to {n} requests"
            return rows, texts if texts is not None else [None] * n, [error] * n

        def hand_on():
            table = pa.Table.from_batches([rows for rows, _, _ in ready])
            for name, i in (("output", 1), ("error", 2)):
                table = table.append_column(name, pa.array([x for r in ready for x in r[i]], pa.string()))
            ready.clear()
            return table.combine_chunks().to_batches()

        try:
            more = True
            while more or calls.running:
                while more and len(calls.running) < in_flight:
                    if (chunk := next(chunks, None)) is None:
                        more = False
                    else:
                        calls.start(chunk[1], chunk[0])
                for rows, texts, error in calls.wait(PAUSE) if calls.running else ():
                    ready.append(finished(rows, texts, error))
                    held += rows.num_rows
                if ready and (held >= HAND_ON or time.monotonic() - last > PAUSE):
                    yield from hand_on()
                    held, last = 0, time.monotonic()
            if ready:
                yield from hand_on()
        finally:
            calls.cancel()

    return df.mapInArrow(run, out)


# The reply of a judge in a dry run.
JUDGE_MOCK = '{"compliance": 7, "flavor_fidelity": 7, "dish_identity_preservation": 7, "explanation_quality": 7, "overall_score": 7.0, "verdict": "PASS", "notes": "dry_run mock judge output"}'


def judge_mock(requests: list[tuple[str, str, int]]) -> list[str]:
    return [JUDGE_MOCK for _ in requests]


def judged(rows: DataFrame, provider: Provider = judge_mock, batch: int = 32, max_tokens: int = 512) -> DataFrame:
    """``rows`` (restrictions, user_text, output_text and others) with ``judge``: the overall score that the judge's reply
    has (a number or numeric text), and ``judge_reply``, its JSON; null where there is none."""
    asked = judge_messages(F.col("restrictions"), F.col("user_text"), F.col("output_text"))
    todo = rows.withColumn("_m", asked).select(*rows.columns, F.col("_m")[0]["content"].alias("system"), F.col("_m")[1]["content"].alias("user"), F.lit(max_tokens).alias("max_tokens"))
    done = call_model(todo, provider, batch).withColumn("judge_reply", json_object(F.col("output")))
    return done.withColumn("judge", optional_float(F.col("judge_reply"), "$.overall_score")).drop("system", "user", "max_tokens", "output", "error")


def scored_output(output, error):
    """What an endpoint's row is scored on: its output, or a note of its error."""
    return F.coalesce(output, F.concat(F.lit("[space_error] "), error))
