"""Calls in flight, deadlines, waves up to a target, and runs that are repeated."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import generate, select
from quern.sources import readers, sinks

ASK = "id long, system string, user string, max_tokens int"


def asked(spark, n):
    return spark.createDataFrame([(i, "s", f"u{i}", 5) for i in range(n)], ASK).coalesce(1)


def test_calls_overlap(spark):
    def slow(requests):
        time.sleep(0.05)
        return [u.upper() for _, u, _ in requests]

    began = time.monotonic()
    calls, got, most = generate.Calls(slow, 10), {}, 0
    todo = [[("s", f"u{i}", 5)] for i in range(200)]
    while todo or calls.running:
        while todo and len(calls.running) < 20:
            r = todo.pop()
            calls.start(r, r[0][1])
        most = max(most, len(calls.running))
        got |= {what: texts[0] for what, texts, _ in calls.wait(1)}
    assert got == {f"u{i}": f"U{i}" for i in range(200)} and most == 20 and time.monotonic() - began < 2
    generate.call_model(asked(spark, 1), slow).count()  # a worker that has started
    began = time.monotonic()
    out = generate.call_model(asked(spark, 200), slow, batch=1, in_flight=20)
    assert {r.id: r.output for r in out.collect()} == {i: f"U{i}" for i in range(200)} and time.monotonic() - began < 5


def test_calls_share_threads():
    seen = []

    def provider(requests):
        seen.append(threading.current_thread())
        return ["x"]

    calls = generate.Calls(provider, 10)
    for i in range(100):
        calls.start([("s", "u", 1)], i)
        assert list(calls.wait(5)) == [(i, ["x"], None)]
    assert len(set(seen)) == 1
    calls.cancel()
    seen[0].join(5)
    assert not seen[0].is_alive()


def test_hanging_call_is_an_error_row(spark):
    def hangs(requests):
        if requests[0][1] == "u3":
            generate.cancelled().wait(60)
        return ["x"] * (2 if requests[0][1] == "u4" else 1)

    began = time.monotonic()
    got = {r.id: (r.output, r.error) for r in generate.call_model(asked(spark, 10), hangs, batch=1, in_flight=4, timeout=1.0).collect()}
    assert time.monotonic() - began < 20
    assert got[3] == (None, "timeout after 1 seconds") and got[4] == (None, "2 answers to 1 requests") and all(got[i] == ("x", None) for i in got if i not in (3, 4))


def test_cancel_ends_retries():
    tries, ended = [], threading.Event()

    def failing(requests):
        tries.append(1)
        raise RuntimeError("503")

    def provider(requests):
        try:
            return generate.with_retry(failing, tries=9, base=0.2)(requests)
        finally:
            ended.set()

    calls = generate.Calls(provider, 0.3)
    calls.start([("s", "u", 1)], "it")
    assert list(calls.wait(2)) == [("it", None, "timeout after 0.3 seconds")]
    assert ended.wait(2) and len(tries) <= 2
    calls.start([("s", "u", 1)], "it")
    calls.cancel()
    assert ended.wait(2)


def test_waves_ask_for_hardly_more(spark):
    count = spark.sparkContext.accumulator(0)

    def work(rows):
        n = rows.count()
        count.add(n)
        return rows.withColumn("output", F.when(F.col("id") % 4 == 0, "yes").otherwise("no"))

    rows = spark.range(1000)
    order = select.shuffled(F.col("id"), 5), F.col("id")
    kept = F.col("output") == "yes"
    want = {(r.id, r.output) for r in select.until_target(work(rows), kept, 100, *order).collect()}
    count.value = 0
    got = select.in_waves(rows, work, kept, 100, *order)
    assert {(r.id, r.output) for r in got.collect()} == want and got.columns == ["id", "output"]
    assert len(want) <= count.value <= len(want) * 1.3
    assert select.in_waves(rows, work, kept, 999, *order).count() == 1000  # out of reach: all rows
    assert select.in_waves(rows, work, kept, 0, *order).count() == 0 and select.in_waves(rows.limit(0), work, kept, 5, *order).count() == 0
    assert select.in_waves(rows, work, F.lit(None).cast("boolean"), 5, *order, first=10).count() == 1000


def test_repeated_runs(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "id long, kept boolean, reject_reason string"
    rows = spark.createDataFrame([(1, True, "gone"), (2, False, None)], shape)
    assert readers.routed(spark, path, "id long").count() == 0
    assert sinks.routed(rows, path) == 0 and sinks.routed(rows, path, resume=True, batch=0) == 0
    # a run that wrote and died is not read, and its folder is written anew
    rows.write.json(f"{path}/batch=1/kept=true")
    assert readers.routed(spark, path, "id long").count() == 2
    assert sinks.routed(spark.createDataFrame([(3, True, None)], shape), path, resume=True) == 1
    got = readers.routed(spark, path, "id long, reject_reason string")
    assert {(r.id, r.kept, r.reject_reason, r.batch) for r in got.collect()} == {(1, True, None, 0), (2, False, "rejected", 0), (3, True, None, 1)}
    assert sinks.routed(rows, path) == 0 and readers.routed(spark, path, "id long").count() == 2


def test_stream_batches_once(spark, tmp_path):
    """A stream writes each of its batches once, though its sink is called twice for each."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.json(source)

    def sink(df, number):
        for _ in range(2):
            sinks.routed(df.select("id", (F.col("id") > 3).alias("kept"), F.lit(None).cast("string").alias("reject_reason")), path, resume=True, batch=number)

    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(source)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in readers.routed(spark, path, "id long").collect()) == list(range(10))
