"""Jobs watched through a stream: late snapshots, a restart, ends, silence and forgetting."""

import json

from quern.streaming import jobs, snapshots


def run(spark, tmp_path, patience):
    with jobs.keyed_state(spark):
        snapshots.write(jobs.watched(snapshots.read(spark, str(tmp_path / "in")), patience, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return sorted((r.job_id, r.at.strftime("%H:%M:%S"), r.status, r.previous, r.exit_code) for r in spark.read.schema(jobs.OUT).parquet(str(tmp_path / "out")).collect() if r.job_id != "~")


def put(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"captured_at": f"2024-01-01T{at}Z", "poll_index": 0, "status": status, "job_id": job, "payload": "{}"}) for job, at, status in rows))


def test_deadline():
    p = jobs.Patience(interval=10, backoff=2, most=30, all_=100)
    assert [p.deadline(0, 0, n) for n in (1, 2, 3, 4, 99)] == [10_000, 20_000, 30_000, 30_000, 30_000] and p.deadline(0, 90_000, 3) == 100_000


def test_watched_jobs(spark, tmp_path):
    patience = jobs.Patience(interval=600, backoff=1.5, most=1200, all_=7200, forget=3600)
    put(tmp_path, "a", [("a", "01:00:00", "QUEUED"), ("a", "01:05:00", "RUNNING"), ("b", "01:00:00", "QUEUED"), ("c", "01:00:00", "SUCCESS"), ("d", None, "RUNNING"), (None, "01:00:00", "RUNNING")])
    assert all(r[0] != "d" for r in run(spark, tmp_path, patience))
    # within the watermark a snapshot may come late; b falls silent; a goes on from the checkpoint and returns to a status
    put(tmp_path, "b", [("a", "01:03:00", "PAUSED"), ("a", "01:10:00", "QUEUED"), ("a", "01:20:00", "FAILED"), ("a", "01:21:00", "RUNNING"), ("~", "01:40:00", "QUEUED")])
    got = run(spark, tmp_path, patience)
    put(tmp_path, "c", [("a", "01:01:00", "SUCCESS"), ("c", "01:31:00", "RUNNING"), ("c", "03:00:00", "QUEUED"), ("~", "05:00:00", "QUEUED")])  # the first is too late, the second of an ended job
    got = run(spark, tmp_path, patience)
    assert [r for r in got if r[0] == "a"] == [("a", "01:00:00", "queued", None, None), ("a", "01:03:00", "paused", "queued", None), ("a", "01:05:00", "running", "paused", None), ("a", "01:10:00", "queued", "running", None), ("a", "01:20:00", "failed", "queued", 2)]
    assert [r for r in got if r[0] == "b"] == [("b", "01:00:00", "queued", None, None), ("b", "01:10:00", "timeout", "queued", 3)]
    # an ended job is forgotten after an hour: its number begins anew
    assert [r for r in got if r[0] == "c"] == [("c", "01:00:00", "success", None, 0), ("c", "03:00:00", "queued", None, None), ("c", "03:10:00", "timeout", "queued", 3)]


def test_jobs_share_calls(spark, tmp_path):
    """Jobs of one shard do not mix, and a shard is called once a batch, however many jobs it has."""
    patience, n = jobs.Patience(interval=600, backoff=1.5, most=1200, all_=7200, forget=3600), 300
    put(tmp_path, "a", [(f"j{i}", f"01:00:{i % 60:02d}", "QUEUED") for i in range(n)])
    put(tmp_path, "b", [(f"j{i}", f"01:05:{i % 60:02d}", "SUCCESS" if i % 3 == 0 else "RUNNING") for i in range(n)] + [("~", "05:00:00", "QUEUED")])
    with jobs.keyed_state(spark):
        query = snapshots.write(jobs.watched(snapshots.read(spark, str(tmp_path / "in")), patience, "10 minutes", shards=5), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
    got = {}
    for r in spark.read.schema(jobs.OUT).parquet(str(tmp_path / "out")).orderBy("at").collect():
        got.setdefault(r.job_id, []).append((r.at.strftime("%H:%M:%S"), r.status, r.previous, r.exit_code))
    for i in range(n):
        s = f"{i % 60:02d}"
        end = [(f"01:05:{s}", "success", "queued", 0)] if i % 3 == 0 else [(f"01:05:{s}", "running", "queued", None), (f"01:20:{s}", "timeout", "running", 3)]
        assert got[f"j{i}"] == [(f"01:00:{s}", "queued", None, None), *end]
    states = [op["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for op in p["stateOperators"]]
    assert sum(states) <= 3 * 5


def test_times_in_any_zone(spark, tmp_path):
    had = spark.conf.get("spark.sql.session.timeZone")
    put(tmp_path, "a", [("a", "01:00:00", "QUEUED"), ("~", "05:00:00", "QUEUED")])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with jobs.keyed_state(spark):
            snapshots.write(jobs.watched(snapshots.read(spark, str(tmp_path / "in")), late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = spark.read.schema(jobs.OUT).parquet(str(tmp_path / "out")).where("job_id = 'a'").selectExpr("unix_millis(at) AS ms").orderBy("ms").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", had)
    assert [r.ms for r in got] == [1704070800000, 1704070830000]
