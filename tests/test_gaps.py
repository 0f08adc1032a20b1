"""Throttle and stalls as streams over files in mixed triggers equal their batch twins."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources.events import read_progress_events, stream_progress_events
from plumbline.streaming import progress, stalls, throttle


def stamp(ms):
    return f"2024-05-01T{10 + ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"


def advances():
    r = random.Random(6)
    out = []
    for job in ("a", "b"):
        at = 0
        for seq in range(160):
            at += r.choice([1, 20, 90, 249, 250, 400])
            kind = "advance" if r.random() < .9 else "warning"
            done = 10 if r.random() < .05 else r.randint(0, 9)
            out.append((at, {"seq": seq, "created_utc": stamp(at), "job_id": job, "event": kind, "stage": f"s{seq % 2}", "completed": done, "total": 10}))
    return sorted(out, key=lambda x: x[0])


def brute(events):
    last, kept = {}, set()
    for at, e in sorted(events, key=lambda x: (x[0], x[1]["seq"])):
        key = e["job_id"], e["stage"]
        if e["event"] != "advance":
            kept.add((e["job_id"], e["seq"]))
        elif e["completed"] >= e["total"] or key not in last or at - last[key] >= 250:
            last[key] = at
            kept.add((e["job_id"], e["seq"]))
    return kept


def dated(folder):
    """A stream takes files in the order of their dates."""
    for n, path in enumerate(sorted(folder.iterdir())):
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def run(stream, tmp_path, mode):
    out = str(tmp_path / "out")
    query = stream.writeStream.outputMode(mode).foreachBatch(
        lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def write(folder, events, size, seed):
    """Files of ``size`` lines, in disorder of up to three files; then a line of another job that moves the watermark on."""
    folder.mkdir()
    r = random.Random(seed)
    order = sorted(range(len(events)), key=lambda i: i + r.uniform(0, 3 * size))
    for n, i in enumerate(range(0, len(order), size)):
        (folder / f"{n:03d}.jsonl").write_text("".join(json.dumps(events[j][1]) + "\n" for j in order[i:i + size]))
    far = max(at for at, _ in events) + 3_600_000
    for n in range(2):
        (folder / f"999{n}.jsonl").write_text(json.dumps({"seq": n, "created_utc": stamp(far + n), "job_id": "clock", "event": "warning", "stage": "s"}) + "\n")
    dated(folder)


@pytest.mark.parametrize("size", [17])
def test_throttle_stream_equals_batch(spark, tmp_path, size):
    events = advances()
    source = tmp_path / "log"
    write(source, events, size, size)
    batch = throttle.throttle(read_progress_events(spark, str(source)))
    kept = {(r.job_id, r.seq) for r in batch.collect() if r.job_id != "clock"}
    assert kept == brute(events)
    out = run(throttle.throttle_stream(stream_progress_events(spark, str(source), max_files=1), delay="1 minute"), tmp_path, "append")
    got = spark.read.parquet(out)
    assert set(batch.columns) <= set(got.columns)
    rows = [(r.job_id, r.seq) for r in got.collect() if r.job_id != "clock"]
    assert len(rows) == len(set(rows)) and set(rows) == kept
    assert got.select("n").distinct().count() > 3


def test_throttle_odd_rows(spark):
    rows = [(None, 1, None, "advance", None, None, None), ("j", 2, None, "advance", "s", 1, 10), ("j", 3, None, "advance", "s", 2, 10), ("j", 3, None, None, "s", 2, 10)]
    frame = spark.createDataFrame(rows, "job_id string, seq long, created_utc timestamp, event string, stage string, completed long, total long")
    assert throttle.throttle(frame).count() == 3
    assert throttle.throttle(frame.limit(0)).count() == 0


def test_stalls_stream_equals_batch(spark, tmp_path):
    r = random.Random(9)
    events = []
    for job in range(12):
        at, kinds = r.randint(0, 3_000_000), ["run_started", "stage_started", "advance", "warning"][:1 + job % 4]
        kinds += [["run_completed"], ["run_failed"], []][job % 3]
        for seq, kind in enumerate(kinds):
            at += r.randint(1, 200_000)
            events.append((at, {"seq": seq, "created_utc": stamp(at), "job_id": f"j{job}", "event": kind, "stage": f"s{seq}", "completed": 1, "total": 2, "code": "E" if kind == "run_failed" else None}))
    events.sort(key=lambda x: x[0])
    source = tmp_path / "log"
    source.mkdir()
    for n in range(0, len(events), 5):
        (source / f"{n:03d}.jsonl").write_text("".join(json.dumps(e) + "\n" for _, e in events[n:n + 5]))
    now = events[-1][0] + 300_000
    for n in range(2):
        (source / f"999{n}.jsonl").write_text(json.dumps({"seq": n, "created_utc": stamp(now + 10_000), "job_id": "clock", "event": "warning"}) + "\n")
    dated(source)
    jobs = spark.createDataFrame([(f"j{i}", i % 2 == 0, i % 4 != 0) for i in range(16)], "job_id string, launched boolean, has_artifact boolean")
    out = run(stalls.stalled_stream(jobs, stream_progress_events(spark, str(source), max_files=1), delay="10 seconds"), tmp_path, "update")
    updates = spark.read.parquet(out)
    last = updates.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "error_code"), F.struct("n", "last_seq")).alias("r")).select("job_id", "r.*")
    status = progress.run_status(read_progress_events(spark, str(source)))
    batch = progress.stalled_runs(jobs, status, F.lit(stamp(now)).cast("timestamp")).select("job_id", "status", "stage", "error_code")
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    seen = {r.status for r in batch.collect()}
    assert {"queued", "pending", "stalled", "failed", "completed"} <= seen
    assert updates.filter("status = 'stalled'").count() >= 2
