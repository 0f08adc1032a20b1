"""The stream of statuses over several triggers equals the batch twin."""

import json
import random

from pyspark.sql import functions as F

from plumbline.sources.events import read_progress_events, stream_progress_events
from plumbline.streaming import progress, stalls, throttle

SHOWN = ("job_id", "status", "stage", "completed", "total", "n_warnings", "n_stages_completed", "last_seq")


def written_events():
    r = random.Random(4)
    events = []
    for job in range(6):
        kinds = ["run_started", "stage_started", "advance", "warning", "advance", "stage_completed", "stage_started", "advance", "warning", "stage_completed"]
        kinds += ["run_completed", "run_failed", "advance"][job % 3:job % 3 + 1]
        for seq, kind in enumerate(kinds):
            events.append({"schema": 1, "seq": seq, "created_utc": f"2024-05-01T10:{seq:02d}:{job:02d}Z", "job_id": f"j{job}", "event": kind,
                           "stage": f"s{seq // 5}", "completed": seq, "total": 20, "message": "m", "code": "E"})
    late = events + r.sample(events, 25)
    r.shuffle(late)
    return late


def test_late_and_repeated_lines_in_several_triggers(spark, tmp_path):
    source, out, check = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    events = written_events()
    for i in range(0, len(events), 12):
        (source / f"{i:03d}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events[i:i + 12]))
    stream = progress.run_status_stream(stream_progress_events(spark, str(source), max_files=1), delay="1 hour")
    query = stream.writeStream.outputMode("update").foreachBatch(
        lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).option(
        "checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(out).groupBy("job_id").agg(F.max_by(F.struct(*SHOWN[1:]), "n").alias("r")).select("job_id", "r.*")
    batch = progress.run_status(progress.drop_repeats(read_progress_events(spark, str(source)))).select(*SHOWN)
    assert sorted(map(tuple, last.select(*SHOWN).collect())) == sorted(map(tuple, batch.collect()))
    assert {r["n_warnings"] for r in batch.collect()} == {2}


class _Store:
    """A state store of one key that notes its calls."""

    def __init__(self):
        self.calls, self.values = [], {}

    def getValueState(self, name, schema):
        return _Value(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls.append("timer")


class _Value:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls.append("get")
        return self.store.values.get(self.name)

    def update(self, value):
        self.store.calls.append("update")
        self.store.values[self.name] = value

    def appendList(self, values):
        self.update((self.store.values.get(self.name) or []) + values)

    def clear(self):
        self.store.values.pop(self.name)


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_job_is_read_and_written_once_in_a_trigger():
    store, job = _Store(), stalls._Stalls(1000)
    job.init(store)
    job.handleInitialState(("7",), {"launched": True, "has_artifact": True}, None)
    store.calls.clear()
    rows = [{"event": "run_started", "seq": i, "stage": "s", "code": None, "at": 5_000_000 + i} for i in range(3)]
    assert [r["status"] for r in job.handleInputRows(("7",), iter(rows), None)] == ["running"]
    assert store.calls == ["get", "update"]
    assert not list(job.handleExpiredTimer(("7",), _Now(5500), None))
    assert [r["status"] for r in job.handleExpiredTimer(("7",), _Now(6001), None)] == ["stalled"]


def test_stages_of_a_job_share_one_state():
    store, gap = _Store(), throttle._Gap(100)
    gap.init(store)
    rows = [{"moving": True, "at": at, "seq": at, "final": False, "at_stage": stage, "row": f"{stage}{at}"}
            for at, stage in ((0, "a"), (10, "b"), (50, "a"), (120, "a"), (130, "b"))]
    assert not list(gap.handleInputRows(("j",), iter(rows), None)) and store.calls == ["update", "timer"]
    assert [r["row"] for r in gap.handleExpiredTimer(("j",), _Now(1), None)] == ["a0", "b10", "a120", "b130"]


def test_a_status_leaves_as_one_column():
    """Frames of one column, times as microseconds in the state."""
    state = dict.fromkeys(progress._STATE_FIELDS)
    state.update(job_id="j", status="pending", n_warnings=0, n_stages_completed=0, last_seq=-1, **{f"seq_{g}": -1 for g in progress._GROUPS})
    rows = progress.pd.DataFrame([{**dict.fromkeys(progress._READ), "seq": 4, "at": 4_000_000, "event": "run_started"}])
    progress._fold(state, rows)
    assert (state["status"], state["started_utc"], state["last_seq"]) == ("running", 4_000_000, 4)
    assert progress._out(state).columns.tolist() == ["row"]
