"""Status of runs from their progress log: batch twins and the stream. ``throttle`` thins the log out.

Events: job_id, seq, created_utc, event, stage, completed, total, and optionally
unit, message, code, artifact_path, artifact_sha256. Order is ``seq``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMEOUT_S = 900

STATUS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("completed", T.LongType()),
    T.StructField("total", T.LongType()), T.StructField("unit", T.StringType()),
    T.StructField("n_warnings", T.LongType()), T.StructField("n_stages_completed", T.LongType()),
    T.StructField("artifact_path", T.StringType()), T.StructField("artifact_sha256", T.StringType()),
    T.StructField("error_code", T.StringType()), T.StructField("error_message", T.StringType()),
    T.StructField("started_utc", T.TimestampType()), T.StructField("updated_utc", T.TimestampType()),
    T.StructField("last_seq", T.LongType())])


def _with_optional(events: DataFrame) -> DataFrame:
    for name in ("unit", "message", "code", "artifact_path", "artifact_sha256"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    return events


def run_status(events: DataFrame) -> DataFrame:
    """Current state per job: every field is the latest event that sets it.

    All of it is ``max_by`` on seq, a partial aggregate of one small row per task,
    so a job with a third of all events is no bottleneck. Warnings and finished
    stages are counted here and listed by ``run_lists``.
    """
    e = _with_optional(events)
    kind = F.col("event")

    def latest(value, *kinds):
        at = F.when(kind.isin(*kinds), F.col("seq")) if kinds else F.col("seq")
        return F.max_by(value, at)

    starts, moves = "stage_started", "advance"
    status = F.when(kind == "run_started", "running").when(kind == "run_completed", "completed").when(
        kind == "run_failed", "failed")
    out = e.groupBy("job_id").agg(
        latest(status, "run_started", "run_completed", "run_failed").alias("status"),
        latest(F.when(kind != "run_completed", F.col("stage")), starts, moves, "run_completed").alias("stage"),
        latest(F.when(kind == starts, F.lit(0)).otherwise(F.col("completed")), starts, moves).cast("long").alias("completed"),
        latest(F.col("total"), starts, moves).cast("long").alias("total"),
        latest(F.col("unit"), moves).alias("unit"),
        F.count_if(kind == "warning").alias("n_warnings"),
        F.count_if(kind == "stage_completed").alias("n_stages_completed"),
        latest(F.col("artifact_path"), "run_completed").alias("artifact_path"),
        latest(F.col("artifact_sha256"), "run_completed").alias("artifact_sha256"),
        latest(F.col("code"), "run_failed").alias("error_code"),
        latest(F.col("message"), "run_failed").alias("error_message"),
        latest(F.col("created_utc"), "run_started").alias("started_utc"),
        latest(F.col("created_utc")).alias("updated_utc"), F.max("seq").alias("last_seq"))
    return out.withColumn("status", F.coalesce("status", F.lit("pending")))


def run_lists(events: DataFrame) -> DataFrame:
    """(job_id, seq, kind, text): warnings and completed stages as rows, in order of seq."""
    e = _with_optional(events).filter(F.col("event").isin("warning", "stage_completed"))
    return e.select("job_id", "seq", F.col("event").alias("kind"),
                    F.when(F.col("event") == "warning", F.col("message")).otherwise(F.col("stage")).alias("text"))


def stalled_runs(jobs: DataFrame, status: DataFrame, now, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """Effective status: queued, stalled, failed for a missing artifact, else as reported.

    ``jobs`` has job_id, launched (has a process) and has_artifact.
    """
    at = now.cast("timestamp") if hasattr(now, "isNull") else F.lit(now).cast("timestamp")
    s = jobs.join(status, "job_id", "left")
    silent = (at.cast("double") - F.col("updated_utc").cast("timestamp").cast("double")) > timeout_s
    final = (
        F.when(F.col("status").isNull() & ~F.col("launched"), "queued")
        .when(F.col("status").isNull(), "pending")
        .when((F.col("status") == "completed") & ~F.col("has_artifact"), "failed")
        .when(F.col("status").isin("pending", "running") & F.coalesce(silent, F.lit(False)), "stalled")
        .otherwise(F.col("status")))
    code = F.when((F.col("status") == "completed") & ~F.col("has_artifact"), "MissingArtifact").otherwise(F.col("error_code"))
    return s.select("job_id", final.alias("status"), "stage", code.alias("error_code"), "updated_utc")


def drop_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Repeated lines out: within a watermark on a stream, over all rows in a batch."""
    if events.isStreaming:
        return events.withWatermark("created_utc", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])
    return events.dropDuplicates(["job_id", "seq"])


_FIELDS = [f.name for f in STATUS.fields]

#: What one kind of event sets together; each keeps the seq of its latest event.
_GROUPS = ("status", "stage", "progress", "unit", "artifact", "error", "started", "updated")
_AT = ("started_utc", "updated_utc")  # microseconds inside the stream
_ROW = T.StructType([T.StructField(f.name, T.LongType()) if f.name in _AT else f for f in STATUS.fields])
_STATE = T.StructType([*_ROW.fields, *(T.StructField(f"seq_{g}", T.LongType()) for g in _GROUPS)])
_STATE_FIELDS = [f.name for f in _STATE.fields]
ENDS = {"run_started": "running", "run_completed": "completed", "run_failed": "failed"}


def _number(v):
    return None if v is None or v != v else int(v)


def _text(v):
    return None if v is None or v != v else v


_READ = ("seq", "at", "event", "stage", "completed", "total", "unit", "message", "code", "artifact_path", "artifact_sha256")


def _fold(state: dict, rows: pd.DataFrame) -> None:
    """One batch of new events onto the state of its job, whatever their order.

    As in the batch twin every field follows its own latest event, so an event that
    arrives late changes what later ones have not set. A job has few events in a
    trigger: one pass over plain values costs less than a frame's filters.
    """
    for seq, at, event, stage, completed, total, unit, message, code, path, sha256 in zip(*(rows[c].tolist() for c in _READ)):
        if event in ENDS and seq > state["seq_status"]:
            state["seq_status"], state["status"] = seq, ENDS[event]
        if event in ("stage_started", "advance", "run_completed") and seq > state["seq_stage"]:
            state["seq_stage"], state["stage"] = seq, None if event == "run_completed" else _text(stage)
        if event in ("stage_started", "advance") and seq > state["seq_progress"]:
            state["seq_progress"], state["total"] = seq, _number(total)
            state["completed"] = 0 if event == "stage_started" else _number(completed)
        if event == "advance" and seq > state["seq_unit"]:
            state["seq_unit"], state["unit"] = seq, _text(unit)
        if event == "run_completed" and seq > state["seq_artifact"]:
            state["seq_artifact"], state["artifact_path"], state["artifact_sha256"] = seq, _text(path), _text(sha256)
        if event == "run_failed" and seq > state["seq_error"]:
            state["seq_error"], state["error_code"], state["error_message"] = seq, _text(code), _text(message)
        if event == "run_started" and seq > state["seq_started"]:
            state["seq_started"], state["started_utc"] = seq, _number(at)
        if seq > state["seq_updated"]:
            state["seq_updated"], state["updated_utc"], state["last_seq"] = seq, _number(at), seq
        state["n_warnings"] += event == "warning"
        state["n_stages_completed"] += event == "stage_completed"


def _out(state: dict) -> pd.DataFrame:
    """A row as text: a frame of one column is made and put together much faster than one of fifteen."""
    return pd.DataFrame({"row": [json.dumps({f: state[f] for f in _FIELDS})]})


def _follow(key, batches, state):
    if state.hasTimedOut:
        # A silent job keeps its state and may go on; a finished one is forgotten, and
        # lines older than the watermark can no longer bring it back.
        current = dict(zip(_STATE_FIELDS, state.get))
        if current["status"] in ("pending", "running"):
            current["status"] = "stalled"
            yield _out(current)
        else:
            state.remove()
        return
    if state.exists:
        current = dict(zip(_STATE_FIELDS, state.get))
    else:
        current = dict.fromkeys(_STATE_FIELDS)
        current.update(job_id=key[0], status="pending", n_warnings=0, n_stages_completed=0, last_seq=-1,
                       **{f"seq_{g}": -1 for g in _GROUPS})
    for batch in batches:  # a job's trigger comes in pieces; none needs the others
        if len(batch):
            _fold(current, batch)
    state.update(tuple(current[f] for f in _STATE_FIELDS))
    if current["updated_utc"] is not None:
        due = current["updated_utc"] // 1000 + TIMEOUT_S * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    yield _out(current)


def run_status_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same status per job as a stream of updates, with stalls by event time.

    State is one small row per job. Repeated lines are dropped within the watermark, and
    a late line sets only what no later one has set, so triggers may cut and mix the log
    in any way. A job is reported as stalled once the watermark is ``TIMEOUT_S`` behind
    its last event: with ``delay`` the watermark itself lags, so choose it as small as
    late lines allow. ``events`` comes from ``stream_progress_events``.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    ready = _with_optional(events).select(
        F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), "created_utc", F.unix_micros(F.col("created_utc").cast("timestamp")).alias("at"),
        "event", "stage", F.col("completed").cast("long").alias("completed"), F.col("total").cast("long").alias("total"),
        "unit", "message", "code", "artifact_path", "artifact_sha256").withWatermark("created_utc", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])
    rows = ready.groupBy("job_id").applyInPandasWithState(
        _follow, "row string", _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    out = rows.select(F.from_json("row", _ROW).alias("r")).select("r.*")
    return out.withColumns({c: F.timestamp_micros(c) for c in _AT})
