"""Effective status of runs as a stream: queued, pending, stalled, failed for a missing artifact, or as reported.

The jobs table is the initial state: one small row per job. Time is the watermark. A job
without events is reported once the watermark moves, as queued or pending; every event
sets its job's timer anew, and a timer that runs out on a job that has not ended reports
it as stalled. A later event brings it back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import TIMEOUT_S, ENDS
from .throttle import STORE

OUT = "job_id string, status string, stage string, error_code string, updated long, last_seq long"
#: A job's row, its events so far and when its timer runs out (0: none), read and written at once.
_STATE = "launched boolean, has_artifact boolean, timer long, status string, status_seq long, stage string, stage_seq long, code string, code_seq long, updated long, last_seq long"
_FRESH = (None, -1, None, -1, None, -1, 0, -1)


def effective(job: tuple, seen: tuple, stalled: bool) -> tuple[str, str | None, str | None]:
    """(status, stage, error_code) from a job's row and its events so far."""
    launched, has_artifact = job
    status, _, stage, _, code, _, _, last_seq = seen
    if last_seq < 0:
        return "pending" if launched else "queued", None, None
    status = status or "pending"
    if status == "completed" and not has_artifact:
        return "failed", stage, "MissingArtifact"
    return "stalled" if stalled and status in ("pending", "running") else status, stage, code


class _Stalls(StatefulProcessor):
    """A call of the state store costs more than a job's events, so a trigger reads and writes a job once and a job has one timer.

    The timer stays where it is while events come; when it runs out early it is set anew.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        # The first time that the watermark moves.
        self.state.update((bool(initialState["launched"]), bool(initialState["has_artifact"]), 1, *_FRESH))
        self.handle.registerTimer(1)

    def _row(self, key, job: tuple, seen: tuple, stalled: bool) -> Row:
        status, stage, code = effective(job, seen, stalled)
        return Row(job_id=key[0], status=status, stage=stage, error_code=code, updated=seen[6] if seen[7] >= 0 else None, last_seq=seen[7])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.state.get()
        if state is None:  # no job of the table
            return
        launched, has_artifact, timer, status, status_seq, stage, stage_seq, code, code_seq, updated, last = state
        for row in rows:
            kind, seq = row["event"], row["seq"]
            if seq is None:
                continue
            if kind in ENDS and seq > status_seq:
                status, status_seq = ENDS[kind], seq
            if kind in ("stage_started", "advance", "run_completed") and seq > stage_seq:
                stage, stage_seq = (None if kind == "run_completed" else row["stage"]), seq
            if kind == "run_failed" and seq > code_seq:
                code, code_seq = row["code"], seq
            if seq > last:
                updated, last = row["at"], seq
        seen = (status, status_seq, stage, stage_seq, code, code_seq, updated, last)
        if not timer:
            timer = updated // 1000 + self.timeout_ms + 1
            self.handle.registerTimer(timer)
        self.state.update((launched, has_artifact, timer, *seen))
        yield self._row(key, (launched, has_artifact), seen, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        launched, has_artifact, _, *seen = self.state.get()
        due = seen[6] // 1000 + self.timeout_ms
        if seen[7] >= 0 and timerValues.getCurrentWatermarkInMs() <= due:
            self.handle.registerTimer(due + 1)
            self.state.update((launched, has_artifact, due + 1, *seen))
            return
        self.state.update((launched, has_artifact, 0, *seen))
        if seen[7] < 0 or seen[0] in (None, "running"):
            yield self._row(key, (launched, has_artifact), tuple(seen), True)

    def close(self) -> None:
        pass


def stalled_stream(jobs: DataFrame, events: DataFrame, timeout_s: int = TIMEOUT_S, delay: str = "10 seconds") -> DataFrame:
    """Updates of (job_id, status, stage, error_code, updated_utc, last_seq); the last one of a job is ``stalled_runs`` at the watermark.

    ``jobs`` has job_id, launched and has_artifact, one row per job; events of other jobs
    are not reported. Late and repeated lines change nothing that a later line has set.
    """
    events.sparkSession.conf.set(*STORE)
    if "code" not in events.columns:
        events = events.withColumn("code", F.lit(None).cast("string"))
    rows = events.select("created_utc", F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), "event", "stage", "code",
                         F.unix_micros(F.col("created_utc").cast("timestamp")).alias("at")).withWatermark("created_utc", delay)
    known = jobs.select(F.col("job_id").cast("string").alias("job_id"), F.coalesce("launched", F.lit(False)).alias("launched"),
                        F.coalesce("has_artifact", F.lit(False)).alias("has_artifact"))
    out = rows.groupBy("job_id").transformWithState(
        statefulProcessor=_Stalls(timeout_s * 1000), outputStructType=OUT, outputMode="Update", timeMode="EventTime", initialState=known.groupBy("job_id"))
    return out.select("job_id", "status", "stage", "error_code", F.timestamp_micros("updated").alias("updated_utc"), "last_seq")
