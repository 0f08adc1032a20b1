"""At most one advance in a quarter of a second per job and stage, in batch and as a stream.

The gap is a real one: an advance is kept when it comes ``window_ms`` after the last one
that was kept, in the order of (created_utc, seq). An advance that completes its stage is
always kept, and the gap goes on from it. Events of other kinds pass.

Both forms run the same rule over the same order. In batch a task streams through its
sorted jobs and holds one time stamp. The stream holds events back until the watermark has
passed them, so files that mix the order, within the watermark's delay, change nothing;
what was kept last stays in the state from one trigger to the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

THROTTLE_MS = 250

#: The state store that ``transformWithStateInPandas`` needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _wrapped(events: DataFrame) -> DataFrame:
    """Key, order and kind of every event next to the event itself as text."""
    moving = F.coalesce(F.col("event") == "advance", F.lit(False))
    final = F.coalesce(F.col("completed") >= F.col("total"), F.lit(False))
    return events.select(
        "created_utc", F.coalesce(F.col("job_id").cast("string"), F.lit("")).alias("job"), F.coalesce(F.col("stage").cast("string"), F.lit("")).alias("at_stage"),
        F.coalesce(F.unix_micros(F.col("created_utc").cast("timestamp")), F.lit(0)).alias("at"), F.col("seq").cast("long").alias("seq"),
        moving.alias("moving"), final.alias("final"), F.to_json(F.struct(*events.columns), _STAMPS).alias("row"))


def _unwrapped(rows: DataFrame, schema) -> DataFrame:
    return rows.select(F.from_json("row", schema, _STAMPS).alias("e")).select("e.*")


def keeps(events: Iterable[tuple[int, bool]], last: int | None, window: int) -> Iterator[tuple[bool, int | None]]:
    """For every (time, final) in order: whether it stays, and what was kept last by then."""
    for at, final in events:
        stays = final or last is None or at - last >= window
        if stays:
            last = at
        yield stays, last


def throttle(events: DataFrame, window_ms: int = THROTTLE_MS) -> DataFrame:
    """The events that stay, over a whole table. A null time counts as the earliest, a null job or stage as an empty one.

    A job's stage is thinned out in one pass of one task, which streams through its
    events in order and holds nothing of them.
    """
    if window_ms < 0:
        raise ValueError("the gap must not be negative")
    wrapped = _wrapped(events).drop("created_utc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            stay = []
            for job, stage, at, final in zip(batch["job"], batch["at_stage"], batch["at"].tolist(), batch["final"].tolist()):
                if (job, stage) != key:
                    key, last = (job, stage), None
                ((stays, last),) = keeps([(at, final)], last, window_ms * 1000)
                stay.append(stays)
            yield batch.loc[stay, ["row"]]

    ordered = wrapped.filter("moving").repartition("job", "at_stage").sortWithinPartitions("job", "at_stage", "at", "seq")
    kept = ordered.select("job", "at_stage", "at", "final", "row").mapInPandas(run, "row string")
    return _unwrapped(kept.unionByName(wrapped.filter("NOT moving").select("row")), events.schema)


class _Gap(StatefulProcessor):
    """Per job: the events that wait for the watermark, and for each of its stages the time of the last one kept.

    A job's few stages share one state, as a call of the state store costs more than their events.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, final boolean, at_stage string, row string")
        self.last = handle.getValueState("last", "stages array<string>, at array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = []
        for row in rows:
            if row["moving"]:
                held.append((row["at"], row["seq"], row["final"], row["at_stage"], row["row"]))
            else:
                yield Row(row=row["row"])
        if held:
            self.waiting.appendList(held)
            self.handle.registerTimer(max(at for at, *_ in held) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        ready = [w for w in waiting if w[0] < passed]
        if not ready:
            return
        last = dict(zip(*(self.last.get() or ((), ()))))
        for at, _, final, stage, row in ready:
            ((stays, last[stage]),) = keeps([(at, final)], last.get(stage), self.window)
            if stays:
                yield Row(row=row)
        self.last.update((list(last), list(last.values())))
        if len(ready) < len(waiting):
            self.waiting.put(waiting[len(ready):])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, window_ms: int = THROTTLE_MS, delay: str = "10 seconds") -> DataFrame:
    """The same events as ``throttle`` keeps, as a stream in append mode.

    An advance leaves once the watermark (``delay`` behind the latest event) has passed
    it; other events leave at once. Lines later than the watermark are dropped. The state
    of a job's stage is its events within the delay and one time stamp.
    """
    events.sparkSession.conf.set(*STORE)
    wrapped = _wrapped(events).withWatermark("created_utc", delay)
    rows = wrapped.groupBy("job").transformWithState(
        statefulProcessor=_Gap(window_ms * 1000), outputStructType="row string", outputMode="Append", timeMode="EventTime")
    return _unwrapped(rows, events.schema)
