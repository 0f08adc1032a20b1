"""Run status from the event log, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import fresh_path
from ..sources.events import stream_progress_events
from ..streaming import progress, stalls, throttle
from .files import MICROS, event_file
from .views import view

SHOWN = ("status", "stage", "completed", "total", "n_warnings", "n_stages_completed", "last_seq")


def _shown(df):
    return df.select(F.col("job_id").cast("long").alias("job_id"), *SHOWN, F.date_format("updated_utc", MICROS).alias("updated"),
                     F.date_format("started_utc", MICROS).alias("started"))


def status(spark, sf):
    return _shown(progress.run_status(view(spark, sf, "v_progress")))


def status_stream(spark, sf):
    """The stream run over all files at hand; the last update of each job is kept."""
    path, out, check = event_file(spark, sf, torn=False), fresh_path(spark, "status"), fresh_path(spark, "streamstate")
    stream = progress.run_status_stream(stream_progress_events(spark, path))

    def store(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", check).trigger(
        availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(out).filter("status <> 'stalled'")
    last = updates.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in updates.columns if c != "job_id"]), "last_seq").alias("r"))
    return _shown(last.select("job_id", "r.*"))


def _jobs(spark, sf):
    """Events, jobs of which some have no event, and the time at which they are looked at."""
    e = view(spark, sf, "v_progress").filter("job_id % 5 <> 0")
    jobs = view(spark, sf, "v_progress").select("job_id").distinct().select(
        "job_id", (F.col("job_id") % 10 != 0).alias("launched"), (F.col("job_id") % 3 != 0).alias("has_artifact"))
    return e, jobs, e.agg((F.max("created_utc") + F.expr("INTERVAL 5 SECONDS")).alias("now"))


def stalled(spark, sf):
    e, jobs, now = _jobs(spark, sf)
    out = progress.stalled_runs(jobs, progress.run_status(e).crossJoin(F.broadcast(now)), F.col("now"))
    return out.select("job_id", "status", "stage", "error_code")


#: With the log's few events an hour, a gap of six hours thins it out as a quarter of a second does a real one.
GAP_MS = 6 * 3_600_000
KEPT = ("seq", "event", "stage")
#: The sample's files come in no order, so the watermark stays behind the whole log until the clock's line.
DELAY = "40000 hours"


def _kept(df):
    return df.select(F.col("job_id").cast("long").alias("job_id"), *KEPT, F.col("completed").cast("long").alias("completed"), F.date_format("created_utc", MICROS).alias("at"))


def throttled(spark, sf):
    return _kept(throttle.throttle(view(spark, sf, "v_progress"), GAP_MS))


def _over_files(spark, sf, events, make, after):
    """What a stream over files of ``events`` gives in several triggers; at last a line of a clock moves the watermark ``after`` the latest event."""
    path, out, check = fresh_path(spark, "log"), fresh_path(spark, "streamed"), fresh_path(spark, "streamstate")
    stamps = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    lines = events.withColumn("created_utc", F.col("created_utc").cast("timestamp"))
    lines.select(F.to_json(F.struct(*lines.columns), stamps).alias("value")).repartition(4).write.text(path)
    clock = lines.agg((F.max("created_utc") + F.expr(f"INTERVAL {DELAY}") + F.expr(f"INTERVAL {after}")).alias("created_utc")).select(
        F.lit("clock").alias("job_id"), F.lit(0).alias("seq"), "created_utc", F.lit("warning").alias("event"))
    for _ in range(2):
        clock.select(F.to_json(F.struct(*clock.columns), stamps).alias("value")).write.mode("append").text(path)
    stream, mode = make(stream_progress_events(spark, path, max_files=2))

    def store(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).filter("job_id <> 'clock'")


def throttled_stream(spark, sf):
    """The stream over all files at hand keeps what the batch twin keeps."""
    return _kept(_over_files(spark, sf, view(spark, sf, "v_progress"), lambda e: (throttle.throttle_stream(e, GAP_MS, DELAY), "append"), "7 hours"))


def stalled_stream(spark, sf):
    """The last update of each job, stalled ones included, at the time of ``stalled``."""
    e, jobs, _ = _jobs(spark, sf)
    updates = _over_files(spark, sf, e, lambda s: (stalls.stalled_stream(jobs, s, delay=DELAY), "update"), "5 seconds")
    order = F.struct("batch", "last_seq", F.col("status") == "stalled")
    last = updates.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "error_code"), order).alias("r"))
    return last.select(F.col("job_id").cast("long").alias("job_id"), "r.*")


def repeats(spark, sf):
    """H4: every third line twice and in disorder changes no status."""
    e = view(spark, sf, "v_progress")
    twice = e.unionByName(e.filter("seq % 3 = 0")).orderBy(F.xxhash64("seq"))
    a = progress.run_status(progress.drop_repeats(twice)).select("job_id", F.xxhash64(*SHOWN).alias("a"))
    b = progress.run_status(e).select("job_id", F.xxhash64(*SHOWN).alias("b"))
    return a.join(b, "job_id", "full_outer").select("job_id", a["a"].eqNullSafe(b["b"]).alias("same"))


def lists(spark, sf):
    e = view(spark, sf, "v_progress").withColumn(
        "event", F.when(F.col("event") == "run_failed", "stage_completed").otherwise(F.col("event")))
    return progress.run_lists(e)


STATUS_SQL = """SELECT job_id, CASE arg_max(event, seq) FILTER (event IN ('run_started', 'run_completed', 'run_failed')) WHEN 'run_started' THEN 'running' WHEN 'run_completed' THEN 'completed' WHEN 'run_failed' THEN 'failed' ELSE 'pending' END AS status,
  nullif(arg_max(CASE event WHEN 'run_completed' THEN '' ELSE stage END, seq) FILTER (event IN ('stage_started', 'advance', 'run_completed')), '') AS stage,
  (arg_max(CASE event WHEN 'stage_started' THEN 0 ELSE completed END, seq) FILTER (event IN ('stage_started', 'advance')))::BIGINT AS completed,
  (arg_max(total, seq) FILTER (event IN ('stage_started', 'advance')))::BIGINT AS total, 0::BIGINT AS n_warnings, 0::BIGINT AS n_stages_completed, max(seq) AS last_seq,
  strftime(arg_max(created_utc, seq), '%Y-%m-%d %H:%M:%S.%f') AS updated, strftime(arg_max(created_utc, seq) FILTER (event = 'run_started'), '%Y-%m-%d %H:%M:%S.%f') AS started FROM {src} GROUP BY job_id"""

STALLED_SQL = f"""WITH e AS (SELECT * FROM v_progress WHERE job_id % 5 <> 0), s AS ({STATUS_SQL.format(src='e')}), j AS (SELECT DISTINCT job_id FROM v_progress)
        SELECT j.job_id, CASE WHEN s.status IS NULL AND j.job_id % 10 = 0 THEN 'queued' WHEN s.status IS NULL THEN 'pending' WHEN s.status = 'completed' AND j.job_id % 3 = 0 THEN 'failed'
          WHEN s.status IN ('pending', 'running') AND epoch((SELECT max(created_utc) FROM e)) + 5 - epoch(s.updated::TIMESTAMP) > 900 THEN 'stalled' ELSE s.status END AS status, s.stage,
          CASE WHEN s.status = 'completed' AND j.job_id % 3 = 0 THEN 'MissingArtifact' END AS error_code FROM j LEFT JOIN s ON s.job_id = j.job_id"""

#: From one kept event to the next.
THROTTLE_SQL = f"""WITH RECURSIVE m AS (SELECT *, completed >= total AS final, epoch_us(created_utc) AS at_us FROM v_progress WHERE event = 'advance'),
  k AS (SELECT job_id, stage, arg_min(seq, (at_us, seq)) AS seq, min(at_us) AS at_us FROM m GROUP BY job_id, stage
    UNION ALL
    SELECT k.job_id, k.stage, arg_min(m.seq, (m.at_us, m.seq)), min(m.at_us) FROM k JOIN m ON m.job_id = k.job_id AND m.stage = k.stage
      AND (m.at_us > k.at_us OR m.at_us = k.at_us AND m.seq > k.seq) AND (m.at_us - k.at_us >= {GAP_MS * 1000} OR m.final) GROUP BY k.job_id, k.stage)
  SELECT p.job_id, p.seq, p.event, p.stage, p.completed::BIGINT AS completed, strftime(p.created_utc, '%Y-%m-%d %H:%M:%S.%f') AS at FROM v_progress p
  WHERE p.event <> 'advance' OR (p.job_id, p.stage, p.seq) IN (SELECT (job_id, stage, seq) FROM k)"""

QUERIES = {
    "h1_run_status": (status, STATUS_SQL.format(src="v_progress")),
    "h1_run_status_stream": (status_stream, STATUS_SQL.format(src="v_progress")),
    "h1_run_lists": (lists, "SELECT job_id, seq, 'stage_completed' AS kind, stage AS text FROM v_progress WHERE event = 'run_failed'"),
    "h2_stalled_runs": (stalled, STALLED_SQL),
    "h2_stalled_stream": (stalled_stream, STALLED_SQL),
    "h3_throttle": (throttled, THROTTLE_SQL),
    "h3_throttle_stream": (throttled_stream, THROTTLE_SQL),
    "h4_repeated_lines": (repeats, "SELECT DISTINCT job_id, true AS same FROM v_progress"),
}
