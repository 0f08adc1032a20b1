"""The progress log: JSON lines, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("created_utc", T.TimestampType()), T.StructField("event", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("completed", T.LongType()),
    T.StructField("total", T.LongType()), T.StructField("unit", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("artifact_path", T.StringType()), T.StructField("artifact_sha256", T.StringType())])


def parse(lines: DataFrame) -> DataFrame:
    """Events of text lines; blank and torn lines are ignored."""
    return lines.select(F.from_json("value", EVENT).alias("e")).select("e.*").filter(
        F.col("job_id").isNotNull() & F.col("seq").isNotNull() & F.col("event").isNotNull())


def read_progress_events(spark: SparkSession, path) -> DataFrame:
    return parse(spark.read.text(path))


def stream_progress_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse(reader.text(path))
