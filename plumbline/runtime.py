"""Session defaults, shared scratch space and the one size check operators use."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many input rows a single task can sort any one group comfortably, so
#: plain windows are safe whatever the key distribution. Above it operators switch
#: to plans that split a hot group over many tasks.
ROWS_PER_TASK = 4_000_000

#: A table may be broadcast only up to this many rows (checked by a count).
BROADCAST_ROWS = 1_000_000

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", app: str = "plumbline", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Without that setting a temporary folder is made for a local session; on a cluster
    every machine would see another one, so there it is an error.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all machines share")
        made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where the same rows feed several branches that must agree even when an
    executor is lost and a stage is recomputed. ``discard`` deletes what was written,
    once nothing that is still to run reads it.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``cut_lineage`` result."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def is_large(df: DataFrame, rows: int = ROWS_PER_TASK) -> bool:
    """True when ``df`` has more than ``rows`` rows: counted, up to that bound, without its columns."""
    return not fits_broadcast(df, rows)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows: counted, as estimates err in both directions."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows
