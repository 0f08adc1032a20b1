"""Numbered lines of text files, however large or many."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that are read of a file at a time, and at most, to learn its first line.
HEAD_BLOCK, HEAD_BYTES = 1 << 16, 1 << 24
_LINE_END = re.compile(r"\r\n|\n|\r")


def number_rows(df: DataFrame, out: str) -> DataFrame:
    """1-based row number within each file of a file-backed scan.

    ``df`` carries file, block (start of the split) and pos (order within the split).
    Splits are numbered on their own; the row counts of earlier splits, a table with
    one row per split, supply the offsets. A single huge file is never one task.
    """
    sizes = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("file", "block").orderBy("pos")
    return df.join(offsets, ["file", "block"]).withColumn(
        out, (F.col("__off") + F.row_number().over(inside)).cast("long")).drop("__off")


def placed(df: DataFrame) -> DataFrame:
    """Add file, block and pos to a fresh file scan."""
    return df.select("*", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("pos"))


def numbered_lines(spark: SparkSession, path, **options) -> DataFrame:
    """(file, block, line_no, value); a byte-order mark is dropped."""
    lines = placed(spark.read.options(**options).text(path))
    out = number_rows(lines, "line_no").drop("pos")
    return out.withColumn("value", F.regexp_replace("value", r"^﻿|\r$", ""))


def running_sum(df: DataFrame, what, out: str, inclusive: bool = True) -> DataFrame:
    """Sum of ``what`` over the lines of a file so far, split by split."""
    df = df.withColumn("__w", what)
    totals = df.groupBy("file", "block").agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", "block", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    return df.join(offsets, ["file", "block"]).withColumn(
        out, F.col("__off") + F.coalesce(F.sum("__w").over(inside), F.lit(0))).drop("__w", "__off")


def first_lines(spark: SparkSession, path) -> DataFrame:
    """(file, head, n_lines) of the non-blank lines; partial aggregates only.

    Where only the head is asked for, the count is pruned.
    """
    lines = placed(spark.read.text(path)).filter(F.trim(F.col("value")) != "")
    return lines.groupBy("file").agg(
        F.min_by("value", F.struct("block", "pos")).alias("head"), F.count(F.lit(1)).alias("n_lines"))


def head_of(stream) -> str | None:
    """The first line that is not blank, of at most HEAD_BYTES bytes; null if there is none."""
    data = b""
    while len(data) < HEAD_BYTES:
        more = stream.read(HEAD_BLOCK)
        data += more
        lines = _LINE_END.split(data.decode("utf-8", "replace"))
        # The last piece may go on in the next block.
        for line in lines if not more else lines[:-1]:
            if line.strip(" "):
                return line
        if not more:
            return None
    raise ValueError(f"no end of the first line within {HEAD_BYTES} bytes")


def _readable(uri: str) -> bool:
    try:
        fs.FileSystem.from_uri(uri)
    except (ValueError, OSError):
        return False
    return True


def file_heads(spark: SparkSession, path) -> DataFrame:
    """(file, head): the first non-blank line of every file, null for a blank one, from the start of each file alone.

    Spark lists the files and deals them to tasks, which open each one and read a block
    or two. A store that only Spark's own readers can open is scanned instead.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    some = files.first()
    if some is not None and not _readable(some["file"]):
        return files.join(first_lines(spark, path).select("file", "head"), "file", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for uri in batch["file"]:
                store, at = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(at) as stream:
                    heads.append(head_of(stream))
            yield pd.DataFrame({"file": batch["file"], "head": pd.Series(heads, dtype=object)})

    return files.mapInPandas(run, "file string, head string")
