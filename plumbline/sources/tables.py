"""Materialised feature tables, run records, and the catalogue of libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import null_non_finite
from .lines import first_lines, numbered_lines

MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "source", "curator", "curated_date")]
                        + [T.StructField("synthetic", T.BooleanType())])
MIN_LIBRARY = 50


def table_id(df: DataFrame, settings: dict | None = None) -> str:
    """An id of a table's content and of the settings behind it, whatever its layout.

    Row hashes are added up in pieces (a partial aggregate), then hashed once more.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    pieces = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    row = df.select(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), *pieces).select(
        F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)],
                           F.lit(repr(sorted((settings or {}).items())))), 256).alias("id")).first()
    return row["id"][:32]


def materialize_features(df: DataFrame, path: str, settings: dict | None = None) -> str:
    """Write a feature table under its id (Parquet keeps doubles exact); returns the id.

    The id covers content and settings, so a table that exists is never rewritten.
    """
    key = table_id(df, settings)
    spark = df.sparkSession
    jvm = spark._jvm
    target = f"{path.rstrip('/')}/corpus_id={key}"
    hadoop = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(target)
    return key


def read_features(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/corpus_id={key}")


def write_run_records(df: DataFrame, path: str) -> None:
    """Nested JSON, one record per line; NaN and infinities are written as null."""
    null_non_finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_run_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def library_catalog(spark: SparkSession, directories: list[str]) -> DataFrame:
    """Distinct reference libraries under several folders, real ones first.

    The content key is a sum of line hashes, so no file is ever held whole. The
    first location (folder order, then path) wins among copies.
    """
    pattern = [f"{d.rstrip('/')}/*.csv" for d in directories]
    lines = numbered_lines(spark, pattern)
    h = F.sha2(F.concat_ws("|", F.col("line_no").cast("string"), "value"), 256)
    pieces = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    keys = lines.groupBy("file").agg(*pieces).select(
        "file", F.sha2(F.concat_ws("|", *[F.col(f"s{i}").cast("string") for i in range(5)]), 256).alias("content_key"))
    heads = first_lines(spark, pattern).select(
        "file", F.transform(F.split(F.lower(F.regexp_replace("head", r"^﻿", "")), ","),
                            lambda c: F.trim(F.regexp_replace(c, '"', ""))).alias("columns"),
        (F.col("n_lines") - 1).alias("n_sequences"))
    order = F.coalesce(*[F.when(F.col("file").contains(d.rstrip("/") + "/"), F.lit(i)) for i, d in enumerate(directories)])
    found = keys.join(heads, "file").withColumn("__first", F.struct(order.alias("o"), F.col("file").alias("f")))
    distinct = found.groupBy("content_key").agg(F.min_by(F.struct("file", "columns", "n_sequences"), "__first").alias("r")).select(
        "content_key", "r.*")
    distinct = distinct.withColumn("stem", F.regexp_replace("file", r"\.csv$", ""))
    manifests = spark.read.text([f"{d.rstrip('/')}/*.manifest.json" for d in directories], wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), r"\.manifest\.json$", "").alias("stem"),
        F.from_json("value", MANIFEST).alias("m"))
    both = distinct.join(manifests, "stem", "left")
    base = F.regexp_extract("stem", r"([^/]+)$", 1)
    known = F.arrays_overlap("columns", F.array(F.lit("target_name"), F.lit("target_pdb_id"), F.lit("source_reference")))
    problem = (
        F.when(~F.array_contains("columns", "sequence"), "no sequence column")
        .when(~known, "looks like candidates").when(F.col("n_sequences") < MIN_LIBRARY, f"fewer than {MIN_LIBRARY} sequences"))
    full = F.lit(True)
    for c in ("source", "curator", "curated_date"):
        full = full & (F.coalesce(F.col(f"m.{c}"), F.lit("")) != "")
    state = F.when(F.coalesce("m.synthetic", F.lit(False)) | F.lower(base).contains("placeholder"), "development").when(
        full, "verified").otherwise("unverified")
    out = both.select(
        "file", "content_key", F.coalesce("m.name", F.regexp_replace(base, "_", " ")).alias("name"), state.alias("state"),
        F.when(problem.isNull() | problem.startswith("fewer"), F.col("n_sequences")).alias("n_sequences"), problem.alias("problem"))
    return out.orderBy(F.col("state") == "development", "name")
