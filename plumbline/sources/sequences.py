"""Sequence files: CSV, one per line, FASTA; and the reference corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import intake
from ..runtime import cut_lineage
from .lines import file_heads, number_rows, numbered_lines, placed, running_sum

RAW = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("row", T.LongType()),
    T.StructField("sequence", T.StringType()), T.StructField("supplied_id", T.StringType())])

CORPUS_COLUMNS = ("id", "sequence", "target_name", "target_pdb_id", "source_reference")


def _strip(c):
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Commas outside quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_csv_strings(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """Every column a string, by its name in the header of its own file; with file and row.

    Files may differ in the order and choice of their columns: the result has all names,
    null where a file lacks one. Header names are trimmed and lower-cased; the header is
    row 1. ``multiline`` accepts line breaks inside quotes, at the price of files that
    cannot be split.
    """
    clean = F.transform(F.split("head", _COMMA), lambda c: F.lower(_strip(F.regexp_replace(c, '^\ufeff?"?|"$', ""))))
    heads = cut_lineage(file_heads(spark, path).filter("head IS NOT NULL").select(F.col("file").alias("__file"), clean.alias("__names")), "heads")
    names = [r["n"] for r in heads.select(F.posexplode("__names").alias("i", "n")).groupBy("n").agg(F.min("i").alias("i")).orderBy("i", "n").collect()]
    width = heads.agg(F.max(F.size("__names"))).first()[0] or 1
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(schema).csv(path, header=False, quote='"', escape='"', multiLine=multiline,
                                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    numbered = number_rows(placed(raw), "row").filter(F.col("row") > 1)
    values = F.array(*[F.col(f"_c{i}") for i in range(width)])
    place = lambda n: F.array_position("__names", n).cast("int")
    return numbered.join(heads, F.col("file") == F.col("__file")).select(
        "file", "row", *[F.when(place(n) > 0, F.get(values, place(n) - 1)).alias(n) for n in names])


def read_sequences_csv(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    df = read_csv_strings(spark, path, multiline)
    if "sequence" not in df.columns:
        raise ValueError(f"CSV input requires a 'sequence' column, found {df.columns[2:]}")
    supplied = F.nullif(_strip(F.col("id")), F.lit("")) if "id" in df.columns else F.lit(None).cast("string")
    return df.select("file", "row", _strip(F.coalesce("sequence", F.lit(""))).alias("sequence"),
                     supplied.alias("supplied_id")).filter(F.col("sequence") != "")


def read_sequences_lines(spark: SparkSession, path) -> DataFrame:
    lines = numbered_lines(spark, path).withColumn("value", _strip(F.col("value")))
    return lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")).select(
        "file", F.col("line_no").alias("row"), F.col("value").alias("sequence"),
        F.lit(None).cast("string").alias("supplied_id"))


def read_sequences_fasta(spark: SparkSession, path) -> DataFrame:
    """One row per record; the last record of a file counts only when it has letters."""
    lines = numbered_lines(spark, path).withColumn("value", _strip(F.col("value"))).filter(F.col("value") != "")
    head = F.col("value").startswith(">")
    lines = running_sum(lines, head.cast("int"), "record")
    grouped = lines.groupBy("file", "record").agg(
        F.max(F.when(head, F.col("line_no"))).alias("row"),
        F.max(F.when(head, F.col("value"))).alias("title"),
        F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", "value")))).alias("chunks"))
    last = grouped.groupBy("file").agg(F.max("record").alias("__last"))
    kept = grouped.join(last, "file").filter((F.size("chunks") > 0) | (F.col("record") < F.col("__last")))
    name = F.nullif(F.regexp_extract(F.col("title"), r"^>\s*(\S+)", 1), F.lit(""))
    return kept.select("file", F.coalesce("row", F.lit(0)).cast("long").alias("row"),
                       F.array_join(F.col("chunks.value"), "").alias("sequence"), name.alias("supplied_id"))


def sniff_format(spark: SparkSession, path) -> DataFrame:
    """(file, format): csv, fasta, txt or empty, from the suffix and the first line."""
    seen = file_heads(spark, path)
    low = F.lower(F.regexp_replace("head", r"^﻿", ""))
    suffix = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    tabular = low.contains(",") & low.contains("sequence")
    return seen.select("file", F.when(F.col("head").isNull(), "empty")
                       .when((suffix == "csv") | (suffix.isin("tsv", "txt") & tabular), "csv")
                       .when(F.ltrim(low).startswith(">"), "fasta").otherwise("txt").alias("format"))


def read_sequences(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """Files of any of the formats under one path, each read by its own reader."""
    found = {r["format"]: r["files"] for r in sniff_format(spark, path).groupBy("format").agg(
        F.collect_list("file").alias("files")).collect()}
    if "empty" in found:
        raise ValueError(f"empty sequence file: {sorted(found['empty'])[0]}")
    parts = []
    if "csv" in found:
        parts.append(read_sequences_csv(spark, found["csv"], multiline))
    if "fasta" in found:
        parts.append(read_sequences_fasta(spark, found["fasta"]))
    if "txt" in found:
        parts.append(read_sequences_lines(spark, found["txt"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_reference_corpus(spark: SparkSession, path, min_length: int = 20, max_length: int = 100,
                          multiline: bool = False, spread=None):
    """(clean, dropped): the corpus table and why rows were left out."""
    df = read_csv_strings(spark, path, multiline)
    if "sequence" not in df.columns:
        raise ValueError("the corpus has no 'sequence' column")
    for c in CORPUS_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    ordered = df.select(F.struct("file", "row").alias("row"), *[F.coalesce(c, F.lit("")).alias(c) for c in CORPUS_COLUMNS])
    return intake.reference_corpus(ordered, min_length, max_length, spread=spread)
