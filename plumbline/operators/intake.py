"""From raw rows to unique candidates with a full account of the rejected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as Q
from .ordering import null_safe_join, row_numbers


def validated(raw: DataFrame, min_length: int = 20, max_length: int = 100,
              column: str = "sequence") -> DataFrame:
    """Add the normalised sequence (``clean``) and the rejection ``reason``."""
    out = raw.withColumn("clean", Q.normalise_sequence(F.coalesce(F.col(column), F.lit(""))))
    return out.withColumn("reason", Q.rejection_reason(F.col("clean"), min_length, max_length))


def rejections(checked: DataFrame, keys: list[str] = ()) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).select(
        *keys, "row", F.col("supplied_id").alias("id"), Q.truncate_preview("sequence").alias("sequence"),
        "reason")


def dedupe_candidates(checked: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per valid sequence: first row wins, copies are counted.

    Both are partial aggregates, so a sequence that owns a third of the input shuffles
    as one row per task. The ids of the copies are not listed in the row, whatever their
    number: ``copies`` gives them as rows.
    """
    ok = checked.filter(F.col("reason").isNull())
    first = F.struct("row", "supplied_id")
    out = ok.groupBy(*keys, F.col("clean").alias("sequence")).agg(
        F.count(F.lit(1)).alias("duplicate_count"), F.min(first).alias("__first"))
    return out.select(*keys, "sequence", F.length("sequence").alias("length"), "duplicate_count",
                      F.col("__first.row").alias("first_row"),
                      F.col("__first.supplied_id").alias("supplied_id"))


def copies(ok: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(sequence, row, source_id): every accepted input row, whatever the copy count."""
    return ok.select(*keys, F.col("clean").alias("sequence"), "row", _source_name().alias("source_id"))


def _source_name():
    return F.coalesce("supplied_id", F.concat(F.lit("row"), F.col("row").cast("string")))


def assign_ids(unique: DataFrame, prefix: str = "c", by: list[str] = (), spread=None) -> DataFrame:
    """Supplied ids when all are present and unique in the batch, else prefix + number.

    The batch-wide facts come from two aggregates and join back as one row per
    batch; only the numbering itself needs an order.
    """
    by = list(by)
    named = F.col("supplied_id").isNotNull() & (F.col("supplied_id") != "")
    per_id = unique.groupBy(*by, "supplied_id").agg(F.count(F.lit(1)).alias("__c"))
    facts = per_id.groupBy(*by).agg(
        F.sum("__c").alias("__n"),
        F.min((named & (F.col("__c") == 1)).cast("int")).alias("__ok"))
    numbered = row_numbers(unique, by, F.col("first_row"), "__i", spread)
    # Without ``by`` there is one row of facts; with it, one per batch.
    joined = null_safe_join(numbered, facts, by) if by else numbered.crossJoin(F.broadcast(facts))
    width = F.greatest(F.lit(5), F.length(F.col("__n").cast("string")))
    digits = F.col("__i").cast("string")
    made = F.concat(F.lit(prefix), F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0")))
    return joined.withColumn(
        "candidate_id", F.when(F.col("__ok") == 1, F.col("supplied_id")).otherwise(made)
    ).drop("__i", "__n", "__ok")


def ingest_summary(checked: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: submitted, valid, rejected, unique (never repeated), length range."""
    a = checked.agg(F.count(F.lit(1)).alias("n_submitted"),
                    F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))
    b = unique.agg(F.count(F.lit(1)).alias("n_valid"),
                   F.count_if(F.col("duplicate_count") == 1).alias("n_unique"),
                   F.min("length").alias("min_length"), F.max("length").alias("max_length"))
    return a.crossJoin(F.broadcast(b))


def dropped_reasons(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).groupBy(
        Q.merged_reason("reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kmer_counts(df: DataFrame, id_col: str, seq: str = "sequence", k: int = 2) -> DataFrame:
    """Multiset of overlapping k-mers per row: (id, kmer, n)."""
    return df.select(id_col, F.explode(Q.kmers(seq, k)).alias("kmer")).groupBy(id_col, "kmer").agg(
        F.count(F.lit(1)).alias("n"))


def first_per_sequence(df: DataFrame, order: str, seq: str = "sequence", by: list[str] = ()) -> DataFrame:
    """Keep the first row of every sequence; a partial aggregate, not a sort."""
    others = [c for c in df.columns if c not in (*by, seq)]
    kept = df.groupBy(*by, seq).agg(F.min_by(F.struct(*others), F.col(order)).alias("__row"))
    return kept.select(*by, seq, *[F.col(f"__row.{c}").alias(c) for c in others])


def reference_corpus(raw: DataFrame, min_length: int = 20, max_length: int = 100,
                     prefix: str = "ref", spread=None) -> tuple[DataFrame, DataFrame]:
    """Clean a corpus table (strings only). Returns (clean, dropped-reason counts).

    ``raw`` has row, id, sequence, target_name, target_pdb_id, source_reference.
    """
    checked = validated(raw, min_length, max_length)
    good = checked.filter(F.col("reason").isNull()).drop("sequence", "reason").withColumnRenamed(
        "clean", "sequence")
    kept = first_per_sequence(good, "row")
    numbered = row_numbers(kept, [], F.col("row"), "__i", spread)
    made = F.concat(F.lit(prefix), F.lpad(F.col("__i").cast("string"),
                                          F.greatest(F.lit(5), F.length(F.col("__i").cast("string"))),
                                          F.lit("0")))
    clean = numbered.withColumn("candidate_id", F.when(
        F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(made)).drop("__i", "id", "row")
    return clean, dropped_reasons(checked)


__all__ = ["validated", "rejections", "dedupe_candidates", "copies", "assign_ids", "ingest_summary",
           "dropped_reasons", "kmer_counts", "first_per_sequence", "reference_corpus", "Window"]
