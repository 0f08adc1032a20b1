"""The joins that put a run's tables next to each other.

Look-up sides have a key once; where they may not, they are reduced to it first, so rows
are never multiplied and a hot key is split as in any skewed join. Null keys meet null
keys only where it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import lookup_join, null_safe_join


def _once(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: of several the least, all columns from the same row."""
    return table.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])


def with_duplicates(features: DataFrame, candidates: DataFrame, sequence: str = "sequence", count: str = "duplicate_count") -> DataFrame:
    """C1: every feature row with the number of copies its sequence had; null where it is none of the candidates' or null."""
    copies = candidates.filter(F.col(sequence).isNotNull()).groupBy(sequence).agg(F.sum(count).alias(count))
    return features.join(copies, sequence, "left")


def with_metadata(features: DataFrame, metadata: DataFrame, columns: list[str], id_col: str = "candidate_id") -> DataFrame:
    """C3: every corpus row with what is known about it; nulls where nothing is."""
    return features.join(_once(metadata.filter(F.col(id_col).isNotNull()), [id_col], columns), id_col, "left")


def bank_with_provenance(features: DataFrame, provenance: DataFrame, columns: list[str], id_col: str = "candidate_id", control: str = "control_id") -> DataFrame:
    """C4: the bank's features, keyed by ``id_col``, with where each control comes from, keyed by ``control``."""
    known = _once(provenance.filter(F.col(control).isNotNull()), [control], columns)
    return features.withColumnRenamed(id_col, control).join(known, control, "left")


def requested(scored: DataFrame, asked: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """C5: a row for every one that was asked for, in each of its repeats; nulls where it was not scored."""
    columns = [c for c in scored.columns if c != id_col]
    return lookup_join(asked.select(id_col), _once(scored, [id_col], columns), [id_col], how="left").select(id_col, *columns)


def members_of(rows: DataFrame, held: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """C6: rows whose source is among those held out."""
    return null_safe_join(rows, held.select(id_col), [id_col], "left_semi")


def training_rows(corpus: DataFrame, held: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """C7: the corpus without those held out; a row without an id stays unless one without an id is held out."""
    return null_safe_join(corpus, held.select(id_col), [id_col], "left_anti")
