"""Ingest: validate, deduplicate, name and account for every input row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import settings
from ..operators import intake
from ..runtime import cut_lineage


def ingest_candidates(raw: DataFrame, min_length: int = 20, max_length: int = 100,
                      id_prefix: str = "c", spread=None, require_valid: bool = True):
    """(candidates, rejections, summary) of raw rows (row, sequence, supplied_id).

    A batch without a single valid row is an error, not an empty result.
    """
    settings.check_lengths(min_length, max_length)
    checked = intake.validated(raw, min_length, max_length)
    # One pass deduplicates; naming, the summary and the emptiness check read its result.
    unique = cut_lineage(intake.dedupe_candidates(checked), "unique")
    if require_valid and unique.isEmpty():
        raise ValueError("no valid candidates: every row was rejected")
    named = intake.assign_ids(unique, id_prefix, spread=spread)
    rejected: DataFrame = intake.rejections(checked)
    return named, rejected, intake.ingest_summary(checked, unique)
