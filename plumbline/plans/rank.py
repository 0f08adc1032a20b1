"""Rank a batch against a reference population."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import settings
from ..operators import controls as control_ops
from ..operators import percentile, ranking

WEIGHTED, BY_RANK = "corpus_weighted_mean", "batch_rank_aggregation"


def rank_against_reference(candidates: DataFrame, reference: DataFrame,
                           criteria=settings.DEFAULT_CRITERIA, id_col: str = "candidate_id",
                           by: list[str] = (), method: str = WEIGHTED,
                           spread=None, max_values=None) -> DataFrame:
    """Criterion scores, composite and rank columns for every candidate.

    ``by`` names a batch column; each batch is ranked on its own, all against the
    same reference.
    """
    used = settings.active(criteria)
    compact = percentile.compact_reference(reference, [c.name for c in used])
    scored = percentile.criterion_scores(
        candidates, compact, used, id_cols=(*by, id_col), max_values=max_values)
    if method == WEIGHTED:
        scored = ranking.composite(scored, used)
    elif method == BY_RANK:
        scored = ranking.rank_aggregate(scored, used, by, spread=spread)
    else:
        raise ValueError(f"unknown composite method {method!r}")
    if spread is None:
        # The number of candidates decides; counting them before scoring is free.
        from ..runtime import is_large
        spread = is_large(candidates)
    return ranking.rank_candidates(scored, "tier1_score", id_col, by, spread)


def control_test(ranked: DataFrame, controls: DataFrame | None, reference: DataFrame,
                 criteria=settings.DEFAULT_CRITERIA, test=settings.ControlTest(),
                 id_col: str = "candidate_id", spread=None) -> DataFrame:
    """Ranked table plus the comparison of each candidate with its own shuffles.

    ``ranked`` holds the structural criteria and their scores; the controls of all
    candidates are scored in one pass.
    """
    if controls is None:
        return control_ops.attach_outcomes(ranked, None, id_col)
    used = settings.structural(criteria)
    compact = percentile.compact_reference(reference, [c.name for c in used])
    scored = percentile.criterion_scores(controls, compact, used, id_cols=(id_col, "shuffle_index"))
    real = ranking.structural_subscore(ranked, used)
    outcomes = control_ops.shuffle_outcome(
        real, ranking.structural_subscore(scored, used), test.alpha, test.n_shuffles, id_col,
        spread=spread)
    return control_ops.attach_outcomes(ranked, outcomes, id_col)
