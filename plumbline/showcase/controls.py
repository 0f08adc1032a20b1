"""Shuffled controls and the control test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls, percentile, ranking, joins
from ..plans.rank import control_test, rank_against_reference
from ..settings import DEFAULT_CRITERIA
from .ranking import _DOC, _STRUCT, FIVE, mean_sql, scored_sql
from .views import view

FEATURES = [c.name for c in _STRUCT]


def shuffles(spark, sf):
    out = controls.dinucleotide_shuffles(view(spark, sf, "v_seq"), 20)
    same_length = F.length("sequence") == F.length("source_sequence")
    return out.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~same_length).alias("other_length"),
        F.count_if(~controls.composition_kept(F.col("source_sequence"), F.col("sequence"))).alias("other_kmers"),
        F.count_distinct("shuffle_index").alias("n_index"))


def triplet_shuffles(spark, sf):
    out = controls.dinucleotide_shuffles(view(spark, sf, "v_seq"), 2, k=3, seed=7)
    return out.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(
        ~controls.composition_kept(F.col("source_sequence"), F.col("sequence"), 3)).alias("other_kmers"))


def negatives(spark, sf):
    ref = view(spark, sf, "v_reference")
    out = controls.shuffled_negatives(ref)
    joined = out.join(ref.select(F.col("candidate_id").alias("source_id"), F.col("sequence").alias("src")), "source_id")
    return joined.select("candidate_id", "group", "source_id",
                         controls.composition_kept(F.col("src"), F.col("sequence")).alias("kept"))


def bank(spark, sf):
    out = controls.calibration_bank(view(spark, sf, "v_reference"), size=2000)
    return out.select("control_id", "source_id", "shuffle_index", "shuffle_seed", controls.composition_kept(
        F.col("source_sequence"), F.col("sequence")).alias("kept"))


def bank_with_provenance(spark, sf):
    """C4: bank features keyed by one name joined to provenance keyed by another."""
    made = controls.calibration_bank(view(spark, sf, "v_reference"), size=2000)
    feats = made.select(F.col("control_id").alias("candidate_id"), F.length("sequence").alias("length"))
    prov = made.select("control_id", "source_id", "shuffle_index")
    return joins.bank_with_provenance(feats, prov, ["source_id", "shuffle_index"])


def _scored(spark, sf):
    ref = view(spark, sf, "v_reference")
    compact = percentile.compact_reference(ref, FEATURES)
    real = ranking.structural_subscore(percentile.criterion_scores(
        view(spark, sf, "v_features"), compact, _STRUCT), _STRUCT)
    ctrl = ranking.structural_subscore(percentile.criterion_scores(
        view(spark, sf, "v_controls"), compact, _STRUCT, id_cols=("candidate_id", "shuffle_index")), _STRUCT)
    return real, ctrl


ROUNDED = ("structural_subscore", "shuffle_percentile", "shuffle_p_value", "shuffle_margin", "shuffle_median_score")


def _round(df):
    return df.select(*[F.round(c, 9).alias(c) if c in ROUNDED else F.col(c) for c in df.columns])


def outcome(spark, sf):
    real, ctrl = _scored(spark, sf)
    return _round(controls.shuffle_outcome(real, ctrl))


def outcome_spread(spark, sf):
    real, ctrl = _scored(spark, sf)
    return _round(controls.shuffle_outcome(real, ctrl, spread=True))


def without_controls(spark, sf):
    """C2 with no controls run: typed nulls, not a failed test."""
    ranked = ranking.rank_candidates(view(spark, sf, "v_sized"))
    return controls.attach_outcomes(ranked, None).select(
        "candidate_id", "rank", "shuffle_pass", "shuffle_p_value", "shuffle_n")


def with_controls(spark, sf):
    """C2: some candidates have no control outcome and keep nulls."""
    real, ctrl = _scored(spark, sf)
    part = controls.shuffle_outcome(real, ctrl).filter("structural_subscore > 0.5")
    ranked = ranking.rank_candidates(view(spark, sf, "v_sized"))
    return controls.attach_outcomes(ranked, part).select(
        "candidate_id", "rank", "shuffle_pass", F.round("shuffle_p_value", 9).alias("shuffle_p_value"), "shuffle_n")


def full_test(spark, sf):
    ref = view(spark, sf, "v_reference")
    ranked = rank_against_reference(view(spark, sf, "v_features"), ref)
    out = control_test(ranked, view(spark, sf, "v_controls"), ref)
    return _round(out.select("candidate_id", "rank", F.round("tier1_score", 9).alias("tier1_score"), *ROUNDED,
                             "shuffle_pass", "shuffle_n", "shuffle_wins", "shuffle_ties", "shuffle_complete",
                             "shuffle_n_unique", "shuffle_n_identical_to_real"))


def _outcome_sql() -> str:
    both = ("both_c AS (SELECT candidate_id, -1 AS k, sequence, " + ", ".join(FEATURES) + " FROM v_features UNION ALL "
            "SELECT candidate_id, shuffle_index, sequence, " + ", ".join(FEATURES) + " FROM v_controls)")
    scored = scored_sql(_STRUCT, "SELECT * FROM both_c", _DOC[1], "cand.candidate_id, cand.k, cand.sequence")
    return f"""{both}, {scored}, sub AS (SELECT candidate_id, k, sequence, {mean_sql(_STRUCT)} AS s FROM scored),
r AS (SELECT * FROM sub WHERE k = -1), c AS (SELECT * FROM sub WHERE k <> -1),
o AS (SELECT r.candidate_id, any_value(r.s) AS s, count(c.s) AS n, count(*) FILTER (r.s > c.s) AS w, count(*) FILTER (r.s = c.s) AS t,
  count(*) FILTER (c.s >= r.s) AS nb, median(c.s) AS med, count(DISTINCT c.sequence) AS nu, count(*) FILTER (c.sequence = r.sequence) AS ns
  FROM r LEFT JOIN c ON c.candidate_id = r.candidate_id GROUP BY r.candidate_id),
outcome AS (SELECT candidate_id, round(s, 9) AS structural_subscore, (nb + 1) / (n + 1) <= 0.05::DOUBLE AS shuffle_pass,
  round((w + 0.5::DOUBLE * t) / n, 9) AS shuffle_percentile, round((nb + 1) / (n + 1), 9) AS shuffle_p_value,
  round(s - med, 9) AS shuffle_margin, round(med, 9) AS shuffle_median_score, n AS shuffle_n, w AS shuffle_wins, t AS shuffle_ties,
  n = 20 AS shuffle_complete, nu AS shuffle_n_unique, ns AS shuffle_n_identical_to_real, s AS raw FROM o)"""


QUERIES = {
    "f4_dinucleotide_shuffles": (shuffles, "SELECT candidate_id, 20::BIGINT AS n, 0::BIGINT AS other_length, 0::BIGINT AS other_kmers, 20::BIGINT AS n_index FROM v_seq"),
    "f4_triplet_shuffles": (triplet_shuffles, "SELECT candidate_id, 2::BIGINT AS n, 0::BIGINT AS other_kmers FROM v_seq"),
    "f5_shuffled_negatives": (negatives, "SELECT 'shuf_' || candidate_id AS candidate_id, 'shuffled' AS \"group\", candidate_id AS source_id, true AS kept FROM v_reference"),
    "f6_calibration_bank": (bank, """WITH s AS (SELECT min(candidate_id) AS source_id, sequence, row_number() OVER (ORDER BY sequence) AS pos,
        count(*) OVER () AS n FROM v_reference GROUP BY sequence),
        x AS (SELECT *, unnest(range(0, greatest(1, ceil(2000 / n))::BIGINT)) AS k FROM s)
        SELECT 'bank' || lpad((k * n + pos - 1)::VARCHAR, 6, '0') AS control_id, source_id, k::INTEGER AS shuffle_index,
          ('0x' || substr(sha256('42|' || source_id || '|bank|' || k), 1, 8))::BIGINT AS shuffle_seed, true AS kept FROM x"""),
    "c4_bank_with_provenance": (bank_with_provenance, """WITH s AS (SELECT min(candidate_id) AS source_id, sequence, row_number() OVER (ORDER BY sequence) AS pos,
        count(*) OVER () AS n FROM v_reference GROUP BY sequence),
        x AS (SELECT *, unnest(range(0, greatest(1, ceil(2000 / n))::BIGINT)) AS k FROM s)
        SELECT 'bank' || lpad((k * n + pos - 1)::VARCHAR, 6, '0') AS control_id, source_id, k::INTEGER AS shuffle_index,
          length(sequence)::INTEGER AS length FROM x"""),
    "d7_shuffle_outcome": (outcome, f"WITH {_outcome_sql()} SELECT * EXCLUDE (raw) FROM outcome"),
    "d7_shuffle_outcome_spread": (outcome_spread, f"WITH {_outcome_sql()} SELECT * EXCLUDE (raw) FROM outcome"),
    "c2_ranking_without_outcomes": (without_controls, """SELECT candidate_id, row_number() OVER (ORDER BY tier1_score DESC, candidate_id) AS rank,
        NULL::BOOLEAN AS shuffle_pass, NULL::DOUBLE AS shuffle_p_value, 0::BIGINT AS shuffle_n FROM v_sized"""),
    "c2_ranking_with_outcomes": (with_controls, f"""WITH {_outcome_sql()} SELECT a.candidate_id, row_number() OVER (ORDER BY a.tier1_score DESC, a.candidate_id) AS rank,
        o.shuffle_pass, o.shuffle_p_value, o.shuffle_n FROM v_sized a LEFT JOIN (SELECT * FROM outcome WHERE raw > 0.5) o ON o.candidate_id = a.candidate_id"""),
    "g3_control_test": (full_test, f"""WITH {_outcome_sql()} SELECT g.candidate_id, g.rank, g.tier1_score, o.* EXCLUDE (raw, candidate_id)
        FROM outcome o JOIN (WITH {scored_sql(DEFAULT_CRITERIA, *_DOC)}, t AS (SELECT candidate_id, {mean_sql(DEFAULT_CRITERIA)} AS tier1_score FROM scored)
          SELECT candidate_id, row_number() OVER (ORDER BY tier1_score DESC, candidate_id) AS rank, round(tier1_score, 9) AS tier1_score FROM t) g
        ON g.candidate_id = o.candidate_id"""),
}
