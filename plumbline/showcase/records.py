"""Evidence records, explanations, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import explain as rules
from ..operators import intake, ranking
from ..plans import records
from ..plans.annotate import annotate_targets
from ..plans.rank import control_test, rank_against_reference
from ..settings import DEFAULT_CRITERIA, Comparison
from .controls import _outcome_sql
from .ranking import _DOC, _FIVE_SQL, FIVE, mean_sql
from .sequences import DEDUPED, checked
from .targets import _BAND, percentile_sql
from .views import table, view

TARGET = 3
PARAMS = Comparison(n_survivors=400)


def _run(spark, sf):
    """Ranked, control-tested and annotated against one surface target."""
    ref = view(spark, sf, "v_reference")
    ranked = rank_against_reference(view(spark, sf, "v_features"), ref)
    tested = control_test(ranked, view(spark, sf, "v_controls"), ref)
    sized = view(spark, sf, "v_sized").select("candidate_id", "loop_nt_median", "rg_median_A", F.lit(4.0).alias("loop_nt_iqr"))
    full = tested.join(sized, "candidate_id")
    target = view(spark, sf, "v_targets").filter(F.col("target_id") == TARGET)
    return annotate_targets(full, target, view(spark, sf, "v_bank"), PARAMS, keep_unevaluated=True)


def record_rows(spark, sf):
    out = records.candidate_records(_run(spark, sf), target_scored=True)
    return out.select(
        "candidate_id", "rank", F.round("criteria.gc_fraction.score", 9).alias("gc_score"),
        F.round("criteria.mfe_norm.value", 9).alias("mfe_norm"), F.round("shuffle.p_value", 9).alias("p_value"),
        F.col("shuffle.wins").alias("wins"), F.col("tier2.status").alias("status"), F.col("tier2.band").alias("band"),
        F.round("tier2.disagreement", 6).alias("disagreement"), F.col("elements.loop_nt_median").alias("loop_nt_median"))


def without_target(spark, sf):
    """A run without a target: not_run, and no shuffle part where none was made."""
    ranked = rank_against_reference(view(spark, sf, "v_features"), view(spark, sf, "v_reference"))
    out = records.candidate_records(control_test(ranked, None, None))
    return out.select("candidate_id", F.col("tier2.status").alias("status"), F.col("tier2.band").alias("band"),
                      F.col("shuffle").isNull().alias("no_shuffle"), (F.array_contains("explanation.rules_fired", "tier2_not_run")
                       | (F.size("explanation.rules_fired") == 4)).alias("said"))


def explained(spark, sf):
    """The rules that fired for every candidate, and their chips."""
    out = records.candidate_records(_run(spark, sf), target_scored=True)
    return out.select("candidate_id", F.array_join("explanation.rules_fired", ",").alias("rules"),
                      F.array_join(F.col("explanation.chips.label"), ",").alias("chips"),
                      F.col("explanation.text").endswith(rules.TARGET_CAVEAT).alias("caveat"))


def summary(spark, sf):
    recs = records.candidate_records(_run(spark, sf), target_scored=True, with_text=False)
    c = checked(spark, sf)
    ingest = intake.ingest_summary(c, intake.dedupe_candidates(c))
    header = table(spark, sf, "region").filter("r_regionkey = 0").select(
        F.lit("run_1").alias("run_id"), F.lit(False).alias("is_placeholder"), F.lit(True).alias("synthetic_target"),
        F.lit(False).alias("provenance_verified"))
    out = records.run_summary(recs, ingest, header)
    return out.select("run_id", "run_mode", "publication_eligible", F.array_join("development_reasons", ",").alias("reasons"),
                      "n_submitted", "n_rejected", "n_scored", "n_evaluated", "n_strong", "n_moderate", "n_weak",
                      F.round("best_score", 9).alias("best_score"))


def top_rows(spark, sf):
    return ranking.top_k_summary(_run(spark, sf), 12).withColumn("tier1_score", F.round("tier1_score", 9))


def scatter(spark, sf):
    df = _run(spark, sf).withColumn("control_percentile_flexible", F.col("control_percentile"))
    df = df.withColumn("control_percentile", F.when(F.col("rank") % 2 == 0, F.col("control_percentile")))
    out = ranking.scatter_rows(df)
    return out.select("candidate_id", "rank", "band", *[F.round(c, 6).alias(c) for c in ("tier1_score", "control_percentile", "mismatch")])


def eligibility(spark, sf):
    s = table(spark, sf, "supplier")
    r = policy.eligibility_reasons(F.col("s_suppkey") % 4 == 0, F.when(F.col("s_suppkey") % 5 != 1, F.col("s_suppkey") % 3 == 0), F.col("s_suppkey") % 2 == 0)
    return s.select("s_suppkey", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("eligible"))


def reasons(spark, sf):
    s = table(spark, sf, "supplier")
    experiments = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(
        F.concat(F.lit("E"), i.cast("string")).alias("name"), (F.col("s_suppkey") % (i + 1) == 0).alias("synthetic")))
    return s.select("s_suppkey", F.array_join(policy.development_reasons(F.col("s_suppkey") % 7 == 0, experiments), ";").alias("reasons"))


# One run in SQL: ranks, outcomes, annotation, one row per candidate.
_RUN_SQL = f"""{_outcome_sql()}, g2 AS (WITH {_FIVE_SQL}, t AS (SELECT *, {mean_sql(DEFAULT_CRITERIA)} AS tier1_score FROM scored)
  SELECT *, row_number() OVER (ORDER BY tier1_score DESC, candidate_id) AS rank FROM t),
{percentile_sql("SELECT candidate_id, loop_nt_median, length, rg_median_A FROM v_sized")},
run AS (SELECT g2.*, o.shuffle_pass, o.shuffle_p_value, o.shuffle_wins, p.loop_nt_median, p.mean_potential, CASE WHEN rank <= 400 THEN p.cp END AS cp,
  CASE WHEN rank <= 400 THEN p.disagreement END AS gap, CASE WHEN rank > 400 THEN 'not_evaluated' WHEN p.evaluable THEN 'evaluated' ELSE 'not_evaluable_no_footprint' END AS status,
  f.mfe_norm, f.stem_fraction FROM g2 JOIN outcome o ON o.candidate_id = g2.candidate_id JOIN pct p ON p.candidate_id = g2.candidate_id AND p.target_id = {TARGET}
  JOIN v_features f ON f.candidate_id = g2.candidate_id),
runb AS (SELECT *, {_BAND} AS band FROM run)"""

_FIRE = """rl AS (SELECT candidate_id, unnest(list_filter([
  CASE WHEN NOT shuffle_pass THEN {'p': 10, 'n': 'shuffle_fail', 'c': 'shuffle control failed'} END,
  CASE WHEN s_ensemble_defect < 0.3::DOUBLE THEN {'p': 20, 'n': 'poorly_defined_fold', 'c': 'unstable fold'} END,
  CASE WHEN stem_fraction < 0.2::DOUBLE THEN {'p': 30, 'n': 'barely_pairs', 'c': 'little structure'} END,
  CASE WHEN s_gc_fraction < 0.25::DOUBLE THEN {'p': 40, 'n': 'atypical_composition', 'c': 'atypical GC'} END,
  CASE WHEN loop_nt_median > 0 AND 4 >= 0.5::DOUBLE * loop_nt_median THEN {'p': 50, 'n': 'uncertain_loop_size', 'c': 'loop size uncertain'} END,
  CASE WHEN band = 'weak' THEN {'p': 61, 'n': 'surface_weak', 'c': 'size: weak match'} END,
  CASE WHEN s_ensemble_defect > 0.9::DOUBLE THEN {'p': 110, 'n': 'dominant_fold', 'c': 'well-defined fold'} END,
  CASE WHEN band = 'strong' THEN {'p': 121, 'n': 'surface_strong', 'c': 'size: strong match'} END,
  CASE WHEN shuffle_pass THEN {'p': 130, 'n': 'shuffle_pass', 'c': 'beats shuffled controls'} END,
  CASE WHEN s_mfe_norm > 0.85::DOUBLE THEN {'p': 140, 'n': 'stable_for_length', 'c': 'stable'} END,
  CASE WHEN s_positional_entropy_mean > 0.85::DOUBLE THEN {'p': 160, 'n': 'certain_fold', 'c': 'low uncertainty'} END,
  CASE WHEN band = 'moderate' THEN {'p': 171, 'n': 'surface_moderate', 'c': 'size: moderate match'} END,
  CASE WHEN mean_potential IS NOT NULL THEN {'p': 180, 'n': 'surface_charge', 'c': 'site charge'} END,
  CASE WHEN status = 'not_evaluated' THEN {'p': 200, 'n': 'tier2_not_evaluated', 'c': 'Tier 2 not evaluated'} END], lambda x: x IS NOT NULL)) AS r FROM runb),
rk2 AS (SELECT candidate_id, r, row_number() OVER (PARTITION BY candidate_id, r.p < 100 ORDER BY r.p) AS k, least(2, count(*) FILTER (r.p < 100) OVER (PARTITION BY candidate_id)) AS nc FROM rl)"""

QUERIES = {
    "g8_candidate_records": (record_rows, f"""WITH {_RUN_SQL} SELECT candidate_id, rank, round(s_gc_fraction, 9) AS gc_score, round(mfe_norm, 9) AS mfe_norm, shuffle_p_value AS p_value, shuffle_wins AS wins,
        status, band, round(gap, 6) AS disagreement, loop_nt_median FROM runb"""),
    "g8_records_without_target": (without_target, "SELECT candidate_id, 'not_run' AS status, 'not_evaluated' AS band, true AS no_shuffle, true AS said FROM v_features"),
    "g9_explain": (explained, f"""WITH {_RUN_SQL}, {_FIRE} SELECT b.candidate_id, coalesce(string_agg(r.n, ',' ORDER BY r.p) FILTER ((r.p < 100 AND k <= 2) OR (r.p >= 100 AND k <= 4 - nc)), '') AS rules,
        coalesce(string_agg(r.c, ',' ORDER BY r.p) FILTER ((r.p < 100 AND k <= 2) OR (r.p >= 100 AND k <= 4 - nc)), '') AS chips, true AS caveat FROM runb b LEFT JOIN rk2 ON rk2.candidate_id = b.candidate_id GROUP BY 1"""),
    "g16_run_summary": (summary, f"""WITH {_RUN_SQL}, {DEDUPED.replace('checked', 'chk')} SELECT 'run_1' AS run_id, 'development' AS run_mode, false AS publication_eligible,
        'synthetic_target_bundle,unverified_corpus_provenance' AS reasons, (SELECT count(*) FROM chk) AS n_submitted, (SELECT count(*) FROM chk WHERE reason IS NOT NULL) AS n_rejected, count(*) AS n_scored,
        count(*) FILTER (status = 'evaluated') AS n_evaluated, count(*) FILTER (band = 'strong') AS n_strong, count(*) FILTER (band = 'moderate') AS n_moderate, count(*) FILTER (band = 'weak') AS n_weak,
        round(max(tier1_score), 9) AS best_score FROM runb"""),
    "e11_top_k_summary": (top_rows, f"""WITH {_RUN_SQL} SELECT rank, b.candidate_id, round(tier1_score, 9) AS tier1_score, band, CASE WHEN shuffle_pass THEN 'pass' ELSE 'fail' END AS shuffle_mark,
        CASE WHEN length(s.sequence) > 34 THEN substr(s.sequence, 1, 34) || '…' ELSE s.sequence END AS preview FROM runb b JOIN v_seq s ON s.candidate_id = b.candidate_id WHERE rank <= 12"""),
    "e12_tier_scatter": (scatter, f"""WITH {_RUN_SQL} SELECT candidate_id, rank, band, round(tier1_score, 6) AS tier1_score, round(cp, 6) AS control_percentile, round(gap, 6) AS mismatch FROM runb WHERE status = 'evaluated'"""),
    "b26_publication_eligibility": (eligibility, """WITH r AS (SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 4 = 0 THEN 'placeholder_corpus' END, CASE WHEN s_suppkey % 5 <> 1 AND s_suppkey % 3 = 0 THEN 'synthetic_target_bundle' END,
        CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 2 <> 0 THEN 'unverified_corpus_provenance' END) AS reasons FROM supplier) SELECT s_suppkey, reasons, reasons = '' AS eligible FROM r"""),
    "b28_development_reasons": (reasons, "SELECT s_suppkey, concat_ws(';', CASE WHEN s_suppkey % 7 = 0 THEN 'scored against a placeholder corpus' END, "
        + ", ".join(f"CASE WHEN s_suppkey % {i + 1} = 0 THEN 'E{i} used a synthetic target bundle' END" for i in (1, 2, 3)) + ") AS reasons FROM supplier"),
}

__all__ = ["QUERIES", "_DOC", "FIVE"]
