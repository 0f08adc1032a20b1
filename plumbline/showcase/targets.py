"""Target arithmetic, control percentiles, bands and the annotation job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotation as A
from ..functions import geometry as G
from ..operators import ranking, targets
from ..plans.annotate import annotate_targets
from ..settings import Comparison
from .views import view

PARAMS = Comparison(n_survivors=200)


def sized(spark, sf):
    return view(spark, sf, "v_sized")


def reach(spark, sf):
    return sized(spark, sf).select(
        "candidate_id", F.round(G.loop_reach(F.col("loop_nt_median")), 9).alias("flexible"),
        F.round(G.loop_reach(F.col("loop_nt_median"), extended=True), 9).alias("extended"))


def footprint(spark, sf):
    n = F.when(F.col("loop_nt_median") == 0, float("nan")).otherwise(F.col("length"))
    r = F.when(F.col("loop_nt_median") == 0, -1.0).otherwise(F.col("rg_median_A"))
    return sized(spark, sf).select(
        "candidate_id", F.round(G.footprint_from_length(n, 6.0, 0.5), 6).alias("by_length"),
        F.round(G.footprint_from_radius(r), 6).alias("by_radius"))


def agreement(spark, sf):
    gap = G.loop_reach(F.col("loop_nt_median")) - F.lit(18.0)
    return sized(spark, sf).select(
        "candidate_id", F.round(gap, 9).alias("signed"), F.round(F.abs(gap), 9).alias("absolute"),
        F.round(G.gaussian_agreement(F.abs(gap), 6.0), 9).alias("score"))


def charge(spark, sf):
    return view(spark, sf, "v_targets").select(
        "target_id", F.round(G.charge_factor(F.col("mean_potential")), 9).alias("factor"),
        F.round(G.charge_factor(F.col("mean_potential") * 1e6), 9).alias("saturated"))


def surface_mean(spark, sf):
    size = F.col("target_id") % 10 / 10.0
    c = G.charge_factor(F.col("mean_potential"))
    return view(spark, sf, "v_targets").select(
        "target_id", F.round(G.surface_agreement(size, c, 2.0, 1.0), 9).alias("agreement"))


def bands(spark, sf):
    p = F.when(F.col("loop_nt_median") == 0, float("nan")).when(
        F.col("loop_nt_median") == 1, F.lit(None)).otherwise(F.round("tier1_score", 2))
    return sized(spark, sf).select("candidate_id", A.assign_band(p).alias("band"))


def evaluable(spark, sf):
    mode = F.when(F.col("length") % 2 == 0, "pocket").otherwise("surface")
    v = F.when(F.col("loop_nt_median") == 1, float("inf")).when(F.col("loop_nt_median") == 2, F.lit(None)).otherwise(
        F.col("loop_nt_median"))
    return sized(spark, sf).select("candidate_id", A.is_evaluable(v).alias("evaluable"),
                                   A.not_evaluable_status(mode).alias("otherwise"))


def descriptors(spark, sf):
    pairs = targets.pair_with_targets(sized(spark, sf), view(spark, sf, "v_targets"))
    model = F.when(F.col("target_id") % 3 == 0, "length").otherwise("radius_of_gyration")
    m = F.col("binding_mode")
    return pairs.select("candidate_id", "target_id", A.descriptor_name(m, model).alias("name"), A.descriptor_value(
        m, model, F.col("loop_nt_median"), F.col("length"), F.col("rg_median_A")).alias("value"))


COMPARED = ("disagreement", "signed_mismatch", "size_agreement", "agreement", "charge_complementarity", "coverage_ratio")


def compared(spark, sf):
    out = targets.compare(targets.pair_with_targets(sized(spark, sf), view(spark, sf, "v_targets")))
    return out.select("candidate_id", "target_id", "evaluable", "charge_status",
                      *[F.round(c, 6).alias(c) for c in COMPARED])


def distribution(spark, sf):
    t = view(spark, sf, "v_targets")
    d, n = F.col("disagreement"), F.col("n")
    out = targets.compact_distribution(view(spark, sf, "v_bank"), t).groupBy(*targets.CLASS).agg(
        F.sum(n).alias("n"), F.round(F.min(d), 6).alias("lowest"), F.round(F.max(d), 6).alias("highest"),
        F.round(F.sum(d * n) / F.sum(F.when(d.isNotNull(), n)), 6).alias("mean"))
    return targets.of_targets(t, out)


def _percentiles(spark, sf, score):
    out = targets.by_measure(sized(spark, sf), view(spark, sf, "v_targets"), score)
    return out.select("candidate_id", "target_id", F.round("control_percentile", 9).alias("control_percentile"))


def percentiles(spark, sf):
    return _percentiles(spark, sf, lambda pairs: targets.calibrated(pairs, view(spark, sf, "v_bank")))


def percentiles_by_range(spark, sf):
    """The plan for a bank of any size: bounds looked up in ranges of it."""
    return _percentiles(spark, sf, lambda pairs: targets.interval_percentiles(pairs, view(spark, sf, "v_bank"), range_values=16))


def percentiles_by_shuffle(spark, sf):
    """The plan for a bank and target table too large to broadcast."""
    dist = targets.compact_distribution(view(spark, sf, "v_bank"), view(spark, sf, "v_targets"))
    return _percentiles(spark, sf, lambda pairs: targets.control_percentile(pairs.drop("disagreement_extended"), dist, max_values=0))


def thresholds(spark, sf):
    t = view(spark, sf, "v_targets")
    out = targets.of_targets(t, targets.band_thresholds(targets.compact_distribution(view(spark, sf, "v_bank"), t)))
    return out.select("target_id", "n_controls", "units", *[F.round(c, 6).alias(c) for c in (
        "disagreement_at_moderate", "disagreement_at_strong", "control_disagreement_median")])


def annotate(spark, sf, max_bank=1_000_000):
    ranked = ranking.rank_candidates(sized(spark, sf))
    out = annotate_targets(ranked, view(spark, sf, "v_targets"), view(spark, sf, "v_bank"), PARAMS, keep_unevaluated=True, max_bank=max_bank)
    return out.select(
        "candidate_id", "target_id", "rank", "binding_mode", "status", "band", "descriptor",
        *[F.round(c, 6).alias(c) for c in ("disagreement", "agreement", "control_percentile", "control_percentile_extended")])


def annotate_by_range(spark, sf):
    """No control travels: every bound is looked up by a join."""
    return annotate(spark, sf, 0)


def compare_sql(rows: str, model: str = "'radius_of_gyration'") -> str:
    """``cmp``: every row of ``rows`` against every target, in plain arithmetic."""
    return f"""pairs AS (SELECT r.*, t.*, CASE WHEN binding_mode = 'pocket' THEN loop_nt_median WHEN {model} = 'length' THEN length ELSE rg_median_A END AS descriptor
  FROM ({rows}) r CROSS JOIN v_targets t),
sz AS (SELECT *, CASE WHEN descriptor > 0 THEN CASE WHEN binding_mode = 'pocket' THEN 6 * sqrt(descriptor) WHEN {model} = 'length' THEN 36 * descriptor
    ELSE pi() * descriptor * descriptor END END AS mine, CASE WHEN binding_mode = 'pocket' AND descriptor > 0 THEN 6 * descriptor END AS mine_x,
  coalesce(d_pocket_A, patch_area_A2) AS theirs FROM pairs),
cmp AS (SELECT *, descriptor > 0 AS evaluable, mine - theirs AS signed_mismatch, abs(mine - theirs) AS disagreement, abs(mine_x - theirs) AS disagreement_x,
  CASE WHEN binding_mode = 'pocket' THEN exp(-power(mine - theirs, 2) / 72) ELSE exp(-power(mine - theirs, 2) / 720000) END AS size_agreement,
  CASE WHEN binding_mode = 'surface' THEN 1 / (1 + exp(-mean_potential / 5)) END AS charge_complementarity,
  CASE WHEN binding_mode = 'surface' THEN mine / theirs END AS coverage_ratio FROM sz)"""


AGREE = "CASE WHEN binding_mode = 'pocket' OR charge_complementarity IS NULL THEN size_agreement ELSE (size_agreement + charge_complementarity) / 2 END"


def percentile_sql(rows: str) -> str:
    """``pct``: counts over the distribution of every target."""
    mine = compare_sql(rows)
    theirs = compare_sql("SELECT * FROM v_bank")
    for name in ("pairs", "sz", "cmp"):
        theirs = theirs.replace(f"{name} AS (", f"b_{name} AS (").replace(f"FROM {name}", f"FROM b_{name}")
    one = """SELECT target_id, disagreement AS v, count(*) AS eq, sum(count(*)) OVER (PARTITION BY target_id ORDER BY disagreement)::BIGINT AS le,
  sum(count(*)) OVER (PARTITION BY target_id)::BIGINT AS m FROM b_cmp WHERE disagreement IS NOT NULL GROUP BY target_id, disagreement"""
    return f"""{mine}, {theirs}, dist AS ({one}), dist_x AS ({one.replace('disagreement', 'disagreement_x')}),
tot AS (SELECT target_id, max(m) AS m FROM dist GROUP BY 1), tot_x AS (SELECT target_id, max(m) AS m FROM dist_x GROUP BY 1),
pct AS (SELECT c.*, CASE WHEN c.disagreement IS NULL THEN NULL WHEN d.v IS NULL THEN 1.0::DOUBLE
    WHEN d.v = c.disagreement THEN (tot.m - d.le + 0.5::DOUBLE * d.eq) / tot.m ELSE (tot.m - d.le)::DOUBLE / tot.m END AS cp,
  CASE WHEN c.disagreement_x IS NULL THEN NULL WHEN x.v IS NULL THEN 1.0::DOUBLE
    WHEN x.v = c.disagreement_x THEN (tot_x.m - x.le + 0.5::DOUBLE * x.eq) / tot_x.m ELSE (tot_x.m - x.le)::DOUBLE / tot_x.m END AS cpx
  FROM cmp c ASOF LEFT JOIN dist d ON c.target_id = d.target_id AND c.disagreement >= d.v
  ASOF LEFT JOIN dist_x x ON c.target_id = x.target_id AND c.disagreement_x >= x.v
  LEFT JOIN tot ON tot.target_id = c.target_id LEFT JOIN tot_x ON tot_x.target_id = c.target_id)"""


_BAND = "CASE WHEN cp IS NULL THEN 'not_evaluated' WHEN cp >= 0.95::DOUBLE THEN 'strong' WHEN cp >= 0.75::DOUBLE THEN 'moderate' ELSE 'weak' END"
_PCT = f"WITH {percentile_sql('SELECT * FROM v_sized')} SELECT candidate_id, target_id, round(cp, 9) AS control_percentile FROM pct"

_ANNOTATED = f"""WITH rk AS (SELECT *, row_number() OVER (ORDER BY tier1_score DESC, candidate_id) AS rank FROM v_sized),
        {percentile_sql('SELECT * FROM rk')} SELECT candidate_id, target_id, rank, binding_mode,
        CASE WHEN rank > 200 THEN 'not_evaluated' WHEN evaluable THEN 'evaluated' WHEN binding_mode = 'pocket' THEN 'not_evaluable_no_contact_loop' ELSE 'not_evaluable_no_footprint' END AS status,
        CASE WHEN rank > 200 THEN 'not_evaluated' ELSE {_BAND} END AS band, CASE WHEN rank <= 200 THEN descriptor END AS descriptor,
        CASE WHEN rank <= 200 THEN round(disagreement, 6) END AS disagreement, CASE WHEN rank <= 200 AND evaluable THEN round({AGREE}, 6) END AS agreement,
        CASE WHEN rank <= 200 THEN round(cp, 6) END AS control_percentile, CASE WHEN rank <= 200 THEN round(cpx, 6) END AS control_percentile_extended FROM pct"""

QUERIES = {
    "b11_aptamer_reach": (reach, "SELECT candidate_id, round(6 * sqrt(loop_nt_median), 9) AS flexible, round(6 * loop_nt_median, 9) AS extended FROM v_sized"),
    "b12_footprint_area": (footprint, """SELECT candidate_id, CASE WHEN loop_nt_median <> 0 THEN round(9 * length, 6) END AS by_length,
        CASE WHEN loop_nt_median <> 0 THEN round(pi() * rg_median_A * rg_median_A, 6) END AS by_radius FROM v_sized"""),
    "b13_mismatch": (agreement, """SELECT candidate_id, round(6 * sqrt(loop_nt_median) - 18, 9) AS signed, round(abs(6 * sqrt(loop_nt_median) - 18), 9) AS absolute,
        round(exp(-power(6 * sqrt(loop_nt_median) - 18, 2) / 72), 9) AS score FROM v_sized"""),
    "b14_charge_factor": (charge, """SELECT target_id, round(1 / (1 + exp(-mean_potential / 5)), 9) AS factor,
        CASE WHEN mean_potential > 0 THEN 1.0::DOUBLE WHEN mean_potential < 0 THEN 0.0::DOUBLE WHEN mean_potential = 0 THEN 0.5::DOUBLE END AS saturated FROM v_targets"""),
    "b15_surface_agreement": (surface_mean, """SELECT target_id, round(CASE WHEN mean_potential IS NULL THEN (target_id % 10) / 10
        ELSE (2 * (target_id % 10) / 10 + 1 / (1 + exp(-mean_potential / 5))) / 3 END, 9) AS agreement FROM v_targets"""),
    "b16_assign_band": (bands, """SELECT candidate_id, CASE WHEN loop_nt_median IN (0, 1) THEN 'not_evaluated' WHEN round(tier1_score, 2) >= 0.95::DOUBLE THEN 'strong'
        WHEN round(tier1_score, 2) >= 0.75::DOUBLE THEN 'moderate' ELSE 'weak' END AS band FROM v_sized"""),
    "b17_is_evaluable": (evaluable, """SELECT candidate_id, loop_nt_median > 2 AS evaluable, CASE WHEN length::INT % 2 = 0 THEN 'not_evaluable_no_contact_loop'
        ELSE 'not_evaluable_no_footprint' END AS otherwise FROM v_sized"""),
    "b18_descriptor_column": (descriptors, """SELECT candidate_id, target_id, CASE WHEN binding_mode = 'pocket' THEN 'loop_nt_median' WHEN target_id % 3 = 0 THEN 'length'
        ELSE 'rg_median_A' END AS name, CASE WHEN binding_mode = 'pocket' THEN loop_nt_median WHEN target_id % 3 = 0 THEN length ELSE rg_median_A END AS value
        FROM v_sized CROSS JOIN v_targets"""),
    "c8_compare_targets": (compared, f"""WITH {compare_sql('SELECT * FROM v_sized')} SELECT candidate_id, target_id, evaluable,
        CASE WHEN binding_mode = 'surface' THEN CASE WHEN charge_complementarity IS NULL THEN 'not_computed' ELSE 'computed' END END AS charge_status,
        round(disagreement, 6) AS disagreement, round(signed_mismatch, 6) AS signed_mismatch, round(size_agreement, 6) AS size_agreement,
        round(CASE WHEN evaluable THEN {AGREE} END, 6) AS agreement, round(charge_complementarity, 6) AS charge_complementarity, round(coverage_ratio, 6) AS coverage_ratio FROM cmp"""),
    "d10_target_distribution": (distribution, f"""WITH {compare_sql('SELECT * FROM v_bank')} SELECT target_id, binding_mode, count(*) AS n, round(min(disagreement), 6) AS lowest,
        round(max(disagreement), 6) AS highest, round(avg(disagreement), 6) AS mean FROM cmp WHERE evaluable GROUP BY 1, 2"""),
    "d9_control_percentile": (percentiles, _PCT),
    "d9_control_percentile_ranges": (percentiles_by_range, _PCT),
    "d9_control_percentile_shuffled": (percentiles_by_shuffle, _PCT),
    "d11_band_thresholds": (thresholds, f"""WITH {compare_sql('SELECT * FROM v_bank')} SELECT target_id, count(*) AS n_controls,
        CASE WHEN any_value(binding_mode) = 'pocket' THEN 'A' ELSE 'A^2' END AS units, round(quantile_cont(disagreement, 0.25), 6) AS disagreement_at_moderate,
        round(quantile_cont(disagreement, 0.05), 6) AS disagreement_at_strong, round(median(disagreement), 6) AS control_disagreement_median
        FROM cmp WHERE evaluable GROUP BY 1"""),
    "g4_annotate_targets": (annotate, _ANNOTATED),
    "g4_annotate_targets_ranges": (annotate_by_range, _ANNOTATED),
}
