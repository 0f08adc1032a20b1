"""Evidence records: one nested row per candidate, one summary row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import explain as rules
from ..settings import DEFAULT_CRITERIA

ELEMENTS = ("n_hairpins", "n_interior", "n_multiloop", "n_stems", "stem_fraction", "longest_stem_bp", "max_loop_nt",
            "total_unpaired", "loop_nt_median", "loop_nt_p90", "loop_nt_iqr", "radius_of_gyration_A", "rg_median_A",
            "rg_iqr_A", "n_ensemble_samples")
SHUFFLE = {"pass": "shuffle_pass", "percentile": "shuffle_percentile", "p_value": "shuffle_p_value",
           "margin": "shuffle_margin", "n_shuffles": "shuffle_n", "wins": "shuffle_wins", "ties": "shuffle_ties",
           "complete": "shuffle_complete", "n_unique": "shuffle_n_unique",
           "n_identical_to_real": "shuffle_n_identical_to_real", "median_score": "shuffle_median_score",
           "structural_subscore": "structural_subscore"}
# Field names of the records, which must match.
TIER2 = ("status", "band", "binding_mode", "target_id", "descriptor", "d_pocket_A", "d_apt_flexible_A",
         "d_apt_extended_A", "footprint_area_A2", "patch_area_A2", "signed_mismatch", "disagreement",
         "disagreement_units", "agreement", "coverage_ratio", "charge_complementarity", "charge_status",
         "mean_potential", "control_percentile", "control_percentile_extended")


def candidate_records(table: DataFrame, criteria=DEFAULT_CRITERIA, target_scored: bool = False,
                      with_text: bool = True) -> DataFrame:
    """Nested record per row; parts that were not computed are null, never zero.

    ``table`` is a ranked table with whatever columns the earlier jobs added. A run
    without a target is not_run; a candidate below the cut is not_evaluated.
    """
    have = set(table.columns)
    default = "not_evaluated" if target_scored else "not_run"
    df = table
    for c in ("status", "band"):
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumns({"status": F.coalesce("status", F.lit(default)), "band": F.coalesce("band", F.lit("not_evaluated"))})
    df = policy.null_non_finite(df)
    named = [c for c in criteria if f"score__{c.name}" in have]
    if with_text:
        flat = df.withColumns({f"{c.name}_score": F.col(f"score__{c.name}") for c in named})
        df = rules.explain(flat).drop(*[f"{c.name}_score" for c in named])
    def pick(columns):
        return F.struct(*[F.col(c) for c in columns if c in df.columns])
    crit = F.struct(*[F.struct(F.col(c.name).alias("value"), F.col(f"score__{c.name}").alias("score")).alias(c.name) for c in named])
    shuffle = F.struct(*[F.col(c).alias(n) for n, c in SHUFFLE.items() if c in df.columns])
    if "shuffle_n" in df.columns:
        shuffle = F.when(F.col("shuffle_n") > 0, shuffle)
    head = [c for c in ("candidate_id", "sequence", "length", "duplicate_count", "rank", "rank_min", "rank_is_tied",
                        "tier1_score", "batch_rank_fraction") if c in df.columns]
    parts = [crit.alias("criteria"), pick(("dot_bracket", "element_string")).alias("structure") if "dot_bracket" in df.columns else None,
             pick(ELEMENTS).alias("elements") if have & set(ELEMENTS) else None,
             shuffle.alias("shuffle") if "shuffle_n" in df.columns else None, pick(TIER2).alias("tier2"),
             F.col("explanation") if with_text else None]
    return df.select(*head, *[p for p in parts if p is not None])


def run_summary(records: DataFrame, ingest: DataFrame, header: DataFrame) -> DataFrame:
    """One row: header facts, ingest counts, how many were evaluated and in which band."""
    band = F.col("tier2.band")
    counts = records.agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("tier2.status") == "evaluated").alias("n_evaluated"),
        *[F.count_if(band == b).alias(f"n_{b}") for b in ("strong", "moderate", "weak")],
        F.max("tier1_score").alias("best_score"))
    judged = header.withColumn("development_reasons", policy.eligibility_reasons(
        F.col("is_placeholder"), F.col("synthetic_target"), F.col("provenance_verified")))
    judged = judged.withColumns({
        "publication_eligible": F.size("development_reasons") == 0,
        "run_mode": F.when(F.size("development_reasons") == 0, "standard").otherwise("development")})
    return judged.crossJoin(F.broadcast(ingest)).crossJoin(F.broadcast(counts))
