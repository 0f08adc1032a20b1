"""Percentiles, scores, composites and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import ordering, percentile, ranking
from ..plans.rank import BY_RANK, rank_against_reference
from ..settings import DEFAULT_CRITERIA, Criterion
from .views import view

LINE_CRITERIA = (Criterion("c_lower", "lower"), Criterion("c_higher", "higher"),
                 Criterion("c_mid1", "two_sided"), Criterion("c_mid2", "two_sided"))
FIVE = [c.name for c in DEFAULT_CRITERIA]


def _cdf_sql(c: str) -> str:
    """Mid-rank percentile of column c of cand within ref, by as-of join."""
    return (
        f"d_{c} AS (SELECT {c} AS v, sum(count(*)) OVER (ORDER BY {c})::BIGINT AS le, count(*) AS eq "
        f"FROM ref GROUP BY {c}),\n"
        f"p_{c} AS (SELECT u.v, CASE WHEN d.v IS NULL THEN 0.0::DOUBLE "
        f"WHEN d.v = u.v THEN (d.le - d.eq + 0.5::DOUBLE * d.eq) / (SELECT count(*) FROM ref) "
        f"ELSE d.le::DOUBLE / (SELECT count(*) FROM ref) END AS p "
        f"FROM (SELECT DISTINCT {c} AS v FROM cand) u ASOF LEFT JOIN d_{c} d ON u.v >= d.v)"
    )


def _score_sql(p: str, mode: str) -> str:
    if mode == "lower":
        return f"1.0::DOUBLE - {p}"
    if mode == "higher":
        return p
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * abs({p} - 0.5::DOUBLE)))"


def scored_sql(criteria, cand: str, ref: str, carry: str = "cand.candidate_id") -> str:
    """CTE list ending in ``scored``: the candidates with one score per criterion."""
    names = [c.name for c in criteria]
    parts = [f"ref AS ({ref})", f"cand AS ({cand})", *[_cdf_sql(c) for c in names]]
    cols = ", ".join(f"{_score_sql(f'p_{c.name}.p', c.mode)} AS s_{c.name}" for c in criteria)
    joins = " ".join(f"JOIN p_{c} ON p_{c}.v = cand.{c}" for c in names)
    parts.append(f"scored AS (SELECT {carry}, {cols} FROM cand {joins})")
    return ",\n".join(parts)


def mean_sql(criteria) -> str:
    total = float(sum(c.weight for c in criteria))
    return "(" + " + ".join(f"s_{c.name} * {float(c.weight)}::DOUBLE" for c in criteria) + f") / {total}::DOUBLE"


RANKS_SQL = """row_number() OVER (ORDER BY tier1_score DESC, candidate_id) AS rank,
  rank() OVER (ORDER BY tier1_score DESC) AS rank_min,
  count(*) OVER (PARTITION BY tier1_score) > 1 AS rank_is_tied,
  (rank() OVER (ORDER BY tier1_score) + (count(*) OVER (PARTITION BY tier1_score) - 1) / 2.0::DOUBLE)
    / count(*) OVER () AS batch_rank_fraction"""


def _rounded(df, cols, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# -- D1 / C9: percentiles -------------------------------------------------

def empirical_cdf(spark, sf):
    cand, ref = view(spark, sf, "v_features"), view(spark, sf, "v_reference")
    out = percentile.with_percentiles(cand, percentile.compact_reference(ref, FIVE), FIVE)
    return out.select("candidate_id", *[F.round(f"p__{c}", 9).alias(f"p_{c}") for c in FIVE])


def empirical_cdf_shuffled(spark, sf):
    """The same numbers through the plan for references too big to broadcast."""
    rows = view(spark, sf, "v_line")
    cols = [c.name for c in LINE_CRITERIA]
    compact = percentile.compact_reference(rows.filter("is_reference"), cols)
    keyed = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    out = percentile.with_percentiles(keyed, compact, cols, max_values=0)
    return out.agg(F.sum("n").alias("n_rows"),
                   *[F.round(F.sum(F.col("n") * F.col(f"p__{c}")), 4).alias(f"sum_{c}") for c in cols])


def reference_cdf(spark, sf):
    ref = view(spark, sf, "v_reference")
    out = percentile.reference_cdf(percentile.compact_reference(ref, FIVE))
    return out.select("criterion", F.round("value", 9).alias("value"), "n_lt", "n_eq", "m")


def criterion_scores(spark, sf):
    cand, ref = view(spark, sf, "v_features"), view(spark, sf, "v_reference")
    out = percentile.criterion_scores(cand, percentile.compact_reference(ref, FIVE), DEFAULT_CRITERIA)
    return out.select("candidate_id", *[F.round(f"score__{c}", 9).alias(f"score_{c}") for c in FIVE])


def one_sided_score(spark, sf):
    p = F.col("ensemble_defect")
    return view(spark, sf, "v_features").select(
        "candidate_id", F.round(S.one_sided_score(p, "lower"), 9).alias("as_lower"),
        F.round(S.one_sided_score(p, "higher"), 9).alias("as_higher"))


def two_sided_score(spark, sf):
    return view(spark, sf, "v_features").select(
        "candidate_id", F.round(S.two_sided_score(F.col("ensemble_defect")), 9).alias("score"))


def weighted_mean(spark, sf):
    crit = (Criterion("ensemble_defect", "lower", 2.0), Criterion("positional_entropy_mean", "lower", 1.0),
            Criterion("stem_fraction", "two_sided", 0.0), Criterion("gc_fraction", "two_sided", 0.5))
    cols = {c.name: F.col(c.name) for c in crit}
    return view(spark, sf, "v_features").select(
        "candidate_id", F.round(S.weighted_mean(cols, crit), 9).alias("weighted"))


def weighted_mean_long(spark, sf):
    feats = view(spark, sf, "v_features").select("candidate_id", "ensemble_defect", "gc_fraction", "stem_fraction")
    long = feats.unpivot(["candidate_id"], ["ensemble_defect", "gc_fraction", "stem_fraction"], "criterion", "score")
    weights = long.select("criterion").distinct().withColumn(
        "weight", F.when(F.col("criterion") == "gc_fraction", 0.5).otherwise(2.0))
    return ranking.weighted_mean_long(long, weights, ["candidate_id"], out="weighted").withColumn(
        "weighted", F.round("weighted", 9))


# -- ranks ----------------------------------------------------------------

def rank_candidates(spark, sf):
    df = view(spark, sf, "v_sized").withColumn("tier1_score", F.round("tier1_score", 2))
    out = ranking.rank_candidates(df, by=["lang"])
    return out.select("lang", "candidate_id", "tier1_score", "rank", "rank_min", "rank_is_tied",
                      F.round("batch_rank_fraction", 9).alias("batch_rank_fraction"))


def rank_candidates_spread(spark, sf):
    """One whole batch ranked over order-preserving buckets (the large-batch shape)."""
    df = view(spark, sf, "v_sized").withColumn("tier1_score", F.round("tier1_score", 2))
    out = ranking.rank_candidates(df, spread=True, min_rows=10)
    return out.select("candidate_id", "tier1_score", "rank", "rank_min", "rank_is_tied",
                      F.round("batch_rank_fraction", 9).alias("batch_rank_fraction"))


def average_rank(spark, sf):
    df = view(spark, sf, "v_line").select("candidate_id", "c_lower", "c_mid1")
    out = ordering.average_rank(df, ["c_mid1"], "c_lower", "avg_rank", "n")
    return out.groupBy("c_mid1", "c_lower").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.max("avg_rank"), 1).alias("avg_rank"),
        F.round(F.max(F.col("avg_rank") / F.col("n")), 9).alias("fraction"))


def rank_aggregate(spark, sf):
    out = rank_against_reference(view(spark, sf, "v_features"), view(spark, sf, "v_reference"), method=BY_RANK)
    return out.select("candidate_id", F.round("tier1_score", 9).alias("tier1_score"))


def structural_subscore(spark, sf):
    cand, ref = view(spark, sf, "v_features"), view(spark, sf, "v_reference")
    out = percentile.criterion_scores(cand, percentile.compact_reference(ref, FIVE), DEFAULT_CRITERIA)
    return ranking.structural_subscore(out, DEFAULT_CRITERIA).select(
        "candidate_id", F.round("structural_subscore", 9).alias("structural_subscore"))


def survivors(spark, sf):
    ranked = ranking.rank_candidates(view(spark, sf, "v_sized"), by=["source"])
    return ranking.survivors(ranked, 20).select("source", "candidate_id", "rank")


# -- G2 -------------------------------------------------------------------

def rank_documents(spark, sf):
    out = rank_against_reference(view(spark, sf, "v_features"), view(spark, sf, "v_reference"))
    score_cols = [f"score__{c}" for c in FIVE]
    return _rounded(out.select("candidate_id", *score_cols, "tier1_score", "rank", "rank_min",
                               "rank_is_tied", "batch_rank_fraction"),
                    [*score_cols, "tier1_score", "batch_rank_fraction"])


def rank_lines(spark, sf):
    line = view(spark, sf, "v_line")
    out = rank_against_reference(line, line.filter("is_reference"), LINE_CRITERIA)
    return out.groupBy("rank_min").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("tier1_score"), 9).alias("tier1_score"),
        F.max("rank").alias("last_rank"), F.max("rank_is_tied").alias("tied"))


_DOC = ("SELECT * FROM v_features", "SELECT * FROM v_reference")
_FIVE_SQL = scored_sql(DEFAULT_CRITERIA, *_DOC)
_STRUCT = [c for c in DEFAULT_CRITERIA if c.structural]

QUERIES = {
    "d1_empirical_cdf": (empirical_cdf, "WITH " + scored_sql(
        [Criterion(c, "higher") for c in FIVE], *_DOC) + " SELECT candidate_id, "
        + ", ".join(f"round(s_{c}, 9) AS p_{c}" for c in FIVE) + " FROM scored"),
    "c9_percentile_by_shuffle": (empirical_cdf_shuffled, "WITH " + scored_sql(
        [Criterion(c.name, "higher") for c in LINE_CRITERIA], "SELECT * FROM v_line",
        "SELECT * FROM v_line WHERE is_reference") + " SELECT count(*) AS n_rows, "
        + ", ".join(f"round(sum(s_{c.name}), 4) AS sum_{c.name}" for c in LINE_CRITERIA) + " FROM scored"),
    "d1_reference_cdf": (reference_cdf, "WITH long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS criterion, {c} AS value FROM v_reference" for c in FIVE) + """),
        c AS (SELECT criterion, value, count(*) AS n_eq FROM long GROUP BY 1, 2)
        SELECT criterion, round(value, 9) AS value,
          (sum(n_eq) OVER (PARTITION BY criterion ORDER BY value) - n_eq)::BIGINT AS n_lt, n_eq,
          (sum(n_eq) OVER (PARTITION BY criterion))::BIGINT AS m FROM c"""),
    "d2_criterion_scores": (criterion_scores, "WITH " + _FIVE_SQL + " SELECT candidate_id, "
        + ", ".join(f"round(s_{c}, 9) AS score_{c}" for c in FIVE) + " FROM scored"),
    "b8_one_sided_score": (one_sided_score, """SELECT candidate_id, round(1 - ensemble_defect, 9) AS as_lower,
        round(ensemble_defect, 9) AS as_higher FROM v_features"""),
    "b9_two_sided_score": (two_sided_score, """SELECT candidate_id,
        round(greatest(0, least(1, 1 - 2 * abs(ensemble_defect - 0.5::DOUBLE))), 9)::DOUBLE AS score FROM v_features"""),
    "b10_weighted_mean": (weighted_mean, """SELECT candidate_id, round((2 * ensemble_defect
        + positional_entropy_mean + 0.5::DOUBLE * gc_fraction) / 3.5::DOUBLE, 9) AS weighted FROM v_features"""),
    "b10_weighted_mean_long": (weighted_mean_long, """SELECT candidate_id, round((2 * ensemble_defect
        + 2 * stem_fraction + 0.5::DOUBLE * gc_fraction) / 4.5::DOUBLE, 9) AS weighted FROM v_features"""),
    "e1_rank_candidates": (rank_candidates, "WITH s AS (SELECT lang, candidate_id, round(tier1_score, 2) AS tier1_score FROM v_sized) "
        "SELECT lang, candidate_id, tier1_score, "
        "row_number() OVER (PARTITION BY lang ORDER BY tier1_score DESC, candidate_id) AS rank, "
        "rank() OVER (PARTITION BY lang ORDER BY tier1_score DESC) AS rank_min, "
        "count(*) OVER (PARTITION BY lang, tier1_score) > 1 AS rank_is_tied, "
        "round((rank() OVER (PARTITION BY lang ORDER BY tier1_score) + (count(*) OVER (PARTITION BY lang, tier1_score) - 1) / 2.0::DOUBLE) "
        "/ count(*) OVER (PARTITION BY lang), 9) AS batch_rank_fraction FROM s"),
    "e1_rank_candidates_spread": (rank_candidates_spread,
        "WITH s AS (SELECT candidate_id, round(tier1_score, 2) AS tier1_score FROM v_sized), "
        f"r AS (SELECT candidate_id, tier1_score, {RANKS_SQL} FROM s) "
        "SELECT * EXCLUDE (batch_rank_fraction), round(batch_rank_fraction, 9) AS batch_rank_fraction FROM r"),
    "e2_average_rank": (average_rank, """WITH r AS (SELECT c_mid1, c_lower,
        rank() OVER (PARTITION BY c_mid1 ORDER BY c_lower) + (count(*) OVER (PARTITION BY c_mid1, c_lower) - 1) / 2.0::DOUBLE AS a,
        count(*) OVER (PARTITION BY c_mid1) AS n FROM v_line)
        SELECT c_mid1, c_lower, count(*) AS n_rows, round(max(a), 1) AS avg_rank, round(max(a / n), 9) AS fraction
        FROM r GROUP BY 1, 2"""),
    "e3_rank_aggregate": (rank_aggregate, "WITH " + _FIVE_SQL + ", r AS (SELECT candidate_id, " + ", ".join(
        f"(rank() OVER (ORDER BY s_{c}) + (count(*) OVER (PARTITION BY s_{c}) - 1) / 2.0::DOUBLE) / count(*) OVER () AS r_{c}"
        for c in FIVE) + " FROM scored) SELECT candidate_id, round((" + " + ".join(f"r_{c}" for c in FIVE)
        + ") / 5, 9) AS tier1_score FROM r"),
    "d8_structural_subscore": (structural_subscore, "WITH " + _FIVE_SQL
        + f" SELECT candidate_id, round({mean_sql(_STRUCT)}, 9) AS structural_subscore FROM scored"),
    "e8_survivors": (survivors, """SELECT source, candidate_id, rank FROM (SELECT source, candidate_id,
        row_number() OVER (PARTITION BY source ORDER BY tier1_score DESC, candidate_id) AS rank FROM v_sized)
        WHERE rank <= 20"""),
    "g2_rank_against_reference": (rank_documents, "WITH " + _FIVE_SQL
        + f", t AS (SELECT *, {mean_sql(DEFAULT_CRITERIA)} AS tier1_score FROM scored) SELECT candidate_id, "
        + ", ".join(f"round(s_{c}, 9) AS score__{c}" for c in FIVE)
        + f", round(tier1_score, 9) AS tier1_score, rank, rank_min, rank_is_tied, round(batch_rank_fraction, 9) AS batch_rank_fraction FROM (SELECT *, {RANKS_SQL} FROM t)"),
    "g2_rank_lines": (rank_lines, "WITH " + scored_sql(LINE_CRITERIA, "SELECT * FROM v_line",
        "SELECT * FROM v_line WHERE is_reference")
        + f", t AS (SELECT *, {mean_sql(LINE_CRITERIA)} AS tier1_score FROM scored), r AS (SELECT *, {RANKS_SQL} FROM t) "
        "SELECT rank_min, count(*) AS n, round(max(tier1_score), 9) AS tier1_score, max(rank) AS last_rank, "
        "bool_or(rank_is_tied) AS tied FROM r GROUP BY rank_min"),
}
