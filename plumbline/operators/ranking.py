"""Composites and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings
from ..functions import scores as S
from ..runtime import cut_lineage
from .ordering import _ALL, average_rank, bucket_cuts, in_buckets, null_safe_join, wants_spread

PREFIX = "score__"


def composite(scored: DataFrame, criteria, out: str = "tier1_score") -> DataFrame:
    """Weighted mean of the criterion scores: absolute, batch-independent."""
    used = settings.active(criteria)
    return scored.withColumn(out, S.weighted_mean({c.name: F.col(PREFIX + c.name) for c in used}, used))


def structural_subscore(scored: DataFrame, criteria, out: str = "structural_subscore") -> DataFrame:
    used = settings.structural(criteria)
    return scored.withColumn(out, S.weighted_mean({c.name: F.col(PREFIX + c.name) for c in used}, used))


def weighted_mean_long(scores: DataFrame, criteria: DataFrame, keys: list[str],
                       score: str = "score", out: str = "tier1_score") -> DataFrame:
    """Same composite over long (key, criterion, score) rows and a weights table."""
    joined = scores.join(criteria.select("criterion", "weight"), "criterion", "left")
    w = F.when(F.col("weight").isNull(),
               F.raise_error(F.concat(F.lit("no weight declared for "), "criterion")).cast("double")
               ).otherwise(F.col("weight"))
    return joined.groupBy(*keys).agg(
        (F.sum(w * F.col(score)) / F.nullif(F.sum(w), F.lit(0.0))).alias(out))


def rank_aggregate(scored: DataFrame, criteria, by: list[str] = (), out: str = "tier1_score",
                   spread=None) -> DataFrame:
    """Mean over criteria of the within-batch rank fraction; depends on the batch."""
    used = settings.active(criteria)
    spread = wants_spread(scored, spread)
    df = scored
    for c in used:
        df = average_rank(df, list(by), PREFIX + c.name, f"__r_{c.name}", "__n", spread)
        df = df.withColumn(f"__r_{c.name}", F.col(f"__r_{c.name}") / F.col("__n")).drop("__n")
    mean = S.weighted_mean({c.name: F.col(f"__r_{c.name}") for c in used}, used)
    return df.withColumn(out, mean).drop(*[f"__r_{c.name}" for c in used])


def batch_rank_fraction(df: DataFrame, score: str = "tier1_score", by: list[str] = (),
                        out: str = "batch_rank_fraction", spread=None) -> DataFrame:
    df = average_rank(df, list(by), score, "__r", "__n", spread)
    return df.withColumn(out, F.col("__r") / F.col("__n")).drop("__r", "__n")


def rank_candidates(df: DataFrame, score: str = "tier1_score", id_col: str = "candidate_id",
                    by: list[str] = (), spread=None, min_rows=None) -> DataFrame:
    """rank 1..n (score desc, id asc), competition rank_min, tie flag, rank fraction.

    Both shapes read all four from one sort. The plain shape has one window per batch;
    the spread shape has one per order-preserving bucket, so rows are shuffled once, and
    a small table of buckets adds what lies before a bucket and beyond its cuts.
    """
    by = list(by)
    if not wants_spread(df, spread):
        # One sort serves all: ties are the peers of the range frame of that order.
        ks = by or [F.lit(0)]
        order = Window.partitionBy(*ks).orderBy(F.desc(score), F.asc(id_col))
        by_score = Window.partitionBy(*ks).orderBy(F.desc(score))
        peers = by_score.rangeBetween(Window.currentRow, Window.currentRow)
        out = df.withColumns({
            "rank": F.row_number().over(order).cast("long"), "rank_min": F.rank().over(by_score).cast("long"),
            "__t": F.count(F.lit(1)).over(peers), "__n": F.count(F.lit(1)).over(Window.partitionBy(*ks))})
        fraction = (F.col("__n") - F.col("rank_min") + 1 - (F.col("__t") - 1) / F.lit(2.0)) / F.col("__n")
        return out.withColumns({"rank_is_tied": F.col("__t") > 1, "batch_rank_fraction": fraction}).drop("__t", "__n")
    work, ks = (df.withColumn(_ALL, F.lit(0)), [_ALL]) if not by else (df, by)
    # Descending with null last, as a struct that sorts upwards; NaN is above all numbers.
    kind = F.when(F.col(score).isNull(), 2).when(F.isnan(F.col(score).cast("double")), 0).otherwise(1)
    level = F.struct(kind.alias("k"), (-F.col(score)).alias("s"))
    ordered = work.withColumn("__o", F.struct(level.alias("c"), F.col(id_col).alias("i")))
    cuts = bucket_cuts(ordered, ks, "__o", min_rows)
    ends = _bucket_ends(ordered, cuts, ks)
    cut = in_buckets(ordered, cuts, ks, "__o").drop("__o")
    inside = Window.partitionBy(*ks, "__bucket")
    by_score = inside.orderBy(F.desc(score))
    peers = by_score.rangeBetween(Window.currentRow, Window.currentRow)
    numbered = cut.withColumns({
        "rank": F.row_number().over(inside.orderBy(F.desc(score), F.asc(id_col))).cast("long"),
        "rank_min": F.rank().over(by_score).cast("long"), "__t": F.count(F.lit(1)).over(peers), "__n": F.count(F.lit(1)).over(inside)})
    # Only groups that were cut have ends, one small row for every bucket.
    out = null_safe_join(numbered, F.broadcast(ends), [*ks, "__bucket"], "left").withColumn("__off", F.coalesce("__off", F.lit(0)))
    below, above = (level.eqNullSafe(F.col(c)["c"]) for c in ("__low", "__high"))
    first = F.when(below, F.col("__low.first")).when(above, F.col("__high.first")).otherwise(F.col("__off") + F.col("rank_min"))
    ties = F.when(below, F.col("__low.rows")).when(above, F.col("__high.rows")).otherwise(F.col("__t"))
    out = out.withColumns({"rank": F.col("__off") + F.col("rank"), "rank_min": first, "__t": ties, "__n": F.coalesce("__all_n", "__n")})
    fraction = (F.col("__n") - F.col("rank_min") + 1 - (F.col("__t") - 1) / F.lit(2.0)) / F.col("__n")
    return out.withColumns({"rank_is_tied": F.col("__t") > 1, "batch_rank_fraction": fraction}).drop(
        "__bucket", "__off", "__all_n", "__low", "__high", "__t", "__n", _ALL)


def _bucket_ends(ordered: DataFrame, cuts: DataFrame, ks: list[str]) -> DataFrame:
    """One row per bucket of every group that was cut: rows before it, rows of the group, and the classes of equal scores at its two cuts.

    A class that a cut divides has rows in several buckets; its first rank and its size
    are put together here from counts per bucket.
    """
    own, low, high = F.col("__o.c"), F.col("__lower.c"), F.col("__upper.c")
    counted = in_buckets(ordered, cuts, ks, "__o", edges=True).groupBy(*ks, "__bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(own == low).alias("n_low"), F.count_if(own == high).alias("n_high"))
    at = cuts.select(*ks, "__cuts", F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias("__bucket")).select(
        *ks, "__bucket", F.get("__cuts", F.col("__bucket") - 1)["c"].alias("low"), F.get("__cuts", F.col("__bucket"))["c"].alias("high"))
    counted = null_safe_join(cut_lineage(counted, "buckets"), at, [*ks, "__bucket"])
    across = Window.partitionBy(*ks).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.withColumns({"__off": F.coalesce(F.sum("n").over(across), F.lit(0)).cast("long"),
                                 "__all_n": F.sum("n").over(Window.partitionBy(*ks)).cast("long")})
    # Where both cuts of a bucket lie in one class the bucket counts once.
    pieces = sizes.select(*ks, "__bucket", F.explode(F.array(
        F.struct(F.col("low").alias("c"), F.col("n_low").alias("rows"), F.col("__off").alias("at")),
        F.struct(F.col("high").alias("c"), F.col("n_high").alias("rows"), (F.col("__off") + F.col("n") - F.col("n_high")).alias("at")))).alias("p"))
    whole = pieces.filter(F.col("p.c").isNotNull() & (F.col("p.rows") > 0)).groupBy(*ks, "__bucket", "p.c").agg(
        F.max("p.rows").alias("rows"), F.min("p.at").alias("at")).groupBy(*ks, "c").agg(
        F.sum("rows").alias("rows"), (F.min("at") + 1).alias("first"))
    found = sizes.select(*ks, "__bucket", "__off", "__all_n", "low", "high")
    for side in ("low", "high"):
        one = whole.select(*ks, F.col("c").alias(side), F.struct("c", "first", "rows").alias(f"__{side}"))
        found = null_safe_join(found, one, [*ks, side], "left")
    return found.drop("low", "high")


def survivors(ranked: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` of every batch: the feature is the cut itself."""
    return ranked.filter(F.col("rank") <= n)


def top_k_summary(records: DataFrame, k: int = 10) -> DataFrame:
    """The rows a reader looks at first, with a 34-letter preview of the sequence."""
    mark = F.when(F.col("shuffle_pass"), "pass").when(~F.col("shuffle_pass"), "fail").otherwise("-")
    preview = F.when(F.length("sequence") > 34, F.concat(F.substring("sequence", 1, 34), F.lit("…"))
                     ).otherwise(F.col("sequence"))
    return (
        records.orderBy("rank").limit(k)
        .select("rank", "candidate_id", "tier1_score",
                F.coalesce("band", F.lit("not_evaluated")).alias("band"),
                mark.alias("shuffle_mark"), preview.alias("preview"))
    )


def scatter_rows(records: DataFrame) -> DataFrame:
    """Evaluated rows only: what a score-against-percentile plot needs."""
    return records.filter(F.col("status") == "evaluated").select(
        "candidate_id", "rank", "tier1_score",
        F.coalesce("control_percentile", "control_percentile_flexible").alias("control_percentile"),
        F.col("disagreement").alias("mismatch"), "band")
