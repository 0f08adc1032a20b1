"""The plans for large or skewed inputs give the numbers of the plain plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import controls, ordering, percentile, ranking, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, and in it a third on one value."""
    return spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.when(F.col("id") % 9 == 0, 7.0).otherwise((F.xxhash64("id") % 997).cast("double")).alias("v")).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_prefix_counts(skewed):
    compact = skewed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    cols = ("k", "v", "n_before", "n_total")
    plain = rows(ordering.prefix_counts(compact, ["k"], "v", ["n"], False), *cols)
    assert plain == rows(ordering.prefix_counts(compact, ["k"], "v", ["n"], True, min_rows=20), *cols)


def test_row_numbers(skewed):
    order = F.struct("v", "id")
    plain = rows(ordering.row_numbers(skewed, ["k"], order, "i", False), "id", "i")
    assert plain == rows(ordering.row_numbers(skewed, ["k"], order, "i", True, min_rows=50), "id", "i")
    whole = rows(ordering.row_numbers(skewed, [], order, "i", False), "id", "i")
    assert whole == rows(ordering.row_numbers(skewed, [], order, "i", True, min_rows=50), "id", "i")


def test_quantiles(skewed):
    probs = {"a": .05, "b": .5, "c": .95}
    plain = rows(ordering.group_quantiles(skewed, ["k"], "v", probs, False, n="n"), "k", "a", "b", "c", "n")
    big = rows(ordering.group_quantiles(skewed, ["k"], "v", probs, True, min_rows=20, n="n"), "k", "a", "b", "c", "n")
    assert [p[0] for p in plain] == [b[0] for b in big]
    np.testing.assert_allclose([p[1:] for p in plain], [b[1:] for b in big], rtol=1e-12)
    hot = np.array([r["v"] for r in skewed.filter("k = 'hot'").collect()])
    got = [p for p in plain if p[0] == "hot"][0][1:4]
    np.testing.assert_allclose(got, np.quantile(hot, [.05, .5, .95]))


def test_average_rank(skewed):
    plain = rows(ordering.average_rank(skewed, ["k"], "v", "r", "n", False), "id", "r", "n")
    assert plain == rows(ordering.average_rank(skewed, ["k"], "v", "r", "n", True, min_rows=20), "id", "r", "n")


def test_rank_candidates(skewed):
    df = skewed.select(F.col("id").cast("string").alias("candidate_id"), F.col("v").alias("tier1_score"))
    cols = ("candidate_id", "rank", "rank_min", "rank_is_tied", "batch_rank_fraction")
    plain = rows(ranking.rank_candidates(df, spread=False), *cols)
    assert plain == rows(ranking.rank_candidates(df, spread=True, min_rows=100), *cols)
    assert sorted(p[1] for p in plain) == list(range(1, 6001))


def test_lookup_join(skewed):
    keyed = skewed.withColumn("k", F.when(F.col("k") != "g1", F.col("k")))
    table = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.max("v").alias("top"))
    top = {r["k"]: r["top"] for r in table.collect()}
    got = ordering.lookup_join(keyed, table, ["k"]).collect()
    assert len(got) == 6000 and None in top and all(r["top"] == top[r["k"]] for r in got)


@pytest.fixture(scope="module")
def holey(spark):
    """Null keys, null and NaN values, ties."""
    x = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 97 == 0, float("nan")).otherwise((F.xxhash64("id") % 50).cast("double"))
    return spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("k"), x.alias("v")).cache()


def text(rows_):
    return sorted(str(r) for r in rows_)


def test_null_keys_and_values_in_both_shapes(holey):
    compact = holey.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    pairs = [
        lambda s: ordering.prefix_counts(compact, ["k"], "v", ["n"], s, min_rows=10).select("k", "v", "n_before", "n_total"),
        lambda s: ordering.row_numbers(holey, ["k"], F.struct("v", "id"), "i", s, min_rows=50).select("id", "i"),
        lambda s: ordering.average_rank(holey, ["k"], "v", "r", "n", s, min_rows=10).select("id", "r", "n"),
        lambda s: ordering.group_quantiles(holey.filter("NOT isnan(v)"), ["k"], "v", {"a": .25, "b": .5}, s, min_rows=10).select("k", F.round("a", 9), F.round("b", 9)),
        lambda s: ranking.rank_candidates(holey.withColumnRenamed("id", "candidate_id"), "v", by=["k"], spread=s, min_rows=100)
        .select("candidate_id", "rank", "rank_min", "rank_is_tied", F.round("batch_rank_fraction", 12)),
        lambda s: ranking.rank_candidates(holey.withColumnRenamed("id", "candidate_id"), "v", spread=s, min_rows=100)
        .select("candidate_id", "rank", "rank_min", "rank_is_tied", F.round("batch_rank_fraction", 12)),
    ]
    for make in pairs:
        plain, spread = make(False).collect(), make(True).collect()
        assert text(plain) == text(spread) and len(plain) > 4


def test_ranks_put_null_scores_last(spark):
    df = spark.createDataFrame([("a", .9), ("b", .9), ("c", .5), ("d", None)], "candidate_id string, tier1_score double")
    for shape in (False, True):
        got = {r["candidate_id"]: (r["rank"], r["rank_min"]) for r in ranking.rank_candidates(df, spread=shape, min_rows=2).collect()}
        assert got == {"a": (1, 1), "b": (2, 1), "c": (3, 3), "d": (4, 4)}


def test_no_window_over_a_whole_hot_key(skewed):
    out = ordering.row_numbers(skewed, ["k"], F.struct("v", "id"), "i", True, min_rows=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__bucket" in line for line in windows)
    bucketed = ordering.with_buckets(skewed.withColumn("o", F.struct("v", "id")), ["k"], "o", 50)
    sizes = [r["count"] for r in bucketed.groupBy("k", "__bucket").count().collect()]
    assert max(sizes) < 400 and sum(sizes) == 6000


def test_percentile_keys_are_typed_and_rows_need_no_id(spark):
    from datetime import datetime

    at = [datetime(2024, 1, 1), datetime(2024, 1, 2, 3)]
    ref = [(b, t, k, float(v)) for v in range(4) for b in (True, False, None) for t in at for k in ("x|y", "x")]
    rows_ = [(b, t, k, v, "same") for v in (1.5, 9.0) for b in (True, False, None) for t in at for k in ("x|y", "x", "absent")]
    kind = "b boolean, t timestamp, k string, v double"
    reference, df = spark.createDataFrame(ref, kind), spark.createDataFrame(rows_, kind + ", candidate_id string")
    compact = percentile.compact_reference(reference, ["v"], ["b", "t", "k"])
    small, large = (percentile.with_percentiles(df, compact, ["v"], ["b", "t", "k"], max_values=m).collect() for m in (None, 0))
    assert text(small) == text(large) and len(small) == len(rows_)
    assert {(r["v"], r["p__v"]) for r in small if r["k"] != "absent"} == {(1.5, .5), (9.0, 1.0)}
    assert {r["p__v"] for r in small if r["k"] == "absent"} == {None}


def test_many_copies_and_exploded_inputs(spark):
    from plumbline import runtime
    from plumbline.operators import intake

    raw = spark.range(12000).select(F.col("id").alias("row"), F.lit("ACGU" * 6).alias("sequence"), F.col("id").cast("string").alias("supplied_id"))
    checked = intake.validated(raw)
    assert intake.dedupe_candidates(checked).first()["duplicate_count"] == 12000
    assert intake.copies(checked.filter("reason IS NULL")).count() == 12000
    wide = spark.range(1000).select(F.explode(F.sequence(F.lit(1), F.lit(10000))).alias("x"))
    assert runtime.is_large(wide, 4_000_000) and not runtime.is_large(spark.range(10), 10)


def test_percentiles_against_brute_force(spark, skewed):
    ref = skewed.filter("id % 2 = 0")
    compact = percentile.compact_reference(ref, ["v"])
    r = np.array([x["v"] for x in ref.collect()])
    for bound in (None, 0):
        out = percentile.with_percentiles(skewed, compact, ["v"], id_cols=("id",), max_values=bound).collect()
        for row in out[::37]:
            want = ((r < row["v"]).sum() + 0.5 * (r == row["v"]).sum()) / r.size
            assert row["p__v"] == pytest.approx(want, abs=1e-15)


def test_outcomes(skewed):
    real = skewed.groupBy("k").agg(F.lit(400.0).alias("s"), F.lit("x").alias("sequence"))
    ctrl = skewed.select("k", F.col("v").alias("s"), F.col("id").cast("string").alias("sequence"))
    a, b = (controls.shuffle_outcome(real, ctrl, id_col="k", score="s", spread=s) for s in (False, True))
    assert rows(a, *a.columns) == rows(b, *a.columns)


def test_mann_whitney_against_pairs(spark, skewed):
    df = skewed.filter("id < 600").withColumn("p", F.col("id") % 4 == 0)
    got = stats.mann_whitney(df, [], "v", "p").first()
    pos = np.array([r["v"] for r in df.filter("p").collect()])
    neg = np.array([r["v"] for r in df.filter("NOT p").collect()])
    u = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert got["u_statistic"] == u and got["auc"] == pytest.approx(u / pos.size / neg.size)
    assert 0.0 < got["p_value"] <= 1.0


def test_large_bank_gives_the_same_annotation(spark):
    from plumbline.plans.annotate import annotate_targets
    from plumbline.settings import Comparison
    from plumbline.showcase.views import view
    small = "/root/testdata/sf0.001"
    ranked = ranking.rank_candidates(view(spark, small, "v_sized"))
    t, bank = view(spark, small, "v_targets"), view(spark, small, "v_bank")
    cols = ("candidate_id", "target_id", "band", "control_percentile", "control_percentile_extended")
    params = Comparison(n_survivors=30)
    a = annotate_targets(ranked, t, bank, params)
    b = annotate_targets(ranked, t, bank, params, max_bank=0)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, a.select(*cols).collect())) == sorted(map(key, b.select(*cols).collect()))
