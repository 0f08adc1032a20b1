"""Interval look-ups in a large bank, and bootstraps over distinct values, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bootstrap, targets
from plumbline.showcase.views import view

SMALL = "/root/testdata/sf0.001"


def pairs_and_bank(spark):
    rows = [(f"c{i}", float(i % 30), 20.0 + i % 50, 8.0 + i % 13 / 2) for i in range(120)] + [("odd", None, float("nan"), -1.0)]
    cand = spark.createDataFrame(rows, "candidate_id string, loop_nt_median double, length double, rg_median_A double")
    bank = spark.createDataFrame([(f"b{i}", float(i % 40), 50.0, 8.0 + i % 17 / 2) for i in range(300)], "control_id string, loop_nt_median double, length double, rg_median_A double")
    t = spark.createDataFrame([(1, "pocket", 18.0, None, None), (2, "pocket", 36.0, None, None), (3, "surface", None, 300.0, 1.0), (4, "surface", None, 900.0, None)],
                              "target_id long, binding_mode string, d_pocket_A double, patch_area_A2 double, mean_potential double")
    return cand, t, bank


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_interval_percentiles(spark, size):
    cand, t, bank = pairs_and_bank(spark)
    pairs = targets.compare(targets.pair_with_targets(cand, t))
    got = targets.interval_percentiles(pairs, bank, range_values=size)
    want = {(r.target_id, r.candidate_id): (r.control_percentile, r.control_percentile_extended) for r in targets.bank_percentiles(pairs, bank).collect()}
    assert {(r.target_id, r.candidate_id): (r.control_percentile, r.control_percentile_extended) for r in got.collect()} == want
    dist = {}
    for r in targets.target_distribution(bank, t).collect():
        dist.setdefault(r.target_id, []).append(r.disagreement)
    for r in pairs.collect():
        if r.disagreement is not None:
            d = np.array(dist[r.target_id])
            assert want[r.target_id, r.candidate_id][0] == ((d > r.disagreement).sum() + 0.5 * (d == r.disagreement).sum()) / len(d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "control_id" not in plan  # the bank is there as its distinct values only


def test_interval_percentiles_without_controls(spark):
    cand, t, bank = pairs_and_bank(spark)
    pairs = targets.compare(targets.pair_with_targets(cand, t))
    assert targets.interval_percentiles(pairs.limit(0), bank).count() == 0
    with pytest.raises(Exception, match="no control"):
        targets.interval_percentiles(pairs, bank.limit(0)).collect()


@pytest.mark.parametrize("way", ["bank", "ranges", "shuffle", "too many"])
def test_percentiles_by_size_and_measure(spark, monkeypatch, way):
    cand, t, bank = pairs_and_bank(spark)
    t = t.unionByName(spark.createDataFrame([(5, "pocket", 18.0, None, 2.0), (6, "surface", None, None, 1.0)], t.schema))
    score = {"ranges": lambda pairs: targets.interval_percentiles(pairs, bank, range_values=3),
             "shuffle": lambda pairs: targets.control_percentile(pairs.drop("disagreement_extended"), targets.compact_distribution(bank, t), max_values=0)}.get(
                 way, lambda pairs: targets.calibrated(pairs, bank))
    names = ["candidate_id", "target_id", "disagreement", "control_percentile"] + ["control_percentile_extended"] * (way != "shuffle")
    rows = lambda df: sorted(map(repr, df.select(names).collect()))
    want = rows(score(targets.compare(targets.pair_with_targets(cand, t))))
    monkeypatch.setattr(targets, "PAIRS_LEAST", 1)
    if way == "too many":
        monkeypatch.setattr(targets, "MEASURES_AT_ONCE", 3)
    got = targets.by_measure(cand, t, score)
    assert rows(got) == want and len(want) == 121 * 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Python" in plan or "SortMergeJoin" in plan) == (way == "too many")


def test_many_targets_meet_in_blocks(spark, monkeypatch):
    cand, bank = view(spark, SMALL, "v_sized").limit(20), view(spark, SMALL, "v_targets")
    want = sorted((r.candidate_id, r.target_id) for r in targets.pair_with_targets(cand, bank).collect())
    monkeypatch.setattr(targets, "TARGETS_AT_ONCE", 2)
    monkeypatch.setattr(targets, "TARGET_BLOCK", 3)
    many = targets.pair_with_targets(cand, bank)
    assert sorted((r.candidate_id, r.target_id) for r in many.collect()) == want
    assert "Cartesian" not in many._jdf.queryExecution().executedPlan().toString()


def test_draws_are_one_multinomial():
    rows = [np.array([3, 1, 5]), np.array([0]), np.array([7, 7]), np.array([1, 0, 0, 2])]
    totals = np.array([r.sum() for r in rows])
    parts = [bootstrap.value_draws(r, totals, i, 4000, 5, "x") for i, r in enumerate(rows)]
    all_draws = np.concatenate(parts, axis=1)
    weights = np.concatenate(rows)
    n = weights.sum()
    assert (all_draws.sum(1) == n).all()
    assert np.abs(all_draws.mean(0) - weights).max() < 0.25
    want = np.outer(weights, -weights / n) + np.diag(weights)  # covariance of n draws
    assert np.abs(np.cov(all_draws.T) - want).max() < 0.6
    assert (bootstrap.value_draws(rows[2], totals, 2, 4000, 5, "x") == parts[2]).all()


def test_compact_bootstraps(spark):
    r = np.random.default_rng(3)
    rows = [(i, float(round(r.normal(i % 3 == 0), 1)), i % 3 == 0) for i in range(300)] + [(900, None, True), (901, float("nan"), False), (902, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, v double, p boolean")
    got = bootstrap.bootstrap_auc_compact(df, "v", "p", 400, range_values=7).first()
    values = np.array(sorted({v for _, v, p in rows[:300]}))
    pos, neg = (np.array([sum(v == x and p is side for _, v, p in rows[:300]) for x in values]) for side in (True, False))
    plain = bootstrap.bootstrap_auc(df.filter("p IS NOT NULL"), "v", "p", "id", 400).first()
    auc = (pos * (np.cumsum(neg) - neg / 2)).sum() / pos.sum() / neg.sum()
    assert got.n_boot == 400 and got.ci_low < auc < got.ci_high
    assert abs(got.ci_low - plain.ci_low) < 0.02 and abs(got.ci_high - plain.ci_high) < 0.02
    assert bootstrap.bootstrap_auc_compact(df, "v", "p", 400, range_values=7).first() == got
    assert bootstrap.bootstrap_auc_compact(df.filter("p"), "v", "p", 10).first().ci_low is None
    assert bootstrap.bootstrap_auc_compact(df.limit(0), "v", "p", 10).first().n_boot == 0
    a, b = bootstrap.paired_bootstrap_compact(df, "v", 400, range_values=9).first(), bootstrap.paired_bootstrap(df, "v", "id", 400).first()
    for name in ("n", "mean", "median", "fraction_positive"):
        assert a[name] == pytest.approx(b[name])
    assert abs(a.ci_low - b.ci_low) < 0.03 and abs(a.ci_high - b.ci_high) < 0.03
    assert bootstrap.paired_bootstrap_compact(df.limit(1), "v", 10).first().ci_low is None


def test_draws_are_those_of_the_hash(spark):
    """Every engine repeats a draw; a task draws them by the thousand and deals them to blocks of units."""
    from pyspark.sql import functions as F

    from plumbline.functions.identity import hash_draw
    rows = spark.range(700).select(hash_draw(F.lit(97), "pos", 42, F.lit(3), F.col("id")).alias("i")).collect()
    assert bootstrap.draws(97, 42, "pos", 3, 0, 700).tolist() == [r.i for r in rows]


def test_resampling_in_many_blocks_slices_and_ranges(spark, monkeypatch):
    """Few units or values to a block give what one block gives: no block, slice or range is whole in one task."""
    df = spark.range(900).selectExpr(
        "concat('k', id) AS id", "CAST(id * 7919 % 211 AS DOUBLE) / 7 AS v", "id % 3 = 0 AS p", "concat('u', least(id % 40, 9)) AS u",
        "CAST(id * 31 % 97 AS DOUBLE) - 40 AS d")

    def run():
        return [bootstrap.bootstrap_auc(df, "v", "p", "id", 50).first(), bootstrap.bootstrap_auc_clustered(df, "v", "p", "id", "u", 50).first(),
                bootstrap.bootstrap_auc_by_unit(df, "u", "v", "p", 50).first(), bootstrap.paired_bootstrap(df, "d", "id", 50).first()]

    whole = run()
    monkeypatch.setattr(bootstrap, "BLOCK_CELLS", 50 * 4)
    monkeypatch.setattr(bootstrap, "DRAWS_AT_ONCE", 4096)
    for a, b in zip(whole, run(), strict=True):
        assert a.asDict().keys() == b.asDict().keys()
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    size = bootstrap._block_units(50)
    packed = bootstrap.packed_draws(spark, 900, 50, 42, "pair").collect()
    assert size == 4 and len({r.block for r in packed}) == 225 and sum(len(r.cells) for r in packed) == 4 * 900 * 50
