"""Known numbers, by hand or in closed form."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import annotation, geometry, policy, scores, sequences
from plumbline.operators import bootstrap, controls, intake, percentile, shapes, stats, structure, targets
from plumbline.settings import Comparison


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_mid_rank(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    rows = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 9.0), ("d", 2.5)], "candidate_id string, v double")
    compact = percentile.compact_reference(ref, ["v"])
    for bound in (None, 0):
        out = percentile.with_percentiles(rows, compact, ["v"], max_values=bound)
        assert {r["candidate_id"]: r["p__v"] for r in out.collect()} == {"a": 0.0, "b": 0.5, "c": 1.0, "d": 0.75}


def test_non_finite_is_an_error(spark):
    ref = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    with pytest.raises(Exception, match="non-finite"):
        percentile.compact_reference(ref, ["v"]).collect()


def test_two_sided(spark):
    assert [one(spark, scores.two_sided_score(F.lit(p))) for p in (0.0, 0.5, 0.25, 1.0)] == [0.0, 1.0, 0.5, 0.0]


@pytest.mark.parametrize("beaten, p, passed", [(20, 1 / 21, True), (19, 2 / 21, False)])
def test_monte_carlo_p(spark, beaten, p, passed):
    real = spark.createDataFrame([("a", 0.5, "ACGU")], "candidate_id string, structural_subscore double, sequence string")
    rows = [("a", 0.1 if i < beaten else 0.9, f"S{i}") for i in range(20)]
    ctrl = spark.createDataFrame(rows, real.schema)
    out = controls.shuffle_outcome(real, ctrl).first()
    assert out["shuffle_p_value"] == pytest.approx(p) and out["shuffle_pass"] is passed and out["shuffle_complete"]


def test_outcome_without_controls(spark):
    real = spark.createDataFrame([("a", 0.8, "ACGU")], "candidate_id string, structural_subscore double, sequence string")
    out = controls.shuffle_outcome(real, real.limit(0)).first()
    assert out["shuffle_p_value"] is None and out["shuffle_pass"] is False and out["shuffle_n"] == 0


def test_margin(spark):
    schema = "candidate_id string, structural_subscore double, sequence string"
    real = spark.createDataFrame([("a", 0.8, "x")], schema)
    ctrl = spark.createDataFrame([("a", v, str(v)) for v in (0.2, 0.3, 0.4)], schema)
    out = controls.shuffle_outcome(real, ctrl).first()
    assert out["shuffle_median_score"] == pytest.approx(0.3) and out["shuffle_margin"] == pytest.approx(0.5)


def bank(spark, loops):
    return spark.createDataFrame([(f"b{i}", float(v), 50.0, 20.0) for i, v in enumerate(loops)],
                                 "control_id string, loop_nt_median double, length double, rg_median_A double")


def pocket_target(spark, d):
    return spark.createDataFrame([(1, "pocket", float(d), None, None)],
                                 "target_id long, binding_mode string, d_pocket_A double, patch_area_A2 double, mean_potential double")


def test_control_percentile(spark):
    # Mismatches of loops 4, 16, 25, 36 with 18 A: 6, 6, 12, 18; a mismatch of 6 ties two.
    cand = bank(spark, [16]).withColumnRenamed("control_id", "candidate_id")
    t = pocket_target(spark, 18)
    pairs = targets.compare(targets.pair_with_targets(cand, t))
    dist = targets.target_distribution(bank(spark, [4, 16, 25, 36]), t)
    a = targets.control_percentile(pairs, dist).first()
    b = targets.bank_percentiles(pairs, bank(spark, [4, 16, 25, 36])).first()
    assert a["disagreement"] == 6.0
    assert a["control_percentile"] == b["control_percentile"] == 0.75


def test_sigma_cannot_move_a_percentile(spark):
    cand = bank(spark, range(1, 30)).withColumnRenamed("control_id", "candidate_id")
    t, b = pocket_target(spark, 21), bank(spark, range(1, 40))
    got = [[r["control_percentile"] for r in targets.bank_percentiles(targets.compare(
        targets.pair_with_targets(cand, t), Comparison(sigma=s)), b).orderBy("candidate_id").collect()] for s in (1.0, 60.0)]
    assert got[0] == got[1]


def test_charge_cannot_reorder(spark):
    schema = "candidate_id string, loop_nt_median double, length double, rg_median_A double"
    cand = spark.createDataFrame([(f"c{i}", 5.0, 50.0, 10.0 + i) for i in range(20)], schema)
    def agreement(phi):
        t = spark.createDataFrame([(1, "surface", None, 1200.0, phi)],
                                  "target_id long, binding_mode string, d_pocket_A double, patch_area_A2 double, mean_potential double")
        out = targets.compare(targets.pair_with_targets(cand, t))
        return [r["candidate_id"] for r in out.orderBy(F.desc("agreement"), "candidate_id").collect()]
    assert agreement(8.0) == agreement(-8.0)


def test_reach_and_footprint(spark):
    assert one(spark, geometry.loop_reach(F.lit(16.0))) == 24.0
    assert one(spark, geometry.loop_reach(F.lit(16.0), extended=True)) == 96.0
    assert one(spark, geometry.footprint_from_length(F.lit(70.0))) == 2520.0
    assert one(spark, geometry.footprint_from_radius(F.lit(28.2))) == pytest.approx(2498, abs=1)


def test_charge(spark):
    null = F.lit(None).cast("double")
    assert one(spark, geometry.charge_factor(F.lit(0.0))) == 0.5
    assert one(spark, geometry.charge_factor(null)) is None
    assert one(spark, geometry.charge_factor(F.lit(-1e6))) == 0.0
    assert one(spark, geometry.charge_factor(F.lit(1e6))) == 1.0


def test_missing_is_not_weak(spark):
    assert one(spark, annotation.assign_band(F.lit(None).cast("double"))) == "not_evaluated"
    assert one(spark, annotation.assign_band(F.lit(0.1))) == "weak"
    assert one(spark, annotation.is_evaluable(F.lit(0.0))) is False


def test_retrieval(spark):
    df = spark.createDataFrame([("u", 0.1, True), ("u", 0.9, False), ("u", 0.8, False)], "unit string, s double, t boolean")
    out = stats.retrieval_metrics(df, "unit", "s", "t").first()
    assert out["mrr"] == pytest.approx(1 / 3) and out["top1_accuracy"] == 0.0


STRUCTURES = {
    "helix": ("(" * 45 + "." * 10 + ")" * 45, 40.8606),
    "junction": ("((((" + "((((....))))" * 4 + "))))" + "." * 44, 26.2774),
    "coil": ("." * 40, 15.4919),
}


def test_radius_of_gyration(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in STRUCTURES.items()], "candidate_id string, dot_bracket string")
    out = {r["candidate_id"]: r["radius_of_gyration_A"] for r in structure.structure_features(df).collect()}
    assert out == {k: pytest.approx(v[1], abs=1e-4) for k, v in STRUCTURES.items()}
    assert out["junction"] < 0.75 * out["helix"]


def test_elements_of_a_bulged_hairpin(spark):
    df = spark.createDataFrame([("a", "..((((.(((....)))))))."), ("b", "........")], "candidate_id string, dot_bracket string")
    e = structure.elements(df)
    rows = {r["candidate_id"]: r for r in structure.loop_statistics(e).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["n_stems"], a["n_hairpins"], a["n_interior"], a["longest_stem_bp"], a["max_loop_nt"]) == (2, 1, 1, 4, 4)
    assert a["stem_fraction"] == pytest.approx(14 / 22) and a["loop_sizes"] == [1, 4]
    assert (b["n_stems"], b["max_loop_nt"], b["loop_sizes"]) == (0, 8, [8])
    text = {r["candidate_id"]: r["element_string"] for r in structure.element_string(e).collect()}
    assert text == {"a": "ffssssissshhhhssssssst", "b": "ffffffff"}


def test_flat_pocket(spark):
    pts = [(1, float(x), float(y), 0.0, 1.0) for x in range(6) for y in range(3)]
    df = spark.createDataFrame(pts, "k int, x double, y double, z double, radius double")
    out = shapes.pocket_geometry(df, ["k"]).first()
    assert out["elongation"] == math.inf and out["problem"] is None
    few = shapes.pocket_geometry(df.limit(3), ["k"]).first()
    assert few["problem"] == "fewer than 4 alpha spheres" and few["d_pocket_A"] is None


def test_rotation_does_not_change_a_pocket(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(200, 3)) * [9, 5, 2]
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    rows = [(k, *map(float, p), 1.5) for k, c in ((1, xyz), (2, xyz @ turn.T)) for p in c]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double, radius double")
    a, b = shapes.pocket_geometry(df, ["k"]).orderBy("k").collect()
    assert a["d_pocket_A"] == pytest.approx(b["d_pocket_A"], abs=1e-9)


def test_rejections(spark):
    rows = [(1, "ACGU" * 6, "a"), (2, "acgt" * 6, None), (3, "ACGX" * 6, "b"), (4, "", None), (5, "ACG", None), (6, "A" * 101, None)]
    df = spark.createDataFrame(rows, "row long, sequence string, supplied_id string")
    checked = intake.validated(df)
    reasons = {r["row"]: r["reason"] for r in checked.collect()}
    assert reasons == {1: None, 2: None, 3: "invalid character 'X'", 4: "empty sequence",
                       5: "length 3 below minimum 20", 6: "length 101 above maximum 100"}
    out = intake.dedupe_candidates(checked).first()
    assert out["duplicate_count"] == 2
    assert sorted(r["source_id"] for r in intake.copies(checked.filter("reason IS NULL")).collect()) == ["a", "row2"]


def test_correlation_p():
    # Values of the t distribution from tables.
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_two_sided(0.0, 5) == 1.0


def test_cluster_fallback(spark):
    df = spark.createDataFrame([(str(i), float(i), i % 2 == 0, "c") for i in range(10)], "id string, v double, p boolean, c string")
    out = bootstrap.bootstrap_auc_clustered(df, "v", "p", "id", "c", 10).first()
    assert out["cluster_bootstrap"] is False and out["ci_low"] is None


def test_nan_becomes_null(spark):
    df = spark.range(1).select(F.struct(F.lit(float("nan")).alias("a"), F.array(F.lit(float("inf")), F.lit(1.0)).alias("b")).alias("s"))
    row = policy.null_non_finite(df).first()["s"]
    assert row["a"] is None and row["b"] == [None, 1.0]


def test_preview(spark):
    assert one(spark, sequences.truncate_preview(F.lit(" " + "A" * 61))) == "A" * 59 + "…"


def test_long_structures_have_a_size(spark):
    from plumbline.operators import structure

    hairpin = "(((....)))."
    df = spark.createDataFrame([("long", hairpin * 454), ("one", hairpin)], "candidate_id string, dot_bracket string")
    got = {r["candidate_id"]: r["radius_of_gyration_A"] for r in structure.radius_of_gyration(
        structure.elements(df, "candidate_id", "dot_bracket")).collect()}
    assert len(hairpin * 454) > 4990 and 0 < got["one"] < got["long"]
