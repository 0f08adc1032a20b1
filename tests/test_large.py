"""What only shows on larger tables: overflows, cuts, classes of equal rows."""

import re

from pyspark.sql import functions as F

from plumbline.operators import controls, ordering, ranking, runs, stats, targets
from plumbline.plans import evaluate
from plumbline.showcase import files
from plumbline.sources import structures


def test_many_buckets_of_one_group(spark):
    """Cut places are products beyond 32 bits, and no row meets all of 65536 cuts."""
    rows = spark.range(70_000).withColumns({"k": F.lit(None).cast("int"), "v": F.struct((F.col("id") % 7).alias("a"), "id")})
    out = ordering.with_buckets(rows, ["k"], "v", 1).groupBy("__bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    found = [(tuple(r["lo"]), tuple(r["hi"])) for r in out.orderBy("__bucket").collect()]
    assert len(found) > 10_000
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))


def _runs(spark):
    """Nine runs over seven candidates: copies of a run, different candidates, ties, a run of two."""
    rows = [(f"r{r}", f"c{c}", "evaluated", ((c * (r % 4 + 1)) % 5) / 4.0, "weak" if (c + r % 4) % 2 else "strong")
            for r in range(9) for c in range(7) if (r + c) % 3 or r % 4 == 0 if r != 8 or c < 2]
    rows += [("r1", "c0", "not_evaluated", None, None)]
    return spark.createDataFrame(rows, "run_id string, candidate_id string, status string, control_percentile double, band string")


def _rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_pairs_of_runs_as_classes(spark):
    rows = _runs(spark)
    dense, joined = (evaluate.pair_summary(rows, dense=d) for d in (True, False))
    assert dense.columns == joined.columns
    assert _rounded(dense.na.fill(-9.0)) == _rounded(joined.na.fill(-9.0))
    ok = rows.filter("status = 'evaluated'").selectExpr("run_id AS run", "candidate_id AS id", "control_percentile AS p", "band")
    assert runs.fits_blocks(ok) and not runs.fits_blocks(ok.unionAll(ok.limit(1)))
    assert _rounded(runs.pair_summary(ok, block=2).na.fill(-9.0)) == _rounded(dense.na.fill(-9.0))


def test_repeated_runs_do_not_travel(spark):
    """The blocks are repeated after a scan, so the size of its files says nothing about them."""
    plan = evaluate.shared_candidates(_runs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def _targets(spark):
    t = spark.createDataFrame([(1, "pocket", 12.0, None, 1.0), (2, "pocket", 12.0, None, None), (3, "surface", None, 900.0, 2.0),
                               (4, "surface", None, 900.0, None), (5, "surface", None, 400.0, 2.0), (6, "pocket", None, None, 1.0)],
                              "target_id long, binding_mode string, d_pocket_A double, patch_area_A2 double, mean_potential double")
    bank = spark.range(60).select(F.concat(F.lit("b"), "id").alias("control_id"), (F.col("id") % 6).cast("double").alias("loop_nt_median"),
                                  (20 + F.col("id") % 9).cast("double").alias("length"), (8 + F.col("id") % 7).cast("double").alias("rg_median_A"))
    return t, bank


def test_counted_distribution(spark):
    """Results per class of targets are those of every control against every target, at far fewer rows."""
    t, bank = _targets(spark)
    whole, counted = targets.target_distribution(bank, t), targets.compact_distribution(bank, t)
    assert counted.count() < whole.count() / 4
    same = counted.groupBy(*targets.CLASS).agg(F.sum("n").alias("n"), F.min("disagreement").alias("lo"), F.max("disagreement").alias("hi"))
    assert _rounded(targets.of_targets(t, same).na.fill(-1.0)) == _rounded(whole.groupBy("target_id", "binding_mode").agg(
        F.count(F.lit(1)).alias("n"), F.min("disagreement").alias("lo"), F.max("disagreement").alias("hi")).na.fill(-1.0))
    for spread in (False, True):
        cuts = targets.of_targets(t, targets.band_thresholds(counted, spread=spread))
        want = targets.band_thresholds(whole, spread=spread)
        assert _rounded(cuts.select(want.columns)) == _rounded(want)
    pairs = targets.compare(targets.pair_with_targets(bank.withColumnRenamed("control_id", "candidate_id"), t))
    a, b = (targets.control_percentile(pairs, d).select("candidate_id", "target_id", "control_percentile").na.fill(-1.0) for d in (whole, counted))
    assert _rounded(a) == _rounded(b)


def test_validation_by_classes(spark):
    """Copies of a candidate count, and targets of equal area have equal rows."""
    t, bank = _targets(spark)
    cands = bank.withColumnRenamed("control_id", "candidate_id")
    rows = {r["target_id"]: r for r in evaluate.descriptor_validation(cands, t, bank)[1].collect()}
    assert sorted(rows) == [3, 4, 5] and {r["n"] for r in rows.values()} == {60}
    assert rows[3][1:] == rows[4][1:] != rows[5][1:]


def test_many_small_groups_stay_plain(spark, monkeypatch):
    monkeypatch.setattr(ordering.runtime, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(ordering.runtime.is_large, "__defaults__", (50,))
    rows = spark.range(400).withColumn("k", F.col("id") % 20)
    assert not ordering.wants_spread(rows, None, ["k"]) and ordering.wants_spread(rows, None)
    assert ordering.wants_spread(rows.withColumn("k", F.lit(1)), None, ["k"])


def test_flat_group_has_no_correlation(spark):
    """One run whose values are all equal is a null, and no division by zero for all others."""
    rows = spark.range(30).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"),
                                  F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("y"))
    for spread in (False, True):
        found = {r["k"]: r["rho"] for r in stats.spearman(rows, ["k"], "x", "y", spread).collect()}
        assert found == {0: None, 1: 1.0, 2: 1.0}
    flat = rows.filter("k = 0").select(F.col("x").alias("length"), F.col("y").alias("rg_median_A"))
    assert stats.descriptor_report(flat).first()["correlation"] is None


def test_residue_numbers_beyond_9999(spark, tmp_path):
    """Columns that overflow are hybrid-36; what is no such number stays an error row."""
    line = "ATOM  {:>5}  CA  GLY B{} {:>11.3f}{:8.3f}{:8.3f}  1.00  0.00"
    numbers = ["9999", "A000", "A001", "ZZZZ", "a000", "  x1"]
    (tmp_path / "one.pdb").write_text("\n".join(line.format("A0000", n, 1.0, 2.0, 3.0) for n in numbers) + "\n")
    atoms, errors = structures.read_pdb_atoms(spark, str(tmp_path / "one.pdb"))
    assert [r["residue_number"] for r in atoms.orderBy("line_no").collect()] == [9999, 10000, 10001, 1223055, 1223056]
    assert [r["problem"] for r in errors.collect()] == ["malformed residue number"]
    n = spark.createDataFrame([(9999,), (10000,), (1223055,), (1223056,)], "n long")
    assert [r[0] for r in n.select(files._columns(F.col("n"), 4)).collect()] == ["9999", "A000", "ZZZZ", "a000"]


def test_spread_ranks_shuffle_rows_once(spark):
    """Ties come from the sort that numbers the rows, not from a second shuffle by score; a class may span several buckets."""
    rows = spark.range(3000).select(F.col("id").alias("candidate_id"), F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") % 7) / 7).alias("tier1_score"))
    out = ranking.rank_candidates(rows, spread=True, min_rows=100)
    assert not re.search(r"hashpartitioning\([^\n]*tier1_score", out._jdf.queryExecution().executedPlan().toString())
    assert _rounded(out) == _rounded(ranking.rank_candidates(rows, spread=False).select(out.columns))


def test_ranks_of_a_whole_batch_hold_no_rows_in_one_task(spark):
    rows = spark.range(500).select("id", (F.col("id") % 9).cast("double").alias("v"))
    out = ordering.average_rank(rows, [], "v", "r", "n", spread=False)
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert windows and not any("rank(" in line for line in windows)
    assert _rounded(out.select("id", "r", "n")) == _rounded(ordering.average_rank(rows.withColumn("k", F.lit(1)), ["k"], "v", "r", "n", spread=False).select("id", "r", "n"))


def test_shuffles_are_checked_where_they_are_made(spark):
    """Once per row in the task that makes it, and the query's own check sorts without a comparator of its own."""
    rows = spark.createDataFrame([("a", "ACGUACGGUCAUUGCA"), ("b", "AC")], "candidate_id string, sequence string")
    out = controls.dinucleotide_shuffles(rows, 3)
    checked = out.withColumn("kept", controls.composition_kept(F.col("source_sequence"), F.col("sequence")))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" not in plan and "array_sort" not in plan
    assert [r["kept"] for r in checked.collect()] == [True] * 6


def test_many_rows_with_few_controls_are_small_groups(spark, monkeypatch):
    """Only a row with very many controls is cut in buckets; a median of twenty is one group."""
    from plumbline import runtime
    from plumbline.operators import controls
    real = spark.range(60).selectExpr("concat('c', id) AS candidate_id", "CAST(id AS DOUBLE) AS s", "'AC' AS sequence")
    few = real.selectExpr("candidate_id", "explode(sequence(1, 5)) AS i", "s").selectExpr("candidate_id", "s + i - 3 AS s", "'CA' AS sequence")
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(runtime, "is_large", lambda df: df.count() > 100)
    wanted, used = controls.group_quantiles, []
    monkeypatch.setattr(controls, "group_quantiles", lambda *a, **k: used.append(1) or wanted(*a, **k))
    rows = controls.shuffle_outcome(real, few, id_col="candidate_id", score="s").collect()
    assert not used and all(r.shuffle_median_score == r.structural_subscore for r in rows) and len(rows) == 60
    hot = few.unionByName(few.filter("candidate_id = 'c7'").crossJoin(spark.range(30)).drop("id"))
    rows = controls.shuffle_outcome(real, hot, id_col="candidate_id", score="s").collect()
    assert used and {r.shuffle_n for r in rows if r.candidate_id == "c7"} == {155}
