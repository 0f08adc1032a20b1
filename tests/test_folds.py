"""References with a fold left out, draws per fold, and pairs of runs, against brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from plumbline.functions.identity import derive_seed
from plumbline.operators import groups, percentile
from plumbline.plans import evaluate

REFERENCE = [(0, 1.0), (0, 2.0), (0, 2.0), (1, 2.0), (1, 5.0), (2, -1.0), (2, 0.0), (2, -0.0), (None, 2.0), (None, 9.0)]
ROWS = [(f, v) for f in (0, 1, 2, 7, None) for v in (-2.0, 0.0, 1.5, 2.0, 9.0, 11.0)] + [(0, 2.0), (1, None)]


@pytest.mark.parametrize("above", [False, True])
@pytest.mark.parametrize("limit", [None, 0])
def test_percentiles_of_the_other_folds(spark, limit, above):
    """A fold without a reference of its own (7) meets all of it; null is a fold like any other."""
    ref = spark.createDataFrame(REFERENCE, "fold int, x double")
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS) if r[1] is not None], "i int, fold int, x double")
    compact = percentile.compact_reference(ref, ["x"], ["fold"])
    got = percentile.with_percentiles(rows, compact, ["x"], ["fold"], ("i",), above=above, max_values=limit, others=True)
    result = {r.i: r["p__x"] for r in got.collect()}
    assert len(result) == rows.count()
    for i, (fold, x) in enumerate(ROWS):
        if x is not None:
            rest = [v for f, v in REFERENCE if f != fold]
            side = sum(v > x if above else v < x for v in rest)
            assert result[i] == (side + 0.5 * sum(v == x for v in rest)) / len(rest)


@pytest.mark.parametrize("limit", [None, 0])
def test_nothing_else_is_left(spark, limit):
    ref = spark.createDataFrame([(0, 1.0), (0, 2.0)], "fold int, x double")
    rows = spark.createDataFrame([(0, 1.0), (1, 1.0)], "fold int, x double")
    got = percentile.with_percentiles(rows, percentile.compact_reference(ref, ["x"], ["fold"]), ["x"], ["fold"],
                                      max_values=limit, others=True)
    assert {r.fold: r["p__x"] for r in got.collect()} == {0: None, 1: 0.25}
    with pytest.raises(ValueError, match="key"):
        percentile.with_percentiles(rows, ref, ["x"], others=True)


def test_draws_per_group(spark):
    """Another number for each group; none for a group that asks for none, all where there are fewer."""
    want = {0: 0, 1: 1, 2: 40, 3: 1000, None: 7}
    df = spark.createDataFrame([(f"c{i}", g) for g in want for i in range(90)] + [("c5", 2)], "candidate_id string, g int")
    n = F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(g)), F.lit(k)) for g, k in want.items()])
    h = derive_seed(1, "draw", F.col("candidate_id")) % 4100  # equal hashes, and a cut inside the leading bits
    rows = df.withColumn("h", h).collect()
    for few in (False, True):
        drawn = groups.smallest_hashes(df, ["g"], h, n, few_groups=few)
        assert drawn.columns == df.columns
        got = sorted((str(r.g), r.candidate_id) for r in drawn.collect())
        expected = [(str(g), r.candidate_id) for g, k in want.items()
                    for r in sorted((r for r in rows if r.g == g), key=lambda r: (r.h, r.candidate_id))[:k]]
        assert got == sorted(expected)


def members(spark):
    corpus = spark.createDataFrame(
        [(f"c{i:03d}", f"T{i % 11}", "", float(i % 37), float(i % 5)) for i in range(120)],
        "candidate_id string, target_name string, target_pdb_id string, mfe_norm double, stem_fraction double")
    shuffled = corpus.select(F.col("candidate_id").alias("source_id"), F.concat(F.lit("s"), "candidate_id").alias("candidate_id"),
                             (F.col("mfe_norm") + 3).alias("mfe_norm"), "stem_fraction")
    random = corpus.select(F.concat(F.lit("r"), "candidate_id").alias("candidate_id"), (F.col("mfe_norm") / 2).alias("mfe_norm"), "stem_fraction")
    return corpus, shuffled, random


@pytest.mark.parametrize("limit", [None, 0])
def test_folds_out_of_fold(spark, limit):
    from plumbline import settings
    corpus, shuffled, random = members(spark)
    used = tuple(c for c in settings.DEFAULT_CRITERIA if c.name in ("mfe_norm", "stem_fraction"))
    scored = evaluate.out_of_fold_scores(corpus, shuffled, random, None, used, 4, 42, max_values=limit)
    got = {(r.group, r.candidate_id, r.fold): r.tier1_score for r in scored.collect()}
    folded = groups.target_folds(corpus, 4, 42).collect()
    by_fold = {f: [r for r in folded if r.fold == f] for f in range(4)}
    for f, held in by_fold.items():
        train = [r for r in folded if r.fold != f]
        plain = percentile.criterion_scores(
            corpus.filter(F.col("candidate_id").isin([r.candidate_id for r in held])),
            percentile.compact_reference(corpus.filter(F.col("candidate_id").isin([r.candidate_id for r in train])), [c.name for c in used]), used)
        from plumbline.operators import ranking
        for r in ranking.composite(plain, used).collect():
            assert got["validated", r.candidate_id, f] == pytest.approx(r.tier1_score, abs=1e-12)
        assert {c for g, c, k in got if g == "shuffled" and k == f} == {"s" + r.candidate_id for r in held}
        assert sum(g == "random" and k == f for g, c, k in got) == len(held)
    table = {r.fold: r for r in evaluate.fold_table(corpus, scored, 4, 42).collect()}
    for f, held in by_fold.items():
        assert (table[f].n_test, table[f].n_train, table[f].n_validated, table[f].n_random) == (len(held), 120 - len(held), len(held), len(held))
        values = sorted(v for (g, c, k), v in got.items() if g == "shuffled" and k == f)
        assert table[f].median_shuffled == pytest.approx((values[(len(held) - 1) // 2] + values[len(held) // 2]) / 2)


def test_too_small_to_train(spark):
    corpus, shuffled, random = members(spark)
    from plumbline import settings
    used = tuple(c for c in settings.DEFAULT_CRITERIA if c.name in ("mfe_norm", "stem_fraction"))
    few = corpus.filter("candidate_id < 'c040'")
    scored = evaluate.out_of_fold_scores(few, shuffled, random, None, used, 4, 42)
    assert scored.count() == 0 and evaluate.fold_table(few, scored, 4, 42).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64])
def test_pairs_of_runs(spark, block):
    """A candidate in every run, many in a few; a row without a run, without a candidate, twice, and not evaluated."""
    rows = [(f"r{i:02d}", "hot", i / 20, "weak", "evaluated") for i in range(20)]
    rows += [(f"r{i % 20:02d}", f"c{i // 4}", i % 7 / 7, "strong" if i % 3 else "weak", "evaluated") for i in range(60)]
    rows += [("r03", "hot", 0.15, "weak", "evaluated"), ("r04", "c0", 0.5, "weak", "not_evaluated"),
             (None, "hot", 0.5, "weak", "evaluated"), ("r05", None, 0.5, "weak", "evaluated"), ("r06", None, 0.5, "weak", "evaluated")]
    df = spark.createDataFrame(rows, "run_id string, candidate_id string, control_percentile double, band string, status string")
    ok = [r for r in rows if r[4] == "evaluated" and r[0] and r[1]]
    want = sorted((a[1], a[0], a[2], a[3], b[0], b[2], b[3]) for a, b in itertools.permutations(ok, 2) if a[1] == b[1] and a[0] < b[0])
    out = evaluate.shared_candidates(df, block=block)
    assert out.columns == ["candidate_id", "run_a", "p_a", "band_a", "run_b", "p_b", "band_b"]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert evaluate.shared_candidates(df.limit(0), block=block).count() == 0
