"""Shapes of physical plans that matter at scale."""

import re

from pyspark.sql import functions as F

from plumbline.operators import percentile, ranking, structure, targets
from plumbline.showcase.ranking import LINE_CRITERIA
from plumbline.showcase.views import view

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_needs_no_shuffle(spark):
    line = view(spark, SMALL, "v_line")
    cols = [c.name for c in LINE_CRITERIA]
    compact = percentile.compact_reference(line.filter("is_reference"), cols)
    scored = ranking.composite(percentile.criterion_scores(line, compact, LINE_CRITERIA), LINE_CRITERIA)
    text = plan(scored.select("candidate_id", "tier1_score"))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1
    # Only the columns the criteria and the id need reach the scan.
    read = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert "l_shipdate" not in read and "l_returnflag" not in read and "l_extendedprice" in read


def test_reference_filter_is_pushed_down(spark):
    text = plan(view(spark, SMALL, "v_line").filter("is_reference").select("c_lower"))
    assert "EqualTo(l_returnflag,R)" in text


def test_ranking_sorts_once(spark):
    df = view(spark, SMALL, "v_sized").select("candidate_id", "tier1_score", "lang")
    text = plan(ranking.rank_candidates(df, by=["lang"], spread=False))
    assert len(re.findall(r"Exchange hash", text)) == 1 and len(re.findall(r"\bSort \[", text)) == 1


def test_top_n_is_cut_before_the_shuffle(spark):
    df = view(spark, SMALL, "v_sized").select("candidate_id", "tier1_score", "lang")
    w = ranking.Window.partitionBy("lang").orderBy(F.desc("tier1_score"), "candidate_id")
    assert "WindowGroupLimit" in plan(df.withColumn("r", F.row_number().over(w)).filter("r <= 5"))


def test_structures_are_exchanged_as_strings(spark):
    f = view(spark, SMALL, "v_fold").select("candidate_id", "dot_bracket")
    text = plan(structure.match_brackets(f))
    # One exchange, below the step that makes a row per position.
    assert text.count("Exchange") == 1 and text.index("posexplode") < text.index("Exchange")


def test_bank_is_not_paired_with_targets(spark):
    cand, t, bank = (view(spark, SMALL, v) for v in ("v_sized", "v_targets", "v_bank"))
    text = plan(targets.bank_percentiles(targets.compare(targets.pair_with_targets(cand, t)), bank))
    assert "part.parquet" not in text and "SortMergeJoin" not in text
