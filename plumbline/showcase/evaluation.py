"""Groups, folds, decoys, statistics, bootstrap and the experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, groups, joins, ranking, stats, targets
from ..plans import evaluate
from ..plans.annotate import annotate_targets
from ..settings import Comparison
from .ranking import _STRUCT, FIVE, mean_sql
from .sequences import CHECKED, raw
from .targets import _BAND, percentile_sql
from .views import table, view

N_BOOT = 200


def _r(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# -- joins ----------------------------------------------------------------

def requested_scores(spark, sf):
    """C5: every requested row comes back, failed ones with nulls."""
    scored = view(spark, sf, "v_features").filter("doc_id % 6 <> 0").select("candidate_id", "ensemble_defect")
    return joins.requested(scored, view(spark, sf, "v_seq"))


def held_members(spark, sf):
    """C6: shuffles whose source is held out."""
    held = groups.target_folds(view(spark, sf, "v_reference"), 5).filter("fold = 0")
    c = view(spark, sf, "v_controls")
    return joins.members_of(c, held).groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n"))


def training_rows(spark, sf):
    """C7: the corpus without the fold."""
    ref = groups.target_folds(view(spark, sf, "v_reference"), 5)
    return joins.training_rows(ref.select("candidate_id"), ref.filter("fold = 1"))


# -- groups ---------------------------------------------------------------

def generated(spark, sf):
    df = raw(spark, sf).select(F.col("row").alias("position"), "sequence", F.lit(None).cast("string").alias("id"))
    return groups.load_generated(df)


def random_rows(spark, sf):
    ref = view(spark, sf, "v_reference")
    return groups.random_matched(ref, ref.count())


def all_groups(spark, sf):
    ref = view(spark, sf, "v_reference").select("candidate_id", "sequence")
    seqs = view(spark, sf, "v_seq")
    rnd = seqs.select("candidate_id", F.reverse("sequence").alias("sequence"))
    shf = ref.select(F.concat(F.lit("shuf_"), "candidate_id").alias("candidate_id"),
                     F.concat(F.lit("A"), "sequence").alias("sequence"), F.col("candidate_id").alias("source_id"))
    gen = seqs.select("candidate_id", "sequence")
    out, _dropped = groups.build_groups(ref, rnd, shf, gen)
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count("source_id").alias("with_source"),
                                    F.min("sequence").alias("first"))


def folds(spark, sf):
    return groups.target_folds(view(spark, sf, "v_reference"), 3).select("candidate_id", "target_key", "grouping", "fold")


def folds_unlabelled(spark, sf):
    ref = view(spark, sf, "v_reference").withColumns({"target_name": F.lit(""), "target_pdb_id": F.lit("")})
    return groups.target_folds(ref, 4).select("candidate_id", "target_key", "grouping", "fold")


def sample(spark, sf):
    return groups.seeded_sample(view(spark, sf, "v_seq"), 40, by=["lang"]).select("lang", "candidate_id")


def decoys(spark, sf):
    """five distinct decoys, never the own target."""
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target_id"))
    return groups.choose_decoys(_own(spark, sf), t, 5)


def decoy_counts(spark, sf):
    return decoys(spark, sf).groupBy("candidate_id", "target_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("decoy").alias("n_distinct"),
        F.count_if(F.col("decoy") == F.col("target_id")).alias("own"))


def _own(spark, sf):
    n = table(spark, sf, "supplier").select("s_suppkey")
    c = view(spark, sf, "v_seq").select("candidate_id", (F.col("doc_id") % 10 * 2 + 2).alias("target_id"))
    return c.join(n, c.target_id == n.s_suppkey, "left_semi")


# -- statistics -----------------------------------------------------------

def spearman(spark, sf):
    df = view(spark, sf, "v_sized").withColumn("y", F.when(F.col("source") == "web", 1.0).otherwise(F.col("rg_median_A")))
    out = stats.spearman(df, ["lang", "source"], "loop_nt_median", "y")
    return out.select("lang", "source", "n", F.round("rho", 9).alias("rho"), "reason")


def two_groups(spark, sf):
    lab = table(spark, sf, "labels")
    f = view(spark, sf, "v_features").join(lab, "doc_id")
    return f.select("candidate_id", "ensemble_defect", "positional_entropy_mean", (F.col("quality") == 1).alias("good"),
                    F.round("stem_fraction", 1).alias("tied"))


def auc(spark, sf):
    return _r(stats.auc(two_groups(spark, sf), [], "tied", "good"), "auc", digits=9)


def mann_whitney(spark, sf):
    df = two_groups(spark, sf).join(view(spark, sf, "v_seq").select("candidate_id", "lang"), "candidate_id")
    out = stats.mann_whitney(df, ["lang"], "tied", "good")
    return _r(out.drop("p_value"), "median_a", "median_b", "u_statistic", "auc", digits=9)


def retrieval(spark, sf):
    s = view(spark, sf, "v_samples").select(
        "candidate_id", F.length("dot_bracket").cast("double").alias("score"), (F.col("sample_index") == 1).alias("is_true"))
    out = stats.retrieval_metrics(s, "candidate_id", "score", "is_true")
    return _r(out, "mrr", "top1_accuracy", digits=9)


def wilson(spark, sf):
    t = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 21).alias("n"), (F.col("s_suppkey") % 21 * 2 / 3).cast("long").alias("k"))
    low, high = stats.wilson_bounds(F.col("k"), F.col("n"))
    return t.select("s_suppkey", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def quartiles(spark, sf):
    out = stats.group_quartiles(view(spark, sf, "v_line"), ["c_mid1"], "c_higher")
    return _r(out, "q1", "median", "q3")


def quartiles_spread(spark, sf):
    """The shape for groups too large for one task."""
    out = stats.group_quartiles(view(spark, sf, "v_line"), ["c_mid1"], "c_higher", spread=True)
    return _r(out, "q1", "median", "q3")


def letters(spark, sf):
    return _r(stats.letter_frequencies(view(spark, sf, "v_seq"), ["lang"]), *[f"freq_{c}" for c in "ACGU"], digits=9)


def lengths(spark, sf):
    return stats.length_distribution(view(spark, sf, "v_seq"), ["lang"])


REPORT = ("correlation", "median_rg_median_A", "median_length", "median_sd_within_length", "max_sd_within_length")


def report(spark, sf):
    return _r(stats.descriptor_report(view(spark, sf, "v_sized")), *REPORT)


# -- bootstrap ------------------------------------------------------------

def boot(spark, sf):
    return _r(bootstrap.bootstrap_auc(two_groups(spark, sf), "tied", "good", "candidate_id", N_BOOT), "ci_low", "ci_high", digits=9)


def boot_clustered(spark, sf):
    df = two_groups(spark, sf).join(view(spark, sf, "v_features").select(
        "candidate_id", F.col("doc_id").alias("d")), "candidate_id").withColumn("c", F.concat(F.lit("k"), (F.col("d") % 12).cast("string")))
    return _r(bootstrap.bootstrap_auc_clustered(df, "tied", "good", "candidate_id", "c", N_BOOT), "ci_low", "ci_high", digits=9)


def boot_unit(spark, sf):
    s = view(spark, sf, "v_samples").select(
        "candidate_id", F.length("dot_bracket").cast("double").alias("score"), (F.col("sample_index") == 1).alias("is_true"))
    return _r(bootstrap.bootstrap_auc_by_unit(s, "candidate_id", "score", "is_true", N_BOOT), "auc", "ci_low", "ci_high", digits=9)


def boot_paired(spark, sf):
    df = view(spark, sf, "v_features").select("candidate_id", (F.col("ensemble_defect") - F.col("positional_entropy_mean")).alias("d"))
    return _r(bootstrap.paired_bootstrap(df, "d", "candidate_id", N_BOOT), "mean", "median", "fraction_positive", "ci_low", "ci_high")


def boot_compact(spark, sf):
    """D19 with the default 2000 replicates."""
    return _r(bootstrap.bootstrap_auc_compact(two_groups(spark, sf), "tied", "good"), "ci_low", "ci_high", digits=9)


def boot_paired_compact(spark, sf):
    df = view(spark, sf, "v_features").select((F.col("ensemble_defect") - F.col("positional_entropy_mean")).alias("d"))
    return _r(bootstrap.paired_bootstrap_compact(df, "d"), "mean", "median", "fraction_positive", "ci_low", "ci_high")


# -- experiments ----------------------------------------------------------

def _e1(spark, sf):
    f = view(spark, sf, "v_features")
    ref = view(spark, sf, "v_reference").withColumn("target_name", F.concat("target_name", F.lit("-"), (F.col("doc_id") % 4).cast("string")))
    shuf = view(spark, sf, "v_controls").filter("shuffle_index = 1").withColumn("source_id", F.col("candidate_id"))
    rnd = f.join(ref.select("candidate_id"), "candidate_id", "left_anti")
    gen = f
    return ref, shuf, rnd, gen, _STRUCT, 5, 42


def discrimination_scores(spark, sf):
    scores = evaluate.out_of_fold_scores(*_e1(spark, sf))
    return scores.groupBy("group", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median("tier1_score"), 9).alias("median"), F.round(F.sum("tier1_score"), 6).alias("total"))


def discrimination_by_shuffle(spark, sf):
    """The shape for references too large to travel."""
    scores = evaluate.out_of_fold_scores(*_e1(spark, sf), max_values=0)
    return scores.groupBy("group", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median("tier1_score"), 9).alias("median"), F.round(F.sum("tier1_score"), 6).alias("total"))


def discrimination_folds(spark, sf):
    ref, *rest = _e1(spark, sf)
    out = evaluate.fold_table(ref, evaluate.out_of_fold_scores(ref, *rest))
    return _r(out, *[f"median_{g}" for g in evaluate.FOLD_GROUPS], digits=9)


def discrimination(spark, sf):
    _s, comparisons = evaluate.discrimination(*_e1(spark, sf), N_BOOT)
    return comparisons.select("comparison", "n_a", "n_b", F.round("auc", 6).alias("auc"),
                              F.round("median_a", 6).alias("median_a"), F.round("median_b", 6).alias("median_b"))


def pass_rates(spark, sf):
    f = view(spark, sf, "v_features").join(view(spark, sf, "v_seq").select("candidate_id", F.col("lang").alias("group")), "candidate_id")
    out = evaluate.control_pass_rates(f, view(spark, sf, "v_controls"), view(spark, sf, "v_reference"), _STRUCT)
    return _r(out, "pass_rate", "ci_low", "ci_high", "median_p_value", digits=9)


def _e3(spark, sf):
    t = view(spark, sf, "v_targets").filter("binding_mode = 'pocket'")
    c = view(spark, sf, "v_sized").withColumn("target_id", F.substring("candidate_id", 2, 20).cast("long") % 5 * 2 + 2)
    return evaluate.matched_vs_decoy(c, t, view(spark, sf, "v_bank"), Comparison(), 5, 42, N_BOOT)


def matched_pairs(spark, sf):
    """Every labelled candidate: its true percentile, and how many decoys it met."""
    pairs, _s = _e3(spark, sf)
    return pairs.groupBy("candidate_id").agg(
        F.round(F.max(F.when(F.col("is_true"), F.col("control_percentile"))), 9).alias("true_percentile"),
        F.count_if(~F.col("is_true")).alias("n_decoys"))


def matched(spark, sf):
    _p, summary = _e3(spark, sf)
    return _r(summary, *[c for c in summary.columns if c != "n_pairs"])


def _runs(spark, sf):
    """One run per supplier: the same ranking against every target."""
    ranked = ranking.rank_candidates(view(spark, sf, "v_sized"))
    out = annotate_targets(ranked, view(spark, sf, "v_targets"), view(spark, sf, "v_bank"), Comparison(n_survivors=300))
    return out.withColumn("run_id", F.concat(F.lit("run"), F.col("target_id").cast("string")))


def shared(spark, sf):
    out = evaluate.pair_summary(_runs(spark, sf))
    return out.select("run_a", "run_b", F.col("n_shared").alias("n"), F.round("moved", 6).alias("moved"))


def swap(spark, sf):
    out = evaluate.target_swap(_runs(spark, sf))
    return out.select("run_a", "run_b", "n_shared", F.round("band_changed_fraction", 9).alias("band_changed_fraction"), F.round("rho", 6).alias("rho"))


def independence(spark, sf):
    out = evaluate.tier_independence(_runs(spark, sf))
    return out.select("run_id", "n", F.round("rho", 6).alias("rho"), "reason", F.round("max_abs_rho", 6).alias("max_abs_rho"))


def validation(spark, sf):
    _report, agreement = evaluate.descriptor_validation(
        view(spark, sf, "v_sized"), view(spark, sf, "v_targets"), view(spark, sf, "v_bank"))
    return _r(agreement, "agreement", digits=9)


def bands_agree(spark, sf):
    s = view(spark, sf, "v_sized")
    band = lambda c: F.when(F.col(c) >= 30, "strong").when(F.col(c) >= 20, "moderate").otherwise("weak")
    df = s.select("lang", band("rg_median_A").alias("radius"), band("length").alias("length"))
    return _r(stats.band_agreement(df, ["lang"], "radius", "length"), "agreement", digits=9)


# -- SQL ------------------------------------------------------------------

def _key(c):
    return f"trim(regexp_replace(upper({c}), '[^A-Z0-9]+', '-', 'g'), '-')"


def fold_sql(n: int, ref: str = "SELECT * FROM v_reference", unit: str | None = None) -> str:
    unit = unit or _key("target_name")
    return f"""rf AS ({ref}), fu AS (SELECT DISTINCT {unit} AS u FROM rf),
fo AS (SELECT u, ((row_number() OVER (ORDER BY ('0x' || substr(sha256('42|folds|' || u), 1, 8))::BIGINT, u) - 1) % {n})::INTEGER AS fold FROM fu),
folded AS (SELECT rf.*, {unit} AS target_key, fo.fold FROM rf JOIN fo ON fo.u = {unit})"""


def draw(label: str, n: str) -> str:
    return f"('0x' || substr(md5('{label}|42|' || r || '|' || j), 1, 12))::BIGINT % {n}"


def drawn_sql(name: str, label: str, units: str) -> str:
    """``name``: replicate r, and the drawn rows of ``units`` (which has column i from 0)."""
    return f"""{name}_n AS (SELECT count(*) AS n FROM {units}),
{name} AS (SELECT d.r, u.* FROM (SELECT r, {draw(label, 'n')} AS i FROM {name}_n, range({N_BOOT}) a(r), range((SELECT n FROM {name}_n)) b(j)) d JOIN {units} u ON u.i = d.i)"""


def auc_sql(rows: str, keys: str = "r") -> str:
    """``au``: AUC per key over (keys, v, pos, w) rows with weights."""
    return f"""cn AS (SELECT {keys}, v, sum(CASE WHEN pos THEN w ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN pos THEN 0 ELSE w END)::DOUBLE AS q FROM ({rows}) GROUP BY {keys}, v),
cu AS (SELECT *, sum(q) OVER (PARTITION BY {keys} ORDER BY v) - q AS below FROM cn),
au AS (SELECT {keys}, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM cu GROUP BY {keys})"""


_CI = f"SELECT round(quantile_cont(auc, 0.025), 9) AS ci_low, round(quantile_cont(auc, 0.975), 9) AS ci_high, {N_BOOT}::BIGINT AS n_boot"
_TWO = """two AS (SELECT f.candidate_id, f.doc_id, round(f.stem_fraction, 1) AS v, l.quality = 1 AS pos FROM v_features f JOIN labels l ON l.doc_id = f.doc_id),
ps AS (SELECT *, row_number() OVER (ORDER BY candidate_id) - 1 AS i FROM two WHERE pos), ng AS (SELECT *, row_number() OVER (ORDER BY candidate_id) - 1 AS i FROM two WHERE NOT pos)"""
_UNITS = """un AS (SELECT candidate_id, length(dot_bracket) AS v, sample_index = 1 AS pos FROM v_samples),
ids AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) - 1 AS i FROM (SELECT candidate_id FROM un GROUP BY 1 HAVING bool_or(pos) AND NOT bool_and(pos)))"""
_MED = lambda c: f"median({c})"

_E1 = fold_sql(5, "SELECT * EXCLUDE (target_name), target_name || '-' || (doc_id % 4) AS target_name FROM v_reference") + """,
ok AS (SELECT f.fold FROM (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f WHERE (SELECT count(*) FROM folded WHERE folded.fold <> f.fold) >= 50),
sz AS (SELECT fold, count(*) AS n FROM folded GROUP BY 1),
rnd AS (SELECT * FROM (SELECT f.*, sz.fold, sz.n, row_number() OVER (PARTITION BY sz.fold ORDER BY ('0x' || substr(sha256('42|random|' || sz.fold || '|' || candidate_id), 1, 8))::BIGINT, candidate_id) AS k
  FROM v_features f CROSS JOIN sz WHERE candidate_id NOT IN (SELECT candidate_id FROM v_reference)) WHERE k <= n),
cd AS (SELECT 'validated' AS grp, candidate_id, fold, {c} FROM folded UNION ALL SELECT 'shuffled', c.candidate_id, folded.fold, {cc} FROM v_controls c JOIN folded ON folded.candidate_id = c.candidate_id WHERE c.shuffle_index = 1
  UNION ALL SELECT 'random', candidate_id, fold, {c} FROM rnd UNION ALL SELECT 'generated', candidate_id, NULL, {c} FROM v_features),
pc AS (SELECT cd.grp, cd.candidate_id, cd.fold, {p} FROM cd JOIN folded t ON cd.fold IS NULL OR t.fold <> cd.fold WHERE cd.fold IS NULL OR cd.fold IN (SELECT fold FROM ok) GROUP BY ALL),
e1 AS (SELECT grp, candidate_id, fold, {m} AS s FROM pc)""".format(
    c=", ".join(c.name for c in _STRUCT), cc=", ".join(f"c.{c.name}" for c in _STRUCT),
    p=", ".join(f"(count(*) FILTER (t.{c.name} < cd.{c.name}) + 0.5::DOUBLE * count(*) FILTER (t.{c.name} = cd.{c.name})) / count(*) AS p_{c.name}, cd.{c.name}" for c in _STRUCT),
    m="((1 - p_mfe_norm) + (1 - p_ensemble_defect) + (1 - p_positional_entropy_mean) + greatest(0, 1 - 2 * abs(p_stem_fraction - 0.5::DOUBLE))) / 4")

_RUNS = f"""rk AS (SELECT *, row_number() OVER (ORDER BY tier1_score DESC, candidate_id) AS rank FROM v_sized),
{percentile_sql('SELECT * FROM rk WHERE rank <= 300')},
runs AS (SELECT 'run' || target_id AS run_id, candidate_id, tier1_score, cp, {_BAND} AS band FROM pct)"""


def spearman_sql(src: str, keys: str, x: str, y: str) -> str:
    ks = ", ".join(k.strip() for k in keys.split(","))
    return f"""rx AS (SELECT {ks}, rank() OVER (PARTITION BY {ks} ORDER BY {x}) + (count(*) OVER (PARTITION BY {ks}, {x}) - 1) / 2 AS a,
  rank() OVER (PARTITION BY {ks} ORDER BY {y}) + (count(*) OVER (PARTITION BY {ks}, {y}) - 1) / 2 AS b FROM {src}),
rho AS (SELECT {ks}, count(*) AS n, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS rho FROM rx GROUP BY {ks})"""


_WHY = "CASE WHEN rho IS NULL THEN 'insufficient variation or fewer than 3 evaluated survivors' END AS reason"
_MODEL = lambda m: percentile_sql("SELECT * FROM v_sized").replace("'radius_of_gyration' = 'length'", m)


def _validation_sql() -> str:
    both = []
    for tag, model in (("rg", "false"), ("ln", "true")):
        text = _MODEL(model)
        for name in ("pairs", "sz", "cmp", "b_pairs", "b_sz", "b_cmp", "dist", "dist_x", "tot", "tot_x", "pct"):
            import re
            text = re.sub(rf"\b{name}\b", f"{tag}_{name}", text)
        both.append(text)
    return f"""WITH {both[0]}, {both[1]}, wide AS (SELECT a.target_id, a.candidate_id, {_BAND.replace('cp', 'a.cp')} AS radius, {_BAND.replace('cp', 'b.cp')} AS length
  FROM rg_pct a JOIN ln_pct b ON a.target_id = b.target_id AND a.candidate_id = b.candidate_id WHERE a.binding_mode = 'surface')
SELECT target_id, count(*) AS n, """ + ", ".join(
        f"count(*) FILTER ({c} = '{x}') AS {x}_{c}" for c in ("radius", "length") for x in ("strong", "moderate", "weak")) \
        + ", round(avg((radius = length)::INT), 9) AS agreement FROM wide GROUP BY 1"


def _outcome_groups_sql() -> str:
    from .controls import _outcome_sql
    return f"""WITH {_outcome_sql()}, m AS (SELECT s.lang AS "group", o.* FROM v_seq s JOIN outcome o ON o.candidate_id = s.candidate_id),
g AS (SELECT "group", count(*) AS n, avg(shuffle_pass::INT) AS p, median(shuffle_p_value) AS med FROM m GROUP BY 1),
w AS (SELECT *, (p + 1.9208::DOUBLE / n) / (1 + 3.8416::DOUBLE / n) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 0.9604::DOUBLE / (n * n)) / (1 + 3.8416::DOUBLE / n) AS d FROM g)
SELECT "group", n, round(p, 9) AS pass_rate, round(greatest(0, c - d), 9)::DOUBLE AS ci_low, round(least(1, c + d), 9)::DOUBLE AS ci_high, round(med, 9) AS median_p_value FROM w"""


def decoy_sql(targets_: str, own: str) -> str:
    """``dcy``: five consecutive places on a hashed circle, from a hashed start."""
    return f"""pl AS (SELECT target_id AS decoy, count(*) OVER () AS n, row_number() OVER (ORDER BY ('0x' || substr(sha256('42|circle|' || target_id), 1, 8))::BIGINT, target_id) - 1 AS place FROM {targets_}),
stt AS (SELECT o.candidate_id, o.target_id, pl.place AS loc, n, ('0x' || substr(md5('decoy|42|' || o.candidate_id), 1, 12))::BIGINT % (n - 1) AS s FROM {own} o JOIN pl ON pl.decoy = o.target_id),
dcy AS (SELECT x.candidate_id, x.target_id, pl.decoy FROM (SELECT *, (loc + 1 + (s + j) % (n - 1)) % n AS place FROM stt, range(5) r(j) WHERE j < n - 1) x JOIN pl ON pl.place = x.place)"""


_E3 = f"""{percentile_sql("SELECT *, substr(candidate_id, 2)::BIGINT % 5 * 2 + 2 AS own FROM v_sized")},
tg AS (SELECT target_id FROM v_targets WHERE binding_mode = 'pocket'), ow AS (SELECT candidate_id, own AS target_id FROM pct WHERE target_id = own AND binding_mode = 'pocket' AND evaluable),
{decoy_sql('tg', 'ow')}, un AS (SELECT p.candidate_id, p.cp AS v, true AS pos FROM pct p JOIN ow ON ow.candidate_id = p.candidate_id AND ow.target_id = p.target_id
  UNION ALL SELECT p.candidate_id, p.cp, false FROM pct p JOIN dcy ON dcy.candidate_id = p.candidate_id AND dcy.decoy = p.target_id),
df AS (SELECT candidate_id, max(v) FILTER (pos) - avg(v) FILTER (NOT pos) AS d FROM un GROUP BY 1), pr AS (SELECT d, row_number() OVER (ORDER BY candidate_id) - 1 AS i FROM df),
ids AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) - 1 AS i FROM (SELECT DISTINCT candidate_id FROM un)),
{drawn_sql('dd', 'pair', 'pr')}, mn AS (SELECT r, avg(d) AS m FROM dd GROUP BY 1), {drawn_sql('du', 'unit', 'ids')},
{auc_sql("SELECT du.r, un.v, un.pos, 1 AS w FROM du JOIN un ON un.candidate_id = du.candidate_id UNION ALL SELECT -1, v, pos, 1 FROM un")},
rr AS (SELECT a.candidate_id, 1 + count(*) FILTER (b.v > a.v) + 0.5::DOUBLE * count(*) FILTER (b.v = a.v) AS r FROM un a JOIN un b ON b.candidate_id = a.candidate_id AND a.pos AND NOT b.pos GROUP BY 1)"""

QUERIES = {
    "c5_requested_scores": (requested_scores, "SELECT s.candidate_id, CASE WHEN s.doc_id % 6 <> 0 THEN f.ensemble_defect END AS ensemble_defect FROM v_seq s JOIN v_features f ON f.doc_id = s.doc_id"),
    "c6_held_out_members": (held_members, f"WITH {fold_sql(5)} SELECT candidate_id, count(*) AS n FROM v_controls WHERE candidate_id IN (SELECT candidate_id FROM folded WHERE fold = 0) GROUP BY 1"),
    "c7_training_rows": (training_rows, f"WITH {fold_sql(5)} SELECT candidate_id FROM folded WHERE fold <> 1"),
    "f2_load_generated": (generated, f"""WITH {CHECKED} SELECT 'gen' || lpad(min(row)::VARCHAR, 5, '0') AS candidate_id, clean AS sequence, 'generated' AS "group" FROM checked WHERE reason IS NULL GROUP BY clean"""),
    "f3_random_matched": (random_rows, """WITH n AS (SELECT count(*) AS n, sum(len(regexp_extract_all(sequence, 'A')))::DOUBLE AS a, sum(len(regexp_extract_all(sequence, 'C')))::DOUBLE AS c,
          sum(len(regexp_extract_all(sequence, 'G')))::DOUBLE AS g, sum(length(sequence))::DOUBLE AS t FROM v_reference),
        l AS (SELECT row_number() OVER (ORDER BY candidate_id) - 1 AS k, length(sequence) AS length FROM v_reference),
        w AS (SELECT i, n.*, l.length FROM (SELECT i, ('0x' || substr(md5('length|42|' || i), 1, 12))::BIGINT % n AS k FROM n, range((SELECT n FROM n)) x(i)) d JOIN l ON l.k = d.k CROSS JOIN n),
        p AS (SELECT i, p, ('0x' || substr(md5('letter|42|' || i || '|' || p), 1, 12))::BIGINT / 281474976710656::DOUBLE AS u, a, c, g, t FROM (SELECT *, unnest(range(1, length + 1)) AS p FROM w))
        SELECT 'rand' || lpad(i::VARCHAR, 5, '0') AS candidate_id, string_agg(CASE WHEN u < a / t THEN 'A' WHEN u < a / t + c / t THEN 'C' WHEN u < a / t + c / t + g / t THEN 'G' ELSE 'U' END, '' ORDER BY p) AS sequence,
          'random' AS "group" FROM p GROUP BY i"""),
    "f1_build_groups": (all_groups, """WITH g AS (SELECT 'validated' AS grp, sequence, NULL AS src FROM v_reference UNION ALL SELECT 'random', reverse(sequence), NULL FROM v_seq
        UNION ALL SELECT 'shuffled', 'A' || sequence, candidate_id FROM v_reference UNION ALL SELECT 'generated', sequence, NULL FROM v_seq WHERE sequence NOT IN (SELECT sequence FROM v_reference))
        SELECT grp AS "group", count(*) AS n, count(src) AS with_source, min(sequence) AS first FROM g GROUP BY 1"""),
    "f7_target_folds": (folds, f"WITH {fold_sql(3)} SELECT candidate_id, target_key, 'target_name' AS grouping, fold FROM folded"),
    "f7_folds_without_labels": (folds_unlabelled, f"WITH {fold_sql(4, unit='candidate_id')} SELECT candidate_id, '__unlabelled__' AS target_key, 'sequence (no target labels available)' AS grouping, fold FROM folded"),
    "f8_seeded_sample": (sample, """SELECT lang, candidate_id FROM (SELECT lang, candidate_id, row_number() OVER (PARTITION BY lang
        ORDER BY ('0x' || substr(sha256('42|sample|' || candidate_id), 1, 8))::BIGINT, candidate_id) AS k FROM v_seq) WHERE k <= 40"""),
    "f9_choose_decoys": (decoys, f"""WITH tg AS (SELECT s_suppkey AS target_id FROM supplier), ow AS (SELECT candidate_id, doc_id % 10 * 2 + 2 AS target_id FROM v_seq), {decoy_sql('tg', 'ow')}
        SELECT candidate_id, target_id, decoy FROM dcy"""),
    "f9_decoy_counts": (decoy_counts, """SELECT s.candidate_id, (s.doc_id % 10) * 2 + 2 AS target_id, least(5, (SELECT count(*) FROM supplier) - 1) AS n,
        least(5, (SELECT count(*) FROM supplier) - 1) AS n_distinct, 0::BIGINT AS own FROM v_seq s WHERE (s.doc_id % 10) * 2 + 2 IN (SELECT s_suppkey FROM supplier)"""),
    "d16_spearman": (spearman, f"""WITH s AS (SELECT *, CASE WHEN source = 'web' THEN 1.0::DOUBLE ELSE rg_median_A END AS y FROM v_sized), {spearman_sql('s', 'lang, source', 'loop_nt_median', 'y')}
        SELECT lang, source, n, round(rho, 9) AS rho, {_WHY} FROM rho"""),
    "d17_auc": (auc, f"WITH {_TWO} SELECT (SELECT count(*) FROM ps) AS n_a, (SELECT count(*) FROM ng) AS n_b, round(avg(CASE WHEN ps.v > ng.v THEN 1 WHEN ps.v = ng.v THEN 0.5::DOUBLE ELSE 0 END), 9) AS auc FROM ps CROSS JOIN ng"),
    "d18_mann_whitney": (mann_whitney, f"""WITH {_TWO}, t AS (SELECT two.*, s.lang FROM two JOIN v_seq s ON s.doc_id = two.doc_id),
        c AS (SELECT lang, count(*) FILTER (pos) AS n_a, count(*) FILTER (NOT pos) AS n_b, median(v) FILTER (pos) AS ma, median(v) FILTER (NOT pos) AS mb FROM t GROUP BY 1),
        u AS (SELECT a.lang, sum(CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5::DOUBLE ELSE 0 END) AS u FROM t a JOIN t b ON a.lang = b.lang AND a.pos AND NOT b.pos GROUP BY 1)
        SELECT c.lang, n_a, n_b, CASE WHEN n_a >= 2 AND n_b >= 2 THEN round(ma, 9) END AS median_a, CASE WHEN n_a >= 2 AND n_b >= 2 THEN round(mb, 9) END AS median_b,
          CASE WHEN n_a >= 2 AND n_b >= 2 THEN round(u, 9) END AS u_statistic, CASE WHEN n_a >= 2 AND n_b >= 2 THEN round(u / (n_a * n_b), 9) END AS auc,
          CASE WHEN n_a < 2 OR n_b < 2 THEN 'fewer than two observations in a group' END AS reason FROM c LEFT JOIN u ON u.lang = c.lang"""),
    "d23_retrieval_metrics": (retrieval, f"""WITH {_UNITS}, t AS (SELECT candidate_id, v FROM un WHERE pos), r AS (SELECT un.candidate_id, 1 + count(*) FILTER (un.v > t.v) + 0.5::DOUBLE * count(*) FILTER (un.v = t.v) AS r
          FROM un JOIN t ON t.candidate_id = un.candidate_id WHERE NOT un.pos GROUP BY 1)
        SELECT count(*) AS n, round(avg(1 / r), 9) AS mrr, round(avg((r = 1)::INT), 9) AS top1_accuracy FROM r"""),
    "d24_wilson_interval": (wilson, """WITH s AS (SELECT s_suppkey, s_suppkey % 21 AS n, floor(s_suppkey % 21 * 2 / 3) AS k FROM supplier),
        w AS (SELECT s_suppkey, n, k / nullif(n, 0) AS p FROM s), x AS (SELECT s_suppkey, n, (p + 1.9208::DOUBLE / nullif(n, 0)) / (1 + 3.8416::DOUBLE / nullif(n, 0)) AS c,
          1.96::DOUBLE * sqrt(p * (1 - p) / nullif(n, 0) + 0.9604::DOUBLE / nullif(n * n, 0)) / (1 + 3.8416::DOUBLE / nullif(n, 0)) AS d FROM w)
        SELECT s_suppkey, CASE WHEN n > 0 THEN round(greatest(0, c - d), 9) END::DOUBLE AS low, CASE WHEN n > 0 THEN round(least(1, c + d), 9) END::DOUBLE AS high FROM x"""),
    "d25_group_quartiles": (quartiles, "SELECT c_mid1, round(quantile_cont(c_higher, 0.25), 6) AS q1, round(median(c_higher), 6) AS median, round(quantile_cont(c_higher, 0.75), 6) AS q3, count(*) AS n FROM v_line GROUP BY 1"),
    "d25_group_quartiles_spread": (quartiles_spread, "SELECT c_mid1, round(quantile_cont(c_higher, 0.25), 6) AS q1, round(median(c_higher), 6) AS median, round(quantile_cont(c_higher, 0.75), 6) AS q3, count(*) AS n FROM v_line GROUP BY 1"),
    "d26_letter_frequencies": (letters, "SELECT lang, " + ", ".join(f"round(sum(len(regexp_extract_all(sequence, '{c}'))) / sum(length(sequence)), 9) AS freq_{c}" for c in "ACGU") + " FROM v_seq GROUP BY 1"),
    "d26_length_distribution": (lengths, "SELECT lang, length(sequence)::INTEGER AS length, count(*) AS n FROM v_seq GROUP BY 1, 2"),
    "d27_descriptor_report": (report, """WITH w AS (SELECT length, stddev_pop(rg_median_A) AS sd FROM v_sized GROUP BY 1 HAVING count(*) > 2)
        SELECT count(*) AS n, round(corr(rg_median_A, length), 6) AS correlation, min(rg_median_A) AS min_rg_median_A, max(rg_median_A) AS max_rg_median_A, min(length) AS min_length, max(length) AS max_length,
          round(median(rg_median_A), 6) AS median_rg_median_A, round(median(length), 6) AS median_length, round((SELECT median(sd) FROM w), 6) AS median_sd_within_length,
          round((SELECT max(sd) FROM w), 6) AS max_sd_within_length FROM v_sized"""),
    "d28_band_agreement": (bands_agree, "WITH b AS (SELECT lang, CASE WHEN rg_median_A >= 30 THEN 'strong' WHEN rg_median_A >= 20 THEN 'moderate' ELSE 'weak' END AS radius, "
        "CASE WHEN length >= 30 THEN 'strong' WHEN length >= 20 THEN 'moderate' ELSE 'weak' END AS length FROM v_sized) SELECT lang, count(*) AS n, "
        + ", ".join(f"count(*) FILTER ({c} = '{x}') AS {x}_{c}" for c in ("radius", "length") for x in ("strong", "moderate", "weak"))
        + ", round(avg((radius = length)::INT), 9) AS agreement FROM b GROUP BY 1"),
    "d19_bootstrap_auc": (boot, f"WITH {_TWO}, {drawn_sql('dp', 'pos', 'ps')}, {drawn_sql('dn', 'neg', 'ng')}, "
        + auc_sql("SELECT r, v, pos, 1 AS w FROM dp UNION ALL SELECT r, v, pos, 1 FROM dn") + f" {_CI} FROM au"),
    "d19_bootstrap_auc_compact": (boot_compact, None),
    "d22_paired_bootstrap_compact": (boot_paired_compact, None),
    "d20_bootstrap_auc_clustered": (boot_clustered, f"WITH {_TWO}, cl AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT DISTINCT 'k' || (doc_id % 12) AS c FROM ps)), "
        f"{drawn_sql('dc', 'cluster', 'cl')}, {drawn_sql('dn', 'neg', 'ng')}, "
        + auc_sql("SELECT dc.r, ps.v, true AS pos, 1 AS w FROM dc JOIN ps ON 'k' || (ps.doc_id % 12) = dc.c UNION ALL SELECT r, v, false, 1 FROM dn")
        + f" {_CI}, (SELECT count(*) FROM cl)::INTEGER AS n_clusters, true AS cluster_bootstrap FROM au"),
    "d21_bootstrap_auc_by_unit": (boot_unit, f"WITH {_UNITS}, {drawn_sql('du', 'unit', 'ids')}, "
        + auc_sql("SELECT du.r, un.v, un.pos, 1 AS w FROM du JOIN un ON un.candidate_id = du.candidate_id UNION ALL SELECT -1, v, pos, 1 FROM un")
        + f" SELECT round(max(auc) FILTER (r = -1), 9) AS auc, round(quantile_cont(auc, 0.025) FILTER (r >= 0), 9) AS ci_low, round(quantile_cont(auc, 0.975) FILTER (r >= 0), 9) AS ci_high, "
        f"{N_BOOT}::BIGINT AS n_boot, (SELECT count(*) FROM ids)::INTEGER AS n_units FROM au"),
    "d22_paired_bootstrap": (boot_paired, f"WITH pr AS (SELECT ensemble_defect - positional_entropy_mean AS d, row_number() OVER (ORDER BY candidate_id) - 1 AS i FROM v_features), {drawn_sql('dd', 'pair', 'pr')}, "
        "m AS (SELECT r, avg(d) AS m FROM dd GROUP BY 1) SELECT (SELECT count(*) FROM pr) AS n, round((SELECT avg(d) FROM pr), 6) AS mean, round((SELECT median(d) FROM pr), 6) AS median, "
        "round((SELECT avg((d > 0)::INT) FROM pr), 6) AS fraction_positive, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m"),
    "g11_discrimination_scores": (discrimination_scores, f'WITH {_E1} SELECT grp AS "group", fold, count(*) AS n, round(median(s), 9) AS median, round(sum(s), 6) AS total FROM e1 GROUP BY 1, 2'),
    "g11_scores_by_shuffle": (discrimination_by_shuffle, f'WITH {_E1} SELECT grp AS "group", fold, count(*) AS n, round(median(s), 9) AS median, round(sum(s), 6) AS total FROM e1 GROUP BY 1, 2'),
    "g11_fold_table": (discrimination_folds, f"""WITH {_E1}, tr AS (SELECT ok.fold, (SELECT count(*) FROM folded f WHERE f.fold <> ok.fold) AS n_train, (SELECT count(*) FROM folded f WHERE f.fold = ok.fold) AS n_test FROM ok)
        SELECT tr.fold, n_train, n_test, """ + ", ".join(
            f"(SELECT count(*) FROM e1 WHERE e1.fold = tr.fold AND grp = '{g}') AS n_{g}, (SELECT round(median(s), 9) FROM e1 WHERE e1.fold = tr.fold AND grp = '{g}') AS median_{g}"
            for g in evaluate.FOLD_GROUPS) + " FROM tr WHERE n_test > 0"),
    "g11_discrimination": (discrimination, f"""WITH {_E1}, cp AS (SELECT unnest([['validated', 'random'], ['validated', 'shuffled'], ['generated', 'random'], ['validated', 'generated']]) AS p),
        x AS (SELECT p[1] || '_vs_' || p[2] AS comparison, e1.s, e1.grp = p[1] AS pos FROM cp JOIN e1 ON e1.grp = p[1] OR e1.grp = p[2]),
        u AS (SELECT a.comparison, avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) AS auc FROM x a JOIN x b ON a.comparison = b.comparison AND a.pos AND NOT b.pos GROUP BY 1)
        SELECT x.comparison, count(*) FILTER (pos) AS n_a, count(*) FILTER (NOT pos) AS n_b, round(any_value(auc), 6) AS auc, round(median(s) FILTER (pos), 6) AS median_a, round(median(s) FILTER (NOT pos), 6) AS median_b
        FROM x JOIN u ON u.comparison = x.comparison GROUP BY 1"""),
    "g12_control_pass_rates": (pass_rates, _outcome_groups_sql()),
    "g13_matched_pairs": (matched_pairs, f"""WITH {percentile_sql("SELECT *, substr(candidate_id, 2)::BIGINT % 5 * 2 + 2 AS own FROM v_sized")} SELECT candidate_id, round(cp, 9) AS true_percentile,
        least(5, (SELECT count(*) FROM v_targets WHERE binding_mode = 'pocket') - 1) AS n_decoys FROM pct WHERE target_id = own AND binding_mode = 'pocket' AND evaluable"""),
    "g13_matched_vs_decoy": (matched, f"""WITH {_E3} SELECT (SELECT count(*) FROM df) AS n_pairs, round((SELECT avg(d) FROM df), 6) AS mean_difference, round((SELECT median(d) FROM df), 6) AS median_difference,
        round((SELECT quantile_cont(m, 0.025) FROM mn), 6) AS difference_low, round((SELECT quantile_cont(m, 0.975) FROM mn), 6) AS difference_high, round((SELECT avg((d > 0)::INT) FROM df), 6) AS fraction_positive,
        round(max(auc) FILTER (r = -1), 6) AS auc, round(quantile_cont(auc, 0.025) FILTER (r >= 0), 6) AS auc_low, round(quantile_cont(auc, 0.975) FILTER (r >= 0), 6) AS auc_high,
        round((SELECT avg(1 / r) FROM rr), 6) AS mrr, round((SELECT avg((r = 1)::INT) FROM rr), 6) AS top1_accuracy FROM au"""),
    "c15_shared_candidates": (shared, f"""WITH {_RUNS} SELECT a.run_id AS run_a, b.run_id AS run_b, count(*) AS n, round(sum(abs(a.cp - b.cp)), 6) AS moved FROM runs a JOIN runs b ON a.candidate_id = b.candidate_id
        AND a.run_id < b.run_id WHERE a.cp IS NOT NULL AND b.cp IS NOT NULL GROUP BY 1, 2"""),
    "g14_target_swap": (swap, f"""WITH {_RUNS}, sh AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.cp AS x, b.cp AS y, a.band <> b.band AS ch FROM runs a JOIN runs b ON a.candidate_id = b.candidate_id
        AND a.run_id < b.run_id WHERE a.cp IS NOT NULL AND b.cp IS NOT NULL), {spearman_sql('sh', 'run_a, run_b', 'x', 'y')},
        c AS (SELECT run_a, run_b, count(*) AS n, avg(ch::INT) AS f FROM sh GROUP BY 1, 2) SELECT c.run_a, c.run_b, c.n AS n_shared, round(f, 9) AS band_changed_fraction, round(rho, 6) AS rho
        FROM c JOIN rho ON rho.run_a = c.run_a AND rho.run_b = c.run_b WHERE c.n >= 3"""),
    "g15_tier_independence": (independence, f"""WITH {_RUNS}, ok AS (SELECT * FROM runs WHERE cp IS NOT NULL), {spearman_sql('ok', 'run_id', 'tier1_score', 'cp')}
        SELECT run_id, n, round(rho, 6) AS rho, {_WHY}, round((SELECT max(abs(rho)) FROM rho), 6) AS max_abs_rho FROM rho"""),
    "g17_descriptor_validation": (validation, _validation_sql()),
}

__all__ = ["QUERIES", "FIVE", "mean_sql", "targets"]
