"""Bracket matching, elements, sizes and ensemble statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import structure
from .views import view


def folds(spark, sf):
    return view(spark, sf, "v_fold").select("candidate_id", "dot_bracket")


def pairs(spark, sf):
    return structure.match_brackets(folds(spark, sf))


def stems(spark, sf):
    return structure.stems(structure.match_brackets(folds(spark, sf))).select(
        "candidate_id", "i1", "j1", "i2", "j2", "bp")


def loops(spark, sf):
    return structure.loops(folds(spark, sf)).groupBy("candidate_id", "kind", "size").agg(
        F.count(F.lit(1)).alias("n"))


def letters(spark, sf):
    return structure.element_string(structure.elements(folds(spark, sf)))


def statistics(spark, sf):
    out = structure.loop_statistics(structure.elements(folds(spark, sf)))
    return out.select("candidate_id", "n_hairpins", "n_interior", "n_multiloop", "n_stems",
                      F.round("stem_fraction", 9).alias("stem_fraction"), "longest_stem_bp", "max_loop_nt",
                      "total_unpaired", F.array_join(F.transform("loop_sizes", lambda x: x.cast("string")), ",").alias("loop_sizes"))


def gyration(spark, sf):
    out = structure.structure_features(folds(spark, sf))
    return out.select("candidate_id", F.round("radius_of_gyration_A", 6).alias("rg"))


def coil(spark, sf):
    return view(spark, sf, "v_seq").select(
        "candidate_id", F.round(G.free_coil_rg(F.length("sequence")), 9).alias("coil_rg"),
        F.round(G.element_extent(F.lit("s"), F.lit(0), F.lit(0), F.length("sequence")), 9).alias("rod"),
        F.round(G.element_rg(F.lit("s"), F.lit(0), F.length("sequence")), 9).alias("rod_rg"),
        F.round(G.element_extent(F.lit("h"), F.length("sequence"), F.length("sequence"), F.lit(None)), 9).alias("loop"))


def ensemble(spark, sf):
    # Every 50th candidate has no samples and must fall back to its own structure.
    f = view(spark, sf, "v_fold")
    samples = view(spark, sf, "v_samples").join(
        f.filter(F.col("doc_id") % 50 != 0).select("candidate_id"), "candidate_id", "left_semi")
    out = structure.ensemble_stats(f.select("candidate_id", "dot_bracket"), samples)
    return out.select("candidate_id", *[F.round(c, 6).alias(c) for c in (
        "loop_nt_median", "loop_nt_p90", "loop_nt_iqr", "rg_median_A", "rg_iqr_A")], "n_ensemble_samples")


def graph_sql(source: str) -> str:
    """Elements of every (id, dot_bracket) row of ``source``, by pairwise comparison."""
    return f"""src AS ({source}),
pos AS (SELECT id, n, i, c, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS d
  FROM (SELECT id, n, i, substr(dot_bracket, i, 1) AS c FROM (SELECT id, dot_bracket, length(dot_bracket) AS n,
    unnest(range(1, length(dot_bracket) + 1)) AS i FROM src))),
pr AS (SELECT a.id, a.n, a.i, a.d, min(b.i) AS j FROM pos a JOIN pos b ON a.id = b.id AND b.i > a.i AND b.c = ')' AND b.d = a.d - 1
  WHERE a.c = '(' GROUP BY ALL),
st AS (SELECT *, min(i) OVER (PARTITION BY id, i + j, g) AS stem FROM (SELECT *, i - row_number() OVER (PARTITION BY id, i + j ORDER BY i) AS g FROM pr)),
par AS (SELECT c.id, c.n, c.i, c.j, c.stem, coalesce(max(p.i), 0) AS pi FROM st c LEFT JOIN st p ON p.id = c.id AND p.i < c.i AND p.j > c.j GROUP BY ALL),
enc AS (SELECT id, i AS pi, j AS pj, stem FROM st UNION ALL SELECT DISTINCT id, 0, n + 1, 0 FROM st),
kid AS (SELECT par.*, enc.pj, enc.stem AS pstem, lag(par.j) OVER w AS lj, lag(par.stem) OVER w AS ls, lead(par.i) OVER w AS ni,
  count(*) OVER (PARTITION BY par.id, par.pi) AS nk FROM par JOIN enc ON enc.id = par.id AND enc.pi = par.pi WINDOW w AS (PARTITION BY par.id, par.pi ORDER BY par.i)),
el AS (
  SELECT id, 's' AS kind, count(*) AS bp, 2 * count(*) AS size, NULL::BIGINT AS l, NULL::BIGINT AS r, stem, 0::BIGINT AS reach FROM st GROUP BY id, stem
  UNION ALL SELECT s.id, 'h', NULL, s.j - s.i - 1, s.stem, NULL, NULL, s.j - s.i - 1 FROM st s WHERE NOT EXISTS (SELECT 1 FROM st t WHERE t.id = s.id AND t.i > s.i AND t.j < s.j)
  UNION ALL SELECT id, 'i', NULL, (i - pi - 1) + (pj - j - 1), pstem, stem, NULL,
    CASE WHEN i - pi - 1 > 0 AND pj - j - 1 > 0 THEN least(i - pi - 1, pj - j - 1) ELSE (i - pi - 1) + (pj - j - 1) END FROM kid WHERE pi > 0 AND nk = 1 AND stem <> pstem
  UNION ALL SELECT id, 'm', NULL, i - coalesce(lj, pi) - 1, coalesce(ls, pstem), stem, NULL, i - coalesce(lj, pi) - 1 FROM kid WHERE pi > 0 AND nk > 1
  UNION ALL SELECT id, 'm', NULL, pj - j - 1, stem, pstem, NULL, pj - j - 1 FROM kid WHERE pi > 0 AND nk > 1 AND ni IS NULL
  UNION ALL SELECT id, 'f', NULL, i - 1, NULL, stem, NULL, i - 1 FROM kid WHERE pi = 0 AND lj IS NULL AND i > 1
  UNION ALL SELECT id, 'm', NULL, i - lj - 1, ls, stem, NULL, i - lj - 1 FROM kid WHERE pi = 0 AND lj IS NOT NULL
  UNION ALL SELECT id, 't', NULL, n - j, stem, NULL, NULL, n - j FROM kid WHERE pi = 0 AND ni IS NULL AND j < n
  UNION ALL SELECT id, 'f', NULL, length(dot_bracket), NULL, NULL, NULL, length(dot_bracket) FROM src WHERE dot_bracket NOT LIKE '%(%')"""


def rg_sql(source: str) -> str:
    """``rg(id, rg)`` by walking the element graph; needs WITH RECURSIVE."""
    return graph_sql(source) + """,
nd AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY kind, stem, l, r, size) AS x, stem, l, r, size::DOUBLE AS m,
  CASE kind WHEN 's' THEN 2.8::DOUBLE * bp ELSE 6.0::DOUBLE * sqrt(reach) END AS ext,
  CASE kind WHEN 's' THEN 2.8::DOUBLE * bp / sqrt(12) ELSE 6.0::DOUBLE * sqrt(size / 6) END AS rg FROM el),
lk0 AS (SELECT a.id, a.x AS a, b.x AS b FROM nd a JOIN nd b ON a.id = b.id AND b.stem IS NOT NULL AND (a.l = b.stem OR a.r = b.stem)),
lk AS (SELECT id, a, b FROM lk0 UNION SELECT id, b, a FROM lk0),
hop AS (SELECT id, x AS a, x AS b, 0 AS h FROM nd UNION SELECT hop.id, hop.a, lk.b, hop.h + 1 FROM hop JOIN lk ON lk.id = hop.id AND lk.a = hop.b
  WHERE hop.h < (SELECT max(x) FROM nd)),
mh AS (SELECT id, a, b, min(h) AS h FROM hop GROUP BY ALL),
walk AS (SELECT id, x AS a, x AS b, 0 AS h, 0.0::DOUBLE AS d FROM nd UNION SELECT w.id, w.a, lk.b, w.h + 1, w.d + n1.ext / 2 + n2.ext / 2
  FROM walk w JOIN lk ON lk.id = w.id AND lk.a = w.b JOIN mh ON mh.id = w.id AND mh.a = w.a AND mh.b = lk.b AND mh.h = w.h + 1
  JOIN nd n1 ON n1.id = w.id AND n1.x = w.b JOIN nd n2 ON n2.id = w.id AND n2.x = lk.b),
ds AS (SELECT id, a, b, min(d) AS d FROM walk GROUP BY ALL),
tot AS (SELECT id, sum(m) AS mm, sum(m * rg * rg) AS own FROM nd GROUP BY id),
sp AS (SELECT ds.id, sum(n1.m * n2.m * ds.d * ds.d) AS s FROM ds JOIN nd n1 ON n1.id = ds.id AND n1.x = ds.a JOIN nd n2 ON n2.id = ds.id AND n2.x = ds.b GROUP BY ds.id),
rg AS (SELECT tot.id, CASE WHEN mm > 0 THEN sqrt(s / (2 * mm * mm) + own / mm) ELSE 0 END AS rg FROM tot JOIN sp ON sp.id = tot.id)"""


_SRC = "SELECT candidate_id AS id, dot_bracket FROM v_fold"
_DISTINCT = "SELECT DISTINCT dot_bracket AS id, dot_bracket FROM v_fold"

QUERIES = {
    "e5_match_brackets": (pairs, f"WITH {graph_sql(_SRC)} SELECT id AS candidate_id, i::INTEGER AS i, j::INTEGER AS j, d::INTEGER AS depth FROM pr"),
    "e6_stems": (stems, f"""WITH {graph_sql(_SRC)} SELECT id AS candidate_id, min(i)::INTEGER AS i1, max(j)::INTEGER AS j1, max(i)::INTEGER AS i2,
        min(j)::INTEGER AS j2, count(*)::INTEGER AS bp FROM st GROUP BY id, stem"""),
    "e7_loops": (loops, f"WITH {graph_sql(_SRC)} SELECT id AS candidate_id, kind, size::INTEGER AS size, count(*) AS n FROM el WHERE kind <> 's' GROUP BY ALL"),
    "e7_element_string": (letters, f"""WITH {graph_sql(_SRC)}, u AS (SELECT pos.id, pos.i, pos.c, coalesce(max(pr.i), 0) AS pi FROM pos LEFT JOIN pr
          ON pr.id = pos.id AND pr.i < pos.i AND pr.j > pos.i GROUP BY ALL),
        k AS (SELECT id, pi, max(nk) AS nk, min(i) AS f, max(j) AS t FROM kid GROUP BY ALL)
        SELECT u.id AS candidate_id, string_agg(CASE WHEN u.c <> '.' THEN 's' WHEN u.pi = 0 AND k.nk IS NULL THEN 'f' WHEN u.pi = 0 AND u.i < k.f THEN 'f'
          WHEN u.pi = 0 AND u.i > k.t THEN 't' WHEN u.pi = 0 THEN 'm' WHEN k.nk IS NULL THEN 'h' WHEN k.nk = 1 THEN 'i' ELSE 'm' END, '' ORDER BY u.i) AS element_string
        FROM u LEFT JOIN k ON k.id = u.id AND k.pi = u.pi GROUP BY u.id"""),
    "d30_loop_statistics": (statistics, f"""WITH {graph_sql(_SRC)}, s AS (SELECT id, count(*) FILTER (kind = 'h') AS n_hairpins, count(*) FILTER (kind = 'i') AS n_interior,
          count(*) FILTER (kind = 'm') AS n_multiloop, count(*) FILTER (kind = 's') AS n_stems, coalesce(sum(size) FILTER (kind = 's'), 0) AS nt,
          coalesce(max(bp), 0)::INTEGER AS longest_stem_bp, max(size) FILTER (kind IN ('h', 'i', 'm')) AS ml,
          string_agg(size::BIGINT::VARCHAR, ',' ORDER BY size) FILTER (kind IN ('h', 'i', 'm')) AS sizes FROM el GROUP BY id)
        SELECT s.id AS candidate_id, n_hairpins, n_interior, n_multiloop, n_stems, round(nt / length(dot_bracket), 9) AS stem_fraction, longest_stem_bp,
          coalesce(ml, length(replace(replace(dot_bracket, '(', ''), ')', '')))::INTEGER AS max_loop_nt,
          length(replace(replace(dot_bracket, '(', ''), ')', ''))::INTEGER AS total_unpaired, coalesce(sizes, length(dot_bracket)::VARCHAR) AS loop_sizes
        FROM s JOIN src ON src.id = s.id"""),
    "d31_radius_of_gyration": (gyration, f"WITH RECURSIVE {rg_sql(_DISTINCT)} SELECT candidate_id, round(rg.rg, 6) AS rg FROM v_fold JOIN rg ON rg.id = dot_bracket"),
    "b21_free_coil_rg": (coil, """SELECT candidate_id, round(6 * sqrt(length(sequence) / 6), 9) AS coil_rg, round(2.8::DOUBLE * length(sequence), 9) AS rod,
        round(2.8::DOUBLE * length(sequence) / sqrt(12), 9) AS rod_rg, round(6 * sqrt(length(sequence)), 9) AS loop FROM v_seq"""),
    "d6_ensemble_stats": (ensemble, f"""WITH RECURSIVE {rg_sql(_DISTINCT)}, ml AS (SELECT id, coalesce(max(size) FILTER (kind IN ('h', 'i', 'm')),
          max(size) FILTER (kind = 'f')) AS ml FROM el GROUP BY id),
        one AS (SELECT f.candidate_id, ml.ml::DOUBLE AS l, rg.rg AS r, f.doc_id FROM v_fold f JOIN ml ON ml.id = f.dot_bracket JOIN rg ON rg.id = f.dot_bracket),
        q AS (SELECT s.candidate_id, quantile_cont(ml.ml::DOUBLE, [0.25, 0.5, 0.75, 0.9]) AS lq, quantile_cont(rg.rg, [0.25, 0.5, 0.75]) AS rq, count(*) AS n
          FROM v_samples s JOIN ml ON ml.id = s.dot_bracket JOIN rg ON rg.id = s.dot_bracket GROUP BY s.candidate_id)
        SELECT one.candidate_id, round(coalesce(lq[2], l), 6) AS loop_nt_median, round(coalesce(lq[4], l), 6) AS loop_nt_p90,
          round(coalesce(lq[3] - lq[1], 0), 6)::DOUBLE AS loop_nt_iqr, round(coalesce(rq[2], r), 6) AS rg_median_A,
          round(coalesce(rq[3] - rq[1], 0), 6)::DOUBLE AS rg_iqr_A, coalesce(n, 0) AS n_ensemble_samples
        FROM one LEFT JOIN q ON q.candidate_id = one.candidate_id AND one.doc_id % 50 <> 0"""),
}
