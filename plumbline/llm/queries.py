"""One query per operator: it applies the operator to its whole table and returns the whole result.

QUERIES: name -> (function of the session and the tables' folder, SQL for the same rows or None).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fresh_path
from . import byte_bpe, cover_tree, curriculum, decontaminate, hard_negatives, html_content, importance, jaccard_join, language_id, license_scan, quality, suffix_dedup, token_files
from .columns import table


def op1_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write(token_files.encode_sorted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), path)
    return token_files.catalogue(spark, path).withColumnRenamed("key", "doc_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cover_tree.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return cover_tree.top_k(rows, F.col("id") % 20 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
cut AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM dup),
grouped AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM cut),
span AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM grouped GROUP BY doc_id, g),
bounds AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
kept AS (SELECT x.doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k,
  sum(b - a) AS removed, count(*) AS spans FROM bounds x JOIN d ON d.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[ \t\n\v\f\r]+'), lambda x: x <> '') AS v FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(v) >= 3 THEN list_transform(range(len(v) - 2), lambda i: array_to_string(v[i + 1:i + 3], ' '))
  WHEN len(v) > 0 THEN [array_to_string(v, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(c.component, w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.quantised(rows), F.col("id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("visits.position", 0).alias("first_position"))


#: Demand is integrated segment by segment: schedules (1, 1, 1), (0.25, 1, 1.75) and (1.75, 1, 0.25), in halves of the training time.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	
]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS o FROM documents
), s AS (
  SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY no_source, source_key) - 1 AS n FROM d GROUP BY no_source, source_key
), w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, n % 3 AS schedule FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT *, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.schedule, CAST(floor(t.target + 0.5::DOUBLE) AS BIGINT) AS lim,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.no_source, d.source_key ORDER BY d.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM d JOIN t ON d.no_source = t.no_source AND d.source_key = t.source_key
), q AS (
  SELECT *, greatest(least(lim - a, size), 0) AS once, greatest(least(lim - source_size - a, size), 0) AS again, 2.0::DOUBLE * (a / target) AS c FROM p
), r AS (
  SELECT *, CASE schedule WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN c < 0.625 THEN 0.25 ELSE 1.0 END ELSE CASE WHEN c < 1.375 THEN 1.75 ELSE 1.0 END END::DOUBLE AS lo,
    CASE schedule WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN c < 0.625 THEN 1.0 ELSE 1.75 END ELSE CASE WHEN c < 1.375 THEN 1.0 ELSE 0.25 END END::DOUBLE AS hi,
    CASE schedule WHEN 0 THEN 1.0 WHEN 1 THEN 0.625 ELSE 1.375 END::DOUBLE AS half FROM q
), u AS (SELECT *, c - CASE WHEN c < half THEN 0.0::DOUBLE ELSE half END AS rest FROM r)
SELECT doc_id, size, source_size, target, CAST(once + again AS BIGINT) AS taken,
  CASE WHEN once > 0 THEN ((CASE WHEN c < half THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) + 2.0::DOUBLE * rest / (lo + sqrt(greatest(lo * lo + 2.0::DOUBLE * (hi - lo) * rest, 0.0::DOUBLE)))) / 2.0::DOUBLE END AS first_position
FROM u
"""


QUERIES = {
    "op1_html_content": (op1_html_content, None),
    "op2_byte_bpe": (op2_byte_bpe, None),
    "op3_token_files": (op3_token_files, None),
    "op4_decontaminate": (op4_decontaminate, None),
    "op5_top_k": (op5_top_k, OP5_SQL),
    "op6_quality": (op6_quality, None),
    "op7_suffix_dedup": (op7_suffix_dedup, OP7_SQL),
    "op8_license_scan": (op8_license_scan, None),
    "op9_jaccard_join": (op9_jaccard_join, OP9_SQL),
    "op10_language_id": (op10_language_id, None),
    "op11_importance_resampling": (op11_importance_resampling, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_source_mixing": (op13_source_mixing, OP13_SQL),
}


def queries() -> dict:
    return {name: fn for name, (fn, _sql) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_fn, sql) in QUERIES.items() if sql}
