"""Sequence expressions, validation, deduplication, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, policy
from ..functions import sequences as Q
from ..operators import intake, joins
from ..plans.ingest import ingest_candidates
from .views import table, view


def raw(spark, sf):
    return view(spark, sf, "v_raw").withColumnRenamed("raw_sequence", "sequence")


def checked(spark, sf):
    return intake.validated(raw(spark, sf))


def normalise(spark, sf):
    return raw(spark, sf).select("row", Q.normalise_sequence("sequence").alias("clean"))


def reason(spark, sf):
    return checked(spark, sf).select("row", "reason")


def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.truncate_preview("text").alias("preview"))


def gc(spark, sf):
    return view(spark, sf, "v_seq").select(
        "candidate_id", F.length("sequence").alias("length"), F.round(Q.gc_fraction("sequence"), 9).alias("gc"))


def kmers(spark, sf):
    return intake.kmer_counts(view(spark, sf, "v_seq"), "candidate_id")


def fold_scalars(spark, sf):
    df = view(spark, sf, "v_fold").withColumn("entropy", F.transform(
        F.sequence(F.lit(1), F.length("dot_bracket")),
        lambda i: ((i * F.col("doc_id")) % 7).cast("double") / 7))
    return df.select("candidate_id", F.round(Q.mfe_norm("mfe", F.length("dot_bracket")), 9).alias("mfe_norm"),
                     F.round(Q.array_mean("entropy"), 9).alias("entropy_mean"))


def valid_structure(spark, sf):
    df = view(spark, sf, "v_fold")
    broken = (F.when(F.col("doc_id") % 4 == 1, F.concat("dot_bracket", F.lit(")")))
              .when(F.col("doc_id") % 4 == 2, F.concat(F.lit(")"), "dot_bracket", F.lit("(")))
              .when(F.col("doc_id") % 4 == 3, F.concat("dot_bracket", F.lit("x")))
              .otherwise(F.col("dot_bracket")))
    return df.withColumn("s", broken).select("candidate_id", Q.structure_is_valid("s").alias("valid"))


def seeds(spark, sf):
    return view(spark, sf, "v_seq").select(
        "candidate_id", identity.derive_seed(42, F.col("candidate_id"), F.col("sequence"), "shuffle").alias("seed"))


def target_keys(spark, sf):
    df = table(spark, sf, "supplier").select(
        "s_suppkey", identity.clean_key(F.concat(F.lit(" "), "s_name", F.lit(" (v."),
                                                 F.col("s_nationkey").cast("string"), F.lit(") "))).alias("key"))
    return df


def finite(spark, sf):
    df = view(spark, sf, "v_sized").select(
        "candidate_id",
        F.when(F.col("loop_nt_median") == 0, float("nan")).when(F.col("loop_nt_median") == 1, float("inf"))
        .otherwise(F.col("loop_nt_median")).alias("x"),
        F.array(F.col("length"), F.when(F.col("length") > 60, float("-inf")).otherwise(F.lit(1.0))).alias("arr"))
    out = policy.null_non_finite(df)
    return out.select("candidate_id", "x", F.get("arr", 0).alias("a0"), F.get("arr", 1).alias("a1"))


def dedupe(spark, sf):
    out = intake.dedupe_candidates(checked(spark, sf))
    return out.select("sequence", "length", "duplicate_count", "first_row")


def ids(spark, sf):
    out = intake.assign_ids(intake.dedupe_candidates(checked(spark, sf)))
    return out.select("candidate_id", "sequence", "first_row")


def ids_supplied(spark, sf):
    df = view(spark, sf, "v_seq").select(F.col("doc_id").alias("row"), "sequence",
                                         F.col("candidate_id").alias("supplied_id"))
    out = intake.assign_ids(intake.dedupe_candidates(intake.validated(df)))
    return out.select("candidate_id", "sequence")


def summary(spark, sf):
    c = checked(spark, sf)
    return intake.ingest_summary(c, intake.dedupe_candidates(c))


def reasons(spark, sf):
    return intake.dropped_reasons(checked(spark, sf))


def ingest(spark, sf):
    cands, rejected, _summary = ingest_candidates(raw(spark, sf))
    a = cands.select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), "sequence",
                     F.col("duplicate_count").alias("n"), F.lit(None).cast("string").alias("reason"))
    b = rejected.select(F.lit("rejection").alias("kind"), "id", "sequence", F.col("row").alias("n"), "reason")
    return a.unionByName(b)


def reference_features(spark, sf):
    """C1/C3: keep every feature row, attach what is known about it."""
    feats = view(spark, sf, "v_features").select("candidate_id", "sequence", F.round("gc_fraction", 9).alias("gc"))
    dup = intake.dedupe_candidates(checked(spark, sf)).select("sequence", "duplicate_count")
    return joins.with_duplicates(feats, dup).select("candidate_id", "gc", "duplicate_count")


def corpus_metadata(spark, sf):
    feats = view(spark, sf, "v_features").select("candidate_id", F.round("stem_fraction", 9).alias("stem_fraction"))
    meta = view(spark, sf, "v_reference").select("candidate_id", "target_name", "target_pdb_id")
    return joins.with_metadata(feats, meta, ["target_name", "target_pdb_id"])


# The checking engine keeps one capital letter for the German sharp s; upper-casing gives two.
CLEAN = "replace(upper(regexp_replace(replace(raw_sequence, 'ß', 'ss'), '\\s+', '', 'g')), 'T', 'U')"
CHECKED = f"""c0 AS (SELECT row, supplied_id, raw_sequence, {CLEAN} AS clean FROM v_raw),
checked AS (SELECT *, CASE WHEN clean = '' THEN 'empty sequence'
  WHEN len(strange) > 0 THEN 'invalid character' || CASE WHEN len(strange) > 1 THEN 's' ELSE '' END || ' ' ||
    array_to_string([('''' || x || '''') FOR x IN strange[1:4]], ', ')
  WHEN length(clean) < 20 THEN 'length ' || length(clean) || ' below minimum 20'
  WHEN length(clean) > 100 THEN 'length ' || length(clean) || ' above maximum 100' END AS reason
  FROM (SELECT *, list_sort(list_distinct([x FOR x IN string_split(clean, '') IF x NOT IN ('A','C','G','U')])) AS strange FROM c0))"""
DEDUPED = CHECKED + """, deduped AS (SELECT clean AS sequence, length(clean)::INTEGER AS length, count(*) AS duplicate_count,
  min(row) AS first_row, arg_min(coalesce(supplied_id, '\x01'), row) AS supplied0
  FROM checked WHERE reason IS NULL GROUP BY clean)"""
PREVIEW = ("CASE WHEN length(trim(raw_sequence, chr(9)||chr(10)||chr(13)||' ')) <= 60 THEN trim(raw_sequence, chr(9)||chr(10)||chr(13)||' ') "
           "ELSE substr(trim(raw_sequence, chr(9)||chr(10)||chr(13)||' '), 1, 59) || '…' END")

QUERIES = {
    "b1_normalise_sequence": (normalise, f"SELECT row, {CLEAN} AS clean FROM v_raw"),
    "b2_rejection_reason": (reason, f"WITH {CHECKED} SELECT row, reason FROM checked"),
    "b3_truncate_preview": (preview, "SELECT doc_id, " + PREVIEW.replace("raw_sequence", "text")
                            + " AS preview FROM documents"),
    "b4_gc_fraction": (gc, """SELECT candidate_id, length(sequence)::INTEGER AS length,
        round(len(regexp_extract_all(sequence, '[GC]'))::DOUBLE / length(sequence), 9) AS gc FROM v_seq"""),
    "b5_kmer_counts": (kmers, """SELECT candidate_id, kmer, count(*) AS n FROM (SELECT candidate_id,
        unnest([substr(sequence, i, 2) FOR i IN range(1, length(sequence))]) AS kmer FROM v_seq) GROUP BY 1, 2"""),
    "b6_fold_scalars": (fold_scalars, """SELECT candidate_id, round(mfe / length(dot_bracket), 9) AS mfe_norm,
        round(list_avg([((i * doc_id) % 7)::DOUBLE / 7 FOR i IN range(1, length(dot_bracket) + 1)]), 9) AS entropy_mean FROM v_fold"""),
    "b7_structure_is_valid": (valid_structure, """WITH s AS (SELECT candidate_id, CASE doc_id % 4 WHEN 1 THEN dot_bracket || ')'
          WHEN 2 THEN ')' || dot_bracket || '(' WHEN 3 THEN dot_bracket || 'x' ELSE dot_bracket END AS s FROM v_fold),
        e AS (SELECT candidate_id, i, substr(s, i, 1) AS c FROM (SELECT candidate_id, s, unnest(range(1, length(s) + 1)) AS i FROM s)),
        d AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY i) AS depth FROM e)
        SELECT candidate_id, min(depth) >= 0 AND arg_max(depth, i) = 0 AND bool_and(c IN ('(', ')', '.')) AS valid
        FROM d GROUP BY candidate_id"""),
    "b23_derive_seed": (seeds, """SELECT candidate_id,
        ('0x' || substr(sha256('42|' || candidate_id || '|' || sequence || '|shuffle'), 1, 8))::BIGINT AS seed FROM v_seq"""),
    "b24_canonical_target_key": (target_keys, """SELECT s_suppkey, trim(regexp_replace(upper(' ' || s_name || ' (v.' || s_nationkey || ') '),
        '[^A-Z0-9]+', '-', 'g'), '-') AS key FROM supplier"""),
    "b27_null_non_finite": (finite, """SELECT candidate_id, CASE WHEN loop_nt_median >= 2 THEN loop_nt_median END AS x,
        length AS a0, CASE WHEN length <= 60 THEN 1.0::DOUBLE END AS a1 FROM v_sized"""),
    "c1_features_with_duplicates": (reference_features, f"""WITH {DEDUPED} SELECT f.candidate_id, round(f.gc_fraction, 9) AS gc, d.duplicate_count
        FROM v_features f LEFT JOIN deduped d ON d.sequence = f.sequence"""),
    "c3_corpus_metadata": (corpus_metadata, """SELECT f.candidate_id, round(f.stem_fraction, 9) AS stem_fraction, r.target_name, r.target_pdb_id
        FROM v_features f LEFT JOIN v_reference r ON r.candidate_id = f.candidate_id"""),
    "d3_dedupe_candidates": (dedupe, f"WITH {DEDUPED} SELECT sequence, length, duplicate_count, first_row FROM deduped"),
    "d4_ingest_summary": (summary, f"""WITH {DEDUPED} SELECT (SELECT count(*) FROM checked) AS n_submitted,
        (SELECT count(*) FROM checked WHERE reason IS NOT NULL) AS n_rejected, count(*) AS n_valid,
        count(*) FILTER (duplicate_count = 1) AS n_unique, min(length) AS min_length, max(length) AS max_length FROM deduped"""),
    "d5_dropped_reasons": (reasons, f"""WITH {CHECKED} SELECT CASE WHEN reason LIKE 'length %' THEN 'length out of range' ELSE reason END AS reason,
        count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY 1"""),
    "e4_assign_ids": (ids, f"""WITH {DEDUPED} SELECT 'c' || lpad((row_number() OVER (ORDER BY first_row))::VARCHAR, 5, '0') AS candidate_id,
        sequence, first_row FROM deduped"""),
    "e4_assign_ids_supplied": (ids_supplied, "SELECT arg_min(candidate_id, doc_id) AS candidate_id, sequence FROM v_seq GROUP BY sequence"),
    "g1_ingest_candidates": (ingest, f"""WITH {DEDUPED} SELECT 'candidate' AS kind,
        'c' || lpad((row_number() OVER (ORDER BY first_row))::VARCHAR, 5, '0') AS id, sequence, duplicate_count AS n, NULL::VARCHAR AS reason FROM deduped
        UNION ALL SELECT 'rejection', supplied_id, {PREVIEW}, row, reason FROM checked WHERE reason IS NOT NULL"""),
}
