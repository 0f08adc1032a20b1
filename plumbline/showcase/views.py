"""Derived views over the sample tables, the same text for both engines.

A table name in braces is replaced by the engine's way to name it. Array access is
the only spelling that differs between engines: ``[[embedding:3]]``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_seq": """
SELECT doc_id, concat('c', CAST(doc_id AS STRING)) AS candidate_id,
  translate(substr(concat(md5(concat('s', CAST(doc_id AS STRING))), md5(concat('t', CAST(doc_id AS STRING))),
                          md5(concat('u', CAST(doc_id AS STRING))), md5(concat('v', CAST(doc_id AS STRING)))), 1, CAST(20 + doc_id % 81 AS INT)),
            '0123456789abcdef', 'ACGUACGUACGUACGU') AS sequence, lang, source
FROM {documents}""",
    "v_raw": """
SELECT s.doc_id AS row, CASE WHEN s.doc_id % 4 = 3 THEN NULL ELSE s.candidate_id END AS supplied_id,
  CASE s.doc_id % 10
    WHEN 0 THEN d.text WHEN 1 THEN substr(s.sequence, 1, 10)
    WHEN 2 THEN lower(translate(s.sequence, 'U', 'T'))
    WHEN 3 THEN concat(' ', substr(s.sequence, 1, 10), ' ', substr(s.sequence, 11))
    WHEN 4 THEN '' WHEN 5 THEN concat(s.sequence, s.sequence)
    WHEN 6 THEN repeat('ACGU', CAST(5 + s.doc_id % 3 AS INT)) ELSE s.sequence END AS raw_sequence
FROM v_seq s JOIN {documents} d ON d.doc_id = s.doc_id""",
    "v_fold": """
SELECT doc_id, candidate_id, sequence,
  CASE WHEN doc_id % 17 = 0 THEN repeat('.', 40)
       WHEN doc_id % 5 = 0 THEN concat('(((', hp1, '..', hp2, ')))')
       WHEN doc_id % 3 = 0 THEN concat(hp1, '..', hp2)
       ELSE concat(repeat('.', CAST(doc_id % 4 AS INT)), hp1, repeat('.', CAST(doc_id % 6 AS INT))) END AS dot_bracket,
  -CAST((doc_id * 31) % 4000 AS DOUBLE) / 100 AS mfe,
  CAST((doc_id * 37) % 1000 AS DOUBLE) / 1000 AS ensemble_defect,
  CAST((doc_id * 53) % 800 AS DOUBLE) / 1000 AS positional_entropy_mean
FROM (SELECT doc_id, candidate_id, sequence,
  concat(repeat('(', CAST(3 + doc_id % 8 AS INT)), repeat('.', CAST(doc_id % 4 AS INT)), repeat('(', CAST(2 + doc_id % 5 AS INT)),
         repeat('.', CAST(3 + doc_id % 9 AS INT)), repeat(')', CAST(2 + doc_id % 5 AS INT)), repeat('.', CAST(doc_id % 3 AS INT)),
         repeat(')', CAST(3 + doc_id % 8 AS INT))) AS hp1,
  concat(repeat('(', CAST(2 + doc_id % 6 AS INT)), repeat('.', CAST(4 + doc_id % 7 AS INT)), repeat(')', CAST(2 + doc_id % 6 AS INT))) AS hp2
  FROM v_seq) q""",
    # v_fold with the derived features the five default criteria need.
    "v_features": """
SELECT doc_id, candidate_id, sequence, dot_bracket, length(dot_bracket) AS length,
  mfe / length(dot_bracket) AS mfe_norm, ensemble_defect, positional_entropy_mean,
  CAST(length(dot_bracket) - length(replace(dot_bracket, '(', '')) AS DOUBLE) * 2 / length(dot_bracket) AS stem_fraction,
  CAST(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')) AS DOUBLE) / length(sequence) AS gc_fraction
FROM v_fold""",
    "v_reference": """
SELECT f.*, s.source AS target_name, s.lang AS target_pdb_id FROM v_features f JOIN v_seq s ON s.doc_id = f.doc_id
JOIN {labels} l ON l.doc_id = f.doc_id WHERE l.quality = 1""",
    "v_controls": """
SELECT f.candidate_id, n.p_partkey AS shuffle_index,
  concat(substr(f.sequence, CAST(1 + n.p_partkey % 5 AS INT)), substr(f.sequence, 1, CAST(n.p_partkey % 5 AS INT))) AS sequence,
  -CAST((f.doc_id * 31 + n.p_partkey * 997) % 4000 AS DOUBLE) / 100 / length(f.dot_bracket) AS mfe_norm,
  CAST((f.doc_id * 37 + n.p_partkey * 211) % 1000 AS DOUBLE) / 1000 AS ensemble_defect,
  CAST((f.doc_id * 53 + n.p_partkey * 89) % 800 AS DOUBLE) / 1000 AS positional_entropy_mean,
  CAST((f.doc_id * 7 + n.p_partkey * 3) % 40 AS DOUBLE) / 40 AS stem_fraction
FROM v_fold f CROSS JOIN (SELECT p_partkey FROM {part} WHERE p_partkey BETWEEN 1 AND 20) n""",
    "v_samples": """
SELECT a.candidate_id, n.p_partkey AS sample_index, b.dot_bracket
FROM v_fold a CROSS JOIN (SELECT p_partkey FROM {part} WHERE p_partkey BETWEEN 1 AND 9) n
JOIN v_fold b ON b.doc_id = (a.doc_id * 7 + n.p_partkey * 13) % (SELECT count(*) FROM {documents})""",
    "v_bank": """
SELECT concat('bank', CAST(p_partkey AS STRING)) AS control_id, CAST(p_partkey % 26 AS DOUBLE) AS loop_nt_median,
  CAST(20 + p_partkey % 81 AS DOUBLE) AS length, 8 + CAST(p_partkey % 320 AS DOUBLE) / 10 AS rg_median_A FROM {part}""",
    "v_targets": """
SELECT s_suppkey AS target_id, CASE WHEN s_suppkey % 2 = 0 THEN 'pocket' ELSE 'surface' END AS binding_mode,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST(8 + s_suppkey % 30 AS DOUBLE) END AS d_pocket_A,
  CASE WHEN s_suppkey % 2 = 1 THEN CAST(600 + (s_suppkey * 97) % 3000 AS DOUBLE) END AS patch_area_A2,
  CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 21 - 10 AS DOUBLE) END AS mean_potential FROM {supplier}""",
    # Candidates with the three descriptors a target comparison may read.
    "v_sized": """
SELECT candidate_id, CAST(doc_id % 27 AS DOUBLE) AS loop_nt_median, CAST(20 + doc_id % 81 AS DOUBLE) AS length,
  8 + CAST((doc_id * 13) % 330 AS DOUBLE) / 10 AS rg_median_A,
  CAST((doc_id * 7919) % 1009 AS DOUBLE) / 1009 AS tier1_score, lang, source FROM v_seq""",
    "v_progress": """
SELECT user_id AS job_id, event_id AS seq, ts AS created_utc,
  CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'click' THEN 'stage_started' WHEN 'view' THEN 'advance'
       WHEN 'purchase' THEN 'run_completed' ELSE 'run_failed' END AS event,
  concat('stage', CAST(event_id % 4 AS STRING)) AS stage, CAST(floor(value) AS INT) AS completed, 500 AS total FROM {events}""",
    "v_line": """
SELECT l_orderkey * 10 + l_linenumber AS candidate_id, l_quantity AS c_lower, l_extendedprice AS c_higher,
  l_discount AS c_mid1, l_tax AS c_mid2, l_returnflag = 'R' AS is_reference FROM {lineitem}""",
    "v_spheres": """
SELECT label AS pocket_id, vec_id, CAST([[embedding:1]] AS DOUBLE)*10 AS x, CAST([[embedding:2]] AS DOUBLE)*6 AS y,
  CAST([[embedding:3]] AS DOUBLE)*3 AS z, 1 + abs(CAST([[embedding:4]] AS DOUBLE)) AS radius FROM {embeddings}""",
    "v_atoms": """
SELECT vec_id AS atom_id, CASE WHEN vec_id % 3 = 0 THEN 'C' ELSE 'B' END AS chain, CAST(floor(vec_id/5) AS INT) AS residue_number,
  CAST([[embedding:5]] AS DOUBLE)*60 AS x, CAST([[embedding:6]] AS DOUBLE)*60 AS y, CAST([[embedding:7]] AS DOUBLE)*60 AS z,
  CAST(vec_id*17 % 50 AS DOUBLE) AS sasa FROM {embeddings}""",
    # The same atoms as lines of three structure files, with residue names and flags.
    "v_pdb": """
SELECT concat('S', CAST(residue_number % 3 AS STRING)) AS structure_id, chain, residue_number,
  CASE WHEN residue_number % 19 = 0 THEN 'A' ELSE '' END AS icode,
  CASE residue_number % 7 WHEN 0 THEN 'HOH' WHEN 1 THEN 'ZN' WHEN 2 THEN 'SO4' WHEN 3 THEN 'MSE' WHEN 4 THEN 'GLY'
    WHEN 5 THEN 'ALA' ELSE 'LYS' END AS resname, residue_number % 7 < 4 AS hetero,
  CASE atom_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE ' ' END AS altloc, atom_id AS line_no, x, y, z, sasa FROM v_atoms""",
    "v_pockets": """
SELECT CAST(pocket_id % 3 AS BIGINT) AS target_id, pocket_id AS pocket_index, CAST((pocket_id * 37) % 11 AS DOUBLE) / 10 AS score,
  CASE WHEN pocket_id % 4 <> 0 THEN CAST((pocket_id * 13) % 10 AS DOUBLE) / 10 END AS druggability,
  200 + 50 * CAST(pocket_id AS DOUBLE) AS volume_A3, count(*) + CASE WHEN pocket_id = 4 THEN 1 ELSE 0 END AS n_reported
FROM v_spheres GROUP BY pocket_id""",
    "v_lining": """
SELECT CAST((residue_number * 7) % 10 % 3 AS BIGINT) AS target_id, CAST((residue_number * 7) % 10 AS INT) AS pocket_index,
  chain, residue_number, '' AS icode FROM v_atoms WHERE chain = 'B' AND residue_number % 10 <> 9""",
    "v_site": """
SELECT DISTINCT target_id, chain, residue_number, icode FROM v_lining WHERE residue_number % 4 = 1""",
    "v_grid": """
SELECT a.r_regionkey AS ix, b.r_regionkey AS iy, c.r_regionkey AS iz,
  CAST(a.r_regionkey*3 - b.r_regionkey*2 + c.r_regionkey*c.r_regionkey AS DOUBLE) AS phi
FROM {region} a CROSS JOIN {region} b CROSS JOIN {region} c""",
}


def _needed(text: str, have: list[str]) -> None:
    for name in re.findall(r"\bv_[a-z]+\b", text):
        if name in VIEWS and name not in have:
            _needed(VIEWS[name], have)
            have.append(name)


def _render(text: str, spark_dir: str | None) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", f"parquet.`{spark_dir}/{t}.parquet`" if spark_dir else t)
    access = r"element_at(\1, \2)" if spark_dir else r"list_extract(\1, \2)"
    return re.sub(r"\[\[(\w+):(\d+)\]\]", access, text)


def _with(text: str, spark_dir: str | None) -> str:
    names: list[str] = []
    _needed(text, names)
    body = ",\n".join(f"{n} AS ({_render(VIEWS[n], spark_dir).strip()})" for n in names)
    return f"WITH {body}\n" if names else ""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_with(f"v_x {name}", sf_dir) + f"SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """A statement for the checking engine, with the views it names in front."""
    sql = sql.strip()
    head = _with(sql, None)
    sql = _render(sql, None)
    if head and sql[:5].upper() == "WITH ":
        rest = sql[5:].lstrip()
        if rest[:10].upper() == "RECURSIVE ":
            return "WITH RECURSIVE " + head[5:].rstrip() + ",\n" + rest[10:]
        return head.rstrip() + ",\n" + rest
    return head + sql
