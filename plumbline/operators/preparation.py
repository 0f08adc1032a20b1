"""Choosing the chain and the atoms a target is measured on; choosing its pocket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy

MIN_ATOMS = 100


def select_chain(atoms: DataFrame, requests: DataFrame, key: str = "structure_id") -> DataFrame:
    """(key, chain, problem): the requested chain, else the first one with protein.

    ``requests`` has (key, chain) with a null chain where none was asked for;
    ``atoms`` has file order in ``line_no``.
    """
    chains = atoms.groupBy(key, "chain").agg(
        F.min("line_no").alias("first"), F.max(F.col("resname").isin(*policy.AMINO_ACIDS)).alias("protein"))
    facts = chains.groupBy(key).agg(
        F.min_by("chain", F.when(F.col("protein"), F.col("first"))).alias("auto"),
        F.array_sort(F.collect_set("chain")).alias("available"))
    asked = F.col("wanted")
    found = F.array_contains("available", F.coalesce(asked, F.lit("")))
    return requests.select(key, F.col("chain").alias("wanted")).join(facts, key, "left").select(
        key, F.when(asked.isNull(), F.col("auto")).when(found, asked).alias("chain"),
        F.when(asked.isNotNull() & ~F.coalesce(found, F.lit(False)), "chain not found")
        .when(asked.isNull() & F.col("auto").isNull(), "no protein chain").alias("problem"))


def apply_policy(atoms: DataFrame, strip=False, retain=(), remove=policy.WATER, default="retain") -> DataFrame:
    """Add action and reason to each atom of the chosen chain."""
    protein = policy.is_protein(F.upper(F.trim("resname")), F.col("hetero"))
    decided = policy.hetero_action(F.col("resname"), protein, strip, retain, remove, default)
    return atoms.withColumn("__d", decided).select("*", "__d.action", "__d.reason").drop("__d")


def hetero_summary(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per residue name: action, reason, residues, atoms."""
    residues = judged.groupBy(*keys, "resname", "action", "reason", "residue_number", "icode").agg(
        F.count(F.lit(1)).alias("__a"))
    return residues.groupBy(*keys, "resname", "action", "reason").agg(
        F.count(F.lit(1)).alias("residue_count"), F.sum("__a").alias("atom_count"))


def first_altloc(atoms: DataFrame) -> DataFrame:
    """Alternates overlap in space; only the first one counts."""
    return atoms.filter(F.trim(F.coalesce("altloc", F.lit(""))).isin("", "A"))


def select_pocket(pockets: DataFrame, overlap: DataFrame, requests: DataFrame, key: str = "target_id") -> DataFrame:
    """Which cavity counts, per target, and how that was decided.

    ``requests`` has one row per target: n_requested, require_overlap,
    allow_zero_overlap. Order: overlap, score, druggability (null last), index.
    The best pocket is a minimum over a struct, a partial aggregate.
    """
    order = F.struct(
        (-F.col("overlap_count")).alias("o"), (-F.col("score")).alias("s"),
        F.coalesce(-F.col("druggability"), F.lit(float("inf"))).alias("d"), F.col("pocket_index").alias("i"))
    best = pockets.join(overlap.select(key, "pocket_index", "overlap_count"), [key, "pocket_index"]).groupBy(key).agg(
        F.min(order).alias("best"), F.sum("overlap_count").alias("total_overlap"), F.count(F.lit(1)).alias("n_pockets"))
    joined = requests.join(best, key, "left")
    none = F.col("best").isNull()
    asked = F.col("n_requested") > 0
    zero = asked & (F.col("total_overlap") == 0)
    refused = zero & F.col("require_overlap") & ~F.col("allow_zero_overlap")
    status = (
        F.when(none & F.col("require_overlap"), "failed").when(none, "not_applicable")
        .when(refused, "failed").otherwise("selected"))
    method = (
        F.when(none, "no_cavity_detected").when(refused, F.lit(None))
        .when(zero, "target_site_zero_overlap_fallback").when(asked, "target_site_overlap")
        .otherwise("automatic_score"))
    warning = (
        F.when(none, "no cavity was detected; a measured patch is the evidence")
        .when(refused, "no requested residue lines any cavity: check numbering, chain and preparation")
        .when(zero, "requested residues overlap no cavity; the highest score was taken")
        .when(~asked, "no residues requested; the highest score is not guaranteed to be the functional cavity"))
    return joined.select(
        key, status.alias("status"), method.alias("method"),
        F.when(status == "selected", F.col("best.i")).alias("pocket_index"),
        F.coalesce("total_overlap", F.lit(0)).alias("total_overlap"), warning.alias("warning"))


def source_mismatches(info: DataFrame, vertices: DataFrame, lining: DataFrame, key: str = "target_id") -> DataFrame:
    """Pockets whose three sources disagree: missing somewhere, or other sphere counts.

    info: (key, pocket_index, n_reported); vertices and lining: one row per item.
    """
    v = vertices.groupBy(key, "pocket_index").agg(F.count(F.lit(1)).alias("n_vertices"))
    r = lining.groupBy(key, "pocket_index").agg(F.count(F.lit(1)).alias("n_lining"))
    joined = info.select(key, "pocket_index", "n_reported").join(
        v, [key, "pocket_index"], "full_outer").join(r, [key, "pocket_index"], "full_outer")
    problem = (
        F.when(F.col("n_reported").isNull(), "not in the info file")
        .when(F.col("n_vertices").isNull(), "no vertex file").when(F.col("n_lining").isNull(), "no lining residues")
        .when(F.col("n_reported") != F.col("n_vertices"), "sphere counts differ"))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def volume_drift(before: DataFrame, after: DataFrame, keys: list[str], tolerance: float = 0.10) -> DataFrame:
    """Pockets missing from a second build, or whose volume moved too far."""
    a = before.select(*keys, F.col("volume_A3").alias("before"))
    b = after.select(*keys, F.col("volume_A3").alias("after"))
    joined = a.join(b.withColumn("__has", F.lit(True)), keys, "left")
    drift = F.when(F.col("before") > 0, F.abs(F.col("after") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)))
    problem = F.when(F.col("__has").isNull(), "missing").when(drift > tolerance, "volume moved")
    return joined.select(*keys, drift.alias("drift"), problem.alias("problem")).filter(F.col("problem").isNotNull())
