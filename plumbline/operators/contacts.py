"""Interface contacts and the set comparisons around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFF = 4.5


def interface_contacts(target: DataFrame, partner: DataFrame, cutoff: float = CUTOFF,
                       keys: list[str] = (), residue: list[str] = ("residue_number",)) -> DataFrame:
    """Target residues with an atom within ``cutoff`` of a partner atom, and how close.

    Space is cut into cells of one cutoff; the partner atoms are copied to their 27
    neighbouring cells and meet the target atoms of the same cell by an equi-join.
    The minimum is a partial aggregate, so matches never leave their task as pairs.
    """
    keys, residue = list(keys), list(residue)
    cell = [f"CAST(floor({a} / {cutoff}) AS INT) AS c{a}" for a in "xyz"]
    names = [f"`{k}`" for k in keys]
    left = target.selectExpr(*names, *[f"`{r}`" for r in residue], "x", "y", "z", *cell)
    near = "explode(sequence(-1, 1)) AS d{}"
    right = partner.selectExpr(*names, "x AS px", "y AS py", "z AS pz", *cell)
    for a in "xyz":
        right = right.selectExpr("*", near.format(a))
    right = right.selectExpr(*names, "px", "py", "pz", *[f"c{a} + d{a} AS c{a}" for a in "xyz"])
    d2 = "(x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)"
    return (
        left.join(right, [*keys, "cx", "cy", "cz"])
        .selectExpr(*names, *[f"`{r}`" for r in residue], f"sqrt({d2}) AS d").filter(F.col("d") <= cutoff)
        .groupBy(*keys, *residue).agg(F.min("d").alias("d"))
        .select(*keys, *residue, F.round("d", 2).alias("min_distance_A"))
    )


def absent_residues(requested: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Requested residues the structure does not have: almost always a wrong chain."""
    return requested.join(present.select(*on).distinct(), on, "left_anti")


def compare_interface(configured: DataFrame, measured: DataFrame, on: list[str]) -> DataFrame:
    """Each residue once, with the side that names it."""
    a = configured.select(*on).distinct().withColumn("__a", F.lit(True))
    b = measured.select(*on).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__a").isNull(), "interface_not_configured").when(
        F.col("__b").isNull(), "configured_not_in_interface").otherwise("configured_in_interface")
    return a.join(b, on, "full_outer").select(*on, side.alias("side"))


def interface_summary(compared: DataFrame, keys: list[str], residue: str = "residue_number") -> DataFrame:
    """Counts and sorted residue lists per structure (bounded by its chain length)."""
    def listed(side):
        return F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col(residue)))).alias(side)
    measured = F.col("side") != "configured_not_in_interface"
    return compared.groupBy(*keys).agg(
        F.count_if(measured).alias("n_interface_residues"),
        F.array_sort(F.collect_set(F.when(measured, F.col(residue)))).alias("interface_residues"),
        listed("configured_in_interface"), listed("configured_not_in_interface"),
        listed("interface_not_configured"))


def pocket_overlap(pockets: DataFrame, lining: DataFrame, requested: DataFrame,
                   target: str = "target_id", residue: list[str] = ("chain", "residue_number", "icode")) -> DataFrame:
    """(target, pocket_index, overlap_count, overlapping): requested residues lining each pocket."""
    residue = list(residue)
    hits = (
        lining.select(target, "pocket_index", *residue).distinct()
        .join(requested.select(target, *residue).distinct(), [target, *residue])
        .groupBy(target, "pocket_index").agg(
            F.count(F.lit(1)).alias("overlap_count"),
            F.array_sort(F.collect_list(F.struct(*residue))).alias("overlapping"))
    )
    return pockets.select(target, "pocket_index").join(hits, [target, "pocket_index"], "left").select(
        target, "pocket_index", F.coalesce("overlap_count", F.lit(0)).alias("overlap_count"), "overlapping")
