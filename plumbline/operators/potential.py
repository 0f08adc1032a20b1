"""Electrostatic potential at points near a target site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def outward_points(points: DataFrame, centroids: DataFrame, keys: list[str], offset: float = 3.0) -> DataFrame:
    """Points moved away from the centroid of their chain (cx, cy, cz)."""
    moved = points.join(centroids.select(*keys, "cx", "cy", "cz"), keys)
    p = G.offset_outward(F.col("x"), F.col("y"), F.col("z"), F.col("cx"), F.col("cy"), F.col("cz"), offset)
    others = [c for c in points.columns if c not in ("x", "y", "z")]
    return moved.withColumn("__p", p).select(*others, "__p.x", "__p.y", "__p.z")


def sample_potential(points: DataFrame, grid: DataFrame, header: DataFrame, keys: list[str],
                     point_id: str = "point_id") -> DataFrame:
    """Trilinear potential at each point; null outside the grid.

    A point asks for its eight corners; asking and answering meet by an equi-join on
    (target, ix, iy, iz), so grids of any size stay where they are.
    """
    names = [f"`{k}`" for k in keys]
    placed = points.join(header.select(*keys, "origin", "spacing", "counts"), keys).selectExpr(
        *names, f"`{point_id}`", *[f"({a} - origin[{i}]) / spacing[{i}] AS f{a}" for i, a in enumerate("xyz")],
        "counts").selectExpr("*", *[f"CAST(floor(f{a}) AS INT) AS b{a}" for a in "xyz"])
    inside = " AND ".join(f"b{a} >= 0 AND b{a} + 1 < counts[{i}]" for i, a in enumerate("xyz"))
    corners = placed.filter(inside).selectExpr("*", "explode(sequence(0, 7)) AS k").selectExpr(
        *names, f"`{point_id}`", "bx + (k >> 2) AS ix", "by + ((k >> 1) & 1) AS iy", "bz + (k & 1) AS iz",
        "fx - bx AS wx", "fy - by AS wy", "fz - bz AS wz", "k").selectExpr(
        *names, f"`{point_id}`", "ix", "iy", "iz",
        "(CASE WHEN k >> 2 = 1 THEN wx ELSE 1 - wx END) * (CASE WHEN (k >> 1) & 1 = 1 THEN wy ELSE 1 - wy END)"
        " * (CASE WHEN k & 1 = 1 THEN wz ELSE 1 - wz END) AS w")
    phi = corners.join(grid, [*keys, "ix", "iy", "iz"]).groupBy(*keys, point_id).agg(
        F.sum(F.col("w") * F.col("phi")).alias("potential"))
    return points.select(*keys, point_id).join(phi, [*keys, point_id], "left")


def potential_summary(sampled: DataFrame, keys: list[str], spread=None) -> DataFrame:
    """Mean, median, coverage and sign per target; none inside is a failed status."""
    from .ordering import group_quantiles
    stats = sampled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points_requested"), F.count("potential").alias("n_points_inside_grid"),
        F.avg("potential").alias("mean_potential"))
    med = group_quantiles(sampled, keys, "potential", {"median_potential": 0.5}, spread)
    return stats.join(med, keys, "left").select(
        *keys, "n_points_requested", "n_points_inside_grid", "mean_potential", "median_potential",
        (F.col("mean_potential") > 0).alias("electrostatic_compatible"),
        F.when(F.col("n_points_inside_grid") == 0, "failed").otherwise("success").alias("status"))
