"""Principal axes and the shapes of pockets and surface patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.scores import is_finite
from .ordering import null_safe_join, wants_spread, wide_quantiles

MIN_SPHERES = 4

_AXES = T.StructType([
    T.StructField("sv", T.ArrayType(T.DoubleType())),
    T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType())))])


@F.pandas_udf(_AXES)
def _eigen(n: pd.Series, xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series,
           yz: pd.Series) -> pd.DataFrame:
    """Singular values and axes of centred clouds from their 3x3 scatter matrices."""
    m = np.empty((len(n), 3, 3))
    for (i, j), s in {(0, 0): xx, (1, 1): yy, (2, 2): zz, (0, 1): xy, (0, 2): xz, (1, 2): yz}.items():
        m[:, i, j] = m[:, j, i] = s.to_numpy(float) * n.to_numpy(float)
    values, vectors = np.linalg.eigh(m)
    values = values[:, ::-1]
    # Flat clouds leave rounding noise where the last value is zero.
    values = np.where(values < 1e-12 * np.maximum(values[:, :1], 0), 0.0, values)
    axes = np.swapaxes(vectors, 1, 2)[:, ::-1, :]
    lead = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[:, :, None], axis=2)
    axes = np.where(lead < 0, -axes, axes)
    return pd.DataFrame({"sv": list(np.sqrt(values)), "axes": [a.tolist() for a in axes]})


def principal_axes(points: DataFrame, keys: list[str], extra=()) -> DataFrame:
    """One row per cloud: n, centroid, singular values, axes.

    Means and covariances are partial aggregates (stable merging), so a cloud of
    any size meets as a handful of numbers; only those reach the 3x3 solver.
    """
    pairs = {"xx": "xx", "yy": "yy", "zz": "zz", "xy": "xy", "xz": "xz", "yz": "yz"}
    stats = points.groupBy(*keys).agg(
        F.expr("count(*) AS n"), F.expr("avg(x) AS cx"), F.expr("avg(y) AS cy"), F.expr("avg(z) AS cz"),
        *[F.expr(f"covar_pop({p[0]}, {p[1]}) AS {p}") for p in pairs], *extra)
    return stats.withColumn("__e", _eigen("n", *pairs)).select(
        *[c for c in stats.columns if c not in pairs], "__e.sv", "__e.axes")


def project(points: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates along the three axes of the cloud a point belongs to: p1, p2, p3."""
    out = points.join(axes.select(*keys, "cx", "cy", "cz", "axes"), keys)
    return out.selectExpr("*", *[
        f"(x - cx) * axes[{i}][0] + (y - cy) * axes[{i}][1] + (z - cz) * axes[{i}][2] AS p{i + 1}"
        for i in range(3)])


def pocket_geometry(spheres: DataFrame, keys: list[str], volumes: DataFrame | None = None,
                    warning_ratio: float = 2.0, spread=None) -> DataFrame:
    """Robust dimensions of every cavity from its alpha spheres.

    Extents are 5-95% ranges along the principal axes, of the centres and of the
    radius-aware envelope. A pocket that cannot be measured has a ``problem``.
    """
    finite = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")) & is_finite(F.col("radius"))
    health = spheres.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(~finite).alias("__bad"),
        F.count_if(F.col("radius") <= 0).alias("__flat"))
    problem = (
        F.when(F.col("__n") < MIN_SPHERES, "fewer than 4 alpha spheres")
        .when(F.col("__bad") > 0, "non-finite coordinates or radii")
        .when(F.col("__flat") > 0, "radii must be positive"))
    judged = health.select(*keys, problem.alias("problem"))
    good = spheres.join(judged.filter(F.col("problem").isNull()).select(*keys), keys, "left_semi")
    axes = principal_axes(good, keys)
    along = project(good, axes, keys).selectExpr(
        *[f"`{k}`" for k in keys], "p1", "p2", "p3", *[f"p{i} - radius AS lo{i}" for i in (1, 2, 3)],
        *[f"p{i} + radius AS hi{i}" for i in (1, 2, 3)])
    cols = ["p1", "p2", "p3", "lo1", "lo2", "lo3", "hi1", "hi2", "hi3"]
    q = wide_quantiles(along, keys, cols, {"a": .05, "b": .95}, wants_spread(spheres, spread))
    shaped = axes.join(q, keys).selectExpr(
        *[f"`{k}`" for k in keys], "n AS n_alpha_spheres", "array(cx, cy, cz) AS centroid_A",
        "axes AS pca_axes", "sv AS singular_values_A", "transform(sv, s -> s / sqrt(n)) AS rms_spreads_A",
        "array(p1_b - p1_a, p2_b - p2_a, p3_b - p3_a) AS centre_extents_A",
        "array(hi1_b - lo1_a, hi2_b - lo2_a, hi3_b - lo3_a) AS envelope_extents_A")
    shaped = shaped.selectExpr(
        "*", "array_max(centre_extents_A) AS d_pocket_centres_A", "array_max(envelope_extents_A) AS d_pocket_A",
        "CAST(array_position(envelope_extents_A, array_max(envelope_extents_A)) - 1 AS INT) AS primary_axis_index")
    sv = F.col("singular_values_A")
    shaped = shaped.withColumns({
        "elongation": G.elongation(F.get(sv, 0), F.get(sv, 2)),
        "planarity_A": G.planarity(F.get(sv, 2), F.col("n_alpha_spheres"))})
    out = judged.join(shaped, keys, "left")
    if volumes is not None:
        out = out.join(volumes.select(*keys, F.col("volume_A3")), keys, "left")
    else:
        out = out.withColumn("volume_A3", F.lit(None).cast("double"))
    return out.withColumn("d_equiv_A", G.equivalent_diameter(F.col("volume_A3"))).withColumns({
        "envelope_to_equiv_ratio": F.col("d_pocket_A") / F.col("d_equiv_A"),
        "shape_warning": G.pocket_shape_warning(F.col("d_pocket_A"), F.col("d_equiv_A"), warning_ratio)})


def patch_geometry(atoms: DataFrame, requested: DataFrame, target: str = "target_id",
                   buried_below: float = 1.0, flat_limit: float = 12.0, spread=None) -> DataFrame:
    """Area and shape of the named residues of every target.

    ``atoms`` holds one prepared chain per target with an area per atom (sasa). Residues are
    matched on chain and insertion code too where both tables have them. Requested
    residues that no atom belongs to are listed and reported as the ``problem``; a target
    of which none is present has only that. Where ``atoms`` tells ``hetero`` atoms apart,
    they count in the area of the chain, but neither for a patch nor as a requested residue.
    """
    on = [target, "residue_number", *(c for c in ("chain", "icode") if c in atoms.columns and c in requested.columns)]
    wanted = requested.select(*on).distinct()
    own = atoms.filter(~F.coalesce("hetero", F.lit(False))) if "hetero" in atoms.columns else atoms
    named = null_safe_join(own, wanted, on, "left_semi")
    absent = null_safe_join(wanted, own.select(*on).distinct(), on, "left_anti").groupBy(target).agg(
        F.array_sort(F.collect_set("residue_number")).alias("absent_residue_numbers"))
    areas = named.groupBy(target, "residue_number").agg(F.sum("sasa").alias("area"))
    per_target = areas.groupBy(target).agg(
        F.count(F.lit(1)).alias("n_residues"), F.sum("area").alias("patch_area_A2"),
        F.array_sort(F.collect_list("residue_number")).alias("residue_numbers"),
        F.array_sort(F.collect_list(F.when(F.col("area") < buried_below, F.col("residue_number"))))
        .alias("buried_residue_numbers"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("residue_number", "area")))).alias("per_residue_area_A2"))
    total = atoms.groupBy(target).agg(F.sum("sasa").alias("total_chain_area_A2"))
    axes = principal_axes(named, [target])
    q = wide_quantiles(project(named, axes, [target]), [target], ["p1", "p2", "p3"], {"a": .05, "b": .95},
                       wants_spread(atoms, spread))
    out = per_target.join(total, target).join(axes, target).join(q, target)
    out = out.select(
        target, "n_residues", F.col("n").alias("n_atoms"), "residue_numbers", "patch_area_A2",
        "per_residue_area_A2", F.array("cx", "cy", "cz").alias("centroid_A"),
        F.array(*[F.col(f"p{i}_b") - F.col(f"p{i}_a") for i in (1, 2, 3)]).alias("extents_A"),
        G.planarity(F.get("sv", 2), F.col("n")).alias("planarity_A"),
        G.elongation(F.get("sv", 0), F.get("sv", 2)).alias("elongation"),
        "buried_residue_numbers", "total_chain_area_A2")
    out = out.withColumn("shape_warning", G.patch_shape_warning(F.col("planarity_A"), flat_limit))
    missing = F.array_join(F.transform("absent_residue_numbers", lambda r: r.cast("string")), ", ")
    return wanted.select(target).distinct().join(out, target, "left").join(absent, target, "left").withColumn(
        "problem", F.concat(F.lit("requested residues not present: "), missing))
