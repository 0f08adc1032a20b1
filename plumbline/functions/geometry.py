"""Geometry of candidates and targets, all plain arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import is_finite

#: A Gaussian segment of n monomers has Rg = b * sqrt(n / 6); a rod has L / sqrt(12).
COIL_DIVISOR = 6.0
ROD_DIVISOR = 12.0


def loop_reach(loop_nt: Column, a_per_nt: float = 6.0, flex_c: float = 1.0,
               extended: bool = False) -> Column:
    if extended:
        return F.lit(float(a_per_nt)) * loop_nt
    return F.lit(float(a_per_nt * flex_c)) * F.sqrt(loop_nt)


def footprint_from_length(n: Column, a_per_nt: float = 6.0, scale: float = 1.0) -> Column:
    side = float(a_per_nt) * float(scale)
    return F.when(is_finite(n) & (n > 0), F.lit(side * side) * n)


def footprint_from_radius(rg: Column, scale: float = 1.0) -> Column:
    scaled = rg * F.lit(float(scale))
    return F.when(is_finite(rg) & (rg > 0), F.lit(math.pi) * scaled * scaled)


def gaussian_agreement(absolute: Column, sigma: float) -> Column:
    return F.exp(-(absolute * absolute) / F.lit(2.0 * float(sigma) ** 2))


def charge_factor(potential: Column, scale: float = 5.0) -> Column:
    """Logistic of the site potential; null when none was computed."""
    phi = potential / F.lit(float(scale))
    return F.when(
        is_finite(potential),
        F.when(phi <= -700, F.lit(0.0)).when(phi >= 700, F.lit(1.0))
        .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-phi))),
    )


def surface_agreement(size: Column, charge: Column, w_size: float = 1.0, w_charge: float = 1.0) -> Column:
    """Weighted mean of both terms; the charge term drops out when it is null."""
    ws, wc = F.lit(float(w_size)), F.lit(float(w_charge))
    without = size if w_size > 0 else F.lit(None).cast("double")
    return F.when(charge.isNull(), without).otherwise((ws * size + wc * charge) / (ws + wc))


def elongation(sv1: Column, sv3: Column) -> Column:
    return F.when(sv3 > 0, sv1 / F.when(sv3 > 0, sv3)).when(sv1 > 0, F.lit(float("inf"))).otherwise(
        F.lit(float("nan")))


def planarity(sv3: Column, n: Column) -> Column:
    return F.when(n > 0, F.lit(2.0) * sv3 / F.sqrt(F.when(n > 0, n).cast("double")))


def equivalent_diameter(volume: Column) -> Column:
    return F.when(
        volume > 0, F.lit(2.0) * F.pow(F.lit(3.0) * volume / F.lit(4.0 * math.pi), F.lit(1.0 / 3.0))
    )


def pocket_shape_warning(d_pocket: Column, d_equiv: Column, limit: float = 2.0) -> Column:
    ratio = d_pocket / F.when(d_equiv > 0, d_equiv)
    return F.coalesce((ratio > limit) | (ratio < 1.0 / limit), F.lit(False))


def patch_shape_warning(planarity_a: Column, flat_limit: float = 12.0) -> Column:
    return F.coalesce(is_finite(planarity_a) & (planarity_a > flat_limit), F.lit(False))


def free_coil_rg(n: Column, a_per_nt: float = 6.0) -> Column:
    return F.lit(float(a_per_nt)) * F.sqrt(F.greatest(n, F.lit(0)) / F.lit(COIL_DIVISOR))


def element_extent(kind: Column, mass: Column, reach: Column, bp: Column,
                   a_per_nt: float = 6.0, a_per_bp: float = 2.8) -> Column:
    return F.when(kind == "s", F.lit(float(a_per_bp)) * bp).otherwise(
        F.lit(float(a_per_nt)) * F.sqrt(reach.cast("double")))


def element_rg(kind: Column, mass: Column, bp: Column,
               a_per_nt: float = 6.0, a_per_bp: float = 2.8) -> Column:
    return F.when(kind == "s", F.lit(float(a_per_bp)) * bp / F.lit(math.sqrt(ROD_DIVISOR))).otherwise(
        F.lit(float(a_per_nt)) * F.sqrt(mass / F.lit(COIL_DIVISOR)))


def offset_outward(x, y, z, cx, cy, cz, offset: float = 3.0) -> Column:
    """Move a point away from the centroid; a point on the centroid stays."""
    dx, dy, dz = x - cx, y - cy, z - cz
    norm = F.sqrt(dx * dx + dy * dy + dz * dz)
    safe = F.when(norm > 1e-6, norm).otherwise(F.lit(1.0))
    o = F.lit(float(offset))
    return F.struct((x + o * (dx / safe)).alias("x"), (y + o * (dy / safe)).alias("y"),
                    (z + o * (dz / safe)).alias("z"))
