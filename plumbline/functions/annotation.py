"""Bands and statuses of the target-aware annotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import POCKET
from .scores import is_finite


def assign_band(p: Column, moderate: float = 0.75, strong: float = 0.95) -> Column:
    return (
        F.when(~is_finite(p), "not_evaluated")
        .when(p >= strong, "strong").when(p >= moderate, "moderate").otherwise("weak")
    )


def is_evaluable(value: Column) -> Column:
    """True for a finite descriptor above zero; without one there is nothing to compare."""
    return F.coalesce(is_finite(value) & (value > 0), F.lit(False))


def not_evaluable_status(mode: Column) -> Column:
    return F.when(mode == POCKET, "not_evaluable_no_contact_loop").otherwise("not_evaluable_no_footprint")


def descriptor_name(mode: Column, model: Column | str = "radius_of_gyration") -> Column:
    m = F.lit(model) if isinstance(model, str) else model
    return (
        F.when(mode == POCKET, "loop_nt_median")
        .when(m == "length", "length").otherwise("rg_median_A")
    )


def descriptor_value(mode: Column, model: Column | str, loop: Column, length: Column, rg: Column) -> Column:
    """The number the mode compares, so mixed-mode target tables work in one plan."""
    m = F.lit(model) if isinstance(model, str) else model
    return (
        F.when(mode == POCKET, loop.cast("double"))
        .when(m == "length", length.cast("double")).otherwise(rg.cast("double"))
    )
