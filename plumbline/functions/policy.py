"""Policies written as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Residue names of water, and of the amino acids a protein chain holds.
WATER = ("HOH", "DOD", "WAT")
AMINO_ACIDS = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE",
    "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL",
    "MSE", "SEC", "PYL",
)


def is_protein(name: Column, hetero: Column) -> Column:
    """Standard residues, and the one modified residue that counts as one."""
    return name.isin(*AMINO_ACIDS) & (~hetero | (name == "MSE"))


def hetero_action(name: Column, protein: Column, strip: bool = False, retain=(),
                  remove=WATER, default: str = "retain") -> Column:
    """struct(action, reason): water, protein, strip, explicit remove, explicit retain, default."""
    name = F.upper(F.trim(name))
    yes, no = F.lit("retained"), F.lit("removed")
    removed = name.isin(*[r.upper() for r in remove]) if remove else F.lit(False)
    retained = name.isin(*[r.upper() for r in retain]) if retain else F.lit(False)
    dflt = yes if default == "retain" else no

    def rule(action, reason):
        return F.struct(action.alias("action"), F.lit(reason).alias("reason"))

    return (
        F.when(name.isin(*WATER), rule(no, "water"))
        .when(protein, rule(yes, "protein"))
        .when(F.lit(strip), rule(no, "strip_hetatm"))
        .when(removed, rule(no, "explicit_remove"))
        .when(retained, rule(yes, "explicit_retain"))
        .otherwise(rule(dflt, "default_policy"))
    )


def eligibility_reasons(placeholder: Column, synthetic_target: Column, verified: Column) -> Column:
    """Why a run is development-only; an empty array means it may be published."""
    return F.array_compact(F.array(
        F.when(placeholder, "placeholder_corpus"),
        F.when(F.coalesce(synthetic_target, F.lit(False)), "synthetic_target_bundle"),
        F.when(~placeholder & ~F.coalesce(verified, F.lit(False)), "unverified_corpus_provenance"),
    ))


def development_reasons(placeholder: Column, experiments: Column) -> Column:
    """Reasons over a set of results; ``experiments`` is array<struct<name, synthetic>>."""
    flagged = F.filter(experiments, lambda e: e["synthetic"])
    named = F.transform(flagged, lambda e: F.concat(e["name"], F.lit(" used a synthetic target bundle")))
    first = F.when(F.coalesce(placeholder, F.lit(False)),
                   F.array(F.lit("scored against a placeholder corpus"))).otherwise(
        F.array().cast("array<string>"))
    return F.concat(first, F.array_distinct(named))


def null_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every double, nested ones included."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _clean(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
    if isinstance(dtype, T.ArrayType) and _has_double(dtype):
        return F.transform(c, lambda x: _clean(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_double(dtype.valueType):
        return F.transform_values(c, lambda _k, v: _clean(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _has_double(dtype):
        inner = [_clean(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*inner))
    return c


def _has_double(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_double(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_double(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_double(f.dataType) for f in dtype.fields)
    return False
