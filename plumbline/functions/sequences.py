"""Expressions over sequence and structure strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = ("A", "C", "G", "U")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_sequence(seq) -> Column:
    """Drop whitespace, upper-case, write T as U."""
    # Java's \s is ASCII only; (?U) extends it to every Unicode white space.
    return F.translate(F.upper(F.regexp_replace(_col(seq), r"(?U)\s+", "")), "T", "U")


def rejection_reason(seq, min_length: int = 20, max_length: int = 100) -> Column:
    """Why a normalised sequence is unusable; null when it is fine."""
    s = _col(seq)
    strange = F.array_sort(F.array_distinct(F.split(F.translate(s, "".join(ALPHABET), ""), "")))
    strange = F.filter(strange, lambda c: c != "")
    quoted = F.transform(F.slice(strange, 1, 4), lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    n = F.length(s).cast("string")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit("empty sequence"))
        .when(
            F.translate(s, "".join(ALPHABET), "") != "",
            F.concat(
                F.lit("invalid character"),
                F.when(F.size(strange) > 1, F.lit("s")).otherwise(F.lit("")),
                F.lit(" "),
                F.array_join(quoted, ", "),
            ),
        )
        .when(F.length(s) < min_length,
              F.concat(F.lit("length "), n, F.lit(f" below minimum {min_length}")))
        .when(F.length(s) > max_length,
              F.concat(F.lit("length "), n, F.lit(f" above maximum {max_length}")))
    )


def merged_reason(reason) -> Column:
    """Rejection reason with both length cases folded into one label."""
    r = _col(reason)
    return F.when(r.startswith("length "), F.lit("length out of range")).otherwise(r)


def truncate_preview(text, limit: int = 60) -> Column:
    t = F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(
        F.concat(F.substring(t, 1, limit - 1), F.lit("…"))
    )


def count_letters(seq, letters: str) -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_fraction(seq) -> Column:
    s = _col(seq)
    return F.when(F.length(s) > 0, count_letters(s, "GC") / F.length(s)).otherwise(F.lit(0.0))


def kmers(seq, k: int = 2) -> Column:
    """Array of overlapping k-mers, in order."""
    s = _col(seq)
    n = F.length(s) - F.lit(k - 1)
    return F.when(
        n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                            lambda i: F.substring(s, i, F.lit(k)))
    ).otherwise(F.array().cast("array<string>"))


def mfe_norm(mfe, length) -> Column:
    return _col(mfe) / F.nullif(_col(length), F.lit(0))


def array_mean(values) -> Column:
    """Mean of an array of doubles; 0 for an empty one."""
    v = _col(values)
    return F.when(
        F.size(v) > 0,
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v),
    ).otherwise(F.lit(0.0))


def structure_is_valid(dot_bracket, length=None) -> Column:
    """Alphabet ``().``, never below depth zero, closed at the end, right length."""
    s = _col(dot_bracket)
    depth = F.aggregate(
        F.split(s, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, c: F.struct(
            (acc["d"] + _step(c)).alias("d"), F.least(acc["low"], acc["d"] + _step(c)).alias("low")
        ),
    )
    ok = (F.translate(s, "().", "") == "") & (depth["d"] == 0) & (depth["low"] >= 0)
    if length is not None:
        ok = ok & (F.length(s) == _col(length))
    return ok


def _step(c: Column) -> Column:
    return F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
