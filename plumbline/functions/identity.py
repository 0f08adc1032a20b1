"""Stable seeds, keys and content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNLABELLED = "__unlabelled__"


def _part(p) -> Column:
    return p.cast("string") if isinstance(p, Column) else F.lit(str(p))


def derive_seed(*parts) -> Column:
    """A 32-bit seed that depends only on its parts, never on scheduling."""
    text = F.concat_ws("|", *[_part(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hash_draw(n: Column, *parts) -> Column:
    """A draw from 0..n-1 that any engine with md5 can repeat."""
    text = F.concat_ws("|", *[_part(p) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n)


def hash_uniform(*parts) -> Column:
    """A repeatable uniform in [0, 1)."""
    text = F.concat_ws("|", *[_part(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))


def clean_key(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9]+", "-"), "^-+|-+$", "")


def basename_argument(arg: Column) -> Column:
    """Reduce a path, or the path after ``flag=``, to its file name."""
    has_path = arg.rlike(r"[/\\]")
    prefix = F.regexp_extract(arg, r"^([^=]*=)", 1)
    rest = F.regexp_replace(arg, r"^[^=]*=", "")
    return F.when(has_path, F.concat(prefix, F.regexp_replace(rest, r"^.*[/\\]", ""))).otherwise(arg)


def content_id(df: DataFrame, exclude=(), blank=(), paths=(), length: int = 32) -> Column:
    """SHA-256 over a row's canonical JSON.

    ``exclude`` columns are volatile and left out; ``blank`` columns are not
    reproducible and are blanked, not removed, so a row without the field cannot
    hash like one that carries it; ``paths`` columns count by file name only.
    """
    cols = []
    for name in sorted(df.columns):
        if name in exclude:
            continue
        c = F.col(f"`{name}`")
        if name in blank:
            c = F.when(c.isNotNull(), F.lit("<nondeterministic>"))
        elif name in paths:
            dtype = dict(df.dtypes)[name]
            c = F.transform(c, basename_argument) if dtype.startswith("array") else basename_argument(c)
        cols.append(c.alias(name))
    return F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, length)
