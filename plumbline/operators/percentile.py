"""Position of a value within a reference distribution (tie-aware percentile)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import scores as S
from .ordering import lookup_join, null_safe_join, prefix_counts

#: A reference is broadcast only while its distinct values stay below this count
#: (16 bytes each); beyond it the look-up runs as a distributed running count.
BROADCAST_VALUES = 2_000_000


def compact_reference(reference: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., criterion, value, n): one row per distinct reference value."""
    missing = [c for c in columns if c not in reference.columns]
    if missing:
        raise ValueError(f"reference is missing columns: {missing}")
    checked = reference.select(*by, *[S.finite_or_fail(F.col(c), f"reference column {c}").alias(c)
                                      for c in columns])
    long = checked.unpivot(list(by), list(columns), "criterion", "value")
    return long.groupBy(*by, "criterion", "value").agg(F.count(F.lit(1)).alias("n"))


def reference_cdf(compact: DataFrame, by: list[str] = (), spread=None) -> DataFrame:
    """The compact reference with cumulative counts: n_lt, n_eq, m."""
    run = prefix_counts(compact, [*by, "criterion"], "value", ["n"], spread)
    return run.select(*by, "criterion", "value", F.col("n_before").alias("n_lt"),
                      F.col("n").alias("n_eq"), F.col("n_total").alias("m"))


def _search(lo, hi, values, x, right):
    """First position in each [lo, hi) slice whose value is > x (or >= x)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        probe = values[np.minimum(mid, values.size - 1)]
        go = open_ & ((probe <= x) if right else (probe < x))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def with_percentiles(rows: DataFrame, compact: DataFrame, columns: list[str], by: list[str] = (),
                     id_cols: list[str] = ("candidate_id",), prefix: str = "p__",
                     above: bool = False, max_values: int | None = None, others: bool = False) -> DataFrame:
    """Add ``p__<column>`` for each column: mid-rank percentile within the reference.

    ``by`` partitions both sides (fold, target, ...). With a reference of bounded
    size the rows are scored in place, in one pass without a shuffle; otherwise each
    column is looked up by a join. Keys are compared as what they are (null meets null),
    and rows need no identity of their own. ``above`` counts
    the reference values above x instead of below (for values where low is good).
    A null value keeps a null percentile when ``by`` has no reference for it.
    ``others`` compares each row with the references of all other keys instead (its
    fold left out): counts of the whole less counts of the row's own key, so no
    reference is repeated per key. Null where nothing else is left.
    """
    if others and not by:
        raise ValueError("leaving a key out needs the columns of that key")
    limit = BROADCAST_VALUES if max_values is None else max_values
    small = compact.filter(F.col("criterion").isin(*columns)).limit(limit + 1)
    if runtime.fits_broadcast(small, limit):
        return _score_in_place(rows, small, columns, list(by), prefix, above, others)
    return _score_by_shuffle(rows, compact, columns, list(by), prefix, above, others)


def _score_in_place(rows, small, columns, by, prefix, above, others=False):
    """``small`` is bounded: its distinct keys get numbers, which travel to the rows by a join on the keys."""
    spark, slots = rows.sparkSession, None
    if by:
        keys = small.select(*by).distinct().toArrow()
        numbered = keys.append_column("__slot", pa.array(range(keys.num_rows), pa.int32()))
        slots = spark.createDataFrame(numbered).select(*(F.col(b).cast(small.schema[b].dataType).alias(b) for b in by), "__slot")
        small = null_safe_join(small, F.broadcast(slots), by)
    pdf = small.select(*(["__slot"] if by else []), "criterion", "value", "n").toArrow().to_pandas()
    if pdf.empty:
        raise ValueError("cannot compute a percentile against an empty reference")
    pdf = pdf.sort_values([*(["__slot"] if by else []), "criterion", "value"], kind="stable").reset_index(drop=True)
    tables = {}
    for name in columns:
        part = pdf[pdf["criterion"] == name]
        if part.empty:
            raise ValueError(f"criterion {name!r} is missing from the reference")
        below = np.r_[0, np.cumsum(part["n"].to_numpy(dtype=np.int64))]
        starts = ends = whole = None
        if by:  # slices per key inside one array
            slot, n_slots = part["__slot"].to_numpy(), int(pdf["__slot"].max()) + 1
            starts, ends = (np.searchsorted(slot, np.arange(n_slots), side) for side in ("left", "right"))
        if others:
            merged = part.groupby("value", sort=True)["n"].sum()
            whole = merged.index.to_numpy(dtype=float), np.r_[0, np.cumsum(merged.to_numpy(dtype=np.int64))]
        tables[name] = (part["value"].to_numpy(dtype=float), below, starts, ends, whole)
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def look_up(name, x, key):
        values, below, starts, ends, whole = shared.value[name]
        if not np.isfinite(x).all():
            raise ValueError(f"non-finite value in {name}")
        if starts is None:
            left = np.searchsorted(values, x, "left")
            right = np.searchsorted(values, x, "right")
            twice = below[left] + below[right]
            return (2 * below[-1] - twice if above else twice) / (2.0 * below[-1])
        known = key >= 0
        lo, hi = starts[np.maximum(key, 0)], ends[np.maximum(key, 0)]
        known &= hi > lo
        base, m = below[lo], below[hi] - below[lo]
        left = _search(lo, hi, values, x, right=False)
        right = _search(lo, hi, values, x, right=True)
        twice = below[left] + below[right] - 2 * base
        if whole is not None:
            distinct, upto = whole
            both = upto[np.searchsorted(distinct, x, "left")] + upto[np.searchsorted(distinct, x, "right")]
            twice, m = both - np.where(known, twice, 0), upto[-1] - np.where(known, m, 0)
            known = m > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(known, (2 * m - twice if above else twice) / (2.0 * m), np.nan)

    schema = ", ".join(f"`{c}` double" for c in columns)

    @F.pandas_udf(schema)
    def percentiles(batch: pd.DataFrame) -> pd.DataFrame:
        key = batch["__slot"].to_numpy() if by else None
        return pd.DataFrame({c: look_up(c, batch[c].to_numpy(dtype=float), key) for c in columns})

    packed = [F.col(c).cast("double").alias(c) for c in columns]
    if by:
        rows = null_safe_join(rows, F.broadcast(slots), by, "left")
        packed.append(F.coalesce("__slot", F.lit(-1)).alias("__slot"))
    out = rows.withColumn("__p", percentiles(F.struct(*packed)))
    for c in columns:
        p = F.col("__p")[c]
        out = out.withColumn(prefix + c, F.when(F.isnan(p), F.lit(None)).otherwise(p) if by else p)
    return out.drop("__p", "__slot")


def _score_by_shuffle(rows, compact, columns, by, prefix, above, others=False):
    keys = [*by, "criterion"]
    checked = rows.withColumns({f"__v_{c}": S.finite_or_fail(F.col(c), c) for c in columns})
    long = checked.select(*by, *[F.col(f"__v_{c}").alias(c) for c in columns if c not in by]).unpivot(list(by), list(columns), "criterion", "value")
    asked = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n_rows"))
    both = (
        compact.select(*keys, "value", F.col("n").alias("n_eq"), F.lit(0).cast("long").alias("n_rows"))
        .unionByName(asked.select(*keys, "value", F.lit(0).cast("long").alias("n_eq"), "n_rows"))
        .groupBy(*keys, "value").agg(F.sum("n_eq").alias("n_eq"), F.sum("n_rows").alias("n_rows"))
    )
    run = prefix_counts(both, keys, "value", ["n_eq"], True)
    run, (less, same, m) = run.filter(F.col("n_rows") > 0), (F.col(f"n_eq{c}") for c in ("_before", "", "_total"))
    if others:
        every = both.groupBy("criterion", "value").agg(F.sum("n_eq").alias("all"))
        run = lookup_join(run, prefix_counts(every, ["criterion"], "value", ["all"], True), ["criterion", "value"])
        less, same, m = F.col("all_before") - less, F.col("all") - same, F.col("all_total") - m
    side = m - less - same if above else less
    table = run.select(
        *keys, "value", "n_rows", F.when(m > 0, S.mid_rank(side, same, F.when(m > 0, m))).alias("p"))
    table = runtime.cut_lineage(table, "percentiles")
    out = checked
    for c in columns:
        one = table.filter(F.col("criterion") == c).select(*by, F.col("value").alias(f"__v_{c}"), F.col("p").alias(prefix + c))
        out = lookup_join(out, one, [*by, f"__v_{c}"], how="left")
    return out.drop(*[f"__v_{c}" for c in columns])


def criterion_scores(rows: DataFrame, compact: DataFrame, criteria, by: list[str] = (),
                     id_cols: list[str] = ("candidate_id",), prefix: str = "score__", **kw) -> DataFrame:
    """Add ``score__<criterion>`` in [0, 1], higher always better."""
    names = [c.name for c in criteria]
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"feature table is missing criterion columns: {missing}")
    out = with_percentiles(rows, compact, names, by, id_cols, "__p__", **kw)
    scored = {f"{prefix}{c.name}": S.score_for(F.col(f"__p__{c.name}"), c.mode) for c in criteria}
    return out.withColumns(scored).drop(*[f"__p__{n}" for n in names])
