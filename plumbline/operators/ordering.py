"""Order-based kernels: running counts, quantiles, ranks, look-ups.

A window without a partition key, or with one key that owns most rows, runs in a
single task. Every kernel here therefore has two shapes with the same result:

* plain  - one window per group, right while any group fits one task;
* spread - big groups are cut into buckets that preserve the order, buckets are
  processed in parallel, and bucket totals (a small table) supply the offsets.

``spread=None`` picks by counting the input (``runtime.is_large``). Cut points come
from values whose hash is below a threshold, a sample that is a function of the data
alone, so a recomputed stage sees the same cuts. Both shapes treat null keys as one
group and null values as the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime

SAMPLE_PER_PART = 16    # sampled values per part of a big group
BITS = 16               # a group is cut into 2**BITS parts at most
CUT_BLOCK = 256         # cuts that a row is compared with at once
BLOCK_BITS = 9          # for the cuts of a block and the next one, and for the blocks of a group
_ALL = "__all"
_HASHES = 1 << 30


def wants_spread(df: DataFrame, spread, keys: list[str] = ()) -> bool:
    """Counts the input; with ``keys``, a large input counts only where one of its groups is large."""
    if spread is not None:
        return bool(spread)
    if not runtime.is_large(df):
        return False
    return not keys or not df.groupBy(*keys).count().filter(F.col("count") > runtime.ROWS_PER_TASK).isEmpty()


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; ``keys`` appear once, from the left."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    if how in ("left_semi", "left_anti"):
        return left.join(named.select(*[f"__right_{k}" for k in keys]), on, how)
    return left.join(named, on, how).drop(*[f"__right_{k}" for k in keys])


def count_at_most(sorted_array: Column, x: Column, bits: int = BITS) -> Column:
    """How many entries of a sorted array are <= x (binary search)."""
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0),
        lambda pos, step: F.when(F.get(sorted_array, pos + step - 1) <= x, pos + step).otherwise(pos),
    )


def with_buckets(df: DataFrame, keys: list[str], value: str, min_rows: int | None = None,
                 bucket: str = "__bucket") -> DataFrame:
    """Add an order-preserving bucket number; groups of up to ``min_rows`` rows get bucket 0.

    ``value`` (a scalar or a struct) orders the rows. A larger group is cut in proportion
    to its size, so a bucket holds about ``min_rows`` rows.
    """
    return in_buckets(df, bucket_cuts(df, keys, value, min_rows), keys, value, bucket)


def bucket_cuts(df: DataFrame, keys: list[str], value: str, min_rows: int | None = None) -> DataFrame:
    """(keys..., __cuts): the sorted cuts of every group above ``min_rows`` rows, found once and written.

    The sample behind the cuts is a filter on a hash, without a sort or a window: its rate
    follows from the group's size.
    """
    if min_rows is None:
        min_rows = runtime.ROWS_PER_TASK // 4
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.least(F.ceil(F.col("__n") / min_rows), F.lit(1 << BITS))
    big = sizes.filter(F.col("__n") > min_rows).withColumn("__parts", parts.cast("int"))
    rate = F.col("__parts") * SAMPLE_PER_PART / F.col("__n")
    sample = (
        null_safe_join(df.filter(F.col(value).isNotNull()).select(*keys, value), big, keys)
        .filter(F.pmod(F.xxhash64(value), F.lit(_HASHES)) < rate * _HASHES)
    )
    ordered = sample.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("__s"), F.max("__parts").alias("__parts"))
    places = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.col("__parts") - 1),
        lambda i: F.floor(i.cast("long") * F.size("__s") / F.col("__parts")).cast("int")))
    cuts = ordered.filter(F.size("__s") > 0).select(*keys, "__s", places.alias("__at")).select(
        *keys, F.transform("__at", lambda i: F.get("__s", i)).alias("__cuts"))
    return runtime.cut_lineage(cuts, "cuts")


def in_buckets(df: DataFrame, cuts: DataFrame, keys: list[str], value: str, bucket: str = "__bucket", edges: bool = False) -> DataFrame:
    """The rows with the number of their bucket. The cuts travel to the rows in blocks.

    ``edges`` keeps only the rows of groups that were cut, with the cuts at which a row's
    bucket begins and ends (``__lower``, ``__upper``; null where the group does).
    """
    # A row meets the first cut of every block, then the cuts of one block: never all of them.
    heads = cuts.select(*keys, F.transform(F.sequence(F.lit(1), F.size("__cuts"), F.lit(CUT_BLOCK)),
                                           lambda i: F.get("__cuts", i - 1)).alias("__heads"))
    blocks = cuts.select(*keys, "__cuts", F.explode(F.sequence(F.lit(1), F.size("__cuts"), F.lit(CUT_BLOCK))).alias("__from")).select(
        *keys, "__from", F.slice("__cuts", F.col("__from"), F.lit(CUT_BLOCK + 1)).alias("__cuts"))
    head = F.when(F.col("__heads").isNull(), F.lit(0)).otherwise(count_at_most(F.col("__heads"), F.col(value), BLOCK_BITS))
    near = null_safe_join(df, F.broadcast(heads), keys, "left").withColumns(
        {"__from": (head - 1) * CUT_BLOCK + 1, "__first": F.get("__heads", F.lit(0))}).drop("__heads")
    if edges:
        near = near.filter(F.col("__first").isNotNull())
    # The last cut of a block is the first one of the next, which no row of the block reaches.
    inside = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(count_at_most(F.col("__cuts"), F.col(value), BLOCK_BITS))
    out = null_safe_join(near, F.broadcast(blocks), [*keys, "__from"], "left").withColumn("__in", inside)
    out = out.withColumn(bucket, F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(F.col("__from") - 1 + F.col("__in")))
    if edges:
        out = out.withColumns({"__lower": F.get("__cuts", F.col("__in") - 1), "__upper": F.coalesce(
            F.get("__cuts", F.col("__in")), F.when(F.col("__cuts").isNull(), F.col("__first")))})
    return out.drop("__cuts", "__from", "__first", "__in")


def prefix_counts(compact: DataFrame, keys: list[str], value: str, counts: list[str],
                  spread=None, min_rows: int | None = None) -> DataFrame:
    """Running totals over a table that has one row per (keys, value).

    Adds ``<c>_before`` (sum over smaller values of the group) and ``<c>_total``.
    """
    work, ks = (compact.withColumn(_ALL, F.lit(0)), [_ALL]) if not keys else (compact, list(keys))
    if not wants_spread(compact, spread):
        run = Window.partitionBy(*ks).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*ks)
        out = work
        for c in counts:
            out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(run), F.lit(0)).cast("long"))
            out = out.withColumn(f"{c}_total", F.sum(c).over(whole).cast("long"))
        return out.drop(_ALL)

    # Read by four branches that must agree, and already one row per value.
    work = runtime.cut_lineage(work, "values")
    bucketed = with_buckets(work, ks, value, min_rows)
    totals = bucketed.groupBy(*ks, "__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in counts])
    across = Window.partitionBy(*ks).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*ks)
    offsets = totals.select(
        *ks, "__bucket",
        *[F.coalesce(F.sum(f"__{c}").over(across), F.lit(0)).alias(f"__{c}_off") for c in counts],
        *[F.sum(f"__{c}").over(whole).alias(f"{c}_total") for c in counts],
    )
    run = Window.partitionBy(*ks, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = null_safe_join(bucketed, offsets, [*ks, "__bucket"])
    for c in counts:
        out = out.withColumn(
            f"{c}_before",
            (F.col(f"__{c}_off") + F.coalesce(F.sum(c).over(run), F.lit(0))).cast("long"))
        out = out.withColumn(f"{c}_total", F.col(f"{c}_total").cast("long"))
    return out.drop(_ALL, "__bucket", *[f"__{c}_off" for c in counts])


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], n_rows: str = "n_rows",
                how: str = "inner") -> DataFrame:
    """Join rows to a table that has one row per key, null keys included.

    No side is forced to be broadcast. The table has a key once, so where one key owns
    very many rows the adaptive skew join splits them over tasks.
    """
    return null_safe_join(rows, table.drop(n_rows), on, how)


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    spread=None, min_rows: int | None = None, n: str | None = None, weight: str | None = None) -> DataFrame:
    """Exact quantiles per group, linear between neighbours.

    ``probs`` maps output names to probabilities; ``n`` optionally names a count. A row
    stands for as many as its ``weight`` (a whole number) says.
    """
    rows = df.filter(F.col(value).isNotNull())
    times = F.sum(weight) if weight else F.count(F.lit(1))
    if not wants_spread(df, spread):
        names = list(probs)
        q = F.percentile(value, F.array(*[F.lit(float(probs[k])) for k in names]), F.col(weight) if weight else F.lit(1))
        out = rows.groupBy(*keys).agg(q.alias("__q"), times.alias("__n"))
        cols = [F.get("__q", i).alias(k) for i, k in enumerate(names)]
        return out.select(*keys, *cols, *([F.col("__n").alias(n)] if n else []))

    compact = rows.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(
        times.alias("__c"))
    run = prefix_counts(compact, keys, "__v", ["__c"], True, min_rows)
    aggs, cols = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("__c_total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("__c_before") <= at) & (at < F.col("__c_before") + F.col("__c"))
            aggs.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{side}{i}"))
        frac = F.lit(float(p)) * (F.col("__t") - 1)
        frac = frac - F.floor(frac)
        cols.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * frac).alias(name))
    out = run.groupBy(*keys).agg(F.max("__c_total").alias("__t"), *aggs)
    return out.select(*keys, *cols, *([F.col("__t").alias(n)] if n else []))


def wide_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: dict[str, float],
                   spread=None) -> DataFrame:
    """Quantiles of several columns at once: ``<column>_<name>`` per group."""
    names = list(probs)
    if not wants_spread(df, spread):
        ps = F.array(*[F.lit(float(probs[k])) for k in names])
        out = df.groupBy(*keys).agg(*[F.percentile(c, ps).alias(c) for c in columns])
        return out.select(*keys, *[F.get(F.col(c), i).alias(f"{c}_{k}")
                                   for c in columns for i, k in enumerate(names)])
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "__m", "__x")
    q = group_quantiles(long, [*keys, "__m"], "__x", probs, True)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("__m") == c, F.col(k))).alias(f"{c}_{k}")
                                  for c in columns for k in names])


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank",
                 n: str | None = None, spread=None, min_rows: int | None = None) -> DataFrame:
    """Rank from 1 within the group, ties share their mean rank."""
    spread = wants_spread(df, spread)
    if not spread and keys:
        order = Window.partitionBy(*keys).orderBy(value)
        peers = Window.partitionBy(*keys, value)
        res = df.withColumn(
            out, F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0))
        return res.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if n else res
    # Without keys one window would hold whole rows in one task: only counted values meet there.
    compact = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_rows"))
    run = prefix_counts(compact, keys, value, ["n_rows"], spread, min_rows).select(
        *keys, value, "n_rows",
        (F.col("n_rows_before") + (F.col("n_rows") + 1) / F.lit(2.0)).alias(out),
        *([F.col("n_rows_total").alias(n)] if n else []),
    )
    return lookup_join(df, run, [*keys, value])


def row_numbers(df: DataFrame, keys: list[str], order: Column, out: str, spread=None,
                min_rows: int | None = None) -> DataFrame:
    """Dense 1..n by ``order`` (a scalar or struct that is unique within the group)."""
    work = df.withColumn("__o", order)
    work, ks = (work.withColumn(_ALL, F.lit(0)), [_ALL]) if not keys else (work, list(keys))
    if not wants_spread(df, spread):
        return work.withColumn(
            out, F.row_number().over(Window.partitionBy(*ks).orderBy("__o"))).drop("__o", _ALL)
    bucketed = with_buckets(work, ks, "__o", min_rows)
    totals = bucketed.groupBy(*ks, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    across = Window.partitionBy(*ks).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*ks, "__bucket",
                            F.coalesce(F.sum("__c").over(across), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*ks, "__bucket").orderBy("__o")
    return (
        null_safe_join(bucketed, offsets, [*ks, "__bucket"])
        .withColumn(out, (F.col("__off") + F.row_number().over(inside)).cast("long"))
        .drop("__o", "__bucket", "__off", _ALL)
    )
