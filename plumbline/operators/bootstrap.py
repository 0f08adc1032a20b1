"""Bootstrap intervals as joins: replicates are rows, draws are hashes.

Draw j of replicate r is a hash of (seed, r, j), so any engine repeats it and no
task owns a random stream. Draws travel packed to the block of their unit, where they
are counted as a matrix (unit, replicate) and meet the unit's values; what goes on is
counted per value, and ranked for all replicates at once in ranges of the values.

The compact forms draw counts instead of rows: a binomial split tree over ranges of the
distinct values, and a multinomial inside a range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import is_finite
from ..runtime import cut_lineage
from .ordering import bucket_cuts, group_quantiles, in_buckets, row_numbers, wants_spread, with_buckets
from .stats import mann_whitney_counts


def _numbered(df: DataFrame, order: list[str], spread) -> tuple[DataFrame, int]:
    """Rows with a stable index 0..n-1 and their number."""
    n = df.count()
    return row_numbers(df, [], F.struct(*order), "__i", spread).withColumn(
        "__i", F.col("__i") - 1), n


#: Draws that a task holds before it deals them to blocks of units; cells (replicates times units, or values) of one block, or one range of values.
DRAWS_AT_ONCE, BLOCK_CELLS = 1 << 22, 1 << 21
#: Tasks that add up the counts of a range of values before its replicates are ranked.
SHARES = 64


def draws(n: int, seed: int, label: str, replicate: int, first: int, last: int) -> np.ndarray:
    """The rows drawn by draws ``first`` to ``last`` - 1 of a replicate: ``identity.hash_draw`` of (label, seed, replicate, draw)."""
    start = f"{label}|{seed}|{replicate}|".encode()
    found = b"".join([hashlib.md5(b"%s%d" % (start, j), usedforsecurity=False).digest() for j in range(first, last)])
    return (np.frombuffer(found, ">u8")[::2] >> np.uint64(16)).astype(np.int64) % n


def packed_draws(spark, n: int, n_boot: int, seed: int, label: str) -> DataFrame:
    """(block, cells): all draws dealt to blocks of units, four bytes each; a cell is unit of the block * n_boot + replicate.

    A task has a run of the draws of all replicates, so even one replicate of many rows is
    spread over tasks.
    """
    if n <= 0:
        raise ValueError("nothing to resample")
    size, every, step = _block_units(n_boot), n_boot * n, DRAWS_AT_ONCE // 16

    def deal(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        unit, replicate = np.concatenate([u for u, _r in held]), np.concatenate([np.full(len(u), r) for u, r in held])
        block = (unit // size).astype(np.int32)
        order = np.argsort(block, kind="stable")
        block, cell = block[order], (unit % size * n_boot + replicate).astype(np.int32)[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        cells = [c.tobytes() for c in np.split(cell, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(cells, pa.binary())], names=["block", "cells"])

    def pack(batches):
        held, rows = [], 0
        for batch in batches:
            for run in batch.column("id").to_pylist():
                at, end = run * step, min(every, (run + 1) * step)
                while at < end:
                    replicate, j = divmod(at, n)
                    stop = min(n, j + end - at)
                    held.append((draws(n, seed, label, replicate, j, stop), replicate))
                    at += stop - j
                rows += end - run * step
                if rows >= DRAWS_AT_ONCE:
                    yield deal(held)
                    held, rows = [], 0
        if held:
            yield deal(held)

    runs = -(-every // step)
    tasks = max(min(runs, spark.sparkContext.defaultParallelism), -(-every // DRAWS_AT_ONCE))
    return spark.range(0, runs, 1, tasks).mapInArrow(pack, "block int, cells binary")


def _block_units(n_boot: int) -> int:
    return max(1, BLOCK_CELLS // n_boot)


def _resampled(members: DataFrame, n: int, n_boot: int, seed: int, label: str, add, schema: str) -> DataFrame:
    """``add(block, times, rows)`` for every block of units, with the rows of ``members`` (which has __i) and how often each unit is drawn.

    ``times`` is (unit, replicate), ``rows.unit`` the number in it. Draws travel as four
    bytes each and meet their block once; a block with many members is several tasks.
    """
    size = _block_units(n_boot)
    placed = members.withColumns({"block": F.expr(f"CAST(__i div {size} AS INT)"), "unit": F.expr(f"CAST(__i % {size} AS INT)")}).drop("__i")
    slices = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (8 * size)).cast("int").alias("slices"))
    packed = packed_draws(members.sparkSession, n, n_boot, seed, label).join(F.broadcast(slices), "block").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    rows = placed.join(F.broadcast(slices), "block").withColumn(
        "slice", F.pmod(F.xxhash64("unit", "v"), F.col("slices")).cast("int")).drop("slices")

    def count(key, drawn: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if drawn.empty or rows.empty:
            return pd.DataFrame()
        cells = np.frombuffer(b"".join(drawn["cells"]), np.int32)
        return add(int(key[0]), np.bincount(cells, minlength=size * n_boot).reshape(size, n_boot), rows)

    return packed.groupBy("block", "slice").cogroup(rows.groupBy("block", "slice")).applyInPandas(count, schema)


def _sums(times: np.ndarray, units: np.ndarray, weights: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """(group, replicate): weights of the drawn units; ``groups`` is in order, 0 to n - 1."""
    out = np.zeros((n, times.shape[1]), np.int64)
    for at in range(0, len(units), len(times)):
        part = slice(at, at + len(times))
        of = groups[part]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] += np.add.reduceat(times[units[part]] * weights[part, None], first, axis=0)
    return out


_COUNTS = "range int, share int, held binary, counts binary, kind string"


def _counts_row(which: int, share: int, values: np.ndarray, counts: np.ndarray) -> tuple:
    """Values of a range and their (pos or neg, value, replicate) counts, in as few bytes each as they need."""
    kind = np.min_scalar_type(int(counts.max(initial=0))).str
    return which, share, values.tobytes(), counts.astype(kind).tobytes(), kind


def _merged(rows: pd.DataFrame, n_boot: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of several such rows, in order, and the sums of their counts."""
    held = [np.frombuffer(b, np.float64) for b in rows["held"]]
    values = np.unique(np.concatenate(held))
    out = np.zeros((2, len(values), n_boot), np.int64)
    for some, counts, kind in zip(held, rows["counts"], rows["kind"]):
        out[:, np.searchsorted(values, some)] += np.frombuffer(counts, kind).reshape(2, len(some), n_boot)
    return values, out


def _auc_interval(sides: list[tuple[DataFrame, int, str]], n_boot: int, seed: int) -> DataFrame:
    """2.5 and 97.5 percentiles of the AUC. A side is its members (__i, v, pos, neg), its number of units and its label.

    The distinct values are cut into ranges. Counts are added up per block of units and
    range, then per range, where a task ranks all replicates; only totals go on.
    """
    sides = [(cut_lineage(members.select(F.col("__i"), F.col("v"), F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg")), "members"), n, label)
             for members, n, label in sides]
    every = sides[0][0].select("v")
    for members, _n, _label in sides[1:]:
        every = every.unionByName(members.select("v"))
    cuts = bucket_cuts(every.distinct().withColumn("__all", F.lit(0)), ["__all"], "v", _block_units(n_boot))
    n_ranges = cuts.select(F.max(F.size("__cuts"))).first()[0] or 0
    shares = max(1, SHARES // (n_ranges + 1))

    def count(block, times, rows):
        rows, out = rows.sort_values(["range", "v"]), []
        for which, part in rows.groupby("range", sort=False):
            values, of = np.unique(part["v"].to_numpy(), return_inverse=True)
            units = part["unit"].to_numpy()
            out.append(_counts_row(which, block % shares, values, np.stack(
                [_sums(times, units, part[c].to_numpy(), of, len(values)) for c in ("pos", "neg")])))
        return pd.DataFrame(out, columns=["range", "share", "held", "counts", "kind"])

    def merge(key, rows):
        return pd.DataFrame([_counts_row(int(key[0]), int(key[1]), *_merged(rows, n_boot))], columns=["range", "share", "held", "counts", "kind"])

    def rank(key, rows):
        _values, (pos, neg) = _merged(rows, n_boot)
        wins = (pos * (np.cumsum(neg, axis=0) - neg + 0.5 * neg)).sum(0)
        return pd.DataFrame({"replicate": np.arange(n_boot), "range": int(key[0]), "pos": pos.sum(0), "neg": neg.sum(0), "wins": wins})

    parts = None
    for members, n, label in sides:
        cut = in_buckets(members.withColumn("__all", F.lit(0)), cuts, ["__all"], "v", "range").drop("__all")
        one = _resampled(cut.withColumn("range", F.col("range").cast("int")), n, n_boot, seed, label, count, _COUNTS)
        parts = one if parts is None else parts.unionByName(one)
    if shares > 1:
        parts = parts.groupBy("range", "share").applyInPandas(merge, _COUNTS)
    ranked = parts.groupBy("range").applyInPandas(rank, "replicate long, range int, pos long, neg long, wins double")
    below = Window.partitionBy("replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    won = ranked.withColumn("wins", F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0)))
    total = won.groupBy("replicate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"))
    enough = (F.col("pos") >= 2) & (F.col("neg") >= 2)
    one = total.select(F.when(enough, F.col("wins") / (F.col("pos") * F.col("neg")).cast("double")).alias("auc"), F.lit(0).alias("__all"))
    return group_quantiles(one, ["__all"], "auc", {"ci_low": .025, "ci_high": .975}, False, n="n_boot").drop("__all")


def bootstrap_auc(df: DataFrame, value: str, positive: str, id_col: str, n_boot: int = 2000, seed: int = 42,
                  spread=None) -> DataFrame:
    """iid resampling of both groups."""
    ok = df.filter(is_finite(F.col(value))).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"),
                                                   F.col(positive).alias("p"))
    spread = wants_spread(df, spread)
    pos, n_pos = _numbered(ok.filter("p").select("id", "v"), ["id"], spread)
    neg, n_neg = _numbered(ok.filter(~F.col("p")).select("id", "v"), ["id"], spread)
    return _auc_interval([(_one_each(pos, 1, 0), n_pos, "pos"), (_one_each(neg, 0, 1), n_neg, "neg")], n_boot, seed)


def _one_each(rows: DataFrame, pos: int, neg: int) -> DataFrame:
    return rows.select("__i", "v", F.lit(pos).alias("pos"), F.lit(neg).alias("neg"))


def bootstrap_auc_clustered(df: DataFrame, value: str, positive: str, id_col: str, cluster: str,
                            n_boot: int = 2000, seed: int = 42, spread=None) -> DataFrame:
    """Positives resampled by cluster, the rest iid; under 3 clusters a flagged row without interval."""
    ok = df.filter(is_finite(F.col(value))).select(
        F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"), F.col(positive).alias("p"),
        F.col(cluster).alias("c"))
    spread = wants_spread(df, spread)
    pos = ok.filter("p")
    names, n_clusters = _numbered(pos.select("c").distinct(), ["c"], spread)
    fallback = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"),
        F.lit(0).cast("long").alias("n_boot"), F.lit(n_clusters).alias("n_clusters"),
        F.lit(False).alias("cluster_bootstrap"))
    if n_clusters < 3:
        return fallback
    # Counted per (cluster, value): a cluster with a third of all rows stays small.
    members = pos.groupBy("c", "v").agg(F.count(F.lit(1)).alias("m"))
    drawn = names.join(members, "c").select("__i", "v", F.col("m").alias("pos"), F.lit(0).alias("neg"))
    neg, n_neg = _numbered(ok.filter(~F.col("p")).select("id", "v"), ["id"], spread)
    out = _auc_interval([(drawn, n_clusters, "cluster"), (_one_each(neg, 0, 1), n_neg, "neg")], n_boot, seed)
    return out.withColumns({"n_clusters": F.lit(n_clusters), "cluster_bootstrap": F.lit(True)})


def bootstrap_auc_by_unit(df: DataFrame, unit: str, value: str, positive: str, n_boot: int = 2000, seed: int = 42,
                          spread=None) -> DataFrame:
    """Units are resampled, each brings all its positives and negatives."""
    ok = df.filter(is_finite(F.col(value)))
    spread = wants_spread(df, spread)
    both = ok.groupBy(F.col(unit).alias("u")).agg(
        F.count_if(F.col(positive)).alias("a"), F.count_if(~F.col(positive)).alias("b"))
    usable = both.filter((F.col("a") > 0) & (F.col("b") > 0)).select("u")
    names, n_units = _numbered(usable, ["u"], spread)
    if n_units < 2:
        return df.sparkSession.range(1).select(
            F.lit(n_units).alias("n_units"), F.lit(None).cast("double").alias("auc"),
            F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"),
            F.lit(0).cast("long").alias("n_boot"))
    members = ok.withColumn("u", F.col(unit)).join(usable, "u", "left_semi").groupBy(
        "u", F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    whole = members.groupBy("v").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("__one", F.lit(0))
    point = mann_whitney_counts(whole, ["__one"], None, spread).select("auc")
    ci = _auc_interval([(names.join(members, "u"), n_units, "unit")], n_boot, seed)
    return point.crossJoin(F.broadcast(ci)).withColumn("n_units", F.lit(n_units))


def paired_bootstrap(df: DataFrame, value: str, id_col: str, n_boot: int = 2000, seed: int = 42,
                     spread=None) -> DataFrame:
    """Mean, median, interval of the mean and share above zero of paired differences."""
    ok = df.filter(is_finite(F.col(value))).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"))
    spread = wants_spread(df, spread)
    rows, n = _numbered(ok, ["id"], spread)
    base = ok.withColumn("__all", F.lit(0))
    point = base.groupBy("__all").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
                                      F.avg((F.col("v") > 0).cast("double")).alias("fraction_positive"))
    point = point.join(group_quantiles(base, ["__all"], "v", {"median": .5}, spread), "__all")
    if n < 2:
        return point.select("n", *[F.lit(None).cast("double").alias(c) for c in (
            "mean", "median", "fraction_positive", "ci_low", "ci_high")])

    def total(_block, times, rows):
        return pd.DataFrame({"replicate": np.arange(n_boot), "total": rows["v"].to_numpy() @ times[rows["unit"].to_numpy()]})

    sums = _resampled(cut_lineage(rows.select("__i", "v"), "differences"), n, n_boot, seed, "pair", total, "replicate long, total double")
    means = sums.groupBy("replicate").agg((F.sum("total") / float(n)).alias("m")).withColumn("__all", F.lit(0))
    ci = group_quantiles(means, ["__all"], "m", {"ci_low": .025, "ci_high": .975}, False)
    return point.join(ci, "__all").drop("__all")


#: Distinct values of a range; all replicates of a range are drawn by one task.
RANGE_VALUES = 512


def _stream(seed: int, label: str, *node) -> np.random.Generator:
    """The random numbers of one node of the split tree, the same wherever they are asked for."""
    name = hashlib.blake2b(repr((seed, label, *node)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(name, "little")))


def split_draws(totals: np.ndarray, which: int, n_boot: int, seed: int, label: str) -> np.ndarray:
    """How many of the draws of every replicate fall into range ``which`` of ranges that hold ``totals`` rows.

    The draws are split in two again and again, a binomial at every node of a tree over
    the ranges, so a range needs the nodes above it only and all ranges agree.
    """
    sums = np.concatenate(([0], np.cumsum(totals)))
    lo, hi = 0, len(totals)
    counts = np.full(n_boot, sums[-1], np.int64)
    while hi - lo > 1:
        middle, whole = (lo + hi) // 2, sums[hi] - sums[lo]
        left = _stream(seed, label, lo, hi).binomial(counts, (sums[middle] - sums[lo]) / whole if whole else 0.0)
        counts, lo, hi = (left, lo, middle) if which < middle else (counts - left, middle, hi)
    return counts


def value_draws(rows: np.ndarray, totals: np.ndarray, which: int, n_boot: int, seed: int, label: str) -> np.ndarray:
    """(replicate, value): how often each of a range's values, held by ``rows`` rows each, is drawn."""
    counts = split_draws(totals, which, n_boot, seed, label)
    if not rows.sum():
        return np.zeros((n_boot, len(rows)), np.int64)
    return _stream(seed, label, "in", which).multinomial(counts, rows / rows.sum())


def _ranged(compact: DataFrame, range_values: int) -> DataFrame:
    """Distinct values with the number of their range, written once."""
    cut = with_buckets(compact.withColumn("__all", F.lit(0)), ["__all"], "v", range_values).drop("__all")
    return cut_lineage(cut.withColumnRenamed("__bucket", "range"), "values")


def _range_totals(ranged: DataFrame, *columns: str) -> tuple[list[int], list[np.ndarray]]:
    """Rows of each range: at most 2^16 small numbers."""
    found = ranged.groupBy("range").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("range").toArrow()
    return found.column("range").to_pylist(), [found.column(c).to_numpy().astype(np.int64) for c in columns]


def bootstrap_auc_compact(df: DataFrame, value: str, positive: str, n_boot: int = 2000, seed: int = 42, range_values: int = RANGE_VALUES) -> DataFrame:
    """``bootstrap_auc`` over distinct values: exact multinomial counts by a binomial split tree.

    Work and memory follow the number of distinct values and of replicates; what is
    shuffled is one row per replicate and range. Rows with a null or non-finite value take
    no part; without a positive or without another row the interval is null.
    """
    ok = df.filter(is_finite(F.col(value)) & F.col(positive).isNotNull())
    ranged = _ranged(ok.groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg")), range_values)
    names, (pos, neg) = _range_totals(ranged, "pos", "neg")
    if not names or not pos.sum() or not neg.sum():
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"), F.lit(0).cast("long").alias("n_boot"))
    place = {name: i for i, name in enumerate(names)}

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")
        which = place[int(rows["range"].iloc[0])]
        a = value_draws(rows["pos"].to_numpy(np.int64), pos, which, n_boot, seed, "pos")
        b = value_draws(rows["neg"].to_numpy(np.int64), neg, which, n_boot, seed, "neg")
        wins = (a * (np.cumsum(b, axis=1) - b + 0.5 * b)).sum(1)
        return pd.DataFrame({"replicate": np.arange(n_boot), "range": which, "pos": a.sum(1), "neg": b.sum(1), "wins": wins})

    parts = ranged.groupBy("range").applyInPandas(draw, "replicate long, range int, pos long, neg long, wins double")
    below = Window.partitionBy("replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    won = parts.select("replicate", (F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0))).alias("wins"))
    auc = won.groupBy("replicate").agg((F.sum("wins") / float(pos.sum()) / float(neg.sum())).alias("auc")).withColumn("__all", F.lit(0))
    return group_quantiles(auc, ["__all"], "auc", {"ci_low": .025, "ci_high": .975}, False, n="n_boot").drop("__all")


def paired_bootstrap_compact(df: DataFrame, value: str, n_boot: int = 2000, seed: int = 42, range_values: int = RANGE_VALUES) -> DataFrame:
    """``paired_bootstrap`` over distinct differences, drawn as in ``bootstrap_auc_compact``."""
    ok = df.filter(is_finite(F.col(value)))
    ranged = _ranged(ok.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), range_values)
    names, (n,) = _range_totals(ranged, "n")
    point = ranged.withColumn("__all", F.lit(0)).groupBy("__all").agg(
        F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction_positive"))
    if not names or n.sum() < 2:
        few = df.sparkSession.range(1).select(F.lit(int(n.sum())).cast("long").alias("n"))
        return few.select("n", *[F.lit(None).cast("double").alias(c) for c in ("mean", "median", "fraction_positive", "ci_low", "ci_high")])
    place = {name: i for i, name in enumerate(names)}

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        which = place[int(rows["range"].iloc[0])]
        rows = rows.sort_values("v")
        times = value_draws(rows["n"].to_numpy(np.int64), n, which, n_boot, seed, "pair")
        return pd.DataFrame({"replicate": np.arange(n_boot), "total": times @ rows["v"].to_numpy()})

    means = ranged.groupBy("range").applyInPandas(draw, "replicate long, total double").groupBy("replicate").agg(
        (F.sum("total") / float(n.sum())).alias("m")).withColumn("__all", F.lit(0))
    ci = group_quantiles(means, ["__all"], "m", {"ci_low": .025, "ci_high": .975}, False)
    median = group_quantiles(ok.withColumn("__all", F.lit(0)), ["__all"], value, {"median": .5})
    return point.join(median, "__all").join(ci, "__all").select("n", "mean", "median", "fraction_positive", "ci_low", "ci_high")
