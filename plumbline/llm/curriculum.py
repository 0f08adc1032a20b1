"""Mixing sources to target weights under a time-varying curriculum.

Every source has a weight, which sets how many words of it the whole training takes, and
a schedule, which says when. A schedule is a list of weights at evenly spaced points of
training time 0 to 1, linear in between. Its integral up to time t, scaled to the source's
target, is the demand for the source's words by then. A source's documents stand in the
order of a hash; the word at which a document starts, looked up in the inverted demand,
is the document's position in training. A source that is taken more than once goes
through the same order again. Sorting all positions by range gives the training order.

Only columns of words and hashes move: a source is cut into a fixed number of ranges of
the hash, the totals of the ranges say where each one starts, and the running sums inside
them run side by side, so a source with a third of all documents is many tasks. Rows that
agree in everything are counted first and told apart at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

#: Ranges of the hash that each source is cut into.
RANGES = 1024

#: Weights by place of the source in the order of code points, and schedules likewise.
WEIGHTS = (3, 1, 2)
SCHEDULES = ((1.0, 1.0, 1.0), (0.25, 1.0, 1.75), (1.75, 1.0, 0.25))

WORDS = r"[^\x20\x09-\x0D]+"

_SOURCE = ["no_source", "source_key"]


def _checked(weights, share: float, most: float, schedules, ranges: int) -> int:
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    if not 0 < share <= most:
        raise ValueError("the share must be above 0 and at most what a source may be repeated")
    if any(len(s) < 2 or min(s) < 0 or sum(s[1:-1]) + (s[0] + s[-1]) / 2 <= 0 for s in schedules):
        raise ValueError("a schedule needs two weights or more, none below 0, and a positive integral")
    if not 1 <= ranges <= 1 << 24:
        raise ValueError("ranges must be 1 to 2^24")
    return int(-(-most // 1))


def position(share_taken: Column, schedule: tuple[float, ...]) -> Column:
    """Training time at which the demand of a schedule has reached a share (0 to 1) of its total.

    The demand is the schedule's integral; within a segment of width 1 it grows by
    p u + (q - p) u^2 / 2, which is solved for u.
    """
    area = [0.0]
    for p, q in zip(schedule[:-1], schedule[1:]):
        area.append(area[-1] + (p + q) / 2)
    wanted = share_taken * F.lit(area[-1])
    out = F.lit(1.0)
    for i in reversed(range(len(schedule) - 1)):
        p, q = schedule[i], schedule[i + 1]
        if p + q == 0:
            continue
        rest = wanted - F.lit(area[i])
        root = F.sqrt(F.greatest(F.lit(p * p) + F.lit(2.0 * (q - p)) * rest, F.lit(0.0)))
        inside = F.when(F.lit(p) + root > 0, F.lit(2.0) * rest / (F.lit(p) + root)).otherwise(F.lit(0.0))
        out = F.when(wanted < F.lit(area[i + 1]), (F.lit(float(i)) + inside) / F.lit(float(len(schedule) - 1))).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, schedules: int = 1) -> DataFrame:
    """Adds weight, target and schedule number to a table of one row per source (no_source, source_key, source_size).

    Targets share ``share`` times all sizes by weight, none above ``most`` times its
    source's size; what is over goes to the others by weight. In the order of size over
    weight the capped sources come first, so the level that the others reach is the
    greatest of the levels each source would see as the first uncapped one.
    """
    by_name = Window.orderBy(*_SOURCE)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    named = sizes.select(*_SOURCE, "source_size", weight.alias("weight"), F.pmod(F.row_number().over(by_name) - 1, F.lit(schedules)).alias("schedule"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), *_SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(by_level), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
    levels = named.withColumn("level", level)
    return levels.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.max("level").over(everything) * F.col("weight"))).drop("level")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5,
        most: float = 2.0, schedules=SCHEDULES, ranges: int = RANGES) -> DataFrame:
    """One row per row of ``df``: key, source, size, source_size, target, taken, visits; sorted by the first visit.

    ``visits`` lists (pass, words, position): the words that a pass takes of the document
    (all, but for the one in which the source's target is reached) and its training time.
    ``taken`` is their sum; a source's sum is its target, halves rounded up. Size is the
    number of runs without white space; a null or empty text has size 0 and is never
    visited. A null source is a source of its own, the last; a null key is kept. Rows that
    agree in key, source and text are interchangeable. An empty table gives an empty one;
    further columns are ignored. ``weights`` and ``schedules`` repeat over the sources in
    the order of code points.
    """
    passes = _checked(weights, share, most, schedules, ranges)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))
    rows = df.select(F.col(key).alias("key"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_key"),
                     F.regexp_count(body, F.lit(WORDS)).cast("long").alias("size"), order.alias("order"), F.spark_partition_id().alias("part"))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("order", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int"))
    rows = cut_lineage(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows")), "mix")

    of_range = rows.groupBy(*_SOURCE, "range").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    of_source = targets(of_range.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), weights, share, most, len(schedules))
    before = Window.partitionBy(*_SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_range.select(*_SOURCE, "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("range_start")).join(of_source, _SOURCE)

    run = Window.partitionBy(*_SOURCE, "range").orderBy("order", "part", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, [*_SOURCE, "range"]).withColumn("first", F.col("range_start") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(run), F.lit(0)))
    # A row stands for equal rows of one input partition.
    single = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    limit = F.floor(F.col("target") + 0.5).cast("long")

    def visit(i: int) -> Column:
        start = F.col("source_size") * i + F.col("first") + F.col("i") * F.col("size")
        words = F.greatest(F.least(limit - start, F.col("size")), F.lit(0).cast("long"))
        reached = start / F.col("target")
        when = None
        for number, schedule in enumerate(schedules):
            here = position(reached, tuple(schedule))
            when = here if when is None else F.when(F.col("schedule") == number, here).otherwise(when)
        return F.struct(F.lit(i).alias("pass"), words.alias("words"), F.when(words > 0, when).alias("position"))

    visits = F.filter(F.array(*[visit(i) for i in range(passes)]), lambda v: v["words"] > 0)
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda total, v: total + v["words"])
    # What is never visited is sorted by its hash: a range of its own for every share of it.
    return single.withColumn("visits", visits).withColumn("taken", taken).orderBy(F.get("visits.position", 0).asc_nulls_last(), "order").select(
        F.col("key").alias(key), F.when(~F.col("no_source"), F.col("source_key")).alias(source), "size", "source_size", "target", "taken", "visits")


def training_order(mixed: DataFrame) -> DataFrame:
    """Every visit as a row, range-sorted by its position: what the training reads, in order."""
    return mixed.select(*[c for c in mixed.columns if c != "visits"], F.explode("visits").alias("v")).select(
        *[c for c in mixed.columns if c != "visits"], F.col("v.pass"), F.col("v.words"), F.col("v.position")).orderBy("position")
