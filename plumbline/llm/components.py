"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import null_safe_join
from ..runtime import cut_lineage, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours are tied to its least one. Small: its smaller ones.

    The minimum is a partial aggregate. The join behind it has one row per node on one
    side and does not share the aggregate's exchange, so the rows of a node with very many
    neighbours are split as those of any skewed join.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = null_safe_join(both, least, ["a"])
    if large:
        return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        tied.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """True if all components are stars: every node has one edge to a lesser one, or is the lesser one of its edges."""
    uses = edges.select(F.col("a").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return uses.groupBy("id").agg(F.sum("low").alias("low"), F.max("high").alias("high")).filter("low > 1 OR low = 1 AND high = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge; a component is named by its least node.

    Loops and repeated edges do no harm. Every round is written to the shared folder, and the
    one before it is deleted.
    """
    large, small = F.greatest(a, b), F.least(a, b)
    now = cut_lineage(edges.select(large.alias("a"), small.alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        before, now = now, cut_lineage(_star(_star(now, True), False), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
