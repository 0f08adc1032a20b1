"""Secondary-structure elements from dot-bracket strings, with windows only.

Every step is keyed by the structure, so one exchange of the (short) strings serves
all windows and aggregates that follow. Identical strings are parsed once:
``structure_features`` works on distinct strings and joins the result back.

Element kinds: s stem, h hairpin loop, i interior loop or bulge, m segment of a
junction (zero length included), f and t the unpaired ends.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from ..functions import geometry as G
from .ordering import group_quantiles, lookup_join, wants_spread



def positions(structures: DataFrame, id_col: str, dot: str) -> DataFrame:
    """(id, i, c): one row per position, 1-based, laid out by structure."""
    return (
        structures.select(F.col(id_col), F.col(dot).alias("__s")).repartition(id_col)
        .selectExpr(f"`{id_col}`", "posexplode(split(__s, '')) AS (__p, c)")
        .selectExpr(f"`{id_col}`", "__p + 1 AS i", "c")
    )


def match_brackets(structures: DataFrame, id_col: str = "candidate_id", dot: str = "dot_bracket") -> DataFrame:
    """(id, i, j, depth): the pair table. The k-th opening bracket of a depth meets
    the k-th closing bracket of that depth."""
    key = f"`{id_col}`"
    deep = positions(structures, id_col, dot).selectExpr(
        key, "i", "c", f"""sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
            OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING)
            + CASE c WHEN ')' THEN 1 ELSE 0 END AS depth""").filter("c <> '.'")
    numbered = deep.selectExpr(
        key, "i", "depth", f"row_number() OVER (PARTITION BY {key}, depth, c ORDER BY i) AS k")
    return numbered.groupBy(id_col, "depth", "k").agg(F.expr("min(i) AS i"), F.expr("max(i) AS j")).selectExpr(
        key, "i", "j", "CAST(depth AS INT) AS depth")


def stems(pairs: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """(id, stem, i1, j1, i2, j2, bp): runs of pairs (i, j), (i+1, j-1), ..."""
    key = f"`{id_col}`"
    return (
        pairs.selectExpr(
            key, "i", "j",
            "coalesce(lag(i) OVER w = i - 1 AND lag(j) OVER w = j + 1, false) AS follows".replace(
                "OVER w", f"OVER (PARTITION BY {key} ORDER BY i)"))
        .selectExpr(key, "i", "j", f"""CAST(sum(CASE WHEN follows THEN 0 ELSE 1 END)
            OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS INT) AS stem""")
        .groupBy(id_col, "stem").agg(
            F.expr("min(i) AS i1"), F.expr("max(j) AS j1"), F.expr("max(i) AS i2"), F.expr("min(j) AS j2"),
            F.expr("CAST(count(*) AS INT) AS bp"))
    )


_ELEMENT = "struct<kind:string,a:int,b:int,size:int,bp:int,left:int,right:int,stem:int,a_start:int,b_start:int>"


def _element(kind, a_start, a, left, right, b="NULL", b_start="NULL", bp="NULL", stem="NULL", size=None):
    size = size or (a if b == "NULL" else f"({a}) + ({b})")
    return (f"CAST(struct('{kind}', {a}, {b}, {size}, {bp}, {left}, {right}, {stem}, {a_start}, {b_start}) "
            f"AS {_ELEMENT})")


def elements(structures: DataFrame, id_col: str = "candidate_id", dot: str = "dot_bracket",
             count_exterior_segments: bool = True) -> DataFrame:
    """(id, kind, a, b, size, bp, left, right, stem, a_start, b_start): every element.

    ``a`` and ``b`` are strand lengths (b null for one strand) with their first
    positions, ``left`` and ``right`` the stems an unpaired element touches,
    ``stem`` the number of a stem.
    """
    key = f"`{id_col}`"
    found = stems(match_brackets(structures, id_col, dot), id_col)
    listed = found.groupBy(id_col).agg(
        F.expr("array_sort(collect_list(struct(i1, j1, i2, j2, stem, bp))) AS st"))
    base = structures.selectExpr(key, f"length(`{dot}`) AS n").repartition(id_col).join(listed, id_col, "left")
    # The parent of a stem is the last stem that encloses it; a string without any
    # pair keeps one row with nulls.
    nodes = (
        base.selectExpr(key, "n", "st", "explode_outer(st) AS s")
        .selectExpr(
            key, "n", "s.*",
            "NOT exists(st, t -> t.i1 > s.i2 AND t.j1 < s.j2) AS leaf",
            "try_element_at(filter(st, t -> t.i2 < s.i1 AND t.j2 > s.j1), -1) AS p")
        .selectExpr(
            key, "n", "stem", "i1", "j1", "i2", "j2", "bp", "leaf", "coalesce(p.stem, 0) AS up",
            "coalesce(p.i2, 0) AS open", "coalesce(p.j2, n + 1) AS close")
        .selectExpr(
            "*", *[f"{e} OVER (PARTITION BY {key}, up ORDER BY i1) AS {name}" for e, name in (
                ("lag(j1)", "prev_end"), ("lag(stem)", "prev_stem"), ("lead(stem)", "next_stem"))],
            f"count(*) OVER (PARTITION BY {key}, up) AS kids")
        .selectExpr("*", "coalesce(prev_end, open) + 1 AS gap", "i1 - coalesce(prev_end, open) - 1 AS before",
                    "close - j1 - 1 AS after", "j1 + 1 AS tail")
    )
    junction = "up > 0 AND kids > 1"
    segment = "up = 0 AND prev_stem IS NOT NULL" if count_exterior_segments else "false"
    made = ", ".join([
        _element("s", "i1", "NULL", "NULL", "NULL", b_start="j2", bp="bp", stem="stem", size="bp * 2"),
        f"CASE WHEN leaf THEN {_element('h', 'i2 + 1', 'j2 - i2 - 1', 'stem', 'NULL')} END",
        f"CASE WHEN up > 0 AND kids = 1 THEN {_element('i', 'gap', 'before', 'up', 'stem', b='after', b_start='tail')} END",
        f"CASE WHEN {junction} THEN {_element('m', 'gap', 'before', 'coalesce(prev_stem, up)', 'stem')} END",
        f"CASE WHEN {junction} AND next_stem IS NULL THEN {_element('m', 'tail', 'after', 'stem', 'up')} END",
        f"CASE WHEN up = 0 AND prev_stem IS NULL AND before > 0 THEN {_element('f', 'gap', 'before', 'NULL', 'stem')} END",
        f"CASE WHEN {segment} THEN {_element('m', 'gap', 'before', 'prev_stem', 'stem')} END",
        f"CASE WHEN up = 0 AND next_stem IS NULL AND after > 0 THEN {_element('t', 'tail', 'after', 'stem', 'NULL')} END",
    ])
    coil = _element("f", "1", "n", "NULL", "NULL")
    return nodes.selectExpr(
        key, f"explode(CASE WHEN stem IS NULL THEN array({coil}) ELSE array_compact(array({made})) END) AS e"
    ).selectExpr(key, "e.*")


def loops(structures: DataFrame, id_col: str = "candidate_id", dot: str = "dot_bracket") -> DataFrame:
    """(id, kind, size): every unpaired element."""
    return elements(structures, id_col, dot).filter(F.col("kind") != "s").select(id_col, "kind", "size")


_STATISTICS = (
    "count_if(kind = 'h') AS n_hairpins", "count_if(kind = 'i') AS n_interior",
    "count_if(kind = 'm') AS n_multiloop", "count_if(kind = 's') AS n_stems",
    "coalesce(sum(size) FILTER (WHERE kind = 's'), 0) AS stem_nt", "sum(size) AS n_nt",
    "coalesce(max(bp), 0) AS longest_stem_bp",
    "max(size) FILTER (WHERE kind IN ('h', 'i', 'm')) AS largest",
    "array_sort(collect_list(size) FILTER (WHERE kind IN ('h', 'i', 'm'))) AS sizes",
)


def _statistics() -> list:
    return [F.expr(e) for e in _STATISTICS]


def _finish(stats: DataFrame, id_col: str, *extra) -> DataFrame:
    return stats.select(
        F.col(id_col), *[F.expr(e) for e in (
            "n_hairpins", "n_interior", "n_multiloop", "n_stems",
            "stem_nt / nullif(n_nt, 0) AS stem_fraction", "longest_stem_bp",
            "CAST(CASE WHEN n_stems = 0 THEN n_nt ELSE coalesce(largest, 0) END AS INT) AS max_loop_nt",
            "CAST(n_nt - stem_nt AS INT) AS total_unpaired",
            "CASE WHEN n_stems = 0 AND n_nt > 0 THEN array(CAST(n_nt AS INT)) ELSE sizes END AS loop_sizes")],
        *extra)


def loop_statistics(elems: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Counts, stem fraction, longest stem, largest loop, unpaired, loop sizes.

    The elements cover every position once (the ends only when they exist), so the
    length of a string is the sum of its element sizes.
    """
    return _finish(elems.groupBy(id_col).agg(*_statistics()), id_col)


def element_string(elems: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """One letter per position: the strands of all elements, laid side by side."""
    laid = elems.selectExpr(f"`{id_col}`", """explode(filter(array(
        struct(a_start AS at, coalesce(bp, a) AS n, kind),
        struct(b_start AS at, coalesce(CASE WHEN kind = 's' THEN bp ELSE b END, 0) AS n, kind)), x -> x.n > 0)) AS x""")
    return laid.groupBy(id_col).agg(F.expr(
        "array_join(transform(array_sort(collect_list(x)), x -> repeat(x.kind, x.n)), '') AS element_string"))


@F.pandas_udf(T.DoubleType())
def _graph_rg(parts: pd.Series) -> pd.Series:
    """Radius of gyration of one element graph per entry.

    An entry lists (stem, left, right, mass, extent, rg). Distances run from centre
    to centre along the fewest elements; among equal hops the shortest counts.
    """
    return pd.Series([_element_graph_rg(list(items)) for items in parts], dtype=float)


def _element_graph_rg(items: list) -> float:
    """One breadth-first pass from each element, over lists of neighbours: elements times links."""
    total = float(sum(e["mass"] for e in items))
    if total <= 0:
        return 0.0
    at = {e["stem"]: x for x, e in enumerate(items) if e["stem"] is not None}
    near: list[set[int]] = [set() for _ in items]
    for x, e in enumerate(items):
        for s in (e["left"], e["right"]):
            if s is not None and s in at and at[s] != x:
                near[x].add(at[s])
                near[at[s]].add(x)
    half = [e["extent"] / 2 for e in items]
    mass = [e["mass"] for e in items]
    spread = 0.0
    for start in range(len(items)):
        known, ring = {start}, {start: 0.0}
        moment = 0.0
        while ring:
            step: dict[int, float] = {}
            for x, far in ring.items():
                for y in near[x]:
                    if y not in known:
                        reach = far + half[x] + half[y]
                        if y not in step or reach < step[y]:
                            step[y] = reach
            known.update(step)
            moment += sum(mass[y] * far * far for y, far in step.items())
            ring = step
        spread += mass[start] * moment
    own = sum(e["mass"] * e["rg"] * e["rg"] for e in items)
    return math.sqrt(spread / (2 * total * total) + own / total)


def _parts(a_per_nt: float, a_per_bp: float):
    kind = F.col("kind")
    reach = F.when(kind.isin("i", "m") & F.col("b").isNotNull() & (F.col("a") > 0) & (F.col("b") > 0),
                   F.least("a", "b")).otherwise(F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))))
    return F.collect_list(F.struct(
        "stem", "left", "right", F.col("size").alias("mass"),
        G.element_extent(kind, F.col("size"), reach, F.col("bp"), a_per_nt, a_per_bp).alias("extent"),
        G.element_rg(kind, F.col("size"), F.col("bp"), a_per_nt, a_per_bp).alias("rg"))).alias("parts")


def radius_of_gyration(elems: DataFrame, id_col: str = "candidate_id", a_per_nt: float = 6.0,
                       a_per_bp: float = 2.8) -> DataFrame:
    """(id, radius_of_gyration_A) from the element table.

    Elements of one structure are at most its length, so the list per structure is
    bounded; Spark distributes the structures.
    """
    parts = elems.groupBy(id_col).agg(_parts(a_per_nt, a_per_bp))
    return parts.select(id_col, _graph_rg("parts").alias("radius_of_gyration_A"))


def structure_features(df: DataFrame, dot: str = "dot_bracket", a_per_nt: float = 6.0,
                       a_per_bp: float = 2.8) -> DataFrame:
    """Add loop statistics and radius of gyration; each distinct string is parsed once."""
    distinct = df.groupBy(dot).agg(F.count(F.lit(1)).alias("n_rows"))
    strings = distinct.select(F.col(dot).alias("__id"), dot)
    parsed = elements(strings, "__id", dot).groupBy("__id").agg(*_statistics(), _parts(a_per_nt, a_per_bp))
    stats = _finish(parsed, "__id", _graph_rg("parts").alias("radius_of_gyration_A"))
    table = stats.withColumnRenamed("__id", dot).join(distinct, dot)
    # Written once: the look-up reads it from several branches.
    table = runtime.cut_lineage(table, "structures")
    return lookup_join(df, table, [dot])


def ensemble_stats(folds: DataFrame, samples: DataFrame, id_col: str = "candidate_id",
                   dot: str = "dot_bracket", spread=None) -> DataFrame:
    """Loop-size and size statistics over sampled structures.

    A candidate without samples falls back to its single structure, with spread 0
    and sample count 0.
    """
    tag = folds.select(id_col, dot, F.lit(True).alias("__single")).unionByName(
        samples.select(id_col, dot, F.lit(False).alias("__single")))
    parsed = structure_features(tag, dot).select(
        id_col, "__single", F.col("max_loop_nt").cast("double").alias("l"), F.col("radius_of_gyration_A").alias("r"))
    single = F.col("__single")
    own = [F.max(F.when(single, F.col("l"))).alias("l"), F.max(F.when(single, F.col("r"))).alias("r"),
           F.count_if(~single).alias("n")]
    probs = {"25": .25, "50": .5, "75": .75, "90": .9}
    if not wants_spread(samples, spread):
        ps = F.array(*[F.lit(p) for p in probs.values()])
        stats = parsed.groupBy(id_col).agg(
            *own, F.percentile(F.when(~single, F.col("l")), ps).alias("lq"),
            F.percentile(F.when(~single, F.col("r")), ps).alias("rq"))
        stats = stats.select(id_col, "l", "r", "n", *[F.get(f"{x}q", i).alias(f"{x}{k}")
                                                      for x in "lr" for i, k in enumerate(probs)])
    else:
        sampled = parsed.filter(~single)
        stats = parsed.groupBy(id_col).agg(*own)
        for x in "lr":
            stats = stats.join(group_quantiles(sampled, [id_col], x, {f"{x}{k}": p for k, p in probs.items()}, True),
                               id_col, "left")
    zero = F.lit(0.0)
    return stats.filter(F.col("l").isNotNull()).select(
        id_col, F.coalesce("l50", "l").alias("loop_nt_median"), F.coalesce("l90", "l").alias("loop_nt_p90"),
        F.coalesce(F.col("l75") - F.col("l25"), zero).alias("loop_nt_iqr"),
        F.coalesce("r50", "r").alias("rg_median_A"), F.coalesce(F.col("r75") - F.col("r25"), zero).alias("rg_iqr_A"),
        F.col("n").alias("n_ensemble_samples"))
