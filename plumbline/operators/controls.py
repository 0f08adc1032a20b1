"""Shuffled controls: generation, checking, and the comparison with the original."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import sequences as Q
from .intake import first_per_sequence
from .ordering import group_quantiles, row_numbers, wants_spread


def _shuffles(seq: str, k: int, rng: random.Random, n: int) -> list[str]:
    """n random strings with the same k-mers: random Eulerian paths over (k-1)-mers.

    The graph is the same for all of them and built once. What loses its composition
    is an error, checked on every string.
    """
    if k <= 1:
        return ["".join(rng.sample(seq, len(seq))) for _ in range(n)]
    if len(seq) <= k:
        return [seq] * n
    w = k - 1
    nodes = [seq[i:i + w] for i in range(len(seq) - w + 1)]
    out: dict[str, list[str]] = {}
    for a, b in zip(nodes, nodes[1:]):
        out.setdefault(a, []).append(b)
    end, first = nodes[-1], nodes[0]
    content = sorted(seq[i:i + k] for i in range(len(nodes) - 1))
    made = []
    for _ in range(n):
        # A random tree towards the end node (loop-erased random walks) fixes the last
        # edge taken from every node; all other edges may come in any order.
        last: dict[str, str] = {}
        done = {end}
        for start in out:
            node = start
            while node not in done:
                last[node] = node = rng.choice(out[node])
            node = start
            while node not in done:
                done.add(node)
                node = last[node]
        walk: dict[str, list[str]] = {}
        for node, targets in out.items():
            rest = targets.copy()
            if node != end:
                rest.remove(last[node])
                rng.shuffle(rest)
                rest.append(last[node])
            else:
                rng.shuffle(rest)
            rest.reverse()
            walk[node] = rest
        node, pieces = first, [first]
        for _ in range(len(nodes) - 1):
            node = walk[node].pop()
            pieces.append(node[-1])
        text = "".join(pieces)
        if sorted(text[i:i + k] for i in range(len(text) - w)) != content:
            raise ValueError("a shuffle changed the composition of its sequence")
        made.append(text)
    return made


def dinucleotide_shuffles(df: DataFrame, n: int, k: int = 2, seed: int = 42, purpose: str = "shuffle",
                          id_col: str = "candidate_id", seed_col=None) -> DataFrame:
    """n shuffles per row that keep its k-mers: (id, source_sequence, shuffle_index, sequence).

    Every row carries its own seed, so partitioning and retries cannot change a
    result. ``seed_col`` replaces the default seed expression.
    """
    seeded = df.select(
        F.col(id_col), F.col("sequence").alias("source_sequence"),
        (seed_col if seed_col is not None
         else identity.derive_seed(seed, F.col(id_col), F.col("sequence"), purpose)).alias("__seed"))

    # Generating is the costly part: spread the rows evenly, whatever the files were.
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    seeded = seeded.repartition(tasks, "__seed")

    def generate(batches):
        for whole in batches:
            # Slices keep the output of one step small whatever n is.
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at:at + 256]
                made = []
                for text, s in zip(pdf["source_sequence"], pdf["__seed"]):
                    rng = random.Random(int(s))
                    made.extend(_shuffles(text, k, rng, n))
                yield pd.DataFrame({
                    id_col: pdf[id_col].repeat(n).to_numpy(),
                    "source_sequence": pdf["source_sequence"].repeat(n).to_numpy(),
                    "shuffle_index": list(range(n)) * len(pdf), "sequence": made})

    id_type = dict(df.dtypes)[id_col]
    return seeded.mapInPandas(
        generate, f"`{id_col}` {id_type}, source_sequence string, shuffle_index int, sequence string")


def composition_kept(a, b, k: int = 2):
    """Same length and same k-mer multiset, decided inside the row."""
    return (F.length(a) == F.length(b)) & (F.sort_array(Q.kmers(a, k)) == F.sort_array(Q.kmers(b, k)))


def shuffled_negatives(reference: DataFrame, seed: int = 42, k: int = 2) -> DataFrame:
    """One shuffle per reference row: the hard negative group."""
    s = identity.derive_seed(seed, F.col("candidate_id"), "eval_shuffle")
    out = dinucleotide_shuffles(reference, 1, k, seed_col=s)
    return out.select(F.concat(F.lit("shuf_"), "candidate_id").alias("candidate_id"), "sequence",
                      F.lit("shuffled").alias("group"), F.col("candidate_id").alias("source_id"))


def calibration_bank(corpus: DataFrame, size: int = 5000, k: int = 2, seed: int = 42,
                     spread=None) -> DataFrame:
    """A fixed set of controls with the same number from every distinct sequence."""
    sources = first_per_sequence(corpus.select("candidate_id", "sequence"), "candidate_id")
    numbered = row_numbers(sources, [], F.col("sequence"), "pos", spread)
    n = numbered.count()
    if n == 0:
        raise ValueError("cannot build a control bank from an empty corpus")
    per_source = max(1, -(-size // n))
    copies = numbered.withColumn("shuffle_index", F.explode(F.sequence(F.lit(0), F.lit(per_source - 1))))
    index = F.col("shuffle_index") * F.lit(n) + F.col("pos") - 1
    text = index.cast("string")
    named = copies.select(
        F.concat(F.lit("bank"), F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))).alias("control_id"),
        F.col("candidate_id").alias("source_id"), "shuffle_index", "sequence",
        identity.derive_seed(seed, F.col("candidate_id"), "bank", F.col("shuffle_index")).alias("shuffle_seed"))
    made = dinucleotide_shuffles(
        named.withColumn("key", F.struct("control_id", "source_id", "shuffle_index", "shuffle_seed"))
        .select(F.to_json("key").alias("key"), "sequence", "shuffle_seed"),
        1, k, id_col="key", seed_col=F.col("shuffle_seed"))
    key = F.from_json("key", "control_id string, source_id string, shuffle_index int, shuffle_seed long")
    return made.select(key.alias("k"), "sequence", "source_sequence").select(
        "k.*", "sequence", "source_sequence",
        (F.col("sequence") == F.col("source_sequence")).alias("identical_to_source"))


def shuffle_outcome(real: DataFrame, controls: DataFrame, alpha: float = 0.05, expected: int = 20,
                    id_col: str = "candidate_id", score: str = "structural_subscore",
                    spread=None) -> DataFrame:
    """Each row against its own controls: percentile, p-value, pass, median, margin.

    Both sides have (id, score, sequence). A row without controls gets nulls and a
    failed test.
    """
    paired = controls.select(id_col, F.col(score).alias("c"), F.col("sequence").alias("cs")).join(
        real.select(id_col, F.col(score).alias("r"), F.col("sequence").alias("rs")), id_col)
    # Many rows with few controls each are many small groups: only a large group is cut.
    spread = wants_spread(controls, spread, [id_col])
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > F.col("c")).alias("wins"),
        F.count_if(F.col("r") == F.col("c")).alias("ties"),
        F.count_if(F.col("c") >= F.col("r")).alias("not_below"),
        F.count_distinct("cs").alias("n_unique"), F.count_if(F.col("cs") == F.col("rs")).alias("n_same"),
    ]
    if not spread:
        stats = paired.groupBy(id_col).agg(*aggs, F.median("c").alias("median"))
    else:
        stats = paired.groupBy(id_col).agg(*aggs).join(
            group_quantiles(paired, [id_col], "c", {"median": 0.5}, True), id_col)
    joined = real.select(id_col, F.col(score).alias("__r")).join(stats, id_col, "left")
    m = F.col("n")
    p = (F.col("not_below") + 1) / (m + 1)
    return joined.select(
        id_col, F.col("__r").alias("structural_subscore"),
        F.coalesce(p <= alpha, F.lit(False)).alias("shuffle_pass"),
        ((F.col("wins") + F.lit(0.5) * F.col("ties")) / m).alias("shuffle_percentile"),
        p.alias("shuffle_p_value"),
        (F.col("__r") - F.col("median")).alias("shuffle_margin"),
        F.col("median").alias("shuffle_median_score"),
        F.coalesce(m, F.lit(0)).alias("shuffle_n"),
        F.coalesce("wins", F.lit(0)).alias("shuffle_wins"),
        F.coalesce("ties", F.lit(0)).alias("shuffle_ties"),
        (F.coalesce(m, F.lit(0)) == expected).alias("shuffle_complete"),
        F.coalesce("n_unique", F.lit(0)).alias("shuffle_n_unique"),
        F.coalesce("n_same", F.lit(0)).alias("shuffle_n_identical_to_real"))


def attach_outcomes(ranked: DataFrame, outcomes: DataFrame | None, id_col: str = "candidate_id") -> DataFrame:
    """Left join of the control outcomes; typed nulls when no controls were run."""
    if outcomes is not None:
        return ranked.join(outcomes, id_col, "left")
    nothing = {"structural_subscore": "double", "shuffle_pass": "boolean", "shuffle_percentile": "double",
               "shuffle_p_value": "double", "shuffle_margin": "double", "shuffle_median_score": "double"}
    out = ranked.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    return out.withColumns({
        "shuffle_n": F.lit(0).cast("long"), "shuffle_wins": F.lit(0).cast("long"),
        "shuffle_ties": F.lit(0).cast("long"), "shuffle_complete": F.lit(None).cast("boolean"),
        "shuffle_n_unique": F.lit(0).cast("long"), "shuffle_n_identical_to_real": F.lit(0).cast("long")})
