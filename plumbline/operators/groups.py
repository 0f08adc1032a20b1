"""Comparison groups, folds, samples and decoys; every draw is a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import sequences as Q
from .intake import first_per_sequence
from .ordering import lookup_join, null_safe_join, row_numbers, wants_spread
from .stats import letter_frequencies

LETTERS = "ACGU"


def load_generated(raw: DataFrame, min_length: int = 20, max_length: int = 100, prefix: str = "gen") -> DataFrame:
    """Generated sequences: normalised, valid ones only, first copy kept.

    ``raw`` has (position, sequence, id); default ids count input positions from 0.
    """
    clean = raw.withColumn("sequence", Q.normalise_sequence("sequence"))
    ok = clean.filter(Q.rejection_reason(F.col("sequence"), min_length, max_length).isNull())
    digits = F.col("position").cast("string")
    made = F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")))
    named = ok.select("position", "sequence", F.coalesce(F.col("id"), made).alias("candidate_id"))
    return first_per_sequence(named, "position").select(
        "candidate_id", "sequence", F.lit("generated").alias("group"))


def random_matched(reference: DataFrame, n: int, seed: int = 42, id_col: str = "candidate_id", spread=None) -> DataFrame:
    """n sequences with lengths and letters drawn like the reference's.

    A length is the length of a drawn reference row (join on its number); letters
    compare a hash uniform with the cumulative letter shares.
    """
    total = reference.count()
    if total == 0:
        raise ValueError("cannot match an empty reference")
    numbered = row_numbers(reference.select(id_col, F.length("sequence").alias("length")), [], F.col(id_col), "__i", spread)
    asked = reference.sparkSession.range(n).select(
        F.col("id").alias("i"), (identity.hash_draw(F.lit(total), "length", seed, F.col("id")) + 1).alias("__i"))
    lengths = asked.join(numbered.select("__i", "length"), "__i").select("i", "length")
    f = letter_frequencies(reference).select(
        F.col("freq_A").alias("a"), (F.col("freq_A") + F.col("freq_C")).alias("c"),
        (F.col("freq_A") + F.col("freq_C") + F.col("freq_G")).alias("g"))
    u = "conv(substring(md5(concat_ws('|', 'letter', '{s}', i, p)), 1, 12), 16, 10) / 281474976710656D".format(s=seed)
    letter = f"CASE WHEN {u} < a THEN 'A' WHEN {u} < c THEN 'C' WHEN {u} < g THEN 'G' ELSE 'U' END"
    text = F.expr(f"array_join(transform(sequence(1, length), p -> {letter}), '')")
    digits = F.col("i").cast("string")
    return lengths.crossJoin(F.broadcast(f)).select(
        F.concat(F.lit("rand"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0"))).alias("candidate_id"),
        text.alias("sequence"), F.lit("random").alias("group"))


def build_groups(validated: DataFrame, random: DataFrame, shuffled: DataFrame,
                 generated: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """One table with a group column, and the generated rows dropped as copies.

    Generated sequences that repeat a validated one would lend it their scores.
    """
    parts = [df.withColumn("group", F.lit(name)) for name, df in (
        ("validated", validated), ("random", random), ("shuffled", shuffled))]
    dropped = None
    if generated is not None:
        known = validated.select("sequence").distinct()
        dropped = generated.join(known, "sequence", "left_semi")
        parts.append(generated.join(known, "sequence", "left_anti").withColumn("group", F.lit("generated")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, dropped


def canonical_targets(corpus: DataFrame) -> DataFrame:
    """Add target_key and grouping: names when any row has one, else structure ids.

    Whether any row has a name is a fact about the table: one aggregate, one row.
    """
    keyed = corpus.withColumns({
        "__name": identity.clean_key(F.col("target_name")), "__pdb": identity.clean_key(F.col("target_pdb_id"))})
    facts = keyed.agg(F.max(F.col("__name") != "").alias("__names"), F.max(F.col("__pdb") != "").alias("__pdbs"))
    both = keyed.crossJoin(F.broadcast(facts))
    key = F.when(F.col("__names"), F.when(F.col("__name") != "", F.col("__name")).otherwise(F.col("__pdb"))).when(
        F.col("__pdbs"), F.col("__pdb")).otherwise("")
    return both.withColumns({
        "target_key": F.when(key == "", identity.UNLABELLED).otherwise(key),
        "grouping": F.when(F.col("__names"), "target_name").when(F.col("__pdbs"), "target_pdb_id").otherwise(
            "sequence (no target labels available)")}).drop("__name", "__pdb", "__names", "__pdbs")


def target_folds(corpus: DataFrame, n_folds: int = 5, seed: int = 42, id_col: str = "candidate_id",
                 spread=None) -> DataFrame:
    """Add a fold; all rows of a target share it. Unlabelled tables fall back to rows."""
    keyed = canonical_targets(corpus)
    unit = F.when(F.col("grouping").startswith("sequence"), F.col(id_col)).otherwise(F.col("target_key"))
    keyed = keyed.withColumn("__unit", unit)
    units = keyed.groupBy("__unit").agg(F.count(F.lit(1)).alias("n_rows"))
    order = F.struct(identity.derive_seed(seed, "folds", F.col("__unit")).alias("h"), F.col("__unit").alias("u"))
    numbered = row_numbers(units, [], order, "__i", spread)
    folds = numbered.select("__unit", "n_rows", F.pmod(F.col("__i") - 1, F.lit(n_folds)).cast("int").alias("fold"))
    return lookup_join(keyed, folds, ["__unit"]).drop("__unit")


def seeded_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "candidate_id",
                  by: list[str] = ()) -> DataFrame:
    """Exactly n rows (per group) without replacement, the same for every layout; all where there are fewer."""
    if n <= 0:
        return df.limit(0)
    drawn = smallest_hashes(df if by else df.withColumn("__all", F.lit(0)), list(by) or ["__all"],
                            identity.derive_seed(seed, "sample", F.col(id_col)), F.lit(n), id_col, not by)
    return drawn.select(df.columns)


def smallest_hashes(df: DataFrame, by: list[str], h, n, id_col: str = "candidate_id",
                    few_groups: bool = False) -> DataFrame:
    """Per group, exactly the ``n`` rows (a column, one value per group) with the smallest 32-bit hashes ``h``.

    Counts per leading 20 bits of the hash say where the n-th row lies, so taking the rows
    before it is a filter; only the rows that share those bits with it (one in a million)
    are put in order, ties by id. One small aggregate, no sort of the rows, any n. With
    ``few_groups`` (a number of groups fixed by a parameter) the cuts travel to the rows,
    which are not shuffled.
    """
    rows = df.withColumns({"__h": h, "__want": n}).filter(F.col("__want") > 0).withColumn("__p", F.expr("__h div 4096"))
    counted = rows.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"), F.max("__want").alias("__w"))
    run = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.withColumn("__before", F.coalesce(F.sum("__n").over(run), F.lit(0)))
    cut = ahead.filter((F.col("__before") < F.col("__w")) & (F.col("__before") + F.col("__n") >= F.col("__w"))).select(
        *by, F.col("__p").alias("__cut"), (F.col("__w") - F.col("__before")).alias("__left"))
    # A group without a cut has fewer rows than asked for.
    placed = null_safe_join(rows, F.broadcast(cut) if few_groups else cut, by, "left")
    first = Window.partitionBy(*by).orderBy("__h", id_col)
    border = placed.filter(F.col("__p") == F.col("__cut")).withColumn("__k", F.row_number().over(first))
    taken = placed.filter(F.col("__cut").isNull() | (F.col("__p") < F.col("__cut")))
    return taken.select(df.columns).unionByName(border.filter(F.col("__k") <= F.col("__left")).select(df.columns))


def choose_decoys(candidates: DataFrame, targets: DataFrame, k: int = 5, seed: int = 42,
                  id_col: str = "candidate_id", own: str = "target_id") -> DataFrame:
    """(id, own target, decoy): k other targets per candidate, without replacement.

    Targets are numbered once; candidate c takes k consecutive places from a hashed
    start and stride over that circle, so no candidate ever meets every target.
    """
    n = targets.count()
    if n < 2:
        raise ValueError("need at least two targets")
    k = min(k, n - 1)
    circle = row_numbers(targets.select(F.col(own).alias("decoy")), [], F.struct(
        identity.derive_seed(seed, "circle", F.col("decoy")).alias("h"), F.col("decoy").alias("d")), "__i")
    placed = circle.select("decoy", (F.col("__i") - 1).alias("place"))
    mine = candidates.select(id_col, own).join(
        placed.select(F.col("decoy").alias(own), F.col("place").alias("at")), own)
    # Steps 1..n-1 away from the own place are all the other targets, each once.
    start = identity.hash_draw(F.lit(n - 1), "decoy", seed, F.col(id_col))
    steps = mine.select(id_col, own, "at", start.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    asked = steps.select(id_col, own, ((F.col("at") + 1 + F.pmod(F.col("s") + F.col("j"), F.lit(n - 1))) % n).alias("place"))
    return asked.join(placed, "place").select(id_col, own, "decoy")


__all__ = ["load_generated", "random_matched", "build_groups", "canonical_targets", "target_folds", "seeded_sample", "smallest_hashes",
           "choose_decoys", "wants_spread"]
