"""Files of measured structures: cavity reports, spheres, atoms, potential grids.

Readers are strict: a line that cannot be accounted for becomes an error row, and
``raise_on_errors`` turns error rows into an exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines, running_sum

REQUIRED = ("Score", "Number of Alpha Spheres", "Volume")


def raise_on_errors(errors: DataFrame) -> None:
    first = errors.limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['problem']} in {first[0]['file']}, line {first[0]['line_no']}")


def read_pocket_info(spark: SparkSession, path):
    """(pockets, errors). Pockets: file, pocket_index, metrics and the required numbers."""
    lines = numbered_lines(spark, path).filter(F.trim(F.col("value")) != "")
    number = F.regexp_extract(F.trim(F.col("value")), r"^Pocket\s+(\d+)\s*:\s*$", 1)
    field = r"^\s*([A-Za-z][^:]*?)\s*:\s*(\S.*?)\s*$"
    parsed = lines.select(
        "file", "line_no", "value", F.expr("try_cast(nullif({}, '') AS INT)".format(
            r"regexp_extract(trim(value), '^Pocket\\s+(\\d+)\\s*:\\s*$', 1)")).alias("header"),
        F.regexp_replace(F.regexp_extract("value", field, 1), r"\s+", " ").alias("label"),
        F.regexp_extract("value", field, 2).alias("text"))
    del number
    # One report describes one structure, so its lines are few.
    along = Window.partitionBy("file").orderBy("line_no")
    owned = parsed.withColumn("pocket_index", F.last("header", ignorenulls=True).over(along))
    fields = owned.filter(F.col("header").isNull())
    bad = fields.select("file", "line_no", F.when(F.col("label") == "", "unparsed line").when(
        F.col("pocket_index").isNull(), "field before any pocket header").alias("problem")).filter("problem IS NOT NULL")
    good = fields.filter((F.col("label") != "") & F.col("pocket_index").isNotNull())
    # A repeated label: the later line counts.
    latest = good.groupBy("file", "pocket_index", "label").agg(F.max_by("text", "line_no").alias("text"))
    metrics = latest.groupBy("file", "pocket_index").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "text")))).alias("metrics"))
    heads = owned.filter(F.col("header").isNotNull()).groupBy("file", "pocket_index").agg(F.min("line_no").alias("line_no"))
    pockets = heads.join(metrics, ["file", "pocket_index"], "left")
    def value(label):
        return F.try_element_at("metrics", F.lit(label)).try_cast("double")
    missing = pockets.filter(F.coalesce(F.size(F.array_except(
        F.array(*[F.lit(r) for r in REQUIRED]), F.map_keys("metrics"))), F.lit(1)) != 0).select(
        "file", "line_no", F.lit("missing required field").alias("problem"))
    none = lines.select("file").distinct().join(heads.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit(0).cast("long").alias("line_no"), F.lit("no pockets").alias("problem"))
    out = pockets.select(
        "file", "pocket_index", "metrics", value("Score").alias("score"), value("Druggability Score").alias("druggability"),
        value("Volume").alias("volume_A3"), value("Number of Alpha Spheres").cast("int").alias("n_reported"))
    return out, bad.unionByName(missing).unionByName(none)


def read_alpha_spheres(spark: SparkSession, path):
    """(spheres, errors) from vertex files; numbers are taken from the right."""
    lines = numbered_lines(spark, path).filter(F.col("value").rlike("^(ATOM|HETATM)"))
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    split = lines.select("file", "line_no", parts.alias("p"))
    def at(i):
        return F.try_element_at("p", F.lit(i)).try_cast("double")
    kind = F.upper(F.get("p", 2))
    out = split.select(
        "file", "line_no", F.regexp_extract("file", r"pocket(\d+)_vert", 1).try_cast("int").alias("pocket_index"),
        F.size("p").alias("n"), at(-5).alias("x"), at(-4).alias("y"), at(-3).alias("z"), at(-1).alias("radius"),
        F.when(kind == "APOL", "apolar").when(kind == "POL", "polar").otherwise("unknown").alias("kind"))
    bad = (F.col("n") < 7) | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.col("radius").isNull()
    return out.filter(~bad).drop("n"), out.filter(bad).select(
        "file", "line_no", F.lit("malformed vertex line").alias("problem"))


def _residue_number(text):
    """A number in four columns; beyond 9999 as hybrid-36: A000 is 10000, a000 follows ZZZZ."""
    place = F.conv(text, 36, 10).cast("int")
    return F.coalesce(text.try_cast("int"), F.when(text.rlike("^[A-Z][0-9A-Z]{3}$"), place - 10 * 36**3 + 10_000).when(
        text.rlike("^[a-z][0-9a-z]{3}$"), place + 16 * 36**3 + 10_000))


def read_pdb_atoms(spark: SparkSession, path, every_location: bool = False):
    """(atoms, errors) by fixed columns; the first alternate location only, unless ``every_location``.

    Residue numbers beyond 9999 are read as hybrid-36. A line that is too short or has no residue number or a coordinate that is no number is an error row.
    """
    lines = numbered_lines(spark, path).filter(F.col("value").rlike("^(ATOM|HETATM)"))
    def cut(a, n):
        return F.trim(F.substring("value", a, n))
    out = lines.select(
        "file", "line_no", F.length("value").alias("n"), F.col("value").startswith("HETATM").alias("hetero"),
        cut(13, 4).alias("atom"), cut(17, 1).alias("altloc"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"),
        _residue_number(cut(23, 4)).alias("residue_number"), cut(27, 1).alias("icode"),
        cut(31, 8).try_cast("double").alias("x"), cut(39, 8).try_cast("double").alias("y"), cut(47, 8).try_cast("double").alias("z"))
    misplaced = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    problem = F.when(F.col("n") < 27, "truncated line").when(F.col("residue_number").isNull(), "malformed residue number").when(misplaced, "malformed coordinate")
    judged = out.withColumn("problem", problem)
    kept = F.lit(True) if every_location else F.col("altloc").isin("", "A")
    atoms = judged.filter(F.col("problem").isNull() & kept).drop("n", "problem")
    return atoms, judged.filter(F.col("problem").isNotNull()).select("file", "line_no", "problem")


def lining_residues(atoms: DataFrame) -> DataFrame:
    """Unique residues per pocket file (the pocket number is in the file name).

    A residue lines a pocket with any of its alternate locations: read the atoms with ``every_location``.
    """
    n = F.regexp_extract("file", r"pocket(\d+)_atm", 1).try_cast("int")
    return atoms.withColumn("pocket_index", n).groupBy(
        "file", "pocket_index", "chain", "residue_number", "icode").agg(F.min_by("resname", "line_no").alias("resname"))


def read_potential_grid(spark: SparkSession, path):
    """(grid, header, errors). Grid: file, ix, iy, iz, phi in the file's own order.

    The place of a value is the number of values before it, kept as a running count
    over lines, so one large grid is read by many tasks.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value"))
    words = F.split(F.regexp_replace("value", r"\s+", " "), " ")
    def numbers(first):
        return F.transform(F.slice(words, first, 3), lambda w: w.try_cast("double"))
    is_count = F.col("value").startswith("object 1 class gridpositions counts")
    header = lines.groupBy("file").agg(
        F.max(F.when(is_count, F.transform(F.slice(words, -3, 3), lambda w: w.try_cast("int")))).alias("counts"),
        F.max(F.when(F.col("value").startswith("origin"), numbers(2))).alias("origin"),
        F.array_sort(F.collect_list(F.when(F.col("value").startswith("delta"), F.struct("line_no", numbers(2).alias("d"))))).alias("deltas"))
    header = header.select(
        "file", "counts", "origin",
        F.when(F.size("deltas") >= 3, F.array(*[F.get(F.get("deltas", i)["d"], i) for i in range(3)])).alias("spacing"))
    data = lines.filter((F.col("value") != "") & ~F.col("value").rlike(r"^[A-Za-z#]"))
    data = running_sum(data.withColumn("w", words), F.size("w"), "before", inclusive=False)
    values = data.select("file", "before", F.posexplode("w").alias("k", "word")).select(
        "file", (F.col("before") + F.col("k")).alias("at"), F.col("word").try_cast("double").alias("phi"))
    c = [F.get("counts", i) for i in range(3)]
    placed = values.join(header.select("file", "counts"), "file").filter(F.col("at") < c[0] * c[1] * c[2])
    at = F.col("at")
    grid = placed.select("file", F.expr("CAST(at div (counts[1] * counts[2]) AS INT)").alias("ix"),
                         F.expr("CAST((at div counts[2]) % counts[1] AS INT)").alias("iy"),
                         (at % c[2]).cast("int").alias("iz"), "phi")
    have = values.groupBy("file").agg(F.count("phi").alias("n"))
    problem = F.when(F.col("counts").isNull() | F.col("origin").isNull() | F.col("spacing").isNull(), "incomplete header").when(
        F.coalesce("n", F.lit(0)) < c[0] * c[1] * c[2], "too few values")
    errors = header.join(have, "file", "left").select("file", F.lit(0).cast("long").alias("line_no"), problem.alias("problem"))
    return grid, header, errors.filter(F.col("problem").isNotNull())
