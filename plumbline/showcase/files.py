"""Files that Spark derives from the sample tables, read back by the readers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import identity
from ..runtime import fresh_path
from ..sources import events, lines, sequences, structures, tables
from .views import table, view

BUCKET = r"/b=(\d+)/"


def write_lines(df, path: str, part: str = "b", order=("row",)):
    """One text file per value of ``part``; ``line`` may hold line breaks."""
    df.repartition(part).sortWithinPartitions(part, *order).select(part, F.col("line").alias("value")).write.partitionBy(
        part).mode("overwrite").text(path)
    return path


def bucket(column: str = "file"):
    return F.regexp_extract(column, BUCKET, 1).cast("int")


def csv_rows(spark, sf):
    raw = view(spark, sf, "v_raw").select(
        "row", (F.col("row") % 8).alias("b"), F.coalesce("supplied_id", F.lit("")).alias(" ID "),
        F.regexp_replace("raw_sequence", "[\r\n]", " ").alias("Sequence"))
    path = fresh_path(spark, "csv")
    # Half of the files have another order of columns.
    for part, order in (("b < 4", (" ID ", "Sequence")), ("b >= 4", ("Sequence", " ID "))):
        raw.filter(part).repartition("b").sortWithinPartitions("b", "row").select("b", *order).write.mode("append").partitionBy("b").csv(
            path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out = sequences.read_sequences_csv(spark, path + "/b=*/")
    return out.select(bucket().alias("b"), "row", "sequence", "supplied_id")


def line_file(spark, sf):
    df = view(spark, sf, "v_seq").select(
        F.col("doc_id").alias("row"), (F.col("doc_id") % 8).alias("b"),
        F.expr("CASE doc_id % 7 WHEN 0 THEN concat('# ', sequence) WHEN 1 THEN '' WHEN 2 THEN concat('  ', sequence, ' ') ELSE sequence END").alias("line"))
    return write_lines(df, fresh_path(spark, "lines"))


def text_rows(spark, sf):
    out = sequences.read_sequences_lines(spark, line_file(spark, sf))
    return out.select(bucket().alias("b"), "row", "sequence")


def fasta_file(spark, sf):
    df = view(spark, sf, "v_seq").select(
        F.col("doc_id").alias("row"), (F.col("doc_id") % 8).alias("b"),
        F.expr("""concat(CASE WHEN doc_id % 10 = 0 THEN '>' ELSE concat('>', candidate_id, ' ', lang) END,
                  CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('\n', substr(sequence, 1, 15), '\n', substr(sequence, 16)) END)""").alias("line"))
    return write_lines(df, fresh_path(spark, "fasta"))


def fasta_rows(spark, sf):
    out = sequences.read_sequences_fasta(spark, fasta_file(spark, sf))
    return out.select(bucket().alias("b"), "row", "sequence", "supplied_id")


def formats(spark, sf):
    """Four kinds of files in one folder tree, told apart by suffix and first line."""
    root = fresh_path(spark, "mixed")
    seq = view(spark, sf, "v_seq").select(F.col("doc_id").alias("row"), (F.col("doc_id") % 4).alias("b"), "candidate_id", "sequence")
    write_lines(seq.withColumn("line", F.col("sequence")), root + "/k=plain")
    write_lines(seq.withColumn("line", F.concat(F.lit(">"), "candidate_id", F.lit("\n"), "sequence")), root + "/k=letters")
    head = seq.groupBy("b").agg(F.lit(-1).cast("long").alias("row"), F.lit("id,Sequence").alias("line"))
    body = seq.select("b", "row", F.concat_ws(",", "candidate_id", "sequence").alias("line"))
    write_lines(head.unionByName(body), root + "/k=table")
    seq.select("b", "candidate_id", "sequence").repartition("b").write.partitionBy("b").csv(root + "/k=commas", header=True)
    out = sequences.sniff_format(spark, root + "/k=*/b=*/")
    return out.select(F.regexp_extract("file", r"/k=(\w+)/", 1).alias("kind"), bucket().alias("b"), "format")


def corpus_file(spark, sf):
    df = view(spark, sf, "v_reference").select(
        (F.col("doc_id") % 4).alias("b"), F.col("doc_id").alias("row"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("candidate_id")).alias("ID"),
        F.expr("""CASE doc_id % 6 WHEN 0 THEN substr(sequence, 1, 12) WHEN 1 THEN lower(translate(sequence, 'U', 'T')) WHEN 2 THEN repeat('ACGU', 7)
                  WHEN 3 THEN concat(sequence, 'X') ELSE sequence END""").alias("Sequence"), "target_name")
    path = fresh_path(spark, "corpus")
    for part, order in (("b < 2", ("ID", "Sequence", "target_name")), ("b >= 2", ("target_name", "Sequence", "ID"))):
        df.filter(part).repartition("b").sortWithinPartitions("b", "row").select("b", *order).write.mode("append").partitionBy("b").csv(path, header=True)
    return path


def corpus_rows(spark, sf):
    clean, dropped = sequences.read_reference_corpus(spark, corpus_file(spark, sf) + "/b=*/")
    return clean.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n"), F.max("target_name").alias("target_name"),
        F.max(F.col("candidate_id").startswith("ref").cast("int")).alias("named")).unionByName(
        dropped.select(F.concat(F.lit("dropped: "), "reason").alias("sequence"), "n", F.lit(None).cast("string").alias("target_name"),
                       F.lit(None).cast("int").alias("named")))


def info_files(spark, sf):
    """One cavity report per target, with one line no reader can account for."""
    p = view(spark, sf, "v_pockets")
    text = F.concat(
        F.format_string("Pocket %d :\n", "pocket_index"), F.lit("\tScore : \t"), F.col("score").cast("string"),
        F.when(F.col("druggability").isNotNull(), F.concat(F.lit("\n\tDruggability  Score : \t"), F.col("druggability").cast("string"))).otherwise(F.lit("")),
        F.lit("\n\tNumber of Alpha Spheres : "), F.col("n_reported").cast("string"),
        F.when(F.col("pocket_index") != 7, F.concat(F.lit("\n\tVolume : "), F.col("volume_A3").cast("string"), F.lit("\r"))).otherwise(F.lit("")),
        F.when(F.col("pocket_index") == 5, F.lit("\n??? not a field")).otherwise(F.lit("")), F.lit("\n"))
    return write_lines(p.select(F.col("target_id").alias("b"), F.col("pocket_index").alias("row"), text.alias("line")), fresh_path(spark, "info"))


def pocket_rows(spark, sf):
    pockets, errors = structures.read_pocket_info(spark, info_files(spark, sf))
    a = pockets.select(bucket().alias("b"), "pocket_index", "score", "druggability", "volume_A3", "n_reported",
                       F.size("metrics").alias("n_fields"), F.lit(None).cast("string").alias("problem"))
    b = errors.select(bucket().alias("b"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("pocket_index", "int"), ("score", "double"), ("druggability", "double"), ("volume_A3", "double"),
        ("n_reported", "int"), ("n_fields", "int"))], "problem")
    return a.unionByName(b)


def sphere_rows(spark, sf):
    s = view(spark, sf, "v_spheres").select("pocket_id", "vec_id", *[F.round(c, 3).alias(c) for c in ("x", "y", "z", "radius")])
    line = F.concat(F.lit("ATOM  "), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 3 == 0, " APOL ").when(F.col("vec_id") % 3 == 1, " POL ").otherwise(" X "),
                    F.lit(" STP C "), F.col("pocket_id").cast("string"), F.lit("  "), F.col("x").cast("string"), F.lit("  "), F.col("y").cast("string"),
                    F.lit(" "), F.when(F.col("vec_id") % 50 == 0, "bad").otherwise(F.col("z").cast("string")), F.lit(" 0.00 "), F.col("radius").cast("string"))
    # The pocket number is read from the file name, so the folder carries it here.
    df = s.select(F.concat(F.lit("pocket"), F.col("pocket_id").cast("string"), F.lit("_vert")).alias("b"), F.col("vec_id").alias("row"), line.alias("line"))
    good, bad = structures.read_alpha_spheres(spark, write_lines(df, fresh_path(spark, "vert")))
    return good.select("pocket_index", "x", "y", "z", "radius", "kind").unionByName(bad.groupBy(
        F.regexp_extract("file", r"pocket(\d+)_vert", 1).cast("int").alias("pocket_index")).agg(F.count(F.lit(1)).cast("double").alias("x")).select(
        "pocket_index", "x", *[F.lit(None).cast("double").alias(c) for c in ("y", "z", "radius")], F.lit("malformed").alias("kind")))


def _columns(number, width: int):
    """A number right-aligned in its columns; hybrid-36 where it has too many digits."""
    over = number - 10**width
    letters = 26 * 36 ** (width - 1)
    text = lambda x: F.conv(x.cast("string"), 10, 36)
    return F.when(over < 0, F.lpad(number.cast("string"), width, " ")).when(
        over < letters, text(over + 10 * 36 ** (width - 1))).otherwise(F.lower(text(over - letters + 10 * 36 ** (width - 1))))


def atom_rows(spark, sf):
    p = view(spark, sf, "v_pdb")
    line = F.format_string(
        "%-6s%s  CA %s%-3s %s%s%s   %8.3f%8.3f%8.3f  1.00  0.00", F.when(F.col("hetero"), "HETATM").otherwise("ATOM"), _columns(F.col("line_no"), 5), "altloc", "resname",
        "chain", F.when(F.col("line_no") % 70 == 0, F.lit("  x1")).otherwise(_columns(F.col("residue_number"), 4)),
        F.when(F.col("icode") == "", " ").otherwise(F.col("icode")), F.col("x"), F.col("y"), F.col("z"))
    df = p.select(F.col("structure_id").alias("b"), F.col("line_no").alias("row"), line.alias("line"))
    atoms, errors = structures.read_pdb_atoms(spark, write_lines(df, fresh_path(spark, "pdb")))
    sid = F.regexp_extract("file", r"/b=(\w+)/", 1).alias("structure_id")
    return atoms.select(sid, "chain", "residue_number", "icode", "resname", "hetero", "altloc", F.round("x", 3).alias("x")).unionByName(
        errors.select(sid, F.lit(None).cast("string").alias("chain"), F.lit(None).cast("int").alias("residue_number"), F.lit(None).cast("string").alias("icode"),
                      F.col("problem").alias("resname"), F.lit(None).cast("boolean").alias("hetero"), F.lit(None).cast("string").alias("altloc"), F.lit(None).cast("double").alias("x")))


def grid_rows(spark, sf):
    """Three values per line after a header, and a second file that ends too early."""
    g = view(spark, sf, "v_grid").select((F.col("ix") * 25 + F.col("iy") * 5 + F.col("iz")).alias("at"), "phi")
    rows = g.groupBy(F.expr("at div 3").cast("long").alias("row")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "phi"))), lambda v: v["phi"].cast("string")), " ").alias("line"))
    head = table(spark, sf, "region").filter("r_regionkey = 0").select(F.lit(-1).cast("long").alias("row"), F.lit(
        "# potential\nobject 1 class gridpositions counts 5 5 5\norigin -20 -20 -20\ndelta 10 0 0\ndelta 0 10 0\ndelta 0 0 10\n"
        "object 2 class gridconnections counts 5 5 5\nobject 3 class array type double rank 0 items 125 data follows").alias("line"))
    both = head.unionByName(rows)
    df = both.withColumn("b", F.lit("full")).unionByName(both.filter("row < 20").withColumn("b", F.lit("short")))
    grid, _header, errors = structures.read_potential_grid(spark, write_lines(df, fresh_path(spark, "grid")))
    name = F.regexp_extract("file", r"/b=(\w+)/", 1)
    return grid.filter(name == "full").select("ix", "iy", "iz", "phi", F.lit(None).cast("string").alias("problem")).unionByName(
        errors.select(*[F.lit(None).cast("int").alias(c) for c in ("ix", "iy", "iz")], F.lit(None).cast("double").alias("phi"),
                      F.concat(name, F.lit(": "), "problem").alias("problem")))


def round_trip(spark, sf):
    """A10: what is read back differs from what was written in no bit; same content, same id."""
    df = view(spark, sf, "v_features").drop("doc_id")
    path = fresh_path(spark, "features")
    key = tables.materialize_features(df, path, {"a_per_nt": 6.0})
    again = tables.materialize_features(df.repartition(5), path, {"a_per_nt": 6.0})
    other = tables.table_id(df, {"a_per_nt": 7.0})
    back = tables.read_features(spark, path, key)
    h = F.xxhash64(*sorted(df.columns))
    joined = df.select("candidate_id", h.alias("a")).join(back.select("candidate_id", h.alias("b")), "candidate_id", "full_outer")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different")).select(
        "*", F.lit(key == again).alias("same_id"), F.lit(key != other).alias("settings_count"))


def json_records(spark, sf):
    """A11: nested records through JSON; NaN arrives as null."""
    df = view(spark, sf, "v_sized").select(
        "candidate_id", F.struct(F.when(F.col("loop_nt_median") == 0, float("nan")).otherwise(F.col("loop_nt_median")).alias("value"),
                                 F.struct(F.col("length").alias("nt")).alias("size")).alias("elements"))
    path = fresh_path(spark, "records")
    tables.write_run_records(df, path)
    back = tables.read_run_records(spark, path, df.schema)
    return back.select("candidate_id", F.col("elements.value").alias("value"), F.col("elements.size.nt").alias("nt"))


def event_file(spark, sf, torn: bool = True):
    """The event log as JSON lines; every 40th line is torn, some are blank."""
    e = view(spark, sf, "v_progress").withColumns({
        "job_id": F.col("job_id").cast("string"), "created_utc": F.col("created_utc").cast("timestamp")})
    e = e.withColumn("line", F.to_json(F.struct(*[F.col(c) for c in e.columns]),
                                       {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
    text = F.col("line")
    if torn:
        text = F.when(F.col("seq") % 40 == 39, F.substring("line", 1, 30)).when(
            F.col("seq") % 41 == 40, "").otherwise(F.col("line"))
    path = fresh_path(spark, "events")
    e.select(text.alias("value")).write.text(path)
    return path


MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def event_rows(spark, sf):
    return events.read_progress_events(spark, event_file(spark, sf)).select(
        F.col("job_id").cast("long").alias("job_id"), "seq", "event", "stage", "completed", F.date_format("created_utc", MICROS).alias("at"))


def content_ids(spark, sf):
    df = table(spark, sf, "supplier").select(
        "s_suppkey", "s_name", F.lit("2024-01-01").alias("created"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("volume"),
        F.concat(F.lit("/data/run/"), "s_name", F.lit(".pdb")).alias("source"),
        F.array(F.lit("/opt/tool"), F.concat(F.lit("--in=/x/"), "s_name")).alias("command"))
    return df.select("s_suppkey", identity.content_id(df, exclude=("created",), blank=("volume",), paths=("source", "command")).alias("id"))


def catalog(spark, sf):
    """Six library files in two folders: copies, a candidate list, a small one, a placeholder."""
    root = fresh_path(spark, "libraries")
    ref = view(spark, sf, "v_seq")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def place(folder, name, rows, suffix="csv"):
        tmp = fresh_path(spark, "one")
        rows.write.text(tmp)
        part = [s.getPath() for s in fs.globStatus(hadoop.Path(tmp + "/part-*"))][0]
        fs.mkdirs(hadoop.Path(f"{root}/{folder}"))
        fs.rename(part, hadoop.Path(f"{root}/{folder}/{name}.{suffix}"))

    def library(header, cols, where):
        body = ref.filter(where).select("doc_id", F.concat_ws(",", *cols).alias("value"))
        top = table(spark, sf, "region").filter("r_regionkey = 0").select(
            F.lit(-1).cast("long").alias("doc_id"), F.lit(header).alias("value"))
        return top.unionByName(body).repartition(1).sortWithinPartitions("doc_id").select("value")

    full = ("candidate_id", "sequence", "source")
    place("one", "alpha_lib", library("id,Sequence,target_name", full, "doc_id % 2 = 0"))
    place("two", "copy_of_alpha", library("id,Sequence,target_name", full, "doc_id % 2 = 0"))
    place("one", "beta", library("id,sequence", ("candidate_id", "sequence"), "doc_id % 3 = 0"))
    place("two", "gamma", library("id,sequence,target_pdb_id", full, "doc_id < 30"))
    place("two", "placeholder_set", library("id,sequence,target_name", full, "doc_id % 2 = 1"))
    place("two", "delta", library("id,letters,target_name", full, "doc_id % 5 = 0"))
    manifest = json.dumps({"name": "Alpha", "source": "s", "curator": "c", "curated_date": "2024-01-01"})
    one = table(spark, sf, "region").filter("r_regionkey = 0")
    place("one", "alpha_lib.manifest", one.select(F.lit(manifest).alias("value")), "json")
    place("two", "gamma.manifest", one.select(F.lit('{"source": "s"}').alias("value")), "json")
    out = tables.library_catalog(spark, [f"{root}/one", f"{root}/two"])
    return out.select(F.regexp_extract("file", r"([^/]+/[^/]+)$", 1).alias("file"), "name", "state", "n_sequences", "problem")


def numbered(spark, sf):
    """Line numbers and running counts over many small splits of one file tree."""
    path = line_file(spark, sf)
    df = lines.running_sum(lines.numbered_lines(spark, path), F.length("value"), "letters")
    return df.groupBy(bucket().alias("b")).agg(F.max("line_no").alias("n_lines"), F.max("letters").alias("letters"))


_SEQ_LINES = "CASE doc_id % 7 WHEN 0 THEN '# ' || sequence WHEN 1 THEN '' WHEN 2 THEN '  ' || sequence || ' ' ELSE sequence END"

QUERIES = {
    "a1_read_sequences_csv": (csv_rows, r"""WITH r AS (SELECT row % 8 AS b, row_number() OVER (PARTITION BY row % 8 ORDER BY row) + 1 AS n, supplied_id,
        trim(regexp_replace(raw_sequence, '[\r\n]', ' ', 'g'), ' ' || chr(9)) AS s FROM v_raw) SELECT b::INTEGER AS b, n AS row, s AS sequence, supplied_id FROM r WHERE s <> ''"""),
    "a2_read_sequences_lines": (text_rows, f"""WITH r AS (SELECT doc_id % 8 AS b, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS n, trim({_SEQ_LINES}) AS s FROM v_seq)
        SELECT b::INTEGER AS b, n AS row, s AS sequence FROM r WHERE s <> '' AND s NOT LIKE '#%'"""),
    "a2_numbered_lines": (numbered, f"SELECT (doc_id % 8)::INTEGER AS b, count(*) AS n_lines, sum(length({_SEQ_LINES}))::BIGINT AS letters FROM v_seq GROUP BY 1"),
    "a3_read_sequences_fasta": (fasta_rows, """WITH r AS (SELECT doc_id % 8 AS b, doc_id, candidate_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE sequence END AS s,
          sum(CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 3 END) OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 3 END + 1 AS line,
          max(doc_id) OVER (PARTITION BY doc_id % 8) AS last FROM v_seq)
        SELECT b::INTEGER AS b, line::BIGINT AS row, s AS sequence, CASE WHEN doc_id % 10 <> 0 THEN candidate_id END AS supplied_id FROM r WHERE s <> '' OR doc_id < last"""),
    "a4_sniff_format": (formats, """SELECT DISTINCT k AS kind, (doc_id % 4)::INTEGER AS b, CASE k WHEN 'plain' THEN 'txt' WHEN 'letters' THEN 'fasta' ELSE 'csv' END AS format
        FROM v_seq CROSS JOIN (SELECT unnest(['plain', 'letters', 'table', 'commas']) AS k)"""),
    "a5_read_reference_corpus": (corpus_rows, """WITH r AS (SELECT doc_id, target_name, doc_id % 5 = 0 AS bare, CASE doc_id % 6 WHEN 0 THEN substr(sequence, 1, 12) WHEN 2 THEN repeat('ACGU', 7) WHEN 3 THEN sequence || 'X'
          ELSE sequence END AS s FROM v_reference), j AS (SELECT *, CASE WHEN s LIKE '%X' THEN 'invalid character ''X''' WHEN length(s) NOT BETWEEN 20 AND 100 THEN 'length out of range' END AS why FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id % 4, doc_id) AS k FROM j WHERE why IS NULL)
        SELECT s AS sequence, 1::BIGINT AS n, target_name, bare::INTEGER AS named FROM k WHERE k = 1 AND s <> repeat('ACGU', 7)
        UNION ALL SELECT s, 1, target_name, bare::INTEGER FROM k WHERE k = 1 AND s = repeat('ACGU', 7)
        UNION ALL SELECT 'dropped: ' || why, count(*), NULL, NULL FROM j WHERE why IS NOT NULL GROUP BY why"""),
    "a6_read_pocket_info": (pocket_rows, """SELECT target_id::INTEGER AS b, pocket_index, score, druggability, CASE WHEN pocket_index <> 7 THEN volume_A3 END AS volume_A3, n_reported::INTEGER AS n_reported,
          (2 + (druggability IS NOT NULL)::INT + (pocket_index <> 7)::INT)::INTEGER AS n_fields, NULL::VARCHAR AS problem FROM v_pockets
        UNION ALL SELECT target_id::INTEGER, NULL, NULL, NULL, NULL, NULL, NULL, CASE pocket_index WHEN 5 THEN 'unparsed line' ELSE 'missing required field' END FROM v_pockets WHERE pocket_index IN (5, 7)"""),
    "a7_read_alpha_spheres": (sphere_rows, """SELECT pocket_id AS pocket_index, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(radius, 3) AS radius,
          CASE vec_id % 3 WHEN 0 THEN 'apolar' WHEN 1 THEN 'polar' ELSE 'unknown' END AS kind FROM v_spheres WHERE vec_id % 50 <> 0
        UNION ALL SELECT pocket_id, count(*)::DOUBLE, NULL, NULL, NULL, 'malformed' FROM v_spheres WHERE vec_id % 50 = 0 GROUP BY 1"""),
    "a8_read_pdb_atoms": (atom_rows, """SELECT structure_id, chain, residue_number, icode, resname, hetero, trim(altloc) AS altloc, round(x, 3) AS x FROM v_pdb WHERE line_no % 70 <> 0 AND altloc <> 'B'
        UNION ALL SELECT structure_id, NULL, NULL, NULL, 'malformed residue number', NULL, NULL, NULL FROM v_pdb WHERE line_no % 70 = 0"""),
    "a9_read_potential_grid": (grid_rows, "SELECT ix, iy, iz, phi, NULL::VARCHAR AS problem FROM v_grid UNION ALL SELECT NULL, NULL, NULL, NULL, 'short: too few values'"),
    "a10_materialize_features": (round_trip, "SELECT count(*) AS n, 0::BIGINT AS n_different, true AS same_id, true AS settings_count FROM v_features"),
    "a11_run_records": (json_records, "SELECT candidate_id, CASE WHEN loop_nt_median <> 0 THEN loop_nt_median END AS value, length AS nt FROM v_sized"),
    "a12_read_progress_events": (event_rows, "SELECT job_id, seq, event, stage, completed::BIGINT AS completed, strftime(created_utc, '%Y-%m-%d %H:%M:%S.%f') AS at FROM v_progress WHERE seq % 40 <> 39 AND seq % 41 <> 40"),
    "a13_content_id": (content_ids, """SELECT s_suppkey, substr(sha256('{"command":["tool","--in=' || s_name || '"],"s_name":"' || s_name || '","s_suppkey":' || s_suppkey || ',"source":"' || s_name || '.pdb","volume":'
        || CASE WHEN s_suppkey % 3 > 0 AND s_acctbal IS NOT NULL THEN '"<nondeterministic>"' ELSE 'null' END || '}'), 1, 32) AS id FROM supplier"""),
    "a14_library_catalog": (catalog, """WITH c AS (SELECT count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id < 30) AS g, count(*) FILTER (doc_id % 2 = 1) AS p FROM v_seq)
        SELECT unnest(['one/alpha_lib.csv', 'one/beta.csv', 'two/gamma.csv', 'two/placeholder_set.csv', 'two/delta.csv']) AS file, unnest(['Alpha', 'beta', 'gamma', 'placeholder set', 'delta']) AS name,
          unnest(['verified', 'unverified', 'unverified', 'development', 'unverified']) AS state, unnest([a, NULL, g, p, NULL]) AS n_sequences,
          unnest([NULL, 'looks like candidates', 'fewer than 50 sequences', NULL, 'no sequence column']) AS problem FROM c"""),
}
