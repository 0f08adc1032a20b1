"""Joins of a run's tables, exact samples of any size, and file heads that read no more than they need."""

import io

import pytest
from pyspark.sql import functions as F

from plumbline.operators import groups, joins
from plumbline.sources import lines, sequences, structures


def test_joins_keep_their_rows(spark):
    feats = spark.createDataFrame([("a", "AC", 1.0), ("b", "AC", 2.0), ("c", None, 3.0), (None, "GG", 4.0)], "candidate_id string, sequence string, x double")
    copies = spark.createDataFrame([("AC", 2), ("AC", 3), ("GG", 1), (None, 9)], "sequence string, duplicate_count long")
    got = {(r.candidate_id, r.duplicate_count) for r in joins.with_duplicates(feats, copies).collect()}
    assert got == {("a", 5), ("b", 5), ("c", None), (None, 1)}
    meta = spark.createDataFrame([("a", "t2", "q"), ("a", "t1", "z"), (None, "t0", "n")], "candidate_id string, target string, pdb string")
    got = {(r.candidate_id, r.target, r.pdb) for r in joins.with_metadata(feats, meta, ["target", "pdb"]).collect()}
    assert got == {("a", "t1", "z"), ("b", None, None), ("c", None, None), (None, None, None)}
    asked = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "candidate_id string")
    got = sorted(((r.candidate_id, r.x) for r in joins.requested(feats, asked).collect()), key=str)
    assert got == sorted([("a", 1.0), ("a", 1.0), ("z", None), (None, 4.0)], key=str)
    held = spark.createDataFrame([("a",), ("a",), ("c",)], "candidate_id string")
    assert {r.candidate_id for r in joins.members_of(feats, held).collect()} == {"a", "c"}
    assert {r.candidate_id for r in joins.training_rows(feats, held).collect()} == {"b", None}
    prov = spark.createDataFrame([("a", "s1", 1), ("a", "s0", 2)], "control_id string, source_id string, shuffle_index int")
    got = {(r.control_id, r.source_id, r.shuffle_index) for r in joins.bank_with_provenance(feats, prov, ["source_id", "shuffle_index"]).collect()}
    assert got == {("a", "s0", 2), ("b", None, None), ("c", None, None), (None, None, None)}


@pytest.mark.parametrize("n", [0, 1, 37, 100, 1000])
def test_seeded_sample_is_exact(spark, n):
    df = spark.range(300).select(F.col("id").cast("string").alias("candidate_id"), F.when(F.col("id") < 250, "x").when(F.col("id") < 290, F.lit(None)).otherwise("z").alias("g"))
    df = df.unionByName(df.filter("candidate_id = '5'")).unionByName(df.filter("candidate_id = '5'"))
    got = groups.seeded_sample(df, n, by=["g"])
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {g: min(n, m) for g, m in (("x", 252), (None, 40), ("z", 10)) if n}
    again = groups.seeded_sample(df.repartition(5), n, by=["g"])
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    larger = {r.candidate_id for r in groups.seeded_sample(df, n + 20, by=["g"]).collect()}
    assert {r.candidate_id for r in got.collect()} <= larger


def test_a_sample_of_a_million(spark):
    df = spark.range(3_000_000).withColumnRenamed("id", "candidate_id")
    got = groups.seeded_sample(df, 1_000_000)
    assert got.count() == 1_000_000 and got.distinct().count() == 1_000_000


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_heads_read_a_block_or_two():
    data = Counting(b"\n  \r\nname,sequence\n" + b"a,ACGU\n" * 1_000_000)
    assert lines.head_of(data) == "name,sequence" and data.taken <= lines.HEAD_BLOCK
    assert lines.head_of(io.BytesIO(b"")) is None and lines.head_of(io.BytesIO(b" \n\n")) is None
    assert lines.head_of(io.BytesIO(b"no end")) == "no end"
    wide = Counting(b"x" * (3 * lines.HEAD_BLOCK) + b"\nrest")
    assert lines.head_of(wide) == "x" * (3 * lines.HEAD_BLOCK)
    with pytest.raises(ValueError):
        lines.head_of(io.BytesIO(b"x" * (lines.HEAD_BYTES + 1)))


def test_heads_of_files_are_those_of_a_scan(spark, tmp_path):
    for name, text in (("a.csv", "\n\nSequence,id\nAC,1\n"), ("b.fa", ">r1\nACGU\n"), ("c.txt", "ACGU\nAC"), ("d.txt", " \n"), ("e f.txt", "é x\r\ny")):
        (tmp_path / name).write_bytes(text.encode())
    got = {r.file: r.head for r in lines.file_heads(spark, str(tmp_path)).collect()}
    want = {r.file: r["head"] for r in lines.first_lines(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and len(got) == 5
    kinds = {r.file.rsplit("/", 1)[-1][:1]: r.format for r in sequences.sniff_format(spark, str(tmp_path)).collect()}
    assert kinds == {"a": "csv", "b": "fasta", "c": "txt", "d": "empty", "e": "txt"}


def test_atoms_with_a_malformed_coordinate_are_errors(spark, tmp_path):
    good = "ATOM      1  CA AGLY A   5      11.104   6.134  -6.504  1.00  0.00           C"
    other = good[:16] + "B" + good[17:]
    bad = good[:30] + "  1x.104" + good[38:]
    (tmp_path / "pocket3_atm.pdb").write_text("\n".join([good, other, bad, "ATOM  short"]))
    atoms, errors = structures.read_pdb_atoms(spark, str(tmp_path))
    assert atoms.count() == 1 and sorted(r.problem for r in errors.collect()) == ["malformed coordinate", "truncated line"]
    every, _ = structures.read_pdb_atoms(spark, str(tmp_path), every_location=True)
    assert every.count() == 2 and structures.lining_residues(every).count() == 1
