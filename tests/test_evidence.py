"""Contacts and problems of a site while the partner chains are there, against loops over all pairs."""

import math
import random

import pytest

from plumbline.operators.evidence import problem_rows, site_evidence
from plumbline.operators.shapes import patch_geometry
from plumbline.plans.measure import prepare_structure

ATOMS = "structure_id string, chain string, resname string, hetero boolean, residue_number int, icode string, altloc string, line_no long, x double, y double, z double"


def structure(name, seed, chains="AB"):
    r = random.Random(seed)
    out = []
    for chain in chains:
        for number in range(1, 25):
            resname, hetero = ("HOH", True) if number > 22 else ("ZN", True) if number == 22 else ("GLY", False)
            for _ in range(3):
                out.append((name, chain, resname, hetero, number, "", "", len(out), *(r.uniform(0, 14) for _ in "xyz")))
    return out


def brute(atoms, own, partner):
    mine = [a for a in atoms if a[1] == own and not a[3]]
    theirs = [a for a in atoms if a[1] == partner and a[2] != "HOH"]
    return sorted({m[4] for m in mine for t in theirs if math.dist(m[8:], t[8:]) <= 4.5})


@pytest.fixture(scope="module")
def found(spark):
    one, two = structure("one", 1), structure("two", 2)
    water = [("wet", "A", "GLY", False, 1, "", "", 0, 0.0, 0.0, 0.0), ("wet", "A", "GLY", False, 2, "A", "", 1, None, None, None),
             ("wet", "W", "HOH", True, 1, "", "", 2, 0.0, 0.0, 1.0)]
    atoms = spark.createDataFrame([*one, *one, *two, *water, (None, "A", "GLY", False, 1, "", "", 0, 0.0, 0.0, 0.0)], ATOMS)
    chains = spark.createDataFrame([("one", "A"), ("two", "B"), ("wet", "A"), ("none", None)], "structure_id string, chain string")
    site = spark.createDataFrame([("one", n) for n in (3, 4, 4, 5, 23, 99, None)] + [("wet", 1)], "structure_id string, residue_number int")
    partners = spark.createDataFrame([("one", "B"), ("one", "B"), ("one", "A"), ("one", "Q"), ("two", "A"), ("wet", "W"), ("two", None)],
                                     "structure_id string, partner_chain string")
    out = site_evidence(atoms, chains, site, partners)
    return {"rows": {r["structure_id"]: r for r in out.collect()}, "one": one, "two": two, "out": out,
            "inputs": (atoms, chains, site, partners)}


def test_interface_equals_all_pairs(found):
    one, two = found["rows"]["one"], found["rows"]["two"]
    want = brute(found["one"], "A", "B")
    assert len(want) > 3 and one["interface_residues"] == want and one["n_interface_residues"] == len(want)
    assert one["configured_in_interface"] == [n for n in (3, 4, 5) if n in want]
    assert one["configured_not_in_interface"] == [n for n in (3, 4, 5) if n not in want]
    assert one["interface_not_configured"] == [n for n in want if n not in (3, 4, 5)]
    assert two["interface_residues"] == brute(found["two"], "B", "A") and two["problems"] == []


def test_problems(found):
    assert found["rows"]["one"]["partner_chains"] == ["B", "Q"]
    got = {(r["structure_id"], r["problem"]): r["items"] for r in problem_rows(found["out"]).collect()}
    assert got == {
        ("one", "partner chains not in the structure"): ["Q"], ("one", "requested residues not in the chain"): ["23", "99"],
        ("wet", "partner chains without atoms"): ["W"], ("wet", "insertion codes in the chain"): ["2A"]}


def test_without_partner_or_chain(found):
    for name in ("wet", "none"):
        row = found["rows"][name]
        assert (row["computed"], row["n_interface_residues"], row["interface_residues"]) == (False, None, None)
    assert found["rows"]["none"]["problems"] == [] and found["rows"]["none"]["partner_chains"] == []


def test_verdict_carries_the_evidence(spark, found):
    atoms, chains, site, partners = found["inputs"]
    _kept, _summary, verdict = prepare_structure(atoms, chains.filter("structure_id IN ('one', 'two')"), min_atoms=10, site=site, partners=partners)
    rows = {r["structure_id"]: r for r in verdict.collect()}
    assert rows["one"]["problem"] == "partner chains not in the structure: Q" and rows["two"]["problem"] is None
    assert rows["two"]["partner_contacts"]["interface_residues"] == brute(found["two"], "B", "A")
    bare = prepare_structure(atoms, chains, min_atoms=10, site=site)[2]
    one = bare.filter("structure_id = 'one'").first()
    assert one["problem"] == "requested residues not in the chain: 23, 99" and not one["partner_contacts"]["computed"]


def test_empty_tables(found):
    atoms, chains, site, partners = found["inputs"]
    assert site_evidence(atoms, chains.limit(0), site, partners).count() == 0
    rows = site_evidence(atoms.limit(0), chains, site, partners).collect()
    assert len(rows) == 4 and not any(r["computed"] for r in rows)


def test_patch_leaves_hetero_atoms_out(spark):
    rows = [(1, n, het, 2.0, float(n), float(n % 3), float(i)) for n, het in ((1, False), (2, True), (3, False), (4, None)) for i in range(4)]
    atoms = spark.createDataFrame(rows, "target_id int, residue_number int, hetero boolean, sasa double, x double, y double, z double")
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "target_id int, residue_number int")
    got = patch_geometry(atoms, asked).first()
    assert (got["residue_numbers"], got["n_atoms"], got["patch_area_A2"], got["total_chain_area_A2"]) == ([1, 4], 8, 16.0, 32.0)
    assert got["problem"] == "requested residues not present: 2"
    assert patch_geometry(atoms.drop("hetero"), asked).first()["residue_numbers"] == [1, 2, 4]
