"""What a structure says about a requested site while its partner chains are still there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from . import contacts

#: Columns of the partner contacts that ``plans.measure.prepare_structure`` carries as one struct.
CONTACTS = ("partner_chains", "computed", "cutoff_A", "n_interface_residues", "interface_residues",
            "configured_in_interface", "configured_not_in_interface", "interface_not_configured")


def _listed(rows: DataFrame, key: str, value, name: str) -> DataFrame:
    """Distinct values per structure in order; bounded by what was requested or by the length of a chain."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def site_evidence(atoms: DataFrame, chains: DataFrame, site: DataFrame, partners: DataFrame,
                  key: str = "structure_id", cutoff: float = contacts.CUTOFF) -> DataFrame:
    """One row per structure of ``chains`` (key, chain): contacts with its partners and the problems of its site.

    atoms: all chains, with resname, hetero, residue_number, icode and x, y, z; site:
    (key, residue_number) as requested; partners: (key, partner_chain). Residues of the
    chosen chain are its ATOM records; partner atoms are all but water. The chosen chain is
    not its own partner. Disagreement between site and interface is listed, not corrected.
    ``problems`` has a struct (problem, items) for partner chains the structure has not,
    partners of which no atom is left, requested residues the chain has not, and insertion
    codes in a chain with a requested site, which a plain number can't name. Without a
    usable partner ``computed`` is false and the interface is null; nulls in a key, a number
    or a coordinate match nothing; repeated rows count once.
    """
    chosen = chains.select(key, F.col("chain").alias("__own"))
    wanted = site.select(key, "residue_number").filter(F.col("residue_number").isNotNull()).distinct()
    asked = partners.select(key, F.col("partner_chain").alias("__partner")).filter("__partner IS NOT NULL").distinct()
    asked = asked.join(chosen, key).filter(~F.col("__own").eqNullSafe(F.col("__partner"))).select(key, "__partner")
    bare = atoms.select(key, "chain", "resname", "hetero", "residue_number", "icode", "x", "y", "z")
    mine = bare.join(chosen.select(key, F.col("__own").alias("chain")), [key, "chain"], "left_semi").filter(~F.col("hetero"))
    theirs = bare.join(asked.select(key, F.col("__partner").alias("chain")), [key, "chain"], "left_semi")
    usable = theirs.filter(~F.col("hetero") | ~F.upper(F.trim("resname")).isin(*policy.WATER))

    held = bare.select(key, F.col("chain").alias("__partner")).distinct()
    missing = _listed(asked.join(held, [key, "__partner"], "left_anti"), key, "__partner", "__missing")
    present = mine.select(key, "residue_number").distinct()
    absent = _listed(contacts.absent_residues(wanted, present, [key, "residue_number"]), key, "residue_number", "__absent")
    code = F.trim(F.coalesce("icode", F.lit("")))
    inserted = mine.filter(code != "").join(wanted.select(key).distinct(), key, "left_semi")
    inserted = _listed(inserted, key, F.struct("residue_number", code.alias("code")), "__inserted")

    touching = contacts.interface_contacts(mine, usable, cutoff, [key])
    configured = wanted.join(present, [key, "residue_number"], "left_semi")
    sides = contacts.interface_summary(contacts.compare_interface(configured, touching, [key, "residue_number"]), [key])
    out = chosen.join(_listed(asked, key, "__partner", "partner_chains"), key, "left")
    out = out.join(usable.groupBy(key).agg(F.lit(True).alias("computed")), key, "left")
    for part in (missing, absent, inserted, sides):
        out = out.join(part, key, "left")

    def text(column):
        return F.transform(column, lambda x: x.cast("string"))

    computed = F.coalesce("computed", F.lit(False))
    has_partner = F.col("partner_chains").isNotNull()
    problems = F.array_compact(F.array(*(
        F.when(when, F.struct(F.lit(problem).alias("problem"), items.alias("items"))) for when, problem, items in (
            (F.col("__missing").isNotNull(), "partner chains not in the structure", F.col("__missing")),
            (has_partner & F.col("__missing").isNull() & ~computed, "partner chains without atoms", F.col("partner_chains")),
            (F.col("__own").isNotNull() & F.col("__absent").isNotNull(), "requested residues not in the chain", text("__absent")),
            (F.col("__inserted").isNotNull(), "insertion codes in the chain",
             F.transform("__inserted", lambda r: F.concat(r["residue_number"].cast("string"), r["code"])))))))
    none = F.array().cast("array<int>")
    number = mine.schema["residue_number"].dataType.simpleString()
    lists = [F.when(computed, F.coalesce(c, none.cast(f"array<{number}>"))).alias(c) for c in CONTACTS[4:]]
    return out.select(
        key, F.col("__own").alias("chain"), F.coalesce("partner_chains", F.array().cast("array<string>")).alias("partner_chains"),
        computed.alias("computed"), F.lit(float(cutoff)).alias("cutoff_A"),
        F.when(computed, F.coalesce("n_interface_residues", F.lit(0))).alias("n_interface_residues"), *lists, problems.alias("problems"))


def problem_rows(evidence: DataFrame, key: str = "structure_id") -> DataFrame:
    """(key, chain, problem, items): one row per problem of ``site_evidence``."""
    return evidence.select(key, "chain", F.explode("problems").alias("p")).select(key, "chain", "p.problem", "p.items")
