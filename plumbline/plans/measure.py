"""Prepare structures and measure targets, many at once, keyed by target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contacts, evidence, potential, preparation, shapes
from ..settings import POCKET, SURFACE, TargetRequest


def prepare_structure(atoms: DataFrame, requests: DataFrame, request: TargetRequest = TargetRequest(),
                      key: str = "structure_id", min_atoms: int = preparation.MIN_ATOMS,
                      site: DataFrame | None = None, partners: DataFrame | None = None):
    """(kept atoms, hetero summary, verdict) for every structure.

    The hetero policy is one for the whole call; the chain may differ per structure. With
    ``site`` (key, residue_number) and ``partners`` (key, partner_chain) the verdict also
    has ``partner_contacts``, measured before the partners are dropped, and
    ``site_problems``; the first of these is a problem of the structure.
    """
    chains = preparation.select_chain(atoms, requests, key)
    chosen = atoms.join(chains.filter(F.col("problem").isNull()).select(key, "chain"), [key, "chain"], "left_semi")
    judged = preparation.apply_policy(chosen, request.strip_hetero, request.retain, request.remove,
                                      request.hetero_default)
    kept = preparation.first_altloc(judged.filter(F.col("action") == "retained"))
    protein = F.col("reason") == "protein"
    counts = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_atoms"),
        F.count_distinct(F.when(protein, F.struct("residue_number", "icode"))).alias("n_protein_residues"),
        F.count_distinct(F.when(~protein, F.struct("residue_number", "icode"))).alias("n_hetero_retained"))
    n_chains = atoms.groupBy(key).agg(F.count_distinct("chain").alias("n_chains"))
    verdict = chains.join(counts, key, "left").join(n_chains, key, "left").withColumn(
        "problem", F.coalesce(
            "problem",
            F.when(F.coalesce("n_protein_residues", F.lit(0)) == 0, "no protein residue after cleaning"),
            F.when(F.coalesce("n_atoms", F.lit(0)) < min_atoms, f"fewer than {min_atoms} atoms after cleaning"),
        )).withColumn("warnings", F.array_compact(F.array(
            F.when(F.col("n_hetero_retained") > 0, "hetero residues retained"),
            F.when(F.col("n_chains") > 1, "isolated from a complex; the bound-state shape is measured"))))
    if site is not None or partners is not None:
        site = atoms.select(key, "residue_number").limit(0) if site is None else site
        partners = atoms.select(key, F.col("chain").alias("partner_chain")).limit(0) if partners is None else partners
        found = evidence.site_evidence(atoms, chains, site, partners, key).select(
            key, F.struct(*evidence.CONTACTS).alias("partner_contacts"), F.col("problems").alias("site_problems"))
        first = F.get("site_problems", F.lit(0))
        verdict = verdict.join(found, key, "left").withColumn("problem", F.coalesce(
            "problem", F.when(first.isNotNull(), F.concat(first["problem"], F.lit(": "), F.array_join(first["items"], ", ")))))
    return kept, preparation.hetero_summary(judged, [key]), verdict


def measure_targets(targets: DataFrame, pockets: DataFrame, spheres: DataFrame, lining: DataFrame,
                    site: DataFrame, atoms: DataFrame, potentials: DataFrame | None = None) -> DataFrame:
    """One row per target in its own mode, ready for comparison.

    targets: target_id, binding_mode, allow_zero_overlap; pockets: target_id,
    pocket_index, score, druggability, volume_A3; site: target_id, chain,
    residue_number, icode. Pocket targets get the selected cavity, surface targets
    their patch; a target without its measurement has a ``problem``.
    """
    key = "target_id"
    requested = site.groupBy(key).agg(F.count(F.lit(1)).alias("n_requested"))
    requests = targets.join(requested, key, "left").select(
        key, F.coalesce("n_requested", F.lit(0)).alias("n_requested"),
        (F.col("binding_mode") == POCKET).alias("require_overlap"), "allow_zero_overlap")
    overlap = contacts.pocket_overlap(pockets, lining, site)
    chosen = preparation.select_pocket(pockets, overlap, requests)
    measured = shapes.pocket_geometry(spheres, [key, "pocket_index"], pockets)
    cavity = chosen.join(measured.select(
        key, "pocket_index", "d_pocket_A", "d_equiv_A", F.col("elongation").alias("pocket_elongation"),
        F.col("planarity_A").alias("pocket_planarity_A"), F.col("shape_warning").alias("pocket_shape_warning"),
        F.col("problem").alias("pocket_problem")), [key, "pocket_index"], "left")
    patch = shapes.patch_geometry(atoms, site).select(
        key, "patch_area_A2", "n_residues", F.col("elongation").alias("patch_elongation"),
        F.col("planarity_A").alias("patch_planarity_A"), F.col("shape_warning").alias("patch_shape_warning"),
        F.col("problem").alias("patch_problem"))
    out = targets.select(key, "binding_mode").join(cavity, key, "left").join(patch, key, "left")
    if potentials is not None:
        out = out.join(potentials.select(key, "mean_potential"), key, "left")
    else:
        out = out.withColumn("mean_potential", F.lit(None).cast("double"))
    pocket, surface = F.col("binding_mode") == POCKET, F.col("binding_mode") == SURFACE
    problem = (
        F.when(pocket & (F.col("status") != "selected"), F.coalesce("warning", F.lit("no cavity selected")))
        .when(pocket, F.col("pocket_problem"))
        .when(surface & F.col("patch_problem").isNotNull(), F.col("patch_problem"))
        .when(surface & (F.coalesce("patch_area_A2", F.lit(0.0)) == 0), "no measured patch"))
    return out.select(
        key, "binding_mode", "method", F.when(pocket, F.col("pocket_index")).alias("pocket_index"),
        F.when(pocket, F.col("d_pocket_A")).alias("d_pocket_A"), F.when(pocket, F.col("d_equiv_A")).alias("d_equiv_A"),
        F.when(surface, F.col("patch_area_A2")).alias("patch_area_A2"), F.when(surface, F.col("n_residues")).alias("n_residues"),
        F.when(pocket, F.col("pocket_elongation")).otherwise(F.col("patch_elongation")).alias("elongation"),
        F.when(pocket, F.col("pocket_planarity_A")).otherwise(F.col("patch_planarity_A")).alias("planarity_A"),
        F.when(pocket, F.col("pocket_shape_warning")).otherwise(F.col("patch_shape_warning")).alias("shape_warning"),
        "mean_potential", problem.alias("problem"))


def site_potential(site_atoms: DataFrame, chain_atoms: DataFrame, grid: DataFrame, header: DataFrame,
                   keys: list[str], offset: float = 3.0) -> DataFrame:
    """Offset the site atoms outward, read the grid there, summarise per target."""
    centroids = chain_atoms.groupBy(*keys).agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    points = potential.outward_points(site_atoms, centroids, keys, offset)
    return potential.potential_summary(potential.sample_potential(points, grid, header, keys, "atom_id"), keys)


def verify_targets(stored: DataFrame, spheres: DataFrame, lining: DataFrame, patches: DataFrame,
                   tolerance: float = 1e-6) -> DataFrame:
    """(target_id, item, problem): what a stored measurement no longer agrees with.

    stored: target_id, pocket_index, n_reported, d_pocket_A, d_pocket_centres_A,
    volume_A3; patches: target_id, patch_area_A2, n_residues, per_residue_area_A2.
    """
    keys = ["target_id", "pocket_index"]
    again = shapes.pocket_geometry(spheres, keys).select(
        *keys, F.col("n_alpha_spheres").alias("n_now"), F.col("d_pocket_A").alias("d_now"),
        F.col("d_pocket_centres_A").alias("c_now"))
    lined = lining.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lining"))
    joined = stored.join(again, keys, "left").join(lined, keys, "left")

    def moved(a, b):
        return F.coalesce(F.abs(F.col(a) - F.col(b)) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(a))), F.lit(True))

    other_count = F.coalesce(F.col("n_reported") != F.col("n_now"), F.lit(True))
    problems = F.array_compact(F.array(
        F.when(other_count, "sphere count differs from the report"),
        F.when(~other_count & moved("d_pocket_A", "d_now"), "d_pocket_A differs when recomputed"),
        F.when(~other_count & moved("d_pocket_centres_A", "c_now"), "d_pocket_centres_A differs when recomputed"),
        F.when(F.coalesce("n_lining", F.lit(0)) == 0, "no lining residues recorded"),
        F.when(~F.coalesce(F.col("volume_A3") > 0, F.lit(False)), "non-positive volume")))
    a = joined.select("target_id", F.concat(F.lit("pocket "), F.col("pocket_index").cast("string")).alias("item"),
                      F.explode(problems).alias("problem"))
    total = F.aggregate(F.map_values("per_residue_area_A2"), F.lit(0.0), lambda x, y: x + y)
    wrong = F.array_compact(F.array(
        F.when(F.abs(total - F.col("patch_area_A2")) > tolerance * F.greatest(F.lit(1.0), F.abs("patch_area_A2")),
               "patch area is not the sum of its residues"),
        F.when(F.size("per_residue_area_A2") != F.col("n_residues"), "residue count differs")))
    b = patches.select("target_id", F.lit("patch").alias("item"), F.explode(wrong).alias("problem"))
    return a.unionByName(b)
