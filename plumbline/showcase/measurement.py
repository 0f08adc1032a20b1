"""Contacts, pockets, patches, preparation, potentials and their verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import policy
from ..operators import contacts, evidence, potential, preparation, shapes
from ..plans import measure
from ..settings import TargetRequest
from .views import table, view


def atoms(spark, sf):
    return view(spark, sf, "v_atoms")


def found_contacts(spark, sf):
    a = atoms(spark, sf)
    return contacts.interface_contacts(a.filter("chain = 'B'"), a.filter("chain = 'C'"))


def absent(spark, sf):
    wanted = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).cast("int").alias("residue_number"))
    return contacts.absent_residues(wanted, atoms(spark, sf).filter("chain = 'B'"), ["residue_number"])


def overlap(spark, sf):
    out = contacts.pocket_overlap(view(spark, sf, "v_pockets"), view(spark, sf, "v_lining"), view(spark, sf, "v_site"))
    return out.select("target_id", "pocket_index", "overlap_count", F.array_join(
        F.transform("overlapping", lambda r: r["residue_number"].cast("string")), ",").alias("residues"))


def _sides(spark, sf):
    a = atoms(spark, sf)
    configured = a.filter("chain = 'B' AND residue_number % 2 = 0")
    return contacts.compare_interface(configured, found_contacts(spark, sf), ["residue_number"])


def sides(spark, sf):
    return _sides(spark, sf)


def side_summary(spark, sf):
    out = contacts.interface_summary(_sides(spark, sf).withColumn("s", F.lit("S")), ["s"])
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("n_interface_residues", join("interface_residues"), join("configured_in_interface"),
                      join("configured_not_in_interface"), join("interface_not_configured"))


def mismatched_sources(spark, sf):
    info = view(spark, sf, "v_pockets").filter("pocket_index <> 2")
    spheres = view(spark, sf, "v_spheres").select(
        (F.col("pocket_id") % 3).cast("long").alias("target_id"), F.col("pocket_id").alias("pocket_index"))
    lining = view(spark, sf, "v_lining").filter("pocket_index <> 7")
    return preparation.source_mismatches(info, spheres, lining).select("target_id", "pocket_index", "problem")


def drift(spark, sf):
    before = view(spark, sf, "v_pockets")
    after = before.filter("pocket_index <> 1").withColumn(
        "volume_A3", F.col("volume_A3") * F.when(F.col("pocket_index") % 3 == 0, 1.2).otherwise(1.05))
    return preparation.volume_drift(before, after, ["target_id", "pocket_index"]).withColumn("drift", F.round("drift", 9))


def shape_scalars(spark, sf):
    s = table(spark, sf, "supplier")
    a, b = F.col("s_suppkey") % 50 + 1.0, F.col("s_suppkey") % 4 * 1.0
    d = G.equivalent_diameter(F.col("s_suppkey") * 20.0)
    return s.select("s_suppkey", F.round(G.elongation(a, b), 9).alias("elongation"),
                    F.round(G.planarity(b, F.col("s_suppkey")), 9).alias("planarity"), F.round(d, 9).alias("d_equiv"))


def shape_flags(spark, sf):
    s = table(spark, sf, "supplier")
    d = G.equivalent_diameter(F.col("s_suppkey") * 20.0)
    return s.select("s_suppkey", G.pocket_shape_warning(F.lit(20.0), d).alias("pocket_warning"),
                    G.patch_shape_warning(F.col("s_suppkey") % 25 * 1.0).alias("patch_warning"))


def outward(spark, sf):
    a = atoms(spark, sf)
    c = a.groupBy("chain").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    out = potential.outward_points(a, c, ["chain"])
    return out.select("atom_id", *[F.round(v, 6).alias(v) for v in "xyz"])


def actions(spark, sf):
    p = view(spark, sf, "v_pdb")
    protein = policy.is_protein(F.col("resname"), F.col("hetero"))
    d = policy.hetero_action(F.col("resname"), protein, retain=("ZN",), remove=("SO4",), default="remove")
    e = policy.hetero_action(F.col("resname"), protein, strip=True)
    return p.select("line_no", d["action"].alias("action"), d["reason"].alias("reason"),
                    e["action"].alias("stripped"), e["reason"].alias("strip_reason"))


def hetero(spark, sf):
    judged = preparation.apply_policy(view(spark, sf, "v_pdb"), retain=("ZN",), remove=("SO4",))
    return preparation.hetero_summary(judged, ["structure_id", "chain"])


def _requests(spark, sf):
    p = view(spark, sf, "v_pdb").select("structure_id").distinct()
    return p.withColumn("chain", F.when(F.col("structure_id") == "S1", "C").when(F.col("structure_id") == "S2", "Q"))


def chains(spark, sf):
    return preparation.select_chain(view(spark, sf, "v_pdb"), _requests(spark, sf))


def prepared(spark, sf):
    _kept, _summary, verdict = measure.prepare_structure(
        view(spark, sf, "v_pdb"), _requests(spark, sf), TargetRequest(remove=("HOH", "SO4")), min_atoms=20)
    return verdict.select("structure_id", "chain", F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"),
                          F.coalesce("n_protein_residues", F.lit(0)).alias("n_protein_residues"), "problem",
                          F.array_join("warnings", ";").alias("warnings"))


def _site_evidence(spark, sf):
    """S0 and S1 against each other's chain, S1 also against one it has not, S2 without partners; residues from supplier."""
    p = view(spark, sf, "v_pdb")
    ids = p.select("structure_id").distinct()
    chosen = ids.withColumn("chain", F.when(F.col("structure_id") == "S1", "C").otherwise("B"))
    other = F.when(F.col("structure_id") == "S0", F.array(F.lit("C"))).when(F.col("structure_id") == "S1", F.array(F.lit("B"), F.lit("Q")))
    site = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string")).alias("structure_id"), F.col("s_suppkey").cast("int").alias("residue_number"))
    return p, chosen, site, ids.select("structure_id", F.explode(other).alias("partner_chain"))


def site_contacts(spark, sf):
    p, chosen, site, partners = _site_evidence(spark, sf)
    _kept, _summary, verdict = measure.prepare_structure(p, chosen, TargetRequest(remove=("HOH", "SO4")), min_atoms=1, site=site, partners=partners)
    v = F.col("partner_contacts")
    join = lambda c: F.array_join(F.transform(v[c], lambda x: x.cast("string")), ",").alias(c)
    return verdict.select("structure_id", "chain", v["computed"].alias("computed"), v["n_interface_residues"].alias("n_interface_residues"),
                          join("partner_chains"), *[join(c) for c in evidence.CONTACTS[4:]], "problem")


def site_problems(spark, sf):
    return evidence.problem_rows(evidence.site_evidence(*_site_evidence(spark, sf))).select(
        "structure_id", "chain", "problem", F.array_join("items", ",").alias("items"))


def _target_rows(spark, sf):
    """Three pocket targets, a surface one, a pocket target without cavities."""
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("target_id"),
        F.when(F.col("r_regionkey") == 3, "surface").otherwise("pocket").alias("binding_mode"),
        F.lit(False).alias("allow_zero_overlap"))


def chosen_pockets(spark, sf):
    site = view(spark, sf, "v_site").filter("target_id <> 2")
    counts = site.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_requested"))
    requests = _target_rows(spark, sf).join(counts, "target_id", "left").select(
        "target_id", F.coalesce("n_requested", F.lit(0)).alias("n_requested"),
        (F.col("binding_mode") == "pocket").alias("require_overlap"), "allow_zero_overlap")
    pockets = view(spark, sf, "v_pockets")
    over = contacts.pocket_overlap(pockets, view(spark, sf, "v_lining"), site)
    return preparation.select_pocket(pockets, over, requests).drop("warning")


def pocket_shapes(spark, sf):
    vol = view(spark, sf, "v_pockets").select(F.col("pocket_index").alias("pocket_id"), "volume_A3")
    out = shapes.pocket_geometry(view(spark, sf, "v_spheres"), ["pocket_id"], vol)
    flat = [F.round(F.get(c, i), 4).alias(f"{n}{i + 1}") for c, n in (
        ("singular_values_A", "sv"), ("centre_extents_A", "ce"), ("envelope_extents_A", "ee")) for i in range(3)]
    return out.select("pocket_id", "n_alpha_spheres", "primary_axis_index", "shape_warning", *flat, *[
        F.round(c, 4).alias(c) for c in ("d_pocket_A", "d_pocket_centres_A", "d_equiv_A", "elongation", "planarity_A")])


def _patch_atoms(spark, sf):
    return atoms(spark, sf).filter("chain = 'B'").withColumn("target_id", F.col("residue_number") % 2)


def _patch_site(spark, sf):
    """Every third residue, and one behind the last that no atom belongs to."""
    own = _patch_atoms(spark, sf)
    beyond = own.groupBy("target_id").agg((F.max("residue_number") + 2).alias("residue_number"))
    return own.filter("residue_number % 3 = 0").select("target_id", "residue_number").distinct().unionByName(beyond)


def patches(spark, sf):
    out = shapes.patch_geometry(_patch_atoms(spark, sf), _patch_site(spark, sf), buried_below=30.0)
    return out.select(
        "target_id", "problem", "n_residues", "n_atoms", F.round("patch_area_A2", 6).alias("patch_area"),
        F.round("total_chain_area_A2", 6).alias("total_area"), F.round("planarity_A", 4).alias("planarity"),
        F.round("elongation", 4).alias("elongation"), "shape_warning",
        F.array_join(F.transform("buried_residue_numbers", lambda x: x.cast("string")), ",").alias("buried"),
        *[F.round(F.get("extents_A", i), 4).alias(f"extent{i + 1}") for i in range(3)])


def _header(spark, sf):
    """Corners from -20 to 20 in steps of 10, one header per chain."""
    return atoms(spark, sf).select("chain").distinct().select(
        "chain", F.array(*[F.lit(-20.0)] * 3).alias("origin"), F.array(*[F.lit(10.0)] * 3).alias("spacing"),
        F.array(*[F.lit(5)] * 3).alias("counts"))


def _grid(spark, sf):
    return view(spark, sf, "v_grid").join(_header(spark, sf).select("chain"), how="cross")


def corner_potential(spark, sf):
    out = potential.sample_potential(atoms(spark, sf), _grid(spark, sf), _header(spark, sf), ["chain"], "atom_id")
    return out.select("atom_id", F.round("potential", 6).alias("potential"))


def site_potential(spark, sf):
    a = atoms(spark, sf)
    return measure.site_potential(a.filter("residue_number % 3 = 0"), a, _grid(spark, sf), _header(spark, sf), ["chain"]).select(
        "chain", "n_points_requested", "n_points_inside_grid", F.round("mean_potential", 6).alias("mean_potential"),
        F.round("median_potential", 6).alias("median_potential"), "electrostatic_compatible", "status")


def summary_potential(spark, sf):
    a = atoms(spark, sf)
    df = a.select(F.col("residue_number").alias("target_id"), F.when(
        (F.col("atom_id") % 4 != 0) & (F.col("residue_number") % 5 != 0), F.col("x")).alias("potential"))
    return potential.potential_summary(df, ["target_id"]).select(
        "target_id", "n_points_requested", "n_points_inside_grid", F.round("mean_potential", 6).alias("mean_potential"),
        F.round("median_potential", 6).alias("median_potential"), "electrostatic_compatible", "status")


def _keyed_spheres(spark, sf):
    return view(spark, sf, "v_spheres").withColumns({
        "target_id": (F.col("pocket_id") % 3).cast("long"), "pocket_index": F.col("pocket_id")})


def measured(spark, sf):
    a = atoms(spark, sf).filter("chain = 'B'").withColumn("target_id", F.lit(3).cast("long"))
    site = view(spark, sf, "v_site").unionByName(
        a.filter("residue_number % 3 = 0").select("target_id", "chain", "residue_number", F.lit("").alias("icode")).distinct())
    out = measure.measure_targets(
        _target_rows(spark, sf), view(spark, sf, "v_pockets"), _keyed_spheres(spark, sf), view(spark, sf, "v_lining"), site, a)
    return out.select("target_id", "binding_mode", "method", "pocket_index", "n_residues", "shape_warning", "problem",
                      *[F.round(c, 4).alias(c) for c in ("d_pocket_A", "d_equiv_A", "patch_area_A2", "elongation", "planarity_A")])


def verified(spark, sf):
    """Stored measurements are our own, except for the faults planted per pocket number."""
    spheres = _keyed_spheres(spark, sf)
    made = shapes.pocket_geometry(spheres, ["target_id", "pocket_index"], view(spark, sf, "v_pockets")).select(
        "target_id", "pocket_index", "volume_A3", "d_pocket_centres_A",
        (F.col("d_pocket_A") + F.when(F.col("pocket_index") == 5, 0.01).otherwise(0.0)).alias("d_pocket_A"))
    stored = made.join(view(spark, sf, "v_pockets").select("target_id", "pocket_index", "n_reported"),
                       ["target_id", "pocket_index"]).withColumn(
        "volume_A3", F.when(F.col("pocket_index") == 8, 0.0).otherwise(F.col("volume_A3")))
    patch = shapes.patch_geometry(_patch_atoms(spark, sf), _patch_site(spark, sf)).withColumn(
        "n_residues", F.col("n_residues") + F.col("target_id"))
    return measure.verify_targets(stored, spheres, view(spark, sf, "v_lining").filter("pocket_index <> 6"), patch)


def pca_sql(points: str, keys: str) -> str:
    """``pca`` and ``along``: principal axes in closed form, and projections.

    ``points`` selects the keys, x, y, z and radius (0 where there is none).
    """
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cross = {1: ("r1", "r2"), 2: ("r1", "r3"), 3: ("r2", "r3")}
    vec = ", ".join(
        f"[{p}[2] * {q}[3] - {p}[3] * {q}[2], {p}[3] * {q}[1] - {p}[1] * {q}[3], {p}[1] * {q}[2] - {p}[2] * {q}[1]] AS w{i}"
        for i, (p, q) in cross.items())
    norm = lambda w: f"({w}[1] * {w}[1] + {w}[2] * {w}[2] + {w}[3] * {w}[3])"
    return f"""pts AS ({points}),
sc AS (SELECT {keys}, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) * covar_pop(x, x) AS a, count(*) * covar_pop(y, y) AS b,
  count(*) * covar_pop(z, z) AS c, count(*) * covar_pop(x, y) AS d, count(*) * covar_pop(x, z) AS e, count(*) * covar_pop(y, z) AS f FROM pts GROUP BY {keys}),
s1 AS (SELECT *, (a + b + c) / 3 AS q FROM sc),
s2 AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM s1),
s3 AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) / 3 AS phi FROM s2),
s4 AS (SELECT *, [q + 2 * p * cos(phi), q - 2 * p * (cos(phi) + cos(phi + 2 * pi() / 3)), q + 2 * p * cos(phi + 2 * pi() / 3)] AS ev FROM s3),
s5 AS (SELECT *, unnest([1, 2, 3]) AS k FROM s4),
s6 AS (SELECT *, [a - ev[k], d, e] AS r1, [d, b - ev[k], f] AS r2, [e, f, c - ev[k]] AS r3 FROM s5),
s7 AS (SELECT *, {vec} FROM s6),
s8 AS (SELECT *, CASE WHEN {norm('w1')} >= {norm('w2')} AND {norm('w1')} >= {norm('w3')} THEN w1 WHEN {norm('w2')} >= {norm('w3')} THEN w2 ELSE w3 END AS w FROM s7),
s9 AS (SELECT *, sqrt({norm('w')}) * CASE WHEN w[list_position([abs(w[1]), abs(w[2]), abs(w[3])], list_max([abs(w[1]), abs(w[2]), abs(w[3])]))] < 0 THEN -1 ELSE 1 END AS ln FROM s8),
pr0 AS (SELECT b.*, a.k, a.n, a.ev, ((x - cx) * w[1] + (y - cy) * w[2] + (z - cz) * w[3]) / ln AS pj FROM s9 a JOIN pts b ON {on}),
ext AS (SELECT {keys}, k, max(n) AS n, max(ev) AS ev, quantile_cont(pj, 0.95) - quantile_cont(pj, 0.05) AS ce,
  quantile_cont(pj + radius, 0.95) - quantile_cont(pj - radius, 0.05) AS ee FROM pr0 GROUP BY {keys}, k),
pca AS (SELECT {keys}, max(n) AS n, sqrt(max(ev[1])) AS sv1, sqrt(max(ev[2])) AS sv2, sqrt(max(ev[3])) AS sv3,
  list(ce ORDER BY k) AS ce, list(ee ORDER BY k) AS ee FROM ext GROUP BY {keys})"""


_SPHERES = "SELECT pocket_id, x, y, z, radius FROM v_spheres"
_PATCH = "SELECT CAST(residue_number % 2 AS INTEGER) AS target_id, residue_number, x, y, z, 0 AS radius, sasa FROM v_atoms WHERE chain = 'B' AND residue_number % 3 = 0"
_CONTACTS = """hits AS (SELECT a.residue_number, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 2) AS min_distance_A
  FROM v_atoms a JOIN v_atoms b ON a.chain = 'B' AND b.chain = 'C' AND abs(a.x - b.x) <= 4.5 AND abs(a.y - b.y) <= 4.5 AND abs(a.z - b.z) <= 4.5
  AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 4.5 GROUP BY 1)"""
_SIDES = _CONTACTS + """, conf AS (SELECT DISTINCT residue_number FROM v_atoms WHERE chain = 'B' AND residue_number % 2 = 0),
sides AS (SELECT coalesce(c.residue_number, h.residue_number) AS residue_number, CASE WHEN c.residue_number IS NULL THEN 'interface_not_configured'
  WHEN h.residue_number IS NULL THEN 'configured_not_in_interface' ELSE 'configured_in_interface' END AS side
  FROM conf c FULL JOIN hits h ON h.residue_number = c.residue_number)"""
_OVER = "ov AS (SELECT p.target_id, p.pocket_index, count(h.residue_number) AS c, string_agg(h.residue_number::VARCHAR, ',' ORDER BY h.residue_number) AS r FROM v_pockets p LEFT JOIN (SELECT DISTINCT l.target_id, l.pocket_index, l.residue_number FROM v_lining l JOIN {site} s ON s.target_id = l.target_id AND s.residue_number = l.residue_number AND s.chain = l.chain) h ON h.target_id = p.target_id AND h.pocket_index = p.pocket_index GROUP BY 1, 2)"
_REASON = """CASE WHEN resname = 'HOH' THEN 'water' WHEN resname IN ('GLY', 'ALA', 'LYS', 'MSE') THEN 'protein' {more} ELSE 'default_policy' END"""
_CORNER = """loc AS (SELECT atom_id, chain, (x + 20) / 10 AS fx, (y + 20) / 10 AS fy, (z + 20) / 10 AS fz FROM {src}),
bs AS (SELECT *, floor(fx)::INT AS kx, floor(fy)::INT AS ky, floor(fz)::INT AS kz FROM loc),
ph AS (SELECT bs.atom_id, bs.chain, sum((1 - abs(fx - g.ix)) * (1 - abs(fy - g.iy)) * (1 - abs(fz - g.iz)) * g.phi) AS potential FROM bs
  LEFT JOIN v_grid g ON g.ix BETWEEN kx AND kx + 1 AND g.iy BETWEEN ky AND ky + 1 AND g.iz BETWEEN kz AND kz + 1
  AND kx BETWEEN 0 AND 3 AND ky BETWEEN 0 AND 3 AND kz BETWEEN 0 AND 3 GROUP BY 1, 2)"""
_SUMMARY = """count(*) AS n_points_requested, count(potential) AS n_points_inside_grid, round(avg(potential), 6) AS mean_potential,
  round(median(potential), 6) AS median_potential, avg(potential) > 0 AS electrostatic_compatible, CASE WHEN count(potential) = 0 THEN 'failed' ELSE 'success' END AS status"""
_PICK = """rq AS (SELECT r_regionkey::BIGINT AS target_id, r_regionkey = 3 AS surface, coalesce(n, 0) AS n FROM region LEFT JOIN (SELECT target_id AS t, count(*) AS n FROM {site} GROUP BY 1) ON t = r_regionkey),
pk AS (SELECT o.*, p.score, p.druggability, row_number() OVER (PARTITION BY o.target_id ORDER BY c DESC, score DESC, druggability DESC NULLS LAST, o.pocket_index) AS k,
  sum(c) OVER (PARTITION BY o.target_id) AS total FROM ov o JOIN v_pockets p ON p.pocket_index = o.pocket_index),
picked AS (SELECT rq.target_id, CASE WHEN pk.k IS NULL THEN CASE WHEN surface THEN 'not_applicable' ELSE 'failed' END WHEN n > 0 AND total = 0 AND NOT surface THEN 'failed' ELSE 'selected' END AS status,
  CASE WHEN pk.k IS NULL THEN 'no_cavity_detected' WHEN n > 0 AND total = 0 AND NOT surface THEN NULL WHEN n > 0 AND total = 0 THEN 'target_site_zero_overlap_fallback'
    WHEN n > 0 THEN 'target_site_overlap' ELSE 'automatic_score' END AS method,
  CASE WHEN NOT (n > 0 AND total = 0 AND NOT surface) THEN pk.pocket_index END AS pocket_index, coalesce(total, 0)::BIGINT AS total_overlap
  FROM rq LEFT JOIN pk ON pk.target_id = rq.target_id AND pk.k = 1)"""

_EVIDENCE = """req AS (SELECT DISTINCT structure_id, CASE structure_id WHEN 'S1' THEN 'C' ELSE 'B' END AS chain FROM v_pdb),
mine AS (SELECT v.* FROM v_pdb v JOIN req ON req.structure_id = v.structure_id AND req.chain = v.chain WHERE NOT hetero),
theirs AS (SELECT * FROM v_pdb WHERE ((structure_id = 'S0' AND chain = 'C') OR (structure_id = 'S1' AND chain = 'B')) AND resname <> 'HOH'),
hits AS (SELECT DISTINCT m.structure_id, m.residue_number AS r FROM mine m JOIN theirs t ON t.structure_id = m.structure_id
  AND sqrt((m.x - t.x) * (m.x - t.x) + (m.y - t.y) * (m.y - t.y) + (m.z - t.z) * (m.z - t.z)) <= 4.5),
site AS (SELECT DISTINCT 'S' || (s_suppkey % 3) AS structure_id, s_suppkey::INTEGER AS r FROM supplier),
here AS (SELECT DISTINCT structure_id, residue_number AS r FROM mine),
gone AS (SELECT structure_id, string_agg(r::VARCHAR, '{sep}' ORDER BY r) AS items FROM site ANTI JOIN here USING (structure_id, r) GROUP BY 1),
codes AS (SELECT structure_id, string_agg(r || 'A', '{sep}' ORDER BY r) AS items FROM (SELECT DISTINCT structure_id, residue_number AS r FROM mine WHERE icode = 'A')
  WHERE structure_id IN (SELECT structure_id FROM site) GROUP BY 1),
problems AS (SELECT 'S1' AS structure_id, 1 AS n, 'partner chains not in the structure' AS problem, 'Q' AS items
  UNION ALL SELECT structure_id, 2, 'requested residues not in the chain', items FROM gone
  UNION ALL SELECT structure_id, 3, 'insertion codes in the chain', items FROM codes)"""

QUERIES = {
    "g6_site_problems": (site_problems, f"WITH {_EVIDENCE.format(sep=',')} SELECT p.structure_id, chain, problem, items FROM problems p JOIN req ON req.structure_id = p.structure_id"),
    "g6_partner_contacts": (site_contacts, f"""WITH {_EVIDENCE.format(sep=', ')},
        conf AS (SELECT * FROM site SEMI JOIN here USING (structure_id, r)),
        joined AS (SELECT coalesce(c.structure_id, h.structure_id) AS structure_id, coalesce(c.r, h.r) AS r, c.r IS NOT NULL AS c, h.r IS NOT NULL AS h
          FROM conf c FULL JOIN hits h ON h.structure_id = c.structure_id AND h.r = c.r),
        l AS (SELECT structure_id, count(*) FILTER (h) AS n, """ + ", ".join(
            f"coalesce(string_agg(r::VARCHAR, ',' ORDER BY r) FILTER ({when}), '') AS {name}" for name, when in (
                ("interface_residues", "h"), ("configured_in_interface", "c AND h"), ("configured_not_in_interface", "c AND NOT h"), ("interface_not_configured", "h AND NOT c")))
        + """ FROM joined GROUP BY 1)
        SELECT req.structure_id, chain, req.structure_id <> 'S2' AS computed, CASE WHEN req.structure_id <> 'S2' THEN coalesce(n, 0) END AS n_interface_residues,
          CASE req.structure_id WHEN 'S0' THEN 'C' WHEN 'S1' THEN 'B,Q' ELSE '' END AS partner_chains, """ + ", ".join(
            f"CASE WHEN req.structure_id <> 'S2' THEN coalesce({c}, '') END AS {c}" for c in evidence.CONTACTS[4:])
        + """, (SELECT arg_min(problem || ': ' || items, p.n) FROM problems p WHERE p.structure_id = req.structure_id) AS problem
        FROM req LEFT JOIN l ON l.structure_id = req.structure_id"""),
    "c10_interface_contacts": (found_contacts, f"WITH {_CONTACTS} SELECT * FROM hits"),
    "c11_absent_residues": (absent, "SELECT (s_suppkey * 3)::INTEGER AS residue_number FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT residue_number FROM v_atoms WHERE chain = 'B')"),
    "c12_pocket_overlap": (overlap, f"WITH {_OVER.format(site='v_site')} SELECT target_id, pocket_index, c AS overlap_count, r AS residues FROM ov"),
    "c13_compare_interface": (sides, f"WITH {_SIDES} SELECT * FROM sides"),
    "d29_interface_set_summary": (side_summary, f"WITH {_SIDES} SELECT count(*) FILTER (side <> 'configured_not_in_interface') AS n_interface_residues, "
        + "coalesce(string_agg(residue_number::VARCHAR, ',' ORDER BY residue_number) FILTER (side <> 'configured_not_in_interface'), '') AS interface_residues, "
        + ", ".join(f"coalesce(string_agg(residue_number::VARCHAR, ',' ORDER BY residue_number) FILTER (side = '{s}'), '') AS {s}"
                    for s in ("configured_in_interface", "configured_not_in_interface", "interface_not_configured")) + " FROM sides"),
    "c14_source_mismatches": (mismatched_sources, """WITH k AS (SELECT pocket_id AS p, count(*) AS v FROM v_spheres GROUP BY 1),
        l AS (SELECT pocket_index AS p, count(*) AS l FROM v_lining WHERE pocket_index <> 7 GROUP BY 1), i AS (SELECT pocket_index AS p, n_reported AS n FROM v_pockets WHERE pocket_index <> 2),
        j AS (SELECT coalesce(i.p, k.p, l.p) AS p, n, v, l FROM i FULL JOIN k ON k.p = i.p FULL JOIN l ON l.p = coalesce(i.p, k.p))
        SELECT (p % 3)::BIGINT AS target_id, p AS pocket_index, CASE WHEN n IS NULL THEN 'not in the info file' WHEN v IS NULL THEN 'no vertex file' WHEN l IS NULL THEN 'no lining residues' ELSE 'sphere counts differ' END AS problem
        FROM j WHERE n IS NULL OR v IS NULL OR l IS NULL OR n <> v"""),
    "c16_volume_drift": (drift, """SELECT target_id, pocket_index, CASE WHEN pocket_index <> 1 THEN 0.2::DOUBLE END AS drift,
        CASE WHEN pocket_index = 1 THEN 'missing' ELSE 'volume moved' END AS problem FROM v_pockets WHERE pocket_index = 1 OR pocket_index % 3 = 0"""),
    "b19_shape_scalars": (shape_scalars, """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'inf'::DOUBLE ELSE round((s_suppkey % 50 + 1)::DOUBLE / (s_suppkey % 4), 9) END AS elongation,
        CASE WHEN s_suppkey > 0 THEN round(2 * (s_suppkey % 4) / sqrt(s_suppkey), 9) END AS planarity,
        CASE WHEN s_suppkey > 0 THEN round(2 * power(3 * s_suppkey * 20 / (4 * pi()), 1.0::DOUBLE / 3), 9) END AS d_equiv FROM supplier"""),
    "b20_shape_warning": (shape_flags, """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey > 0 THEN 20 / (2 * power(3 * s_suppkey * 20 / (4 * pi()), 1.0::DOUBLE / 3)) END AS r FROM supplier)
        SELECT s_suppkey, coalesce(r > 2 OR r < 0.5, false) AS pocket_warning, s_suppkey % 25 > 12 AS patch_warning FROM s"""),
    "b22_offset_outward": (outward, """WITH c AS (SELECT chain, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v_atoms GROUP BY 1),
        d AS (SELECT atom_id, x, y, z, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM v_atoms a JOIN c ON c.chain = a.chain), n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM d)
        SELECT atom_id, round(x + 3 * dx / l, 6) AS x, round(y + 3 * dy / l, 6) AS y, round(z + 3 * dz / l, 6) AS z FROM n"""),
    "b25_hetero_action": (actions, """SELECT line_no, CASE WHEN resname IN ('GLY', 'ALA', 'LYS', 'MSE', 'ZN') THEN 'retained' ELSE 'removed' END AS action, """
        + _REASON.format(more="WHEN resname = 'SO4' THEN 'explicit_remove' WHEN resname = 'ZN' THEN 'explicit_retain'") + """ AS reason,
        CASE WHEN resname IN ('GLY', 'ALA', 'LYS', 'MSE') THEN 'retained' ELSE 'removed' END AS stripped, """
        + _REASON.format(more="WHEN true THEN 'strip_hetatm'") + " AS strip_reason FROM v_pdb"),
    "d14_hetero_summary": (hetero, """SELECT structure_id, chain, resname, CASE WHEN resname IN ('HOH', 'SO4') THEN 'removed' ELSE 'retained' END AS action, """
        + _REASON.format(more="WHEN resname = 'SO4' THEN 'explicit_remove' WHEN resname = 'ZN' THEN 'explicit_retain'")
        + " AS reason, count(DISTINCT residue_number) AS residue_count, count(*) AS atom_count FROM v_pdb GROUP BY ALL"),
    "e10_select_chain": (chains, """WITH f AS (SELECT structure_id, chain, min(line_no) AS l, bool_or(resname IN ('GLY', 'ALA', 'LYS', 'MSE')) AS p FROM v_pdb GROUP BY 1, 2)
        SELECT structure_id, CASE structure_id WHEN 'S1' THEN 'C' WHEN 'S0' THEN arg_min(chain, l) FILTER (p) END AS chain, CASE WHEN structure_id = 'S2' THEN 'chain not found' END AS problem FROM f GROUP BY structure_id"""),
    "g6_prepare_structure": (prepared, """WITH f AS (SELECT structure_id, chain, min(line_no) AS l, bool_or(resname IN ('GLY', 'ALA', 'LYS', 'MSE')) AS p FROM v_pdb GROUP BY 1, 2),
        c AS (SELECT structure_id, CASE structure_id WHEN 'S1' THEN 'C' WHEN 'S0' THEN arg_min(chain, l) FILTER (p) END AS chain, count(*) AS nc FROM f GROUP BY 1),
        a AS (SELECT c.structure_id, any_value(c.chain) AS chain, any_value(nc) AS nc, count(line_no) AS n,
          count(DISTINCT residue_number) FILTER (resname IN ('GLY', 'ALA', 'LYS', 'MSE')) AS np, count(DISTINCT residue_number) FILTER (resname = 'ZN') AS nh
          FROM c LEFT JOIN v_pdb v ON v.structure_id = c.structure_id AND v.chain = c.chain AND v.altloc <> 'B' AND v.resname NOT IN ('HOH', 'SO4') GROUP BY 1)
        SELECT structure_id, chain, n AS n_atoms, np AS n_protein_residues, CASE WHEN structure_id = 'S2' THEN 'chain not found' WHEN np = 0 THEN 'no protein residue after cleaning'
          WHEN n < 20 THEN 'fewer than 20 atoms after cleaning' END AS problem,
          concat_ws(';', CASE WHEN nh > 0 THEN 'hetero residues retained' END, CASE WHEN nc > 1 THEN 'isolated from a complex; the bound-state shape is measured' END) AS warnings FROM a"""),
    "e9_select_pocket": (chosen_pockets, f"WITH st AS (SELECT * FROM v_site WHERE target_id <> 2), {_OVER.format(site='st')}, {_PICK.format(site='st')} SELECT * FROM picked"),
    "d12_pocket_geometry": (pocket_shapes, f"""WITH {pca_sql(_SPHERES, 'pocket_id')}, v AS (SELECT *, list_max(ee) AS d, 2 * power(3 * (200 + 50 * pocket_id) / (4 * pi()), 1.0::DOUBLE / 3) AS eq FROM pca)
        SELECT pocket_id, n AS n_alpha_spheres, (list_position(ee, list_max(ee)) - 1)::INTEGER AS primary_axis_index, d / eq > 2 OR d / eq < 0.5 AS shape_warning,
        round(sv1, 4) AS sv1, round(sv2, 4) AS sv2, round(sv3, 4) AS sv3, {', '.join(f'round({n}[{i}], 4) AS {n}{i}' for n in ('ce', 'ee') for i in (1, 2, 3))},
        round(d, 4) AS d_pocket_A, round(list_max(ce), 4) AS d_pocket_centres_A, round(eq, 4) AS d_equiv_A, round(sv1 / sv3, 4) AS elongation, round(2 * sv3 / sqrt(n), 4) AS planarity_A FROM v"""),
    "d13_patch_geometry": (patches, f"""WITH {pca_sql(_PATCH, 'target_id')}, r AS (SELECT target_id, residue_number, sum(sasa) AS s FROM pts GROUP BY 1, 2),
        g AS (SELECT target_id, count(*) AS n_residues, round(sum(s), 6) AS patch_area, coalesce(string_agg(residue_number::VARCHAR, ',' ORDER BY residue_number) FILTER (s < 30), '') AS buried FROM r GROUP BY 1),
        t AS (SELECT residue_number % 2 AS target_id, sum(sasa) AS total, max(residue_number) + 2 AS beyond FROM v_atoms WHERE chain = 'B' GROUP BY 1)
        SELECT pca.target_id, 'requested residues not present: ' || beyond AS problem, n_residues, pca.n AS n_atoms, patch_area, round(total, 6) AS total_area, round(2 * sv3 / sqrt(n), 4) AS planarity, round(sv1 / sv3, 4) AS elongation,
        2 * sv3 / sqrt(n) > 12 AS shape_warning, buried, round(ce[1], 4) AS extent1, round(ce[2], 4) AS extent2, round(ce[3], 4) AS extent3
        FROM pca JOIN g ON g.target_id = pca.target_id JOIN t ON t.target_id = pca.target_id"""),
    "c17_grid_corners": (corner_potential, f"WITH {_CORNER.format(src='v_atoms')} SELECT atom_id, round(potential, 6) AS potential FROM ph"),
    "g7_sample_potential": (site_potential, """WITH c AS (SELECT chain, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v_atoms GROUP BY 1),
        d AS (SELECT atom_id, a.chain, x, y, z, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM v_atoms a JOIN c ON c.chain = a.chain WHERE residue_number % 3 = 0),
        n AS (SELECT atom_id, chain, x + 3 * dx / l AS x, y + 3 * dy / l AS y, z + 3 * dz / l AS z FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM d)), """
        + _CORNER.format(src="n") + f" SELECT chain, {_SUMMARY} FROM ph GROUP BY chain"),
    "d15_potential_summary": (summary_potential, f"""SELECT residue_number AS target_id, {_SUMMARY} FROM (SELECT residue_number,
        CASE WHEN atom_id % 4 <> 0 AND residue_number % 5 <> 0 THEN x END AS potential FROM v_atoms) GROUP BY 1"""),
    "g5_measure_targets": (measured, f"""WITH {pca_sql(_SPHERES, 'pocket_id')}, {pca_sql(_PATCH.replace('CAST(residue_number % 2 AS INTEGER)', '3'), 'target_id')
            .replace('pts', 'qts').replace('pr0', 'qr0').replace('ext AS', 'qxt AS').replace('FROM ext', 'FROM qxt').replace('pca AS', 'qca AS')
            .replace('sc AS', 'qc AS').replace('FROM sc', 'FROM qc').replace('s1', 'q1').replace('s2', 'q2').replace('s3', 'q3').replace('s4', 'q4').replace('s5', 'q5').replace('s6', 'q6').replace('s7', 'q7').replace('s8', 'q8').replace('s9', 'q9')},
        {_OVER.format(site='v_site')}, {_PICK.format(site="(SELECT target_id FROM v_site UNION ALL SELECT 3)")},
        pa AS (SELECT count(DISTINCT residue_number) AS nr, sum(sasa) AS area FROM qts)
        SELECT p.target_id, CASE WHEN p.target_id = 3 THEN 'surface' ELSE 'pocket' END AS binding_mode, p.method, p.pocket_index, CASE WHEN p.target_id = 3 THEN nr END AS n_residues,
          CASE WHEN p.target_id = 3 THEN 2 * q.sv3 / sqrt(q.n) > 12 ELSE list_max(g.ee) / e.eq > 2 OR list_max(g.ee) / e.eq < 0.5 END AS shape_warning,
          CASE WHEN p.target_id = 4 THEN 'no cavity was detected; a measured patch is the evidence' END AS problem,
          round(list_max(g.ee), 4) AS d_pocket_A, round(e.eq, 4) AS d_equiv_A, CASE WHEN p.target_id = 3 THEN round(area, 4) END AS patch_area_A2,
          round(CASE WHEN p.target_id = 3 THEN q.sv1 / q.sv3 ELSE g.sv1 / g.sv3 END, 4) AS elongation,
          round(CASE WHEN p.target_id = 3 THEN 2 * q.sv3 / sqrt(q.n) ELSE 2 * g.sv3 / sqrt(g.n) END, 4) AS planarity_A
        FROM picked p LEFT JOIN pca g ON g.pocket_id = p.pocket_index LEFT JOIN (SELECT pocket_index AS k, 2 * power(3 * volume_A3 / (4 * pi()), 1.0::DOUBLE / 3) AS eq FROM v_pockets) e ON e.k = p.pocket_index
        LEFT JOIN qca q ON q.target_id = p.target_id CROSS JOIN pa"""),
    "g10_verify_targets": (verified, """SELECT (p % 3)::BIGINT AS target_id, 'pocket ' || p AS item, m AS problem FROM (SELECT pocket_index AS p,
          unnest(CASE pocket_index WHEN 4 THEN ['sphere count differs from the report'] WHEN 5 THEN ['d_pocket_A differs when recomputed']
            WHEN 6 THEN ['no lining residues recorded'] WHEN 3 THEN ['no lining residues recorded'] WHEN 8 THEN ['non-positive volume'] ELSE [] END) AS m FROM v_pockets)
        UNION ALL SELECT 1, 'patch', 'residue count differs'"""),
}
