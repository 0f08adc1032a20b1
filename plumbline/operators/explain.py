"""Rule-based explanations: conditions and templates as columns.

A rule fires when its condition holds and every number its sentence quotes is
there. Rules are data: pass your own list to ``explain``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import TARGET_CAVEAT

CAUTION, POSITIVE, NEUTRAL = "caution", "positive", "neutral"


@dataclass(frozen=True)
class Rule:
    """``condition`` and ``values`` are SQL over the record; ``template`` is printf style."""

    name: str
    kind: str
    priority: int
    condition: str
    template: str
    values: tuple = ()
    chip: str | None = None


_SURFACE = "binding_mode = 'surface'"
_CAVITY = "coalesce(binding_mode, '') <> 'surface'"
_PHRASE = (
    "CASE WHEN footprint_radius_A IS NOT NULL THEN format_string('Folded, the candidate is about %.0f Å across and', footprint_radius_A) "
    "WHEN footprint_nt IS NOT NULL THEN format_string('At %.0f nt the candidate', footprint_nt) END")
_CHARGE = "CASE WHEN mean_potential > 0 THEN 'hospitable to' ELSE 'repulsive to' END"
_HAIRPINS = "concat(n_hairpins, ' hairpin loop', CASE WHEN n_hairpins = 1 THEN '' ELSE 's' END)"

# Names, kinds, priorities, thresholds, sentences and labels of the
# evidence rules, in order of priority.
RULES = (
    Rule("shuffle_fail", CAUTION, 10, "NOT shuffle_pass",
         "Does not outscore its own dinucleotide-shuffled controls (beat %d of %d, p = %.3f), so this structural "
         "score may reflect nucleotide composition rather than arrangement.",
         ("shuffle_wins", "shuffle_n", "shuffle_p_value"), "shuffle control failed"),
    Rule("poorly_defined_fold", CAUTION, 20, "ensemble_defect_score < 0.3",
         "Does not settle on one shape — ensemble defect %.3f is in the bottom %.0f%% of the reference corpus.",
         ("ensemble_defect", "100 * ensemble_defect_score"), "unstable fold"),
    Rule("barely_pairs", CAUTION, 30, "stem_fraction < 0.2",
         "Only %.0f%% of positions are paired, so the candidate has little defined structure to present to a target.",
         ("100 * stem_fraction",), "little structure"),
    Rule("atypical_composition", CAUTION, 40, "gc_fraction_score < 0.25",
         "GC content %.0f%% sits in the tail of the corpus distribution (typicality %.2f).",
         ("100 * gc_fraction", "gc_fraction_score"), "atypical GC"),
    Rule("uncertain_loop_size", CAUTION, 50, "loop_nt_median > 0 AND loop_nt_iqr >= 0.5D * loop_nt_median",
         "Largest-loop size is itself uncertain across the sampled ensemble (median %.0f nt, IQR %.0f nt), so the "
         "target-aware comparison below rests on a soft number.",
         ("loop_nt_median", "loop_nt_iqr"), "loop size uncertain"),
    Rule("tier2_weak", CAUTION, 60, f"band = 'weak' AND {_CAVITY}",
         "Largest accessible loop spans approximately %.0f Å, a poor geometric match to the %.1f Å cavity detected "
         "on the target.", ("d_apt_flexible_A", "d_pocket_A"), "geometry: weak"),
    Rule("surface_weak", CAUTION, 61, f"band = 'weak' AND {_SURFACE}",
         "%s would cover roughly %.0f Å², a poor match to the %.0f Å² binding site measured on the target.",
         (_PHRASE, "footprint_area_A2", "patch_area_A2"), "size: weak match"),
    Rule("dominant_fold", POSITIVE, 110, "ensemble_defect_score > 0.9",
         "Folds into a single dominant structure — ensemble defect %.3f sits in the top %.0f%% of the reference corpus.",
         ("ensemble_defect", "100 * (1 - ensemble_defect_score)"), "well-defined fold"),
    Rule("tier2_strong", POSITIVE, 120, f"band = 'strong' AND {_CAVITY}",
         "Largest accessible loop spans approximately %.0f Å, compatible with the %.1f Å cavity detected on the target.",
         ("d_apt_flexible_A", "d_pocket_A"), "geometry: strong"),
    Rule("surface_strong", POSITIVE, 121, f"band = 'strong' AND {_SURFACE}",
         "%s would cover roughly %.0f Å², a close match to the %.0f Å² binding site measured on the target.",
         (_PHRASE, "footprint_area_A2", "patch_area_A2"), "size: strong match"),
    Rule("shuffle_pass", POSITIVE, 130, "shuffle_pass",
         "Outscores its dinucleotide-shuffled counterparts by %.2f on the structural criteria (p = %.3f), so the "
         "ranking is not driven by composition alone.", ("shuffle_margin", "shuffle_p_value"), "beats shuffled controls"),
    Rule("stable_for_length", POSITIVE, 140, "mfe_norm_score > 0.85",
         "Unusually stable for its length at %.3f kcal/mol per nucleotide (top %.0f%% of the corpus).",
         ("mfe_norm", "100 * (1 - mfe_norm_score)"), "stable"),
    Rule("typical_architecture", POSITIVE, 150, "stem_fraction_score > 0.8",
         "Stem/loop balance is typical of validated aptamers (%.0f%% paired, %s).",
         ("100 * stem_fraction", _HAIRPINS), "typical architecture"),
    Rule("certain_fold", POSITIVE, 160, "positional_entropy_mean_score > 0.85",
         "Positional entropy averages %.2f, so the pairing is well determined along the whole sequence.",
         ("positional_entropy_mean",), "low uncertainty"),
    Rule("tier2_moderate", NEUTRAL, 170, f"band = 'moderate' AND {_CAVITY}",
         "Largest accessible loop spans approximately %.0f Å against a %.1f Å cavity — a moderate geometric match "
         "relative to shuffled controls.", ("d_apt_flexible_A", "d_pocket_A"), "geometry: moderate"),
    Rule("surface_moderate", NEUTRAL, 171, f"band = 'moderate' AND {_SURFACE}",
         "%s would cover roughly %.0f Å² against a %.0f Å² binding site — a moderate size match relative to shuffled "
         "controls.", (_PHRASE, "footprint_area_A2", "patch_area_A2"), "size: moderate match"),
    Rule("surface_charge", NEUTRAL, 180, _SURFACE,
         "The binding site itself carries a mean potential of %+.1f kT/e, which is %s a negatively charged RNA "
         "backbone — a property of the target, identical for every candidate here.",
         ("mean_potential", _CHARGE), "site charge"),
    Rule("tier2_not_evaluated", NEUTRAL, 200, "status = 'not_evaluated'",
         "No target-aware evidence was computed for this candidate: it falls outside the Tier 2 cut.", (),
         "Tier 2 not evaluated"),
    Rule("tier2_not_run", NEUTRAL, 201, "status = 'not_run'",
         "This run scored intrinsic quality only — no target was supplied, so no target-aware evidence exists for any "
         "candidate.", (), "Tier 1 only"),
    Rule("duplicated", NEUTRAL, 210, "duplicate_count > 1", "Submitted %d times in this batch.", ("duplicate_count",),
         "duplicated input"),
)

# Columns the rules read, with the type a missing one gets.
COLUMNS = {
    "shuffle_pass": "boolean", "shuffle_wins": "bigint", "shuffle_n": "bigint", "shuffle_p_value": "double",
    "shuffle_margin": "double", "ensemble_defect": "double", "ensemble_defect_score": "double", "stem_fraction": "double",
    "stem_fraction_score": "double", "gc_fraction": "double", "gc_fraction_score": "double", "mfe_norm": "double",
    "mfe_norm_score": "double", "positional_entropy_mean": "double", "positional_entropy_mean_score": "double",
    "loop_nt_median": "double", "loop_nt_iqr": "double", "n_hairpins": "bigint", "band": "string", "status": "string",
    "binding_mode": "string", "d_apt_flexible_A": "double", "d_pocket_A": "double", "footprint_area_A2": "double",
    "footprint_radius_A": "double", "footprint_nt": "double", "patch_area_A2": "double", "mean_potential": "double",
    "duplicate_count": "bigint",
}


def _literal(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entry(rule: Rule) -> str:
    ready = "".join(f" AND ({v}) IS NOT NULL" for v in rule.values)
    text = f"format_string({', '.join([_literal(rule.template), *rule.values])})" if rule.values else _literal(
        rule.template.replace("%%", "%"))
    return (f"CASE WHEN coalesce({rule.condition}, false){ready} THEN named_struct('priority', {rule.priority}, 'kind', "
            f"'{rule.kind}', 'name', {_literal(rule.name)}, 'text', {text}, 'chip', {_literal(rule.chip)}) END")


def explain(records: DataFrame, rules=RULES, max_sentences: int = 4, max_cautions: int = 2,
            caveat: str | None = TARGET_CAVEAT) -> DataFrame:
    """Add ``explanation``: text, chips and the names of the rules that fired."""
    missing = {c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in records.columns}
    flat = records.withColumns(missing) if missing else records
    ordered = sorted(rules, key=lambda r: r.priority)
    fired = flat.withColumn("__f", F.expr("array_compact(array(" + ",\n".join(_entry(r) for r in ordered) + "))"))
    cautions = f"slice(filter(__f, r -> r.kind = 'caution'), 1, {max_cautions})"
    fired = fired.withColumn("__c", F.expr(cautions)).withColumn("__s", F.expr(
        f"array_sort(concat(__c, slice(filter(__f, r -> r.kind <> 'caution'), 1, greatest({max_sentences} - size(__c), 0))))"))
    tail = "" if not caveat else ", " + _literal(caveat)
    out = fired.withColumn("explanation", F.expr(
        f"""named_struct('text', concat_ws(' ', array_join(transform(__s, r -> r.text), ' '){tail}),
            'chips', transform(filter(__s, r -> r.chip IS NOT NULL), r -> named_struct('label', r.chip, 'kind', r.kind)),
            'rules_fired', transform(__s, r -> r.name))"""))
    return out.drop("__f", "__c", "__s", *missing)
