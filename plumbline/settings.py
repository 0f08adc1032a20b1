"""Parameters of the scoring jobs and the checks they must pass."""

from __future__ import annotations

from dataclasses import dataclass, field

LOWER, HIGHER, TWO_SIDED = "lower", "higher", "two_sided"
POCKET, SURFACE = "pocket", "surface"
FOOTPRINT_MODELS = ("radius_of_gyration", "length")

# Fixed value: the sentence every explanation ends with.
TARGET_CAVEAT = "Tier 2 reflects geometric plausibility only — it is not evidence of binding."


@dataclass(frozen=True)
class Criterion:
    """One scored column. ``structural`` ones also enter the control comparison."""

    name: str
    mode: str
    weight: float = 1.0
    structural: bool = True

    def __post_init__(self):
        if self.mode not in (LOWER, HIGHER, TWO_SIDED):
            raise ValueError(f"unknown criterion mode {self.mode!r}")
        if self.weight < 0:
            raise ValueError(f"criterion {self.name!r} has a negative weight")


DEFAULT_CRITERIA = (
    Criterion("mfe_norm", LOWER),
    Criterion("ensemble_defect", LOWER),
    Criterion("positional_entropy_mean", LOWER),
    Criterion("stem_fraction", TWO_SIDED),
    Criterion("gc_fraction", TWO_SIDED, structural=False),
)


def active(criteria):
    """Criteria with a positive weight; none at all is an error."""
    used = tuple(c for c in criteria if c.weight > 0)
    if not used:
        raise ValueError("no criterion has a positive weight")
    return used


def structural(criteria):
    return active(tuple(c for c in criteria if c.structural))


@dataclass(frozen=True)
class ControlTest:
    """Monte-Carlo comparison of a row with ``n_shuffles`` shuffles of itself."""

    n_shuffles: int = 20
    k: int = 2
    alpha: float = 0.05
    seed: int = 42

    def __post_init__(self):
        if self.n_shuffles < 1:
            raise ValueError("n_shuffles must be at least 1")
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie in (0, 1)")
        if 1.0 / (self.n_shuffles + 1) > self.alpha:
            raise ValueError(
                f"{self.n_shuffles} shuffles cannot reach alpha={self.alpha}: the "
                f"smallest p-value is {1.0 / (self.n_shuffles + 1):.4f}"
            )


@dataclass(frozen=True)
class Comparison:
    """Constants of the candidate-to-target comparison, in Angstrom."""

    a_per_nt: float = 6.0
    a_per_bp: float = 2.8
    footprint_scale: float = 1.0
    flex_c: float = 1.0
    sigma: float = 6.0
    sigma_area: float = 600.0
    charge_enabled: bool = True
    charge_scale: float = 5.0
    weight_size: float = 1.0
    weight_charge: float = 1.0
    footprint_model: str = "radius_of_gyration"
    primary: str = "flexible"
    moderate: float = 0.75
    strong: float = 0.95
    n_survivors: int = 1000

    def __post_init__(self):
        for name in ("a_per_nt", "a_per_bp", "footprint_scale", "flex_c", "sigma",
                     "sigma_area", "charge_scale"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.weight_size < 0 or self.weight_charge < 0:
            raise ValueError("surface weights must be non-negative")
        if self.weight_size + self.weight_charge <= 0:
            raise ValueError("surface weights leave no signal")
        if self.footprint_model not in FOOTPRINT_MODELS:
            raise ValueError(f"footprint_model must be one of {FOOTPRINT_MODELS}")
        if self.primary not in ("flexible", "extended"):
            raise ValueError("primary must be 'flexible' or 'extended'")
        if not 0 < self.moderate < self.strong < 1:
            raise ValueError("require 0 < moderate < strong < 1")
        if self.n_survivors < 1:
            raise ValueError("n_survivors must be at least 1")


@dataclass(frozen=True)
class TargetRequest:
    """What to measure on one structure."""

    chain: str | None = None
    partners: tuple = ()
    mode: str = POCKET
    site_residues: tuple = ()
    strip_hetero: bool = False
    retain: tuple = ()
    remove: tuple = ("HOH", "DOD", "WAT")
    hetero_default: str = "retain"
    allow_zero_overlap: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in (POCKET, SURFACE):
            raise ValueError(f"unsupported binding mode {self.mode!r}")
        if self.chain is not None and self.chain in self.partners:
            raise ValueError("the target chain cannot be its own partner")
        if self.hetero_default not in ("retain", "remove"):
            raise ValueError("hetero_default must be 'retain' or 'remove'")


def check_lengths(min_length: int, max_length: int) -> None:
    if not 0 < min_length <= max_length:
        raise ValueError(f"require 0 < min_length <= max_length, got {min_length}, {max_length}")
