"""Every threshold of the engine, in one frozen object, and its YAML form."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    # noise along shared boundaries
    sliver_abs: float = 0.5
    sliver_rel: float = 1e-4
    # topology of one layer, as fractions of its area
    self_overlap_warn: float = 0.001
    self_overlap_error: float = 0.01
    gap_warn: float = 0.01
    area_method_pct: float = 0.05
    # rows of the transition matrix
    closure_abs: float = 2.0
    closure_pct: float = 0.15
    continuity: float = 0.90
    conservation_abs: float = 5.0
    conservation_pct: float = 0.5
    # documents that corroborate a lineage edge: years from a - before to b + after
    corroboration_before: int = 1
    corroboration_after: int = 3
    confidence: dict[str, float] = field(default_factory=lambda: {"GAZETTE_CORROBORATED": 0.95, "GAZETTE_CORROBORATED_WEAK": 0.85, "SPATIAL_INFERRED": 0.70})
    # events
    residual_pct: float = 1.0
    recovery_threshold: float = 0.65
    recovery_weights: dict[str, float] = field(default_factory=lambda: {"adjacency": 0.25, "parent": 0.30, "boundary": 0.20, "area": 0.15, "event": 0.10})
    # discovery
    discovery_min_area: float = 1.0
    discovery_min_pct: float = 0.5
    candidate_weights: dict[str, float] = field(
        default_factory=lambda: {"area": 0.25, "pct_pre": 0.20, "pct_cand": 0.15, "boundary": 0.10, "adjacent": 0.05, "year": 0.05, "parent_child": 0.10, "state": 0.05, "name": 0.03, "declared": 0.02}
    )
    confirm_threshold: float = 0.55
    discovery_threshold: float = 0.65
    possible_threshold: float = 0.30
    candidates_kept: int = 30
    recent_gap_years: int = 4
    latest_vintage: int = 2025
    cross_state: bool = True
    # backfill
    backfill_depth: int = 15
    direct_share: float = 0.95
    # crosswalk
    overclaim: float = 1.001
    coverage_warn: float = 0.85
    # entity matching
    match_accept: float = 0.85
    match_review: float = 0.60
    # choices where the common behaviour is doubtful
    strict_rename: bool = False
    fold_underscore: bool = False

    def with_(self, **changes) -> Settings:  # noqa: ANN003
        return replace(self, **changes)


def load(path: str | Path) -> Settings:
    """Settings from a YAML mapping of field names; unknown names are an error, missing ones keep their defaults."""
    import yaml

    given = yaml.safe_load(Path(path).read_text()) or {}
    if unknown := set(given) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**given)


@dataclass(frozen=True)
class LayerSource:
    """How the columns of one layer's file are named, and which of its layers are set aside."""

    dataset: str
    year: int
    path: str
    pk_field: str
    name_field: str
    state_field: str | None = None
    state_code_field: str | None = None
    primary_layer: str | None = None
    quarantine_layers: tuple[str, ...] = ()


def load_sources(path: str | Path) -> list[LayerSource]:
    import yaml

    given = yaml.safe_load(Path(path).read_text())["layers"]
    return [LayerSource(**(x | {"quarantine_layers": tuple(x.get("quarantine_layers", ()))})) for x in given]
