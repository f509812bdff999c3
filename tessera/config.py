"""Settings of panels, folds and the leakage protocol."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelConfig:
    """Roles of a panel's columns."""

    entity: str = "entity_id"
    period: str = "period"
    name: str = "entity_name"
    stratum: str = "entity_stratum"
    target_source: str = "target_source"
    target: str = "target"
    lags: tuple[int, ...] = (2, 3)
    excluded: tuple[str, ...] = ()
    derived_prefix: str = "target_"

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.period]

    @property
    def roles(self) -> set[str]:
        return {self.entity, self.period, self.name, self.stratum, self.target_source, self.target}


@dataclass(frozen=True)
class FoldConfig:
    """Sizes, in periods, of walk-forward folds over a closed range; ``most`` keeps the first folds only."""

    first: int
    last: int
    min_train: int
    validation: int
    test: int
    gap: int = 2
    step: int = 1
    embargo: int = 0
    most: int | None = None


@dataclass(frozen=True)
class ProtocolConfig:
    """Thresholds of feature selection and of the leakage checks."""

    floor: float = 0.15
    relaxed_floor: float = 0.10
    least_features: int = 5
    proxy: float = 0.80
    collinear: float = 0.8
    least_rows: int = 10
    reconstruction: float = 0.95
    identity: float = 1 - 1e-9
    tolerance: float = 1e-9
    shrinkage: tuple[float, ...] = (0.6, 0.8, 1.0)
    metadata_fragments: tuple[str, ...] = field(default=("_id", "batch", "lineage", "quality_score"))


class LeakageViolation(ValueError):
    """A fold, feature or artifact breaks the leakage protocol."""
