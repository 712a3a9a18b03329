"""Settings of the synthesizer: validated, immutable, and free of Spark objects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

# Defaults of the published method.
STITCH_MIN_RATIO = 0.7
DERIVED_MIN_COLUMNS = 1
DERIVED_RESERVED_SHARE = 0.5
DERIVED_WEIGHT_SHARE = 0.7
CATEGORY_LIMIT = 15
VARIANCE_LIMIT = 1e-5


@dataclass(frozen=True)
class Interval:
    lower: int = 2
    upper: int = 5

    def __post_init__(self) -> None:
        if self.lower < 0 or self.upper < self.lower:
            raise ValueError("an interval needs 0 <= lower <= upper")


@dataclass(frozen=True)
class SynthConfig:
    low_threshold: int = 3
    low_layer_sd: float = 1.0
    low_mean_gap: float = 2.0
    singularity_threshold: int = 5
    range_threshold: int = 15
    outliers: Interval = field(default_factory=Interval)
    top: Interval = field(default_factory=Interval)
    noise_sd: float = 1.0
    clustering: bool = True
    # Rows drawn to measure dependence and entropy; None measures every row.
    sample_size: int | None = None
    max_cluster_weight: float = 15.0
    merge_threshold: float = 0.1
    depth_row_fraction: int = 10000
    depth_threshold: int = 15
    salt: str | None = None
    table_name: str = "table"
    search_candidates: int = 2000

    def __post_init__(self) -> None:
        if min(self.low_threshold, self.singularity_threshold, self.range_threshold) < 2:
            raise ValueError("thresholds must be at least 2")
        if min(self.low_layer_sd, self.noise_sd, self.low_mean_gap) < 0:
            raise ValueError("deviations and the mean gap cannot be negative")
        if (self.sample_size is not None and self.sample_size < 1) or self.depth_row_fraction < 1:
            raise ValueError("sample size and row fraction must be positive")
        if self.search_candidates < 1:
            raise ValueError("the cluster search needs at least one candidate")


@dataclass(frozen=True)
class DerivedCluster:
    derived: tuple[str, ...]
    stitch: tuple[str, ...] = ()
    owner: str = "shared"

    def __post_init__(self) -> None:
        object.__setattr__(self, "derived", tuple(self.derived))
        object.__setattr__(self, "stitch", tuple(self.stitch))
        object.__setattr__(self, "owner", self.owner.lower())
        if self.owner not in ("left", "right", "shared"):
            raise ValueError(f"invalid stitch owner: {self.owner}")
        if not self.derived:
            raise ValueError("a derived cluster needs derived columns")


@dataclass(frozen=True)
class ClusterSpec:
    """Columns synthesized together first, then the clusters joined to them in order."""

    initial: tuple[str, ...]
    derived: tuple[DerivedCluster, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "initial", tuple(self.initial))
        object.__setattr__(self, "derived", tuple(self.derived))
        if not self.initial:
            raise ValueError("the initial cluster is empty")

    def validate(self, columns: Sequence[str]) -> None:
        present = set(self.initial)
        for cluster in self.derived:
            missing = [c for c in cluster.stitch if c not in present]
            if missing:
                raise ValueError(f"stitch columns not available on the left side: {missing}")
            present |= set(cluster.derived)
        if present != set(columns):
            raise ValueError("clusters must cover every column exactly; got "
                             f"{sorted(present)} for {sorted(columns)}")
