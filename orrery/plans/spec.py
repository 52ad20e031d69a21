"""Typed declarations of populations and the statistics that calibration gives them."""

from __future__ import annotations

from dataclasses import dataclass, field


class OrreryError(Exception):
    """Base of the engine's errors."""


class NavigationError(OrreryError):
    """A step that the current position or data do not allow."""


class NoAliveEdge(NavigationError):
    """No alive edge leads to the line."""


class EntityNotFound(NavigationError):
    """No entity has the key."""


class PositionError(NavigationError):
    """The position is of another kind than the step needs."""


class StorageError(OrreryError):
    """Something is wrong with stored tables."""


class MissingTable(StorageError):
    """A table or version does not exist."""


class CorruptedTable(StorageError):
    """A stored table or its metadata cannot be read."""


class VersionError(OrreryError):
    """A specification of an unsupported version."""


@dataclass(frozen=True)
class Dimension:
    """One coordinate: a relation (binary or continuous), an event column, a tracked property, or self."""

    name: str
    kind: str = "continuous"
    column: str | None = None
    edge_max: float | str = "auto"
    percentile: float = 99.0
    line: str | None = None
    direction: str = "out"
    display_name: str | None = None

    KINDS = ("self", "binary", "continuous", "event", "property")

    def __post_init__(self):
        if self.kind not in self.KINDS:
            raise ValueError(f"unknown kind of dimension: {self.kind}")
        if self.edge_max != "auto" and not float(self.edge_max) > 0:
            raise ValueError(f"edge_max of {self.name} must be positive")

    @property
    def source(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Pattern:
    """A population: its key, dimensions and how it is calibrated."""

    pattern_id: str
    key: str
    dimensions: tuple[Dimension, ...]
    pattern_type: str = "anchor"
    anomaly_percentile: float = 95.0
    group_by: str | None = None
    weights: str | tuple[float, ...] | None = None
    mahalanobis: bool = False
    components: int | None = None

    def __post_init__(self):
        if not self.dimensions:
            raise ValueError(f"pattern {self.pattern_id} needs a dimension")
        kinds = {d.kind for d in self.dimensions if d.kind in ("binary", "continuous")}
        if len(kinds) > 1:
            raise ValueError("relations must be all binary or all continuous")
        if len({d.name for d in self.dimensions}) < len(self.dimensions):
            raise ValueError("names of dimensions repeat")

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dimensions]

    def index(self, name: str) -> int:
        """Place of a dimension by name, display name or line."""
        for i, d in enumerate(self.dimensions):
            if name in (d.name, d.display_name, d.line):
                return i
        raise ValueError(f"no dimension {name!r}; there are {', '.join(self.names)}")

    @property
    def deltas(self) -> list[str]:
        return [f"delta_{n}" for n in self.names]

    @property
    def shapes(self) -> list[str]:
        return [f"shape_{n}" for n in self.names]


@dataclass(frozen=True)
class Alias:
    """A sub-population on one side of a hyperplane in delta space."""

    alias_id: str
    pattern_id: str
    normal: tuple[float, ...]
    bias: float

    @classmethod
    def of_dimension(cls, alias_id: str, pattern: Pattern, dimension: str, threshold: float) -> Alias:
        at = pattern.index(dimension)
        return cls(alias_id, pattern.pattern_id, tuple(float(i == at) for i in range(len(pattern.dimensions))), threshold)


@dataclass
class Calibration:
    """What calibration learned: small arrays on the driver."""

    edge_max: dict[str, float]
    mu: list[float]
    sigma: list[float]
    theta: float
    rows: int
    weights: list[float] | None = None
    cholesky_inverse: list[list[float]] | None = None
    groups: dict[str, dict] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return dict(self.__dict__)


@dataclass(frozen=True)
class Source:
    """A scanner's source of suspects."""

    name: str
    kind: str
    frame: object
    key: str
    weight: float = 1.0
    separator: str | None = None
    filter_expr: str | None = None
    related: object = None
    threshold: float | None = None
    combine: str = "AND"
    rules: tuple[str, ...] = ()
