"""Validated configuration: projections, scans, volume sampling."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields


class ConfigurationError(ValueError):
    """A setting has a wrong type or value."""


class InvalidProjectionError(ConfigurationError):
    """A projection names dimensions or grids that do not exist."""


def resolve_dims(dims: list, n_dims: int, names: list[str] | None = None) -> list[int]:
    """Dimension numbers of numbers and names mixed."""
    out = []
    for d in dims:
        if isinstance(d, str):
            if not names or d not in names:
                raise InvalidProjectionError(f"unknown parameter {d!r}")
            d = names.index(d)
        if isinstance(d, bool) or not isinstance(d, int) or not 0 <= d < n_dims:
            raise InvalidProjectionError(f"dimension {d!r} is not in 0..{n_dims - 1}")
        out.append(d)
    if len(set(out)) != len(out) or not out:
        raise InvalidProjectionError("dimensions must be distinct and at least one")
    return out


@dataclass(frozen=True)
class Projection:
    """A regular grid over some dimensions of a box: n intervals give n + 1 nodes, both ends included.

    Dimensions are sorted, and each keeps its own grid_points.
    """

    dims: tuple[int, ...]
    grid_points: tuple[int, ...]
    bounds: tuple[tuple[float, float], ...]
    method: str = "lbfgs"
    patch: bool = True
    refine: int = 1

    @staticmethod
    def of(dims: list, grid_points: list[int], bounds: list, names: list[str] | None = None, **more) -> Projection:
        numbers = resolve_dims(list(dims), len(bounds), names)
        if len(grid_points) != len(numbers):
            raise InvalidProjectionError("one grid_points value for each dimension")
        if any(isinstance(g, bool) or not isinstance(g, int) or g < 1 for g in grid_points):
            raise InvalidProjectionError("grid_points must be positive integers")
        if any(not (math.isfinite(lo) and math.isfinite(hi) and lo < hi) for lo, hi in bounds):
            raise ConfigurationError("each bound needs finite lower < upper")
        if more.get("method", "lbfgs") not in ("lbfgs", "de", "de_table"):
            raise InvalidProjectionError("method must be lbfgs, de or de_table")
        if int(more.get("refine", 1)) < 1:
            raise InvalidProjectionError("refine must be a positive integer")
        both = sorted(zip(numbers, grid_points))
        return Projection(tuple(d for d, _ in both), tuple(g for _, g in both), tuple((float(a), float(b)) for a, b in bounds), **more)

    @property
    def profiled(self) -> tuple[int, ...]:
        return tuple(d for d in range(len(self.bounds)) if d not in self.dims)

    @property
    def cells(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.dims))]

    def box(self, k: int) -> tuple[float, float]:
        return self.bounds[self.dims[k]]

    def refined(self, factor: int) -> Projection:
        return Projection(self.dims, tuple(g * factor for g in self.grid_points), self.bounds, self.method, self.patch)

    def coordinate(self, k: int, i: int) -> float:
        lo, hi = self.box(k)
        return lo + (hi - lo) * i / self.grid_points[k]


def parse_n_optima(x) -> tuple[int, int | None] | None:
    """None, a number (exact), or {min, max}: (least, most)."""
    if x is None:
        return None
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0
    if whole(x):
        return x, x
    if isinstance(x, dict) and x and set(x) <= {"min", "max"} and all(whole(v) for v in x.values()):
        low, high = x.get("min", 1), x.get("max")
        if high is None or low <= high:
            return low, high
    raise ConfigurationError(f"n_optima {x!r} is no positive integer or {{min, max}}")


@dataclass
class VolumeConfig:
    """Settings of volume sampling; unknown keys are refused."""

    roi_threshold: float = 4.0
    n_walkers: int = 1000
    n_steps: int = 50
    sigma_frac: float = 0.1
    partner_level_window: float | None = None
    warm_start: bool = True
    eval_budget: int | None = None
    stay_in_box: bool = True
    output_file: str | None = None
    summary_file: str | None = None

    @staticmethod
    def from_dict(d: dict) -> VolumeConfig:
        known = {f.name for f in fields(VolumeConfig)}
        if extra := set(d) - known:
            raise ConfigurationError(f"unknown volume settings {sorted(extra)}")
        return VolumeConfig(**d)

    def __post_init__(self) -> None:
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x > 0
        for name in ("roi_threshold", "sigma_frac"):
            if not number(getattr(self, name)):
                raise ConfigurationError(f"{name} must be positive and finite")
        if self.partner_level_window is not None and not number(self.partner_level_window):
            raise ConfigurationError("partner_level_window must be positive")
        for name, least in (("n_walkers", 2), ("n_steps", 1)):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v < least:
                raise ConfigurationError(f"{name} must be an integer of at least {least}")
        if self.eval_budget is not None and (isinstance(self.eval_budget, bool) or not isinstance(self.eval_budget, int) or self.eval_budget < 1):
            raise ConfigurationError("eval_budget must be a positive integer")
        if not isinstance(self.warm_start, bool) or not isinstance(self.stay_in_box, bool):
            raise ConfigurationError("warm_start and stay_in_box must be booleans")
        for name in ("output_file", "summary_file"):
            if getattr(self, name) is not None and not (isinstance(getattr(self, name), str) and getattr(self, name)):
                raise ConfigurationError(f"{name} must not be empty")


@dataclass
class ScanConfig:
    roi_threshold: float = 4.0
    population: int = 3
    max_waves: int = 10
    max_iter: int = 50
    ftol: float = 1e-9
    n_starts: int | None = None  # min(400, 50 for each dimension)
    batch: int = 10
    undiscovered: float = 0.5
    min_starts: int = 10
    n_optima: object = None
    merge_radius: float = 0.02
    generations: int = 100_000
    convergence: float = 1e-6
    window: int = 3
    early_exit: bool = True
    suspect: bool = True
    suspect_k: float = 3.0
    suspect_fraction: float = 0.25
    suspect_gain: float = 1e-3  # what a seed must gain before a rechecked cell is polished
    curvature: bool = True  # a run begins with the curvature that the best neighbour's run left
    proximity: bool = True  # cells also start from the nearest point of the pool
    patch_refined: bool = False
    refine_direct: bool = False  # new cells of a refined grid are evaluated at candidate parameters, not optimised
    clustering: str | None = "dbscan"  # modes that give such candidates: dbscan, hierarchical, kmeans or None
    cluster_eps: float | None = None  # reach of dbscan in standard deviations; learned from the cells if None
    cluster_flat: str = "left out"  # what dbscan makes of a column without spread: left out, or undefined distances ("undefined")
    pull: float = 0.5  # chance of a trial to go towards a better neighbour (de_table)
    archive: float = 0.1  # share of the cells that the archive of best members holds (de_table)
    agree: float = 0.05  # spread of neighbours' parameters up to which a fresh cell needs one generation only
    seed: int = 20240
    gradient: bool = True  # use the target's own gradient where it has one
    central: bool = False  # central instead of forward differences
    log: bool = False  # keep every evaluation: Scan.log()
    optima_range: tuple | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        if not self.roi_threshold > 0 or self.population < 2 or self.max_iter < 1 or (self.n_starts is not None and self.n_starts < 1) or self.batch < 1:
            raise ConfigurationError("roi_threshold, population, max_iter, n_starts and batch must be positive")
        if self.clustering not in (None, "dbscan", "hierarchical", "kmeans") or (self.cluster_eps is not None and not self.cluster_eps > 0):
            raise ConfigurationError("clustering must be dbscan, hierarchical, kmeans or None, and cluster_eps positive")
        if self.cluster_flat not in ("left out", "undefined"):
            raise ConfigurationError("cluster_flat must be 'left out' or 'undefined'")
        self.optima_range = parse_n_optima(self.n_optima)
