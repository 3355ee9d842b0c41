"""Nuisance parameters: targets composed with a coupling of extra parameters and a penalty on them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ridgeline.functions.targets import Target, _d, _sq, _sum, get

COUPLINGS = ("shift", "scale", "rotation", "additive", "mixed")
PENALTIES = ("gaussian", "uniform", "soft_uniform")
#: How the default mixed coupling is drawn.
MIXED_SEED, MIXED_SCALE, MIXED_ZEROED = 42, 0.3, 0.3


def default_coupling(n_poi: int, n_nuisance: int, mode: str) -> np.ndarray:
    """Which parameters a nuisance parameter acts on: contiguous blocks for shift and scale, none for additive."""
    c = np.zeros((n_poi, n_nuisance))
    if mode in ("shift", "scale"):
        for k, block in enumerate(np.array_split(np.arange(n_nuisance), n_poi)):
            c[k, block] = 1.0
    elif mode == "rotation":
        for k, (i, j) in enumerate((i, j) for i in range(n_poi) for j in range(i + 1, n_poi)):
            if k < n_nuisance:
                c[i, k], c[j, k] = 1.0, -1.0
    elif mode == "mixed":
        r = np.random.RandomState(MIXED_SEED)
        c = r.randn(n_poi, n_nuisance) * MIXED_SCALE
        c[r.rand(n_poi, n_nuisance) < MIXED_ZEROED] = 0.0
    return c


@dataclass
class Nuisance:
    """base(T(poi, nu)) + penalty(nu); parameters are ordered poi first."""

    base: Target
    n_nuisance: int
    coupling: str = "shift"
    penalty: str = "gaussian"
    sigma: float | list[float] = 1.0
    mean: float | list[float] = 0.0
    rotation_scale: float = 0.1
    reach: float = 5.0  # the box of a nuisance parameter goes so many sigmas to both sides
    matrix: np.ndarray | None = field(default=None)

    def __post_init__(self) -> None:
        if self.coupling not in COUPLINGS:
            raise ValueError(f"coupling must be one of {COUPLINGS}")
        if self.penalty not in PENALTIES:
            raise ValueError(f"penalty must be one of {PENALTIES}")
        shape = (self.base.dims, self.n_nuisance)
        m = default_coupling(*shape, self.coupling) if self.matrix is None else np.asarray(self.matrix, dtype=float)
        if m.shape != shape:
            raise ValueError(f"the coupling matrix must have shape {shape}")
        self.matrix = m
        self.sigmas = np.broadcast_to(np.asarray(self.sigma, dtype=float), (self.n_nuisance,))
        self.means = np.broadcast_to(np.asarray(self.mean, dtype=float), (self.n_nuisance,))
        if (self.sigmas <= 0).any():
            raise ValueError("sigma must be positive")

    @property
    def dims(self) -> int:
        return self.base.dims + self.n_nuisance

    @property
    def bounds(self) -> list[tuple[float, float]]:
        return self.base.bounds + [(float(m - self.reach * s), float(m + self.reach * s)) for m, s in zip(self.means, self.sigmas)]

    def _pairs(self) -> list[tuple[int, int]]:
        n = self.base.dims
        return [(i, j) for i in range(n) for j in range(i + 1, n)][: self.n_nuisance]

    def sql(self, columns: list[str]) -> str:
        poi, nu = columns[: self.base.dims], columns[self.base.dims :]
        moved = list(poi)
        if self.coupling in ("shift", "mixed", "scale"):
            for i, p in enumerate(poi):
                used = [f"({_d(c)}) * ({v})" for c, v in zip(self.matrix[i], nu) if c]
                if used:
                    moved[i] = f"(({p}) + {_sum(used)})" if self.coupling != "scale" else f"(({p}) * (1 + {_sum(used)}))"
        elif self.coupling == "rotation":
            for (i, j), v in zip(self._pairs(), nu):
                angle = f"({_d(self.rotation_scale)} * ({v}))"
                a, b = moved[i], moved[j]
                moved[i] = f"(cos({angle}) * ({a}) - sin({angle}) * ({b}))"
                moved[j] = f"(sin({angle}) * ({a}) + cos({angle}) * ({b}))"
        pulls = [f"((({v}) - ({_d(m)})) / {_d(s)})" for v, m, s in zip(nu, self.means, self.sigmas)]
        if self.penalty == "gaussian":
            penalty = "-5e-1 * " + _sum([_sq(d) for d in pulls])
        elif self.penalty == "uniform":
            inside = " AND ".join(f"abs({d}) <= 1" for d in pulls)
            penalty = f"CASE WHEN {inside} THEN 0e0 ELSE CAST('-Infinity' AS DOUBLE) END"
        else:
            penalty = "-5e-1 * " + _sum([_sq(f"greatest(0e0, abs({d}) - 1)") for d in pulls])
        return f"({self.base.sql(moved)} + {penalty})"

    def __call__(self, points: np.ndarray) -> np.ndarray:
        x = np.asarray(points, dtype=float)
        poi, nu = x[..., : self.base.dims].copy(), x[..., self.base.dims :]
        if self.coupling in ("shift", "mixed"):
            poi = poi + nu @ self.matrix.T
        elif self.coupling == "scale":
            poi = poi * (1 + nu @ self.matrix.T)
        elif self.coupling == "rotation":
            for k, (i, j) in enumerate(self._pairs()):
                c, s = np.cos(self.rotation_scale * nu[..., k]), np.sin(self.rotation_scale * nu[..., k])
                poi[..., i], poi[..., j] = c * poi[..., i] - s * poi[..., j], s * poi[..., i] + c * poi[..., j]
        d = (nu - self.means) / self.sigmas
        if self.penalty == "gaussian":
            penalty = -0.5 * (d * d).sum(-1)
        elif self.penalty == "uniform":
            penalty = np.where((np.abs(d) <= 1).all(-1), 0.0, -np.inf)
        else:
            penalty = -0.5 * (np.maximum(0.0, np.abs(d) - 1) ** 2).sum(-1)
        v = self.base(poi) + penalty
        return np.where(np.isnan(v) | (v == np.inf), -np.inf, v)

    def at_constraint_mean(self, poi: np.ndarray) -> float:
        """The value at the penalty's centre: a lower bound of the profile for couplings that move the parameters."""
        return float(self(np.concatenate([np.asarray(poi, dtype=float), self.means])))

    def profiled(self, poi: np.ndarray, max_iter: int = 100) -> float:
        """The best value over the nuisance parameters, found numerically."""
        from ridgeline.plans.kernels import lbfgs

        poi = np.asarray(poi, dtype=float)
        at = lambda nu: self(np.concatenate([np.broadcast_to(poi, (*nu.shape[:-1], len(poi))), nu], axis=-1))
        b = np.array(self.bounds[self.base.dims :])
        return max(float(lbfgs(at, self.means.copy(), b, max_iter).value), self.at_constraint_mean(poi))


# The named combinations, {target}_{coupling}_{nuisance parameters}nuis_sigma{width of their penalty}.
PRESETS = """
himmelblau_4d_shift_4nuis_sigma0.5
himmelblau_4d_shift_8nuis_sigma0.5
himmelblau_4d_shift_16nuis_sigma0.5
himmelblau_4d_shift_8nuis_sigma0.2
himmelblau_4d_shift_8nuis_sigma1.0
himmelblau_4d_scale_8nuis_sigma0.1
rosenbrock_4d_shift_8nuis_sigma0.5
rosenbrock_4d_shift_16nuis_sigma0.5
rosenbrock_4d_scale_8nuis_sigma0.1
rastrigin_4d_shift_8nuis_sigma0.5
rastrigin_4d_shift_16nuis_sigma0.5
himmelblau_4d_shift_32nuis_sigma0.5
rosenbrock_6d_shift_12nuis_sigma0.5
sphere_10d_shift_20nuis_sigma0.5
""".split()


def presets() -> dict[str, Nuisance]:
    """Named combinations of a base target, a coupling, a number of nuisance parameters and a penalty width."""
    out = {}
    for name in PRESETS:
        target, coupling, count, sigma = name.rsplit("_", 3)
        out[name] = Nuisance(get(target), int(count.removesuffix("nuis")), coupling, sigma=float(sigma.removeprefix("sigma")))
    return out
