"""Target functions: SQL expressions that Catalyst compiles, with numpy twins for the iterative kernels.

An expression is text over column names, valid in Spark SQL and in DuckDB, so a target is evaluated inside the scan's
generated code and the same text serves as its oracle. All targets are maximised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants, bounds and peak positions of the published test functions.
EGGHOLDER_SHIFT = 959.6407
MICHALEWICZ_MIN = {2: -1.8013, 4: -3.72, 6: -5.69, 10: -9.66}
STYBLINSKI_SHIFT = 39.16617
SCHWEFEL_SHIFT = 418.9829
HIMMELBLAU_PEAKS = ((3.0, 2.0), (-2.805118, 3.131312), (-3.779310, -3.283186), (3.584428, -1.848126))
BOUNDS = {
    "sphere": (-5.0, 5.0), "rosenbrock": (-6.0, 6.0), "himmelblau": (-6.0, 6.0), "beale": (-4.5, 4.5), "eggholder": (-512.0, 512.0),
    "rastrigin": (-5.12, 5.12), "ackley": (-5.0, 5.0), "griewank": (-100.0, 100.0), "michalewicz": (0.0, float(np.pi)),
    "styblinski_tang": (-5.0, 5.0), "levy": (-10.0, 10.0), "schwefel": (-500.0, 500.0),
}
PEAK = {
    "sphere": 0.0, "rosenbrock": 1.0, "rastrigin": 0.0, "ackley": 0.0, "griewank": 0.0, "styblinski_tang": -2.903534,
    "levy": 1.0, "schwefel": 420.9687,
}
DIMS = {
    "sphere": (2, 4, 6, 10), "rosenbrock": (2, 4, 6, 10), "himmelblau": (4,), "beale": (2,), "eggholder": (2, 4, 6), "rastrigin": (2, 4, 6, 10),
    "ackley": (2, 4, 6, 10), "griewank": (2, 4, 6, 10), "michalewicz": (2, 4, 6, 10), "styblinski_tang": (2, 4, 6, 10), "levy": (2, 4, 6, 10),
    "schwefel": (2, 4, 6, 10),
}


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _sq(x: str) -> str:
    return f"(({x}) * ({x}))"


def _pw(x: str, k: int) -> str:
    return "(" + " * ".join([f"({x})"] * k) + ")"


def _d(x: float) -> str:
    """A double literal in both dialects."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def _eggholder(v: list[str]) -> str:
    if len(v) % 2:
        raise ValueError("eggholder takes an even number of dimensions")
    pair = lambda x, y: (
        f"(-(({y}) + 47) * sin(sqrt(abs(({x}) / 2 + ({y}) + 47))) - ({x}) * sin(sqrt(abs(({x}) - (({y}) + 47)))))"
    )
    return f"-({_sum([pair(v[i], v[i + 1]) for i in range(0, len(v), 2)])} + {_d(EGGHOLDER_SHIFT * len(v) / 2)})"


def _levy(v: list[str]) -> str:
    w = [f"(1 + (({x}) - 1) / 4)" for x in v]
    inner = [f"{_sq(f'{a} - 1')} * (1 + 10 * {_sq(f'sin(pi() * {a} + 1)')})" for a in w[:-1]]
    last = f"{_sq(f'{w[-1]} - 1')} * (1 + {_sq(f'sin(2 * pi() * {w[-1]})')})"
    return "-" + _sum([_sq(f"sin(pi() * {w[0]})"), *inner, last])


SQL: dict[str, Callable[[list[str]], str]] = {
    "sphere": lambda v: "-" + _sum([_sq(x) for x in v]),
    "rosenbrock": lambda v: "-1e-1 * " + _sum([f"100 * {_sq(f'({b}) - {_sq(a)}')} + {_sq(f'1 - ({a})')}" for a, b in zip(v, v[1:])]),
    "himmelblau": lambda v: "-5e-2 * " + _sum([f"{_sq(f'{_sq(a)} + ({b}) - 11')} + {_sq(f'({a}) + {_sq(b)} - 7')}" for a, b in zip(v[::2], v[1::2])]),
    "beale": lambda v: "-" + _sum([_sq(f"{_d(c)} - ({v[0]}) + ({v[0]}) * {_pw(v[1], k)}") for c, k in ((1.5, 1), (2.25, 2), (2.625, 3))]),
    "eggholder": _eggholder,
    "rastrigin": lambda v: f"-({10 * len(v)} + {_sum([f'{_sq(x)} - 10 * cos(2 * pi() * ({x}))' for x in v])})",
    "ackley": lambda v: (
        f"(20 * exp(-2e-1 * sqrt({_sum([_sq(x) for x in v])} / {len(v)})) + exp({_sum([f'cos(2 * pi() * ({x}))' for x in v])} / {len(v)}) - 20 - exp(1e0))"
    ),
    "griewank": lambda v: f"-({_sum([_sq(x) for x in v])} / 4000 - {' * '.join(f'cos(({x}) / sqrt({i + 1}e0))' for i, x in enumerate(v))} + 1)",
    "michalewicz": lambda v: (
        "(" + _sum([f"sin({x}) * power(sin({i + 1} * {_sq(x)} / pi()), 20)" for i, x in enumerate(v)]) + f" + ({_d(MICHALEWICZ_MIN.get(len(v), 0.0))}))"
    ),
    "styblinski_tang": lambda v: f"-(5e-1 * {_sum([f'({_pw(x, 4)} - 16 * {_sq(x)} + 5 * ({x}))' for x in v])} + {_d(STYBLINSKI_SHIFT * len(v))})",
    "levy": _levy,
    "schwefel": lambda v: f"-({_d(SCHWEFEL_SHIFT * len(v))} - {_sum([f'({x}) * sin(sqrt(abs({x})))' for x in v])})",
}

#: Vectorised twins over arrays of shape (points, dimensions).
NUMPY: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "sphere": lambda x: -(x * x).sum(-1),
    "rosenbrock": lambda x: -0.1 * (100 * (x[..., 1:] - x[..., :-1] ** 2) ** 2 + (1 - x[..., :-1]) ** 2).sum(-1),
    "himmelblau": lambda x: -0.05 * ((x[..., ::2] ** 2 + x[..., 1::2] - 11) ** 2 + (x[..., ::2] + x[..., 1::2] ** 2 - 7) ** 2).sum(-1),
    "beale": lambda x: -sum((c - x[..., 0] + x[..., 0] * x[..., 1] ** k) ** 2 for c, k in ((1.5, 1), (2.25, 2), (2.625, 3))),
    "eggholder": lambda x: -(
        (
            -(x[..., 1::2] + 47) * np.sin(np.sqrt(np.abs(x[..., ::2] / 2 + x[..., 1::2] + 47)))
            - x[..., ::2] * np.sin(np.sqrt(np.abs(x[..., ::2] - x[..., 1::2] - 47)))
        ).sum(-1)
        + EGGHOLDER_SHIFT * x.shape[-1] / 2
    ),
    "rastrigin": lambda x: -(10 * x.shape[-1] + (x * x - 10 * np.cos(2 * np.pi * x)).sum(-1)),
    "ackley": lambda x: 20 * np.exp(-0.2 * np.sqrt((x * x).mean(-1))) + np.exp(np.cos(2 * np.pi * x).mean(-1)) - 20 - np.e,
    "griewank": lambda x: -((x * x).sum(-1) / 4000 - np.cos(x / np.sqrt(np.arange(1, x.shape[-1] + 1))).prod(-1) + 1),
    "michalewicz": lambda x: (
        (np.sin(x) * np.sin(np.arange(1, x.shape[-1] + 1) * x * x / np.pi) ** 20).sum(-1) + MICHALEWICZ_MIN.get(x.shape[-1], 0.0)
    ),
    "styblinski_tang": lambda x: -(0.5 * (x**4 - 16 * x * x + 5 * x).sum(-1) + STYBLINSKI_SHIFT * x.shape[-1]),
    "levy": lambda x: (
        lambda w: -(
            np.sin(np.pi * w[..., 0]) ** 2
            + ((w[..., :-1] - 1) ** 2 * (1 + 10 * np.sin(np.pi * w[..., :-1] + 1) ** 2)).sum(-1)
            + (w[..., -1] - 1) ** 2 * (1 + np.sin(2 * np.pi * w[..., -1]) ** 2)
        )
    )(1 + (x - 1) / 4),
    "schwefel": lambda x: -(SCHWEFEL_SHIFT * x.shape[-1] - (x * np.sin(np.sqrt(np.abs(x)))).sum(-1)),
}


@dataclass(frozen=True)
class Target:
    """A named target of fixed dimension, as SQL text, Column and vectorised function."""

    name: str
    dims: int

    def __post_init__(self) -> None:
        if self.name not in SQL:
            raise ValueError(f"unknown target {self.name!r}; known: {', '.join(names())}")
        if self.name == "eggholder" and self.dims % 2:
            raise ValueError("eggholder takes an even number of dimensions")

    def sql(self, columns: list[str]) -> str:
        return SQL[self.name](columns)

    def column(self, columns: list[str]) -> Column:
        return sanitised(F.expr(self.sql(columns)))

    def __call__(self, points: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            v = np.asarray(NUMPY[self.name](np.asarray(points, dtype=float)), dtype=float)
        return np.where(np.isnan(v) | (v == np.inf), -np.inf, v)

    @property
    def bounds(self) -> list[tuple[float, float]]:
        return [BOUNDS[self.name]] * self.dims

    @property
    def peaks(self) -> list[tuple[float, ...]]:
        if self.name == "himmelblau":
            return [a + b for a in HIMMELBLAU_PEAKS for b in HIMMELBLAU_PEAKS][: 4 ** (self.dims // 2)]
        if self.name == "beale":
            return [(3.0, 0.5)]
        if self.name == "eggholder":
            return [(512.0, 404.2319) * (self.dims // 2)]
        return [(PEAK[self.name],) * self.dims] if self.name in PEAK else []


def sanitised(c: Column) -> Column:
    """Null, NaN and +inf become -inf, so no maximum ever sees them.

    The column is never null, so joins and aggregations add no test for null that would be evaluated, with the whole
    expression of the target in it, where a log is read.
    """
    least = F.lit(float("-inf"))
    v = F.coalesce(F.nanvl(c, least), least)
    return F.when(v == float("inf"), least).otherwise(v)


def names() -> list[str]:
    """All catalogue names, one per function and dimension."""
    return [f"{n}_{d}d" for n, dims in DIMS.items() for d in dims]


def get(name: str) -> Target:
    base, _, d = name.rpartition("_")
    if name not in names():
        raise ValueError(f"unknown target {name!r}; known: {', '.join(names())}")
    return Target(base, int(d[:-1]))


def gradient(name: str, x: np.ndarray) -> np.ndarray:
    """Analytic gradients of the targets that have a simple one."""
    if name == "sphere":
        return -2 * x
    if name == "rosenbrock":
        g = np.zeros_like(x)
        inner = x[1:] - x[:-1] ** 2
        g[:-1] += -0.1 * (-400 * x[:-1] * inner - 2 * (1 - x[:-1]))
        g[1:] += -0.1 * 200 * inner
        return g
    if name == "himmelblau":
        a, b = x[::2], x[1::2]
        p, q = a * a + b - 11, a + b * b - 7
        g = np.empty_like(x)
        g[::2], g[1::2] = -0.05 * (4 * a * p + 2 * q), -0.05 * (2 * p + 4 * b * q)
        return g
    raise ValueError(f"no analytic gradient for {name!r}")
