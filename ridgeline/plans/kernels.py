"""Numpy kernels: what runs inside one row of a round. Every draw comes from a stream keyed by seed and cell."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Objective = Callable[[np.ndarray], np.ndarray]


def stream(*keys: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([int(k) & 0xFFFFFFFF for k in keys])))


@dataclass
class Run:
    x: np.ndarray
    value: float
    evals: int
    converged: bool
    gradients: int = 0
    failures: int = 0  # of the gradient function
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # steps and gradient changes, for a neighbour


def difference_gradient(
    f: Objective, x: np.ndarray, fx: float, bounds: np.ndarray, central: bool = False, which: np.ndarray | None = None
) -> tuple[np.ndarray, int]:
    """All probes in one call of f, those of the components `which` only if given; at an upper bound a probe steps inward."""
    at = np.arange(len(x)) if which is None else np.flatnonzero(which)
    step = np.maximum(np.abs(x) * 1e-7, 1e-8)
    up = np.where(x + step <= bounds[:, 1], step, -step)
    probes = x + np.diag(up)[at]
    out = np.zeros(len(x))
    if central:
        down = np.where(x - up >= bounds[:, 0], -up, 0.0)
        both = f(np.concatenate([probes, x + np.diag(down)[at]]))
        hi, lo = both[: len(at)], np.where(down[at] == 0, fx, both[len(at) :])
        out[at] = (hi - lo) / (up - down)[at]
        return out, 2 * len(at)
    out[at] = (f(probes) - fx) / up[at]
    return out, len(at)


def lbfgs(
    f: Objective, x0: np.ndarray, bounds: np.ndarray, max_iter: int = 50, ftol: float = 1e-9, memory: int = 10,
    gradient: Callable[[np.ndarray], np.ndarray] | None = None, central: bool = False,
    pairs: list[tuple[np.ndarray, np.ndarray]] | None = None, value: float | None = None,
) -> Run:
    """Maximises f in a box by limited-memory quasi-Newton steps on the free variables; the best iterate is kept.

    Steps are projected on the box. A backtracking search tries its step lengths in calls of growing size, the whole
    step alone first; evals counts every point given to f. Converged means that an accepted step gained less than ftol
    (absolute). pairs: curvature to begin with, as a run at a neighbour left it. value: f at x0, where it is known. A
    gradient function that raises, or returns nothing of use, is counted, and differences take its place.
    """
    bounds = np.asarray(bounds, dtype=float)
    x = np.clip(np.asarray(x0, dtype=float), bounds[:, 0], bounds[:, 1])
    fx, evals, gradients, failures = (float(f(x[None])[0]), 1, 0, 0) if value is None else (value, 0, 0, 0)
    if not len(x) or not np.isfinite(fx):
        return Run(x, fx, evals, not len(x))

    def slope(x: np.ndarray, fx: float) -> np.ndarray:
        nonlocal evals, gradients, failures
        if gradient is not None:
            try:
                g = np.asarray(gradient(x), dtype=float)
                gradients += int(np.isfinite(g).sum())
            except Exception:  # noqa: BLE001 - a user's function may fail anywhere
                failures += 1
                g = np.full(len(x), np.nan)
            if np.isfinite(g).all():
                return g
            # components that the function leaves out come from differences
            d, n = difference_gradient(f, x, fx, bounds, central, ~np.isfinite(g))
            evals += n
            return np.where(np.isfinite(g), g, np.where(np.isfinite(d), d, 0.0))
        g, n = difference_gradient(f, x, fx, bounds, central)
        evals += n
        return np.where(np.isfinite(g), g, 0.0)

    g = slope(x, fx)
    pairs = [(s, y) for s, y in pairs or [] if len(s) == len(x) and s @ y > 0][-memory:]

    def ended(converged: bool) -> Run:
        return Run(x, fx, evals, converged, gradients, failures, pairs)

    lengths = 0.5 ** np.arange(34)
    for _ in range(max_iter):
        stuck = ((x <= bounds[:, 0]) & (g < 0)) | ((x >= bounds[:, 1]) & (g > 0))
        q = np.where(stuck, 0.0, g)
        if not q.any():
            return ended(True)
        back = []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            back.append(a)
            q = q - a * y
        if pairs:
            s, y = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        else:
            q = q * min(1.0, 0.1 * float((bounds[:, 1] - bounds[:, 0]).min()) / float(np.abs(q).max()))
        for (s, y), a in zip(pairs, reversed(back)):
            q = q + (a - (y @ q) / (s @ y)) * s
        q = np.where(stuck, 0.0, q)
        if q @ g <= 0:
            q, pairs = np.where(stuck, 0.0, g), []
        gained = False
        for lo, hi in ((0, 1), (1, 3), (3, 7), (7, 15), (15, len(lengths))):
            tries = np.clip(x + lengths[lo:hi, None] * q, bounds[:, 0], bounds[:, 1])
            values = f(tries)
            good = np.flatnonzero(values >= fx + 1e-4 * ((tries - x) @ g))
            good = good[values[good] > fx]
            evals += len(tries)
            if len(good):
                new, fnew, gained = tries[good[0]], float(values[good[0]]), True
                break
        if not gained:
            return ended(True)
        gnew = slope(new, fnew)
        s, y = new - x, g - gnew
        if s @ y > 1e-10 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[-(memory - 1) :], (s, y)]
        gain, x, fx, g = fnew - fx, new, fnew, gnew
        if gain < ftol:
            return ended(True)
    return ended(False)


def latin_hypercube(rng: np.random.Generator, n: int, bounds: np.ndarray) -> np.ndarray:
    bounds = np.asarray(bounds, dtype=float)
    u = (rng.permuted(np.tile(np.arange(n), (len(bounds), 1)), axis=1).T + rng.random((n, len(bounds)))) / max(n, 1)
    return bounds[:, 0] + u * (bounds[:, 1] - bounds[:, 0])


def evolve(
    f: Objective, population: np.ndarray, values: np.ndarray, bounds: np.ndarray, rng: np.random.Generator, generations: int, window: int,
    threshold: float, guide: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Differential evolution with success-history adaptation: (population, values, evaluations, generations).

    Half of the trials are pulled towards a neighbour's parameters if a guide is given, the others towards the best
    members. It ends when the mean gain of the last `window` generations is below the threshold.
    """
    n, d = population.shape
    x, fx = population.copy(), values.copy()
    memory_f, memory_cr, at, evals, gains = np.full(8, 0.5), np.full(8, 0.5), 0, 0, []
    for g in range(generations):
        slot = rng.integers(0, 8, n)
        cr = np.clip(rng.normal(memory_cr[slot], 0.1), 0, 1)
        scale = memory_f[slot] + 0.1 * np.tan(np.pi * (rng.random(n) - 0.5))
        while (low := scale <= 0).any():
            scale[low] = memory_f[slot[low]] + 0.1 * np.tan(np.pi * (rng.random(int(low.sum())) - 0.5))
        scale = np.minimum(scale, 1.0)[:, None]
        top = np.argsort(-fx)[: max(1, n // 3)]
        pull = x[rng.choice(top, n)]
        if guide is not None:
            pull = np.where((rng.random(n) < 0.5)[:, None], guide, pull)
        a, b = (rng.integers(0, n, n) for _ in range(2))
        trial = x + scale * (pull - x) + scale * (x[a] - x[b])
        cross = rng.random((n, d)) < cr[:, None]
        cross[np.arange(n), rng.integers(0, d, n)] = True
        trial = np.clip(np.where(cross, trial, x), bounds[:, 0], bounds[:, 1])
        ft = f(trial)
        evals += n
        won = ft > fx
        gains.append(max(float(ft.max() - fx.max()), 0.0) if np.isfinite(fx.max()) else float(np.isfinite(ft.max())))
        if won.any():
            s = scale[won, 0]
            memory_f[at % 8], memory_cr[at % 8] = float((s * s).sum() / s.sum()), float(cr[won].mean())
            at += 1
        x[won], fx[won] = trial[won], ft[won]
        if len(gains) >= window and np.mean(gains[-window:]) < threshold:
            return x, fx, evals, g + 1
    return x, fx, evals, generations


def register_optimum(registry: list[dict], point: np.ndarray, value: float, bounds: np.ndarray, radius: float) -> None:
    """Leader clustering: merges into the first entry within a root-mean-square distance, keeping the better point."""
    unit = (np.asarray(point, dtype=float) - bounds[:, 0]) / (bounds[:, 1] - bounds[:, 0])
    for entry in registry:
        if np.sqrt(np.mean((entry["unit"] - unit) ** 2)) < radius:
            entry["count"] += 1
            if value > entry["value"]:
                entry.update(point=np.asarray(point, dtype=float), unit=unit, value=value)
            return
    registry.append({"point": np.asarray(point, dtype=float), "unit": unit, "value": value, "count": 1})


def should_stop(registry: list[dict], completed: int, roi: float, min_starts: int, undiscovered: float, optima: tuple | None) -> bool:
    """Stops when the expected number of optima not met yet is small, or by a prior on their number."""
    if not registry:
        return False
    top = max(e["value"] for e in registry)
    inside = [e for e in registry if e["value"] >= top - roi]
    w, n = len(inside), sum(e["count"] for e in inside)
    if optima:
        low, high = optima
        if w < low:
            return False
        if high is not None and w >= high:
            return True
    if completed < min_starts or undiscovered <= 0 or n - w - 1 <= 0:
        return False
    return w * w / (n - w - 1) < undiscovered


def distinct_seeds(seeds: list[np.ndarray], extents: np.ndarray, radius: float = 1e-3) -> list[np.ndarray]:
    """Greedy, in order: a seed within the normalised distance of a kept one goes."""
    kept: list[np.ndarray] = []
    for s in seeds:
        if all(np.linalg.norm((s - k) / extents) >= radius for k in kept):
            kept.append(s)
    return kept


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels from 0, noise -1; a point counts itself. Neighbourhoods come in blocks, so memory is bounded."""
    n = len(x)
    labels, near = np.full(n, -1), []
    for lo in range(0, n, 512):
        d = ((x[lo : lo + 512, None, :] - x[None]) ** 2).sum(-1)
        near += [np.flatnonzero(r <= eps * eps) for r in d]
    core = np.array([len(r) >= least for r in near], dtype=bool)
    k = 0
    for i in range(n):
        if labels[i] >= 0 or not core[i]:
            continue
        stack, labels[i] = [i], k
        while stack:
            for j in near[stack.pop()]:
                if labels[j] < 0:
                    labels[j] = k
                    if core[j]:
                        stack.append(j)
        k += 1
    return labels


def dbscan_eps(x: np.ndarray, k: int, multiplier: float = 3.0) -> float:
    """The 90th percentile of the distance to the k-th nearest point (a point counts itself), times multiplier."""
    kth = [np.partition(np.sqrt(((x[i] - x) ** 2).sum(-1)), k - 1)[k - 1] for i in range(len(x))]
    return float(np.percentile(kth, 90)) * multiplier


def ward(x: np.ndarray, threshold: float) -> np.ndarray:
    """Agglomerates by Ward's distance until the least merge is beyond threshold; labels by first member."""
    n = len(x)
    size, centre, alive = np.ones(n), x.astype(float).copy(), np.ones(n, dtype=bool)
    member = np.arange(n)
    while alive.sum() > 1:
        ids = np.flatnonzero(alive)
        c, s = centre[ids], size[ids]
        d = np.sqrt(2 * s[:, None] * s[None] / (s[:, None] + s[None]) * ((c[:, None] - c[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        if d[i, j] > threshold:
            break
        a, b = ids[min(i, j)], ids[max(i, j)]
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        member[member == b] = a
    return np.unique(member, return_inverse=True)[1]


def kmeans(x: np.ndarray, k: int = 2, seed: int = 42, rounds: int = 100) -> np.ndarray:
    rng = stream(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(k, len(x)):
        d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.concatenate([centres, x[[int(rng.choice(len(x), p=d / d.sum())) if d.sum() else int(rng.integers(len(x)))]]])
    for _ in range(rounds):
        labels = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return labels
