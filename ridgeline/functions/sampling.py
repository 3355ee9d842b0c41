"""Column expressions of volume sampling and of the stopping rule."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Primitive polynomials (degree, inner coefficients as bits) and first direction numbers of the Sobol
# sequence for the dimensions from the second one on.
POLYNOMIALS = [
    (1, 0), (2, 1), (3, 1), (3, 2), (4, 1), (4, 4), (5, 2), (5, 4), (5, 7), (5, 11), (5, 13), (5, 14), (6, 1), (6, 13), (6, 16), (6, 19),
    (6, 22), (6, 25), (7, 1), (7, 4),
]
FIRST_NUMBERS = [
    (1,), (1, 3), (1, 3, 1), (1, 1, 1), (1, 1, 3, 3), (1, 3, 5, 13), (1, 1, 5, 5, 17), (1, 1, 5, 5, 5), (1, 1, 7, 11, 19), (1, 1, 5, 1, 1),
    (1, 1, 1, 3, 11), (1, 3, 5, 5, 31), (1, 3, 3, 9, 7, 49), (1, 1, 1, 15, 21, 21), (1, 3, 1, 13, 27, 49), (1, 1, 1, 15, 7, 5),
    (1, 3, 1, 15, 13, 25), (1, 1, 5, 5, 19, 61), (1, 3, 7, 11, 23, 15, 103), (1, 3, 7, 13, 13, 15, 69),
]
SOBOL_BITS, SOBOL_DIMS = 32, len(POLYNOMIALS) + 1


@cache
def sobol_directions(dim: int) -> tuple[int, ...]:
    """What each bit of a point's number, the lowest first, contributes to coordinate `dim` (32 bits after the point)."""
    if not 0 <= dim < SOBOL_DIMS:
        raise ValueError(f"coordinates 0 to {SOBOL_DIMS - 1} have direction numbers")
    if dim == 0:
        return tuple(1 << (SOBOL_BITS - 1 - k) for k in range(SOBOL_BITS))
    degree, inner = POLYNOMIALS[dim - 1]
    taps = [1, *[inner >> (degree - 2 - k) & 1 for k in range(degree - 1)], 1]  # of x^degree down to 1
    m = list(FIRST_NUMBERS[dim - 1])
    while len(m) < SOBOL_BITS:
        new = m[-degree]
        for k in range(1, degree + 1):
            new ^= taps[k] * m[-k] << k
        m.append(new)
    return tuple(v << (SOBOL_BITS - 1 - k) for k, v in enumerate(m))


def sobol(number: Column, dim: int, shift: int = 0) -> Column:
    """Coordinate `dim` in [0, 1) of the point with this number, digitally shifted: bit operations alone."""
    out = F.lit(shift).cast("long")
    for k, v in enumerate(sobol_directions(dim)):
        out = out.bitwiseXOR(F.when(number.bitwiseAND(F.lit(1 << k)) != 0, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")))
    return out / F.lit(float(1 << SOBOL_BITS))


def umbrella(logl: Column, level: Column, sigma: Column) -> Column:
    """-(distance to the level in sigmas)^2 / 2; -inf where logl is not finite."""
    d = (logl - level) / sigma
    finite = logl.isNotNull() & ~F.isnan(logl) & (F.abs(logl) < float("inf"))
    return F.when(finite, F.lit(-0.5) * d * d).otherwise(F.lit(float("-inf")))


def stretch(u: Column, a: float = 2.0) -> Column:
    """A draw on [1/a, a] with density proportional to 1/sqrt(z) from a uniform one."""
    s = F.lit(a - 1) * u + 1
    return s * s / F.lit(a)


def log_acceptance(z: Column, dims: int, new: Column, old: Column) -> Column:
    return F.lit(dims - 1) * F.ln(z) + new - old


def undiscovered(w: Column, n: Column) -> Column:
    """Expected number of optima not met yet, from w optima in n converged runs; null where it says nothing."""
    room = n - w - 1
    return F.when((w >= 1) & (room > 0), (w * w) / room)


def uniform(*keys: Column | str) -> Column:
    """A draw on (0, 1) that depends on the keys alone, not on partitions or retries."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
