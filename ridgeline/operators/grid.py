"""Grids: axes, cells, neighbourhoods, level mappings and envelopes. A cell is the integer columns i0, i1, ..."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import ConfigurationError, Projection

#: Offset tables grow with the power of the dimensions; beyond this a neighbourhood is refused.
MAX_OFFSETS = 20_000


def cell_index(x: Column | str, lo: float, hi: float, n: int) -> Column:
    """The nearest of n + 1 nodes, half-way points to the even one, outside points to the ends."""
    x = F.col(x) if isinstance(x, str) else x
    at = F.rint((x - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(n))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(n)), at)).cast("int")


def with_cells(points: DataFrame, p: Projection, prefix: str = "x") -> DataFrame:
    return points.withColumns({c: cell_index(f"{prefix}{p.dims[k]}", *p.box(k), p.grid_points[k]) for k, c in enumerate(p.cells)})


def axes(spark: SparkSession, p: Projection) -> DataFrame:
    """axis, dim, i, coord: every node of every axis."""
    spec = spark.createDataFrame(
        [(k, d, g, *map(float, p.box(k))) for k, (d, g) in enumerate(zip(p.dims, p.grid_points))], "axis int, dim int, n int, lo double, hi double"
    )
    nodes = spec.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    return nodes.select("axis", "dim", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.col("n")).alias("coord"))


def grid(spark: SparkSession, p: Projection) -> DataFrame:
    """Every cell with its coordinates, from one range: no cross join, and as many partitions as the range has."""
    total = 1
    for g in p.grid_points:
        total *= g + 1
    out, stride = spark.range(total), total
    for k, g in enumerate(p.grid_points):
        stride //= g + 1
        out = out.withColumn(f"i{k}", F.pmod(F.expr(f"id div {stride}"), F.lit(g + 1)).cast("int"))
    return with_coordinates(out.drop("id"), p)


def with_coordinates(cells: DataFrame, p: Projection, prefix: str = "g") -> DataFrame:
    add = {}
    for k, c in enumerate(p.cells):
        lo, hi = p.box(k)
        add[f"{prefix}{k}"] = F.lit(lo) + F.lit(hi - lo) * F.col(c) / F.lit(p.grid_points[k])
    return cells.withColumns(add)


def offsets(d: int, kind: str = "moore", k: int = 1) -> list[tuple[int, ...]]:
    """moore: all within k; cross: one step along one axis; ring: from 2 to k steps."""
    if (2 * k + 1) ** d > MAX_OFFSETS:
        raise ConfigurationError(f"{(2 * k + 1) ** d} offsets are too many")
    around = [(o, max(map(abs, o))) for o in product(range(-k, k + 1), repeat=d)]
    if kind == "moore":
        return [o for o, reach in around if reach]
    if kind == "cross":
        return [o for o in product((-1, 0, 1), repeat=d) if sum(map(abs, o)) == 1]
    if kind == "ring":
        return [o for o, reach in around if 2 <= reach <= k]
    raise ConfigurationError(f"unknown neighbourhood {kind!r}")


def neighbours(cells: DataFrame, p: Projection, kind: str = "moore", k: int = 1, centre: bool = False) -> DataFrame:
    """cells once per neighbour inside the grid, the neighbour in n0, n1, ...: a literal array exploded, no join."""
    d = len(p.dims)
    some = offsets(d, kind, k) + ([(0,) * d] if centre else [])
    table = F.array(*[F.struct(*[F.lit(x).alias(f"o{j}") for j, x in enumerate(o)]) for o in some])
    out = cells.withColumn("__o", F.explode(table))
    out = out.withColumns({f"n{j}": F.col(f"i{j}") + F.col(f"__o.o{j}") for j in range(d)}).drop("__o")
    for j, g in enumerate(p.grid_points):
        out = out.filter(F.col(f"n{j}").between(0, g))
    return out


def renamed(cells: DataFrame, p: Projection, suffix: str = "_n", to: str = "n") -> DataFrame:
    """A state as the neighbour's side of a join: its cell in n0, n1, ..., its other columns with a suffix."""
    mine = set(p.cells)
    return cells.select(*[F.col(c).alias(to + c[1:]) if c in mine else F.col(c).alias(c + suffix) for c in cells.columns])


def with_neighbours(state: DataFrame, p: Projection, kind: str = "moore", k: int = 1, centre: bool = False) -> DataFrame:
    """Each cell of state joined with each neighbour that state holds: an equi-join on the shifted cell."""
    keys = [f"n{j}" for j in range(len(p.dims))]
    return neighbours(state, p, kind, k, centre).join(renamed(state, p), keys)


def frontier(cells: DataFrame, state: DataFrame, p: Projection) -> DataFrame:
    """Distinct neighbours of cells that state does not hold (left anti join)."""
    near = neighbours(cells.select(*p.cells), p).select(*[F.col(f"n{j}").alias(f"i{j}") for j in range(len(p.dims))])
    return near.distinct().join(state.select(*p.cells), p.cells, "left_anti")


def coarse_to_fine(cells: DataFrame, p: Projection, factor: int) -> DataFrame:
    """The fine cell at each coarse cell's node; rows outside the fine grid are dropped."""
    out = cells.withColumns({c: (F.col(c) * factor).cast("int") for c in p.cells})
    for c, g in zip(p.cells, p.grid_points):
        out = out.filter(F.col(c).between(0, g * factor))
    return out


def fine_cells(cells: DataFrame, p: Projection, factor: int) -> DataFrame:
    """Distinct fine cells inside the coarse cells that begin at each node, both borders included."""
    out = cells.select(*p.cells)
    for c, g in zip(p.cells, p.grid_points):
        top = F.least(F.col(c) * factor + factor, F.lit(g * factor))
        out = out.withColumn(c, F.explode(F.sequence(F.col(c) * factor, top)))
    return out.distinct()


def is_coarse(p: Projection, factor: int) -> Column:
    out = F.lit(True)
    for c in p.cells:
        out = out & (F.col(c) % factor == 0)
    return out


def fine_to_coarse(cells: DataFrame, p: Projection, factor: int) -> DataFrame:
    return cells.filter(is_coarse(p, factor)).withColumns({c: F.expr(f"cast({c} div {factor} as int)") for c in p.cells})


def inside(columns: list[str], bounds: list[tuple[float, float]]) -> Column:
    out = F.lit(True)
    for c, (lo, hi) in zip(columns, bounds):
        out = out & F.col(c).between(float(lo), float(hi))
    return out


def clipped(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def envelope(points: DataFrame, profiles: list[tuple[Projection, DataFrame]], cut: float, value: str = "logl") -> DataFrame:
    """Points whose cell reaches the cut in every profile: a chain of left semi joins; a cell without value fails."""
    out = points
    for n, (p, profile) in enumerate(profiles):
        names = [f"__e{n}_{c}" for c in p.cells]
        good = profile.filter(F.col(value) >= cut).select(*[F.col(c).alias(a) for c, a in zip(p.cells, names)])
        out = out.withColumns({a: cell_index(f"x{p.dims[k]}", *p.box(k), p.grid_points[k]) for k, a in enumerate(names)})
        out = out.join(good, names, "left_semi").drop(*names)
    return out


def interpolated(fine: DataFrame, coarse: DataFrame, p: Projection, factor: int, values: list[str]) -> DataFrame:
    """Multilinear values at fine cells from the coarse corners around them; null where a corner is missing."""
    d = len(p.dims)
    corner = F.explode(F.array(*[F.struct(*[F.lit(b).alias(f"b{j}") for j, b in enumerate(bits)]) for bits in product((0, 1), repeat=d)]))
    out = fine.select(*p.cells)
    for j, g in enumerate(p.grid_points):  # the last node belongs to the last coarse cell
        out = out.withColumn(f"f{j}", F.least(F.expr(f"cast(i{j} div {factor} as int)"), F.lit(g - 1)))
    out = out.withColumn("__b", corner)
    weight = F.lit(1.0)
    for j in range(d):
        t = F.col(f"i{j}") / F.lit(float(factor)) - F.col(f"f{j}")
        weight = weight * F.when(F.col(f"__b.b{j}") == 1, t).otherwise(1 - t)
        out = out.withColumn(f"n{j}", F.col(f"f{j}") + F.col(f"__b.b{j}"))
    side = coarse.select(*[F.col(f"i{j}").alias(f"n{j}") for j in range(d)], *[F.col(v).alias(f"{v}_c") for v in values])
    out = out.withColumn("__w", weight).join(side, [f"n{j}" for j in range(d)])
    full = F.count("*") == 2**d
    return out.groupBy(*p.cells).agg(*[F.when(full, F.sum(F.col("__w") * F.col(f"{v}_c"))).alias(v) for v in values])
