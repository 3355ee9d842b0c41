"""Steering queries over cell states: who can improve whom, who looks wrong, who is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Projection
from ridgeline.operators.grid import neighbours, renamed, with_neighbours

MAD_SCALE = 1.4826
LEAST_MAD, LEAST_THRESHOLD = 1e-12, 1e-3
AGREE = 0.05


def best_neighbours(state: DataFrame, p: Projection, phi: list[str], k: int = 1, value: str = "logl", of: DataFrame | None = None) -> DataFrame:
    """Each cell (of `of`, or of state) with the k best neighbours' values and parameters; ties go to the smallest neighbour cell."""
    near = [f"n{j}" for j in range(len(p.dims))]
    both = with_neighbours(state, p) if of is None else neighbours(of.select(*p.cells), p).join(renamed(state, p), near)
    if k == 1:  # an aggregation that combines before its exchange
        x = both.groupBy(*p.cells).agg(F.min(F.struct((-F.col(f"{value}_n")).alias("v"), *near, *[f"{c}_n" for c in phi])).alias("b"))
        return x.select(*p.cells, *[F.col(f"b.{n}").alias(n) for n in near], (-F.col("b.v")).alias(f"{value}_n"), *[F.col(f"b.{c}_n").alias(f"{c}_n") for c in phi])
    w = Window.partitionBy(*p.cells).orderBy(F.desc(f"{value}_n"), *near)
    out = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(*p.cells, *near, f"{value}_n", *[f"{c}_n" for c in phi], "rank")


def patch_candidates(state: DataFrame, p: Projection, phi: list[str], threshold: float, value: str = "logl") -> DataFrame:
    """Cells in the region (or on its border) whose best neighbour is better, with the neighbour's parameters to test.

    The border: more than half of a cell's known neighbours are in the region.
    """
    top = state.agg((F.max(value) - F.lit(threshold)).alias("__cut"))
    s = state.join(F.broadcast(top)).withColumn("roi", F.col(value) >= F.col("__cut")).drop("__cut")
    around = with_neighbours(s, p).groupBy(*p.cells).agg(F.avg(F.col("roi_n").cast("double")).alias("share"))
    better = best_neighbours(state, p, phi, 1, value)
    out = s.join(around, p.cells).join(better, p.cells)
    return out.filter((F.col("roi") | (F.col("share") > 0.5)) & (F.col(f"{value}_n") > F.col(value))).select(*p.cells, value, f"{value}_n", *[f"{c}_n" for c in phi])


def better_neighbours(state: DataFrame, p: Projection, phi: list[str], of: DataFrame, value: str = "logl") -> DataFrame:
    """Those cells of `of` in state whose best neighbour is better, with the neighbour's parameters to test."""
    better = best_neighbours(state, p, phi, 1, value, of)
    out = state.join(better, p.cells)
    return out.filter(F.col(f"{value}_n") > F.col(value)).select(*p.cells, value, f"{value}_n", *[f"{c}_n" for c in phi])


def around(cells: DataFrame, state: DataFrame, p: Projection) -> DataFrame:
    """Distinct cells of state next to one of cells."""
    near = neighbours(cells.select(*p.cells), p).select(*[F.col(f"n{j}").alias(f"i{j}") for j in range(len(p.dims))])
    return near.distinct().join(state.select(*p.cells), p.cells, "left_semi")


def apart(seeds: Column, extents: list[float], radius: float = 1e-3) -> Column:
    """An array of parameter arrays without those closer than radius, over the extents, to one kept before: greedy, in order."""
    scale = F.array(*[F.lit(float(e)) for e in extents])

    def distance2(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x - y), scale, lambda d, e: d / e * (d / e)), F.lit(0.0), lambda t, x: t + x)

    return F.aggregate(
        seeds, F.slice(seeds, 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: distance2(k, s) < radius * radius), kept).otherwise(F.concat(kept, F.array(s)))
    )


def status(done: str = "done", phase: str = "phase") -> Column:
    """Where a cell stands: active, converged, or optimized once a polish, a recheck or a refinement gave its best value."""
    return F.when(F.col(phase).isin(2, 3), "optimized").when(F.col(done), "converged").otherwise("active")


def coverage(state: DataFrame, p: Projection) -> DataFrame:
    """One row: how many distinct cells of the grid the state holds, and their share of all."""
    total = 1
    for g in p.grid_points:
        total *= g + 1
    return state.select(*p.cells).distinct().agg(F.count("*").alias("cells"), (F.count("*") / F.lit(float(total))).alias("coverage"))


def improved(state: DataFrame, before: DataFrame, p: Projection, value: str = "logl") -> DataFrame:
    """Cells that are new or better than before."""
    old = before.select(*p.cells, F.col(value).alias("__old"))
    return state.join(old, p.cells, "left").filter(F.col("__old").isNull() | (F.col(value) > F.col("__old"))).drop("__old")


def parameter_distance(state: DataFrame, p: Projection, phi: list[str], extents: list[float]) -> DataFrame:
    """cell, distance: how far a cell's parameters are from the median of its neighbours', over the extents; at least two neighbours."""
    near = with_neighbours(state, p).groupBy(*p.cells).agg(
        F.count("*").alias("around"), *[F.median(f"{c}_n").alias(f"{c}_m") for c in phi]
    )
    both = state.join(near.filter("around >= 2"), p.cells)
    total = sum((((F.col(c) - F.col(f"{c}_m")) / F.lit(float(e))) * ((F.col(c) - F.col(f"{c}_m")) / F.lit(float(e))) for c, e in zip(phi, extents)), F.lit(0.0))
    return both.select(*p.cells, F.sqrt(total).alias("distance"))


def mad_threshold(distances: DataFrame, k: float = 3.0) -> DataFrame:
    """One row: median, mad, threshold = max(median + k * scaled MAD, a least value)."""
    mid = distances.agg(F.median("distance").alias("median"))
    spread = distances.join(F.broadcast(mid)).agg(F.first("median").alias("median"), F.median(F.abs(F.col("distance") - F.col("median"))).alias("mad"))
    scaled = F.lit(MAD_SCALE) * F.when(F.col("mad") == 0, F.lit(LEAST_MAD)).otherwise(F.col("mad"))
    return spread.select("median", "mad", F.greatest(F.col("median") + F.lit(k) * scaled, F.lit(LEAST_THRESHOLD)).alias("threshold"))


def suspects(state: DataFrame, p: Projection, phi: list[str], extents: list[float], roi: float, k: float = 3.0, fraction: float = 0.25, value: str = "logl") -> DataFrame:
    """Cells of the region whose parameters stand out, at most a fraction of all cells, the farthest first."""
    d = parameter_distance(state, p, phi, extents)
    cut = state.agg((F.max(value) - F.lit(roi)).alias("__cut"), F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(fraction))).alias("__most"))
    inside = state.join(F.broadcast(cut)).filter(F.col(value) >= F.col("__cut")).select(*p.cells, "__most")
    out = d.join(inside, p.cells).join(F.broadcast(mad_threshold(d, k))).filter(F.col("distance") > F.col("threshold"))
    w = Window.orderBy(F.desc("distance"), *p.cells)  # outliers only: a robust threshold leaves few rows
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("__most")).select(*p.cells, "distance", "rank")


def agreeing(state: DataFrame, p: Projection, phi: list[str], extents: list[float], limit: float = AGREE, own: bool = True) -> DataFrame:
    """Cells with at least two known neighbours whose parameters (with theirs, if own) deviate from the mean by less than limit."""
    both = with_neighbours(state, p, centre=own)
    stats = both.groupBy(*p.cells).agg(F.count("*").alias("around"), *[x for c in phi for x in (F.avg(f"{c}_n").alias(f"{c}_a"), F.min(f"{c}_n").alias(f"{c}_l"), F.max(f"{c}_n").alias(f"{c}_h"))])
    worst = F.greatest(*[F.greatest(F.col(f"{c}_h") - F.col(f"{c}_a"), F.col(f"{c}_a") - F.col(f"{c}_l")) / F.lit(float(e)) for c, e in zip(phi, extents)], F.lit(0.0))
    return stats.filter(F.col("around") >= (3 if own else 2)).withColumn("spread", worst).filter(F.col("spread") < limit).select(*p.cells, "spread")


def boundary_cells(labelled: DataFrame, p: Projection, label: str = "label") -> DataFrame:
    """Cells with a neighbour along an axis that has another label; noise counts as a label."""
    both = with_neighbours(labelled.select(*p.cells, label), p, "cross")
    return both.filter(F.col(label) != F.col(f"{label}_n")).select(*p.cells).distinct()


def cluster_stats(labelled: DataFrame, phi: list[str], value: str = "logl", label: str = "label") -> DataFrame:
    """Size, centre, spread (population) and best value of each cluster; noise (-1) is left out."""
    stats = [x for c in phi for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return labelled.filter(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"), F.max(value).alias("best"), *stats)


def inverse_distance_candidates(near: DataFrame, keys: list[str], phi: list[str], label: str = "label") -> DataFrame:
    """For each key and cluster the mean parameters of its near cells, weighted by 1 / max(distance, 1e-10)."""
    w = F.lit(1.0) / F.greatest(F.sqrt("dist2"), F.lit(1e-10))
    d = near.withColumn("__w", w)
    return d.groupBy(*keys, label).agg(*[(F.sum(F.col("__w") * F.col(c)) / F.sum("__w")).alias(c) for c in phi])


def lehmer(successes: DataFrame, f: str = "f", cr: str = "cr") -> DataFrame:
    return successes.agg((F.sum(F.col(f) * F.col(f)) / F.sum(f)).alias("f_mean"), F.avg(cr).alias("cr_mean"))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n1, n2, u1, z for the groups 0 and 1, with average ranks by counting, no sort of all rows in one task.

    Products of counts are doubles: n1 * n2 * (n1 + n2 + 1) leaves 64 bits at some three million rows.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("c"), F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("c0"))
    buckets = counts.withColumn("__b", F.floor(F.col(value)))
    sums = buckets.groupBy("__b").agg(F.sum("c").alias("s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = buckets.withColumn("__in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(sums, "__b")
    rank = F.col("__before") + F.col("__in") + (F.col("c") + 1) / 2
    total = ranks.agg(F.sum(rank * F.col("c0")).alias("r1"), F.sum("c0").alias("n1"), F.sum(F.col("c") - F.col("c0")).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mid, sd = n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    return total.select("n1", "n2", u.alias("u1"), ((u - mid) / sd).alias("z"))
