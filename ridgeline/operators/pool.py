"""Solution pools, seeds, nearest neighbours, weighted choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Projection
from ridgeline.operators.grid import with_cells
from ridgeline.operators.profile import best_per_cell, in_roi, top_n

# How a pool's capacity follows the dimensions.
POOL_PER_DIM, POOL_LEAST, POOL_MOST = 2500, 10_000, 100_000
#: A pool side of a nearest-neighbour join is broadcast up to this many rows.
BROADCAST_ROWS = 200_000
#: Pairs of queries and pool rows that a broadcast join may look at.
PAIRS = 50_000_000


def capacity(n_dims: int) -> int:
    return max(POOL_LEAST, min(POOL_MOST, POOL_PER_DIM * n_dims))


def pool_of(points: DataFrame, n_dims: int, value: str = "logl", *ties: str) -> DataFrame:
    """The capped pool of best points."""
    return top_n(points, capacity(n_dims), value, *ties)


def seeds(points: DataFrame, p: Projection, threshold: float, carried: list[str], value: str = "logl") -> DataFrame:
    """The best point of each cell inside the region of interest: bounds, then cells, then the cut. Values of null or -inf
    are no points; they go after the cells are known, so that a log whose value is an expression is evaluated once a row."""
    points = points.withColumn(value, F.coalesce(value, F.lit(float("-inf"))))
    for d, (lo, hi) in enumerate(p.bounds):
        points = points.filter(F.col(f"x{d}").between(lo, hi))
    best = best_per_cell(with_cells(points, p), p.cells, value, carried)
    return in_roi(best.filter(F.col(value) > float("-inf")), threshold, value)


def squared_distance(pairs: list[tuple[str, str, float]]) -> Column:
    """Sum of squared differences, each over its extent."""
    out = None
    for a, b, extent in pairs:
        d = (F.col(a) - F.col(b)) / F.lit(float(extent))
        out = d * d if out is None else out + d * d
    return out


def nearest(
    queries: DataFrame, pool: DataFrame, key: list[str], pairs: list[tuple[str, str, float]], k: int, ties: list[str],
    pool_rows: int, query_rows: int | None = None,
) -> DataFrame:
    """The k nearest pool rows of each query, with `dist2` and `rank`. Columns of the two sides must differ.

    The pool has pool_rows rows, a bound its maker proves. A small pool is broadcast, and every task keeps k candidates
    a query before the exchange; with more than BROADCAST_ROWS rows, or PAIRS pairs where the number of queries is
    given, both sides meet bucket by bucket instead.
    """
    if pool_rows > BROADCAST_ROWS or pool_rows * (query_rows or 0) > PAIRS:
        from ridgeline.operators.nearest import nearest_points

        return nearest_points(queries, pool, key, pairs, k, ties)
    both = queries.join(F.broadcast(pool)).withColumn("dist2", squared_distance(pairs))
    w = Window.partitionBy(*key).orderBy("dist2", *ties)
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def weighted_choice(df: DataFrame, weight: str, n: int, draw: Column) -> DataFrame:
    """n rows without replacement, chances by weight: the n least of -ln(u) / weight."""
    return df.withColumn("__key", -F.ln(draw) / F.col(weight)).orderBy("__key").limit(n).drop("__key")


def priority(best: Column, mean_gain: Column, n: Column, global_max: Column, roi: float) -> Column:
    """How much a cell deserves another generation."""
    return F.greatest(F.lit(0.0), best - (global_max - F.lit(2.0 * roi))) + F.lit(10.0) * mean_gain + F.lit(1.0) / n
