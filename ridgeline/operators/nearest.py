"""Exact nearest neighbours without a broadcast side: a descent through counted buckets.

The pool's bounding box is halved along every axis, level by level, and each level has the counts of its buckets.
A query walks down from the box: of the buckets that it still looks at, it knows the least and the largest distance
and the number of points, so it knows a distance within which k points lie, and drops the buckets beyond. Buckets with
few points, and those of the last level, are not halved further; at the end a query meets the points of the buckets that
are left, some k times a constant. Points at one place count as the k first of them.
"""

from __future__ import annotations

from itertools import product
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.pool import squared_distance
from ridgeline.sources.store import discarded, stored

#: Buckets of at most so many times k points are not halved.
LEAF = 4
#: Levels at most: a bucket is then 2**-20 of the box.
DEEPEST = 20
#: Distances of buckets get this much slack, so that rounding never drops one.
SLACK = 1e-9


def _bucket(x: Column, low: float, width: float, level: Column) -> Column:
    """The bucket of x along one axis: its place at the deepest level, cut to `level`."""
    deep = F.least(F.floor((x - F.lit(low)) / F.lit(width) * F.lit(float(1 << DEEPEST))), F.lit((1 << DEEPEST) - 1)).cast("long")
    return F.call_function("shiftright", deep, F.lit(DEEPEST) - level)


def nearest_points(
    queries: DataFrame, pool: DataFrame, key: list[str], pairs: list[tuple[str, str, float]], k: int, ties: list[str], leaf: int = LEAF
) -> DataFrame:
    """The k nearest pool rows of each query, with `dist2` and `rank`, ties by the columns `ties`, exact.

    pairs: (column of queries, column of pool, extent that the difference is divided by). Columns of the two sides must
    differ; `key` names a query. Rows with a null among these coordinates have no neighbours and are none. An empty pool
    gives no rows, one of fewer than k rows all of them.
    """
    axes = range(len(pairs))
    pool = pool.dropna(subset=[b for _, b, _ in pairs])
    at_place = Window.partitionBy(*[b for _, b, _ in pairs]).orderBy(*ties)
    points = stored(pool.withColumn("__first", F.row_number().over(at_place)).filter(F.col("__first") <= k).drop("__first"), "points")
    # bounds of the pool: one row
    box = points.agg(F.count("*").alias("n"), *[x for j, (_, b, _) in enumerate(pairs) for x in (F.min(b).alias(f"l{j}"), F.max(b).alias(f"h{j}"))]).first()
    if not box["n"]:
        out = queries.join(points, F.lit(False)).withColumns({"dist2": F.lit(0.0), "rank": F.lit(0)})
        return out.filter(F.lit(False))
    low = [float(box[f"l{j}"]) for j in axes]
    width = [float(box[f"h{j}"]) - low[j] or 1.0 for j in axes]
    levels = min(DEEPEST, max(1, ceil(log2(max(box["n"] / (leaf * k), 1)) / len(pairs)) + 3))

    place = [_bucket(F.col(b), low[j], width[j], F.lit(levels)).alias(f"b{j}") for j, (_, b, _) in enumerate(pairs)]
    deepest = points.select(*place).groupBy(*[f"b{j}" for j in axes]).agg(F.count("*").alias("n"))
    each = deepest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = [F.call_function("shiftright", F.col(f"b{j}"), F.lit(levels) - F.col("level")).alias(f"b{j}") for j in axes]
    counted = stored(each.select("level", *up, "n").groupBy("level", *[f"b{j}" for j in axes]).agg(F.sum("n").alias("n")), "buckets")

    mine = queries.dropna(subset=[a for a, _, _ in pairs]).select(*key, *[F.col(a).alias(f"q{j}") for j, (a, _, _) in enumerate(pairs)])
    open_ = mine.distinct().withColumns({"level": F.lit(0), **{f"b{j}": F.lit(0).cast("long") for j in axes}, "n": F.lit(box["n"])})
    own = [*key, *[f"q{j}" for j in axes]]
    reached = 0
    stride = max(1, 4 // len(pairs))  # levels at a time, of which the last one is looked at
    for level in [*range(stride, levels, stride), levels]:
        small = F.col("n") <= leaf * k
        kept = open_.filter(small)
        parts = product(range(1 << (level - reached)), repeat=len(pairs))
        inner = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{j}") for j, o in enumerate(at)]) for at in parts]))
        down = open_.filter(~small).withColumn("__o", inner)
        down = down.select(*own, F.lit(level).alias("level"), *[(F.col(f"b{j}") * (1 << (level - reached)) + F.col(f"__o.o{j}")).alias(f"b{j}") for j in axes])
        down = down.join(counted.filter(F.col("level") == level), ["level", *[f"b{j}" for j in axes]])
        both = kept.unionByName(down.select(*kept.columns))
        near, far = F.lit(0.0), F.lit(0.0)
        for j, (_, _, extent) in enumerate(pairs):
            step = F.lit(width[j]) / F.pow(F.lit(2.0), F.col("level"))
            a = F.lit(low[j]) + F.col(f"b{j}") * step
            gap = F.greatest(a - F.col(f"q{j}"), F.col(f"q{j}") - (a + step), F.lit(0.0)) / F.lit(float(extent))
            reach = F.greatest(F.abs(F.col(f"q{j}") - a), F.abs(F.col(f"q{j}") - (a + step))) / F.lit(float(extent))
            near, far = near + gap * gap, far + reach * reach
        both = both.withColumns({"__near": near * F.lit(1 - SLACK), "__far": far * F.lit(1 + SLACK)})
        # the least distance within which k points surely lie
        so_far = F.sum("n").over(Window.partitionBy(*key).orderBy("__far").rangeBetween(Window.unboundedPreceding, 0))
        both = both.withColumn("__enough", F.when(so_far >= k, F.col("__far")))
        both = both.withColumn("__most", F.min("__enough").over(Window.partitionBy(*key)))
        both = both.filter(F.col("__most").isNull() | (F.col("__near") <= F.col("__most")))
        open_, was = stored(both.select(*open_.columns), "descent"), open_
        if reached:
            discarded(was)
        reached = level
        if open_.filter(F.col("n") > leaf * k).isEmpty():
            break

    deep = points
    leaves = open_.select(*key, "level", *[f"b{j}" for j in axes])
    used = [r["level"] for r in leaves.select("level").distinct().collect()]  # a row for each level
    deep = deep.withColumn("level", F.explode(F.array(*[F.lit(x) for x in sorted(used)]))) if used else deep.withColumn("level", F.lit(-1))
    deep = deep.withColumns({f"b{j}": _bucket(F.col(b), low[j], width[j], F.col("level")) for j, (_, b, _) in enumerate(pairs)})
    meet = leaves.join(deep, ["level", *[f"b{j}" for j in axes]]).drop("level", *[f"b{j}" for j in axes])
    both = queries.join(meet, key).withColumn("dist2", squared_distance(pairs))
    w = Window.partitionBy(*key).orderBy("dist2", *ties)
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
