"""Profiles: best value per cell with its parameters, marginals, slices, intervals, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_cell(points: DataFrame, cells: list[str], value: str = "logl", carried: list[str] | None = None) -> DataFrame:
    """The maximum of each cell with the carried columns of its row; ties go to the smallest carried values.

    max() of a struct is partially aggregated before the exchange: a cell costs one row a task.
    """
    carried = carried or []
    best = points.groupBy(*cells).agg(F.min(F.struct((-F.col(value)).alias("__neg"), *carried)).alias("b"))
    return best.select(*cells, (-F.col("b.__neg")).alias(value), *[F.col(f"b.{c}").alias(c) for c in carried])


def in_roi(df: DataFrame, threshold: float, value: str = "logl", strict: bool = False) -> DataFrame:
    """Rows within threshold of the maximum (a one-row aggregate, broadcast)."""
    top = df.agg(F.max(value).alias("__top"))
    cut = F.col("__top") - F.lit(float(threshold))
    keep = F.col(value) > cut if strict else F.col(value) >= cut
    return df.join(F.broadcast(top)).filter(keep).drop("__top")


def with_delta(df: DataFrame, value: str = "logl", name: str = "delta") -> DataFrame:
    top = df.agg(F.max(value).alias("__top"))
    return df.join(F.broadcast(top)).withColumn(name, F.col(value) - F.col("__top")).drop("__top")


def pair_marginals(profile: DataFrame, cells: list[str], value: str = "logl") -> DataFrame:
    """a, b, ia, ib, logl: the maximum over the other axes for every pair of axes, in one pass by grouping sets."""
    pairs = [(x, y) for k, x in enumerate(cells) for y in cells[k + 1 :]]
    out = profile.groupingSets([[F.col(x), F.col(y)] for x, y in pairs], *cells).agg(F.max(value).alias(value), F.grouping_id().alias("g"))
    n = len(cells)
    code = {sum(1 << (n - 1 - k) for k, c in enumerate(cells) if c not in p): p for p in pairs}
    a = b = ia = ib = None
    for g, (x, y) in code.items():
        hit = F.col("g") == g
        parts = (F.lit(x), F.lit(y), F.col(x), F.col(y))
        a, b, ia, ib = parts_when(hit, parts, (a, b, ia, ib))
    return out.select(a.alias("a"), b.alias("b"), ia.alias("ia"), ib.alias("ib"), value)


def parts_when(hit: Column, parts: tuple, so_far: tuple) -> tuple:
    return tuple(F.when(hit, p) if s is None else s.when(hit, p) for p, s in zip(parts, so_far))


def slice_at_best(profile: DataFrame, cells: list[str], keep: list[str], value: str = "logl") -> DataFrame:
    """The cells that agree with the best cell on all axes but those in keep."""
    others = [c for c in cells if c not in keep]
    best = profile.agg(F.min(F.struct((-F.col(value)).alias("v"), *cells)).alias("b"))
    best = best.select(*[F.col(f"b.{c}").alias(f"__{c}") for c in others])
    out = profile.join(F.broadcast(best))
    for c in others:
        out = out.filter(F.col(c) == F.col(f"__{c}"))
    return out.select(*keep, value)


def median_map(df: DataFrame, cells: list[str], value: str) -> DataFrame:
    return df.groupBy(*cells).agg(F.median(value).alias(value))


def wilks_intervals(profile: DataFrame, coord: str, levels: dict[str, float], value: str = "logl") -> DataFrame:
    """level, lo, hi: the extent of each level below the best value."""
    d = with_delta(profile, value)
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(v)).alias("cut")) for k, v in levels.items()]))
    return (
        d.withColumn("l", table).filter(F.col("delta") >= F.col("l.cut")).groupBy(F.col("l.level").alias("level")).agg(F.min(coord).alias("lo"), F.max(coord).alias("hi"))
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, n: equal bins on [lo, hi], the last closed on both sides, empty ones with 0, values outside left out."""
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    # no filter by value or bin: where the value is an expression, it would be repeated in the filter as often as it is named
    counts = df.groupBy(F.when(F.col(value).between(lo, hi), at).alias("__at")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = all_bins.join(F.broadcast(counts), F.col("bin").eqNullSafe(F.col("__at")), "left")
    return both.select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def top_n(df: DataFrame, n: int, value: str, *ties: str) -> DataFrame:
    """The n best rows: a bounded heap in each task, then one of n rows a task."""
    return df.orderBy(F.desc(value), *ties).limit(n)


def running_best(df: DataFrame, order: str, block: int = 4096, value: str = "logl") -> DataFrame:
    """df with `best_so_far`, the maximum of value up to each row by order, without one sort of all rows.

    Blocks of consecutive order values are ranked alone; the maxima of earlier blocks are added from a table with one
    row a block.
    """
    d = df.withColumn("__block", F.floor(F.col(order) / block))
    tops = d.groupBy("__block").agg(F.max(value).alias("__top"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__block", F.max("__top").over(before).alias("__before"))
    inside = F.max(value).over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__in", inside).join(tops, "__block")
    return d.withColumn("best_so_far", F.greatest("__in", "__before")).drop("__block", "__in", "__before")
