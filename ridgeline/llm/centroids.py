"""Centroid clustering: exact Lloyd rounds by exponion search.

Each vector keeps its cluster, an upper bound u of the distance to its centroid and a lower bound of the distance to
any other. When centroids move, bounds move with them. A vector whose u stays under the lower bound, or under half the
distance from its centroid to the nearest other one, cannot have another nearest centroid and is not looked at. Any other
vector first gets u exact, and then meets only the centroids in a ball around its own: those within 2u plus the distance
to the nearest other centroid, found by a binary search in that centroid's sorted list of distances to the others. The
ball holds the nearest two centroids; its radius is inclusive, and skipping needs strict inequalities, so ties are seen
and go to the smaller number. Distances that decide are exact integers; bounds are rounded away from each other.

A round is one narrow pass that writes the vectors with new clusters and bounds; what members that moved add to their
clusters' sums is all that is shuffled. When no vector has moved, the rounds left would repeat this one; they are left out.

Defined results: vectors that are null, do not have exactly `dims` components or hold null or non-finite ones are left
out; a scaled component beyond 2**27 counts as 2**27; a null vec_id never starts a centroid; repeated rows count as often
as they occur; with fewer vectors than k there are fewer centroids; sums beyond 64 bits are null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.llm import vectors as V
from ridgeline.llm.common import dropped, table, written

CLUSTERS, ROUNDS, SCALE, DIMS = 8, 10, 1024, 64
UP, DOWN = 1 + 1e-12, 1 - 1e-12  # how bounds are rounded


@dataclass
class Lists:
    """What a round knows of its centroids."""

    centres: np.ndarray  # (k, dims)
    order: np.ndarray  # (k, k - 1): the others by distance
    near: np.ndarray  # their distances, rounded down
    moved: np.ndarray  # (k,): how far each moved, rounded up
    others: np.ndarray  # (k,): how far any other moved at most

    @classmethod
    def of(cls, centres: np.ndarray, before: np.ndarray) -> Lists:
        k = len(centres)
        d = np.sqrt(V.squared_distances(centres, centres).astype(np.float64))
        order = np.array([[j for j in np.lexsort((np.arange(k), d[i])) if j != i] for i in range(k)], np.int64).reshape(k, k - 1)
        moved = np.sqrt(((centres - before) ** 2).sum(axis=1).astype(np.float64)) * UP
        others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(k)])
        return cls(centres, order, np.take_along_axis(d, order, axis=1) * DOWN, moved, others)


def _to(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the centre of its own row, exact."""
    return ((x.astype(np.int64) - centres) ** 2).sum(axis=1)


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds of a block of vectors, and how many distances were computed. cluster -1: not known yet."""
    k, cluster = len(at.centres), cluster.copy()
    if (cluster < 0).all():
        d = V.squared_distances(x, at.centres)
        cluster = d.argmin(axis=1)
        first = np.sqrt(np.take_along_axis(d, cluster[:, None], 1)[:, 0].astype(np.float64)) * UP
        second = np.full(len(x), np.inf)
        if k > 1:
            np.put_along_axis(d, cluster[:, None], np.iinfo(np.int64).max, 1)
            second = np.sqrt(d.min(axis=1).astype(np.float64)) * DOWN
        return cluster, first, second, len(x) * k
    upper, lower = (upper + at.moved[cluster]) * UP, lower - at.others[cluster]
    if k == 1:
        return cluster, upper, lower, 0
    half = at.near[:, 0] / 2 * DOWN
    safe = np.maximum(lower, half[cluster])
    open_ = np.flatnonzero(~(upper < safe))
    seen = len(open_)
    own = _to(x[open_], at.centres[cluster[open_]])
    upper[open_] = np.sqrt(own.astype(np.float64)) * UP
    still = ~(upper[open_] < safe[open_])
    open_, own = open_[still], own[still]
    was = cluster[open_]
    for a in np.unique(was):
        rows, best = open_[was == a], own[was == a]
        radius = (2 * upper[rows] + at.near[a, 0] / DOWN * UP) * UP
        inside = np.searchsorted(at.near[a], radius, side="right")  # inclusive
        nearest, second = np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        for j in range(int(inside.max(initial=0))):
            c, some = at.order[a, j], np.flatnonzero(inside > j)
            d = _to(x[rows[some]], at.centres[c])
            seen += len(some)
            wins = (d < best[some]) | ((d == best[some]) & (c < nearest[some]))
            second[some] = np.minimum(second[some], np.where(wins, best[some], d))
            best[some], nearest[some] = np.where(wins, d, best[some]), np.where(wins, c, nearest[some])
        cluster[rows] = nearest
        upper[rows], lower[rows] = np.sqrt(best.astype(np.float64)) * UP, np.sqrt(second.astype(np.float64)) * DOWN
    return cluster, upper, lower, seen


def _round(state: DataFrame, lists: Lists, key: str, first: bool) -> DataFrame:
    """Vectors with clusters and bounds, and what those that moved add to the sums; `scans` counts distances."""
    k, dims = lists.centres.shape
    fields = [T.StructField(key, T.LongType()), T.StructField("x", T.BinaryType()), T.StructField("cluster", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("upper", "lower")]
    schema = T.StructType([*fields, *V.MOVE_FIELDS, T.StructField("scans", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, scans = V.Moves(1, k, dims), 0
        for b in batches:
            x = V.unpacked(b.column("x"), "<i4", dims)
            new, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x))
            old = np.full(len(x), -1) if first else b.column("cluster").to_numpy().astype(np.int64)
            for lo in range(0, len(x), V.BLOCK):
                s = slice(lo, lo + V.BLOCK)
                bounds = (np.empty(0), np.empty(0)) if first else (b.column("upper").to_numpy()[s], b.column("lower").to_numpy()[s])
                new[s], upper[s], lower[s], n = search(x[s], old[s], *bounds, lists)
                scans += n
            moved = np.flatnonzero(old != new)
            moves.add(0, old[moved], new[moved], x[moved])
            yield V.with_moves([b.column(key), b.column("x"), pa.array(new.astype(np.int32)), pa.array(upper), pa.array(lower)], arrow)
        yield V.moves_only(moves, arrow, len(fields))
        yield pa.RecordBatch.from_pylist([{"part": -1, "scans": scans}], schema=arrow)  # part -1: the task's count

    rows = state.select(key, "x") if first else state.filter("part IS NULL").select(key, "x", "cluster", "upper", "lower")
    return rows.mapInArrow(run, schema)


def _distances(state: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """key, cluster, distance (squared)."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("cluster").to_numpy()
            d = _to(V.unpacked(b.column("x"), "<i4", dims), centres[at])
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("cluster"), pa.array(d)], names=[key, "cluster", "distance"])

    return state.filter("part IS NULL").select(key, "x", "cluster").mapInArrow(run, f"`{key}` long, cluster int, distance long")


def cluster(
    base: DataFrame, start: np.ndarray, rounds: int = ROUNDS, key: str = "vec_id"
) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """base: stored integer vectors; start: centroids (k, dims). (key, cluster, distance; centroids; counts of each pass)."""
    spark, dims = base.sparkSession, start.shape[1]
    centres, lists, state, sums, passes = start.astype(np.int64), None, base, None, []
    for r in range(rounds + 1):
        lists = Lists.of(centres, centres if lists is None else lists.centres)
        new = written(_round(state, lists, key, r == 0), "clusters")
        if state is not base:
            dropped(state)
        state = new
        seen = state.filter("part IS NOT NULL").agg(F.sum("scans").alias("scans"), F.count_if(F.col("part") >= 0).alias("moves")).first()
        passes.append({"scans": seen["scans"] or 0, "moves": seen["moves"]})
        if r == rounds or not seen["moves"]:
            break
        sums = V.running_sums(spark, sums, state.filter("part IS NULL OR part >= 0"), dims)
        centres = V.new_centres(centres[None], sums)[0]
    out = written(_distances(state, centres, key), "distances")
    dropped(*[t for t in (state, sums) if t is not None])
    return out, centres, passes


def first_by_hash(base: DataFrame, k: int, key: str, seed: str) -> np.ndarray:
    """The k vectors whose key's hash is smallest, in that order; equal hashes by the vector."""
    named = base.filter(F.col(key).isNotNull()).select(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("hash"), "x")
    rows = named.orderBy("hash", "x").limit(k).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in rows], np.int64)


def cluster_vectors(
    rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = "3:",
    key: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """(key, cluster, distance of each kept vector; centroids; counts of each pass)."""
    base = written(V.integer_vectors(rows, key, vector, scale, dims), "vectors")
    start = first_by_hash(base, k, key, seed)
    if not start.size:
        start = np.zeros((1, dims), np.int64)  # no vector has an id: one cluster that starts at the origin
    out = cluster(base, start, rounds, key)
    dropped(base)
    return out


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centres, _ = cluster_vectors(table(spark, sf_dir, "embeddings"))
    per = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # a row a centroid
    own = [per.get(c, 0) for c in range(len(centres))]
    total = None if None in own or sum(own) >= 1 << 63 else sum(own)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return out.select(
        "vec_id", "cluster", "distance", of(own, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
        of(digest, "string").alias("centroid_sha256"),
    )


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS) -> str:
    """Plain Lloyd rounds as relations."""
    step = [
        f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), v AS MATERIALIZED (SELECT rid, i AS pos, x[i + 1] AS x FROM k, range({dims}) r(i)
), c0 AS MATERIALIZED (SELECT CAST(rid - 1 AS INTEGER) AS cluster, pos, x FROM v WHERE rid <= {k})"""
    ]
    for r in range(rounds + 1):
        step.append(f"""d{r} AS (SELECT rid, cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c ON v.pos = c.pos GROUP BY ALL
), a{r} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            step.append(f"""s{r} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{r} a ON v.rid = a.rid GROUP BY ALL
), c{r + 1} AS MATERIALIZED (SELECT c.cluster AS cluster, c.pos AS pos, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
  FROM c{r} c LEFT JOIN s{r} s ON s.cluster = c.cluster AND s.pos = c.pos)""")
    last = f"""h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM c{rounds} GROUP BY cluster
) SELECT vec_id, a.cluster AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} a JOIN k ON k.rid = a.rid JOIN h ON h.cluster = a.cluster"""
    return "\n, ".join([*step, last])


OP13_SQL = _sql()
