"""Exact search by inner product: blocks of queries against chunks of vectors.

Queries and vectors are packed into rows of some hundred vectors each, every block meets every chunk, and a task looks at
one such product at a time: a matrix product tells which vectors may be among the best, and those few get their exact
value, added up term by term in the order of the components. The work is that of all pairs, spread over the chunks;
what moves on is k rows for each query and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one chunk and queries of one block: a product is 8 MB, and a row that holds both about 1.2 MB at 64 components.
CHUNK, BLOCK = 2048, 512


def best_of_chunk(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, dot of the k vectors (all but those of the query's own id) of largest dot for each query, ties to the
    smallest id. Dots are added up in the order of the components."""
    near = q @ v.T
    near[qids[:, None] == ids[None, :]] = -np.inf
    k = min(k, len(ids))
    least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
    # how far a product in any order of the terms may be from the sum in order
    slack = 4 * v.shape[1] * np.finfo(float).eps * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max())
    at, which = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
    dot = np.zeros(len(at))
    for j in range(v.shape[1]):
        dot += q[at, j] * v[which, j]
    order = np.lexsort((ids[which], -dot, at))
    at, which, dot = at[order], which[order], dot[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return qids[at[place < k]], ids[which[place < k]], dot[place < k]


def _matrix(rows: pa.Array, size: int) -> np.ndarray:
    return rows.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def most_similar(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, vec_id, rank: for each query (q, qv array<double>) the k vectors (vec_id, v array<double>) of another id with the
    largest inner product, ties to the smallest id.

    Vectors that are null, hold null or values that are not finite, or have another length than most, meet the others
    pair by pair.
    """
    vectors = vectors.filter("vec_id is not null").select("vec_id", "v")
    s = vectors.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("size")).first()
    nq, size = queries.count(), s["size"] or 0
    inf = F.lit(float("inf"))

    def plain(c: str) -> F.Column:
        return F.coalesce((F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < inf)), F.lit(False)) & F.lit(size > 0)

    def dealt(d: DataFrame, key: str, value: str, rows: int, each: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(key, value), F.lit(max(1, -(-rows // each))))
        d = d.filter(plain(value)).withColumn("__part", part).repartition(max(1, -(-rows // each)), "__part")
        lists = d.groupBy("__part").agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(value).alias("v"))).alias("l"))
        return lists.select(F.col("l.id").alias(f"{name}_ids"), F.col("l.v").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, v, qids, q = (b.column(j).slice(i, 1) for j in range(4))
                found = best_of_chunk(ids.flatten().to_numpy(), _matrix(v, size), qids.flatten().to_numpy(), _matrix(q, size), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["q", "vec_id", "dot"])

    chunks, blocks = dealt(vectors, "vec_id", "v", s["n"], CHUNK, "v"), dealt(queries, "q", "qv", nq, BLOCK, "q")
    found = chunks.crossJoin(blocks).mapInArrow(run, "q long, vec_id long, dot double")
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    other = F.col("vec_id") != F.col("q")
    odd = vectors.filter(~plain("v")).join(queries, other).unionByName(vectors.filter(plain("v")).join(queries.filter(~plain("qv")), other))
    odd = odd.select("q", "vec_id", dot.alias("dot"))
    w = Window.partitionBy("q").orderBy(F.desc("dot"), "vec_id")
    return found.union(odd).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "vec_id", "rank")
