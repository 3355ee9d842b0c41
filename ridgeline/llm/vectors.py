"""What the two vector operators share: integer vectors, exact squared distances, running sums of moved members.

A table of vectors holds its components as little-endian 32-bit integers in one binary column. Each round of either
operator is one narrow pass that writes a new table of vectors with their assignments, followed, in the same table, by
the pass's contributions: one row per task and changed entry (`part` is null in rows of vectors), with the members
gained and lost added up. Only these rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import dropped, written

#: Scaled components beyond this bound count as the bound: squared distances of 64 components stay within 64 bits.
MOST = 1 << 27
#: Up to this size products of components are exact in floating point, so that a matrix product finds the distances.
EXACT = 1 << 21
#: Vectors that one step of a pass handles.
BLOCK = 4096


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int, dims: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns, and x: floor(scale * component) of the vectors with exactly `dims` components.

    Rows whose vector is null, of another length, or holds null or non-finite components are left out.
    """
    rows = df.select(F.col(key).cast("long").alias(key), *carried, vector)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            sized = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == dims)
            some = b.take(pa.array(sized))
            flat = some.column(some.num_columns - 1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            whole = np.clip(np.floor(x[good] * scale), -MOST, MOST).astype("<i4")
            kept = some.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], packed(whole)], names=schema.names)

    return rows.mapInArrow(run, schema)


def packed(x: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def unpacked(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """The matrix that `packed` made the column of."""
    if not len(column):
        return np.empty((0, width), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), width)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row of x to each centre, exact, 64-bit integers."""
    x, centres = x.astype(np.int64), centres.astype(np.int64)
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


class Moves:
    """What members gained (plus) and lost (minus) add to the counts and sums of entries, within one task."""

    def __init__(self, parts: int, entries: int, width: int):
        self.n = np.zeros((parts, entries), np.int64)
        self.sums = np.zeros((parts, entries, width), np.int64)

    def add(self, part: int, old: np.ndarray, new: np.ndarray, x: np.ndarray) -> None:
        """Rows of x whose entry changed from old (-1: none) to new."""
        for entry, sign in ((old, -1), (new, 1)):
            for e in np.unique(entry[entry >= 0]):
                mine = entry == e
                self.n[part, e] += sign * int(mine.sum())
                self.sums[part, e] += sign * x[mine].sum(axis=0, dtype=np.int64)

    def rows(self) -> list[tuple[int, int, int, list[int]]]:
        touched = np.argwhere((self.n != 0) | (self.sums != 0).any(axis=2))
        return [(int(p), int(e), int(self.n[p, e]), self.sums[p, e].tolist()) for p, e in touched]


MOVE_FIELDS = [
    T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("sums", T.ArrayType(T.LongType())),
]


def with_moves(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of vectors: the columns, and nulls in the fields of moves."""
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, f.type) for f in list(schema)[len(columns) :]]], schema=schema)


def moves_only(moves: Moves, schema: pa.Schema, lead: int) -> pa.RecordBatch:
    """A batch of moves: nulls in the `lead` first fields."""
    rows = moves.rows()
    cols = list(zip(*rows)) or [()] * 4
    own = [pa.array(c, f.type) for c, f in zip(cols, list(schema)[lead : lead + 4])]
    rest = [pa.nulls(len(rows), f.type) for f in list(schema)[lead + 4 :]]
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), f.type) for f in list(schema)[:lead]], *own, *rest], schema=schema)


def running_sums(spark: SparkSession, before: DataFrame | None, state: DataFrame, width: int) -> DataFrame:
    """part, entry, n, sums after the moves of a pass, stored: at most a row for each entry."""
    moves = state.filter("part IS NOT NULL").select("part", "entry", "n", "sums")
    both = moves if before is None else before.unionByName(moves)
    each = both.select("part", "entry", "n", *[F.col("sums")[k].alias(f"s{k}") for k in range(width)])
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])
    out = written(total.select("part", "entry", "n", F.array(*[f"s{k}" for k in range(width)]).alias("sums")), "sums")
    if before is not None:
        dropped(before)
    return out


def new_centres(centres: np.ndarray, sums: DataFrame) -> np.ndarray:
    """centres (part, entry, component) with those that have members at floor(sum / count)."""
    out = centres.copy()
    for r in sums.filter("n > 0").collect():  # a row for each entry at most
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out
