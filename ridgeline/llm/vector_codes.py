"""Vector code compression: product codes by a delta-maintained Lloyd iteration.

Vectors are cut into equal consecutive parts, and each part position has a codebook of its own. A round is one narrow
pass over the vectors with the codes of the round before: it finds each part's nearest entry, writes the vectors with
their new codes, and adds up plus and minus contributions of the parts whose entry changed. The running sums, a stored
table with a row for each entry, take these contributions in: nothing else is shuffled, and a round in which few parts
move shuffles little. Integers throughout, so partitions and retries change nothing. When no part has moved, the
codebooks are as before, and the rounds left would repeat this one; they are left out.

Tables: the vectors as 32-bit integers once, then one table a round, each deleted when the next one stands.

Defined results: rows whose vector is null, holds null or non-finite components, or does not have `dims` components are
left out; a scaled component beyond 2**27 counts as 2**27; with fewer vectors than entries, codebooks have as many
entries as there are vectors; a null vec_id never starts an entry but gets a code; repeated rows count as often as they
occur and are repeated in the result, and of rows with one vec_id the smaller vector starts the smaller entry; sums
beyond 64 bits are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.llm import vectors as V
from ridgeline.llm.common import dropped, table, written

PARTS, ENTRIES, ROUNDS, SCALE, DIMS = 8, 16, 6, 4096, 64
#: Labels whose sums are broadcast, up to this number; beyond, they are joined by a shuffle with every label dealt to SALT tasks.
BROADCAST_LABELS = 100_000
SALT = 16


def nearest_entries(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes (row, part), ties to the lower index, and the squared distances added up over the parts."""
    parts, _, width = books.shape
    codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), V.BLOCK):
        some = x[lo : lo + V.BLOCK]
        for p in range(parts):
            d = V.squared_distances(some[:, p * width : (p + 1) * width], books[p])
            at = d.argmin(axis=1)
            codes[lo : lo + V.BLOCK, p] = at
            error[lo : lo + V.BLOCK] += d[np.arange(len(some)), at]
    return codes, error


def _round(state: DataFrame, books: np.ndarray, carried: T.StructType, first: bool) -> DataFrame:
    """vectors with the codes that books give, and what the parts that moved add to the sums."""
    parts, entries, width = books.shape
    schema = T.StructType([*carried.fields, T.StructField("x", T.BinaryType()), T.StructField("code", T.BinaryType()), *V.MOVE_FIELDS])
    arrow, lead = to_arrow_schema(schema), len(carried) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = V.Moves(parts, entries, width)
        for b in batches:
            x = V.unpacked(b.column("x"), "<i4", parts * width)
            old = np.full((len(x), parts), -1) if first else V.unpacked(b.column("code"), "u1", parts).astype(np.int64)
            new, _ = nearest_entries(x, books)
            for p in range(parts):
                moved = np.flatnonzero(old[:, p] != new[:, p])
                moves.add(p, old[moved, p], new[moved, p].astype(np.int64), x[moved, p * width : (p + 1) * width])
            yield V.with_moves([*[b.column(c) for c in carried.names], b.column("x"), V.packed(new)], arrow)
        yield V.moves_only(moves, arrow, lead)

    rows = state if first else state.filter("part IS NULL").select(*carried.names, "x", "code")
    return rows.mapInArrow(run, schema)


def learn_codebooks(base: DataFrame, key: str, parts: int, entries: int, rounds: int, dims: int) -> tuple[np.ndarray, list[int]]:
    """base: stored integer vectors. Codebooks (part, entry, component), and how many parts moved in each round."""
    spark, width = base.sparkSession, dims // parts
    starts = base.filter(F.col(key).isNotNull()).orderBy(key, "x").limit(entries).select("x").collect()
    books = np.array([np.frombuffer(r["x"], "<i4") for r in starts], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    carried = base.drop("x").schema
    state, sums, moved = base, None, []
    for r in range(rounds if books.size else 0):
        new = written(_round(state, books, carried, r == 0), "codes")
        gains = new.filter("part IS NOT NULL").agg(F.count("*").alias("n")).first()["n"]
        if state is not base:
            dropped(state)
        state = new
        moved.append(gains)
        if not gains:
            break
        sums = V.running_sums(spark, sums, state, width)
        books = V.new_centres(books, sums)
    dropped(*[t for t in (sums, state) if t is not None and t is not base])
    return books, moved


def encode(base: DataFrame, key: str, label: str, books: np.ndarray) -> DataFrame:
    """key, label, code (hexadecimal), error of each integer vector; one narrow pass."""
    parts, _, width = books.shape
    schema = T.StructType([base.schema[key], base.schema[label], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = nearest_entries(V.unpacked(b.column("x"), "<i4", parts * width), books)
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pa.array(error)], schema=arrow)

    return base.select(key, label, "x").mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str, most: int = BROADCAST_LABELS) -> DataFrame:
    """coded with label_error: error summed over the rows of equal labels, nulls together."""
    sums = written(coded.groupBy(F.col(label).alias("__label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    if sums.count() <= most:
        return coded.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
    salted = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = coded.withColumn("__own", F.pmod(F.xxhash64("code", "error"), F.lit(SALT)).cast("int"))
    out = rows.join(salted, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__own") == F.col("__salt")), "left")
    return out.drop("__label", "__own", "__salt")


def books_sha256(books: np.ndarray) -> str:
    """Of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(key, label, code, error of each kept vector; codebooks; entries with moved parts by task, for each round)."""
    if dims % parts or not 1 <= entries <= 256:
        raise ValueError("dims must be a multiple of parts, and a code has 1 to 256 entries")
    base = written(V.integer_vectors(rows, key, vector, scale, dims, (label,)), "vectors")
    books, moved = learn_codebooks(base, key, parts, entries, rounds, dims)
    if not books.size:
        books = np.zeros((parts, 1, dims // parts), np.int64)  # no vectors with an id: all codes are 0 and mean the origin
    coded = written(encode(base, key, label, books), "coded")
    dropped(base)
    return coded, books, moved


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_error(coded, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, width: int = DIMS // PARTS) -> str:
    """The same iteration over all parts in every round, as relations."""
    step = [
        f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), v AS MATERIALIZED (SELECT rid, i // {width} AS part, i % {width} AS pos, x[i + 1] AS x FROM k, range({parts * width}) r(i)
), b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM v WHERE rid <= {entries})"""
    ]
    for r in range(rounds + 1):
        step.append(f"""d{r} AS (SELECT rid, v.part AS part, entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{r} b ON v.part = b.part AND v.pos = b.pos GROUP BY ALL
), a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            step.append(f"""s{r} AS (SELECT a.part AS part, entry, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{r} a ON v.rid = a.rid AND v.part = a.part GROUP BY ALL
), b{r + 1} AS MATERIALIZED (SELECT b.part AS part, b.entry AS entry, b.pos AS pos, CASE WHEN n IS NULL THEN b.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
  FROM b{r} b LEFT JOIN s{r} s ON s.part = b.part AND s.entry = b.entry AND s.pos = b.pos)""")
    last = f"""e AS (SELECT k.vec_id AS vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} a JOIN k ON k.rid = a.rid GROUP BY k.rid, k.vec_id, label
) SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM e"""
    return "\n, ".join([*step, last])


OP11_SQL = _sql()
