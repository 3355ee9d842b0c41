"""Best-fit packing by a configuration linear program over the length histogram.

1. Every document becomes token ids and an end id; longer ones are cut into pieces of `capacity`, the first piece
   taking the remainder. One narrow pass, ids are not kept: a piece is doc_id, piece, start, length, crc32 of its ids.
2. The histogram of piece lengths (at most `capacity` rows, whatever the input) goes to the driver. Multiplicative
   weights solve the covering program "few sequences, every length covered". Each round prices lengths by weight; one
   knapsack dynamic program then gives, for every length, the best filled sequence that holds it (a configuration).
   Those within TOLERANCE of the best one are taken, each by a step of STEP of what its scarcest length allows, and
   lengths that it covers lose weight. Steps are rounded down to whole sequences as they are taken. Where the program
   without bounds on copies asks for more of a length than is left, one with bounds prices the round. When SHARE of the
   tokens are placed, what is left over, pieces of all sizes, is packed best-fit decreasing on the histogram. Prices
   also give a lower bound on the number of sequences, see Solved.
3. The plan is a table of slots: for each length, ranges of ranks with the sequence and offset they map to. Pieces
   are ranked inside their length by counts of (length, salt) plus a rank inside each salt, so a length that a third
   of all pieces have is dealt over all salts. Joining pieces and slots on length and rank range places them.

Defined results: a null text is empty and has one piece, the end id alone; pieces of repeated rows are packed once
for each row; ties in rank follow doc_id, piece, then the checksum; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import begins, keeps, table, written

CAPACITY = 2048
END_ID = 0
#: Ranks inside a length are dealt over one salt per SALT_ROWS pieces, LEAST_SALTS at least.
SALT_ROWS, LEAST_SALTS = 100_000, 64
#: Rounds at most, a part of the scarcest length that a step takes, and the loss of weight of a length covered whole.
ROUNDS, STEP, DECAY = 1000, 0.5, 0.5
#: First prices are this power of a length: of full configurations those of long pieces come first, short ones fill later.
BULK = 1.1
#: Configurations of a round are worth at least 1 - TOLERANCE of the best; SHARE of the tokens are placed by them.
TOLERANCE, SHARE = 0.01, 0.95
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids of a text as little-endian bytes, equal to the tokenizer's own.

    Pre-tokens never reach over a single blank between two other characters, so a text splits at its lines and
    blanks into chunks whose ids are looked up; only new chunks are encoded. Texts with other white space, or with a
    special token's name, are encoded whole. A file with another pre-tokenizer or normaliser has all texts encoded whole,
    by the tokenizer itself.
    """

    def __init__(self, path: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cache: dict[str, bytes] = {}
        split = spec.get("pre_tokenizer") or {}
        known = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.plain = bool(known and spec.get("normalizer") is None and spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("dropout"))
        if not self.plain:
            return
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in plain}
        alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, dtype=np.int32)
        for t, i in ranks.items():
            self.sizes[i] = len(t)
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]$|\x00").search

    def __getitem__(self, chunk: str) -> bytes:
        got = self.cache.get(chunk)
        if got is None:
            if len(self.cache) > 600_000:
                self.cache.clear()
            got = self.cache[chunk] = np.array(self.fast.encode_ordinary(chunk), dtype="<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        got = self.encode_plain(text)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() if got is None else got

    def encode_plain(self, text: str) -> bytes | None:
        """The ids where they cover the text's bytes in order, none left out; else null."""
        if not self.plain or any(s in text for s in self.special):
            return None
        if self.odd(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        # every chunk but a line's first keeps the blank before it
        chunks = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return b"".join(map(self.__getitem__, chunks)) if text else b""


_TOKENS: dict[str, Tokens] = {}
keeps("packing", _TOKENS.clear)


def tokens(path: str) -> Tokens:
    begins("packing")
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = tokens(path), np.uint32(end_id).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                out: list[list] = [[], [], [], [], [], []]
                part = b.slice(lo, 1000)
                for d, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = t.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    head = n % capacity or min(n, capacity)
                    at = piece = 0
                    while at < n:
                        size = head if not piece else capacity
                        raw = ids[4 * at : 4 * (at + size)]
                        for column, x in zip(out, (d, piece, at, size, zlib.crc32(raw), raw)):
                            column.append(x)
                        at, piece = at + size, piece + 1
                arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack for every room up to capacity: best value, and an item to take first (-1: leave one free)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")  # sizes ascend
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            total = best[room - sizes[:k]] + values[:k]
            j = int(total.argmax())
            if total[j] > best[room] + 1e-15:
                best[room], take[room] = total[j], j
    return best, take


def content(take: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    """{item: copies} of knapsack's best content of a room."""
    out: dict[int, int] = {}
    while room > 0:
        if (j := int(take[room])) < 0:
            room -= 1
            continue
        out[j] = out.get(j, 0) + 1
        room -= int(sizes[j])
    return out


def bounded_knapsack(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """{item: copies} of the best content with at most counts[item] copies, copies taken in powers of two."""
    best, steps = np.zeros(capacity + 1), []
    for j in range(len(sizes)):
        most, k = min(int(counts[j]), capacity // int(sizes[j])), 1
        while most > 0:
            k = min(k, most)
            most -= k
            w = k * int(sizes[j])
            better = np.zeros(capacity + 1, dtype=bool)
            total = best[: capacity + 1 - w] + k * values[j]
            better[w:] = total > best[w:] + 1e-15
            best[w:] = np.where(better[w:], total, best[w:])
            steps.append((j, k, w, better))
            k *= 2
    out: dict[int, int] = {}
    room = int(best.argmax())
    for j, k, w, better in reversed(steps):
        if better[room]:
            out[j] = out.get(j, 0) + k
            room -= w
    return out


class Solved(NamedTuple):
    """Configurations {size: copies} with whole multiplicities, the share of the tokens in pieces below `capacity` that
    the program placed, and a lower bound on the number of sequences from its prices."""

    plan: list[tuple[dict[int, int], int]]
    share: float
    bound: int


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, share: float = SHARE) -> Solved:
    """A plan that holds exactly `counts` pieces of each of the ascending sizes."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    full = sizes == capacity
    alone = int(left[full].sum())
    if alone:  # nothing fits beside them
        plan.append(({capacity: 1}, alone))
    left[full] = 0
    need = left.astype(float)
    total = int((sizes * left).sum())
    log_w = BULK * np.log(sizes / capacity)
    taken: dict[tuple, int] = {}
    placed, lower = 0, total / capacity  # what configurations hold is a feasible price, too

    def step(config: dict[int, int], items: np.ndarray) -> int:
        """Takes a configuration; the tokens that it places."""
        if (m := min(int(left[items[j]]) // c for j, c in config.items())) <= 0:
            return 0
        m = max(1, int(STEP * m))
        key = tuple(sorted((int(sizes[items[j]]), c) for j, c in config.items()))
        taken[key] = taken.get(key, 0) + m
        for j, c in config.items():
            left[items[j]] -= m * c
            log_w[items[j]] -= DECAY * m * c / need[items[j]]
        return m * sum(k * c for k, c in key)

    for _ in range(rounds):
        if placed >= share * total:
            break
        items = np.flatnonzero(left > 0)
        s, w = sizes[items].astype(np.int64), np.exp(log_w[items])
        best, take = knapsack(w, s, capacity)
        # weights divided by the best configuration's are feasible prices: no configuration is worth more than one
        lower = max(lower, float(need[items] @ w) / best[capacity])
        worth = w + best[capacity - s]
        before = placed
        for j in sorted(np.flatnonzero(worth >= worth.max() * (1 - TOLERANCE)).tolist(), key=lambda j: -s[j]):
            if placed >= share * total:
                break
            config = content(take, s, capacity - int(s[j]))
            config[j] = config.get(j, 0) + 1
            placed += step(config, items)
        if placed == before:
            placed += step(bounded_knapsack(w, s, left[items], capacity), items)
    plan += [(dict(key), m) for key, m in sorted(taken.items())]
    plan += best_fit({int(a): int(n) for a, n in zip(sizes, left) if n}, capacity)
    return Solved(plan, placed / total if total else 1.0, alone + math.ceil(lower - 1e-6))


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: equal sequences are opened together, so work follows distinct sizes."""
    plan = []
    while left:
        config: dict[int, int] = {}
        room = capacity
        for size in sorted(left, reverse=True):
            if (c := min(left[size], room // size)) > 0:
                config[size] = c
                room -= c * size
            if room <= 0:
                break
        m = min(left[size] // c for size, c in config.items())
        plan.append((config, m))
        for size, c in config.items():
            left[size] -= m * c
            if not left[size]:
                del left[size]
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a sequence, first sequence, offset) of every configuration and size."""
    out, ranks, sequence = [], {}, 0
    for config, m in plan:
        offset = 0
        for size, c in sorted(config.items(), reverse=True):
            lo = ranks.get(size, 0)
            ranks[size] = lo + m * c
            out.append((size, lo, lo + m * c, c, sequence, offset))
            offset += size * c
        sequence += m
    return out


def ranked(pieces: DataFrame, salts: int = LEAST_SALTS) -> DataFrame:
    """pieces with `rank`, from 0, inside each length."""
    p = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = p.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32"))
    return p.withColumn("__in", inside).join(base, ["length", "__salt"]).withColumn("rank", F.col("__base") + F.col("__in") - 1).drop("__salt", "__in", "__base")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read more than once: give a stored table."""
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()  # at most `capacity` rows
    sizes = np.array([r["length"] for r in rows], dtype=np.int64)
    counts = np.array([r["n"] for r in rows], dtype=np.int64)
    places = slots(solve(sizes, counts, capacity, rounds).plan)
    names = "__length long, __lo long, __end long, __copies long, __first long, __offset long"
    # at most one row for each configuration and size: bounded by rounds and capacity, not by the input
    where = F.broadcast(spark.createDataFrame(places, names))
    r = ranked(pieces, max(LEAST_SALTS, int(counts.sum()) // SALT_ROWS))
    j = r.join(where, (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("__lo")) & (F.col("rank") < F.col("__end")))
    at = F.col("rank") - F.col("__lo")
    return j.select(
        *pieces.columns,
        (F.col("__first") + F.floor(at / F.col("__copies"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + F.pmod(at, F.col("__copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    return pack(written(cut_pieces(docs, path, capacity), "pieces"), capacity, rounds)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
