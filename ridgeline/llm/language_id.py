"""Language identification with hyperdimensional profiles.

Every letter symbol owns a random vector of +1/-1 (seeded, the same in every process). A trigram is the product of
its letters' vectors, the first rotated twice and the second once; a document is the sum of its trigrams' vectors,
weighted by counts; a language is the sum of its training documents' unit vectors. A document gets the language
whose prototype has the largest cosine with it.

Symbols: a-z after lower-casing, a border for every run of other characters, and hashed buckets for the letters
beyond, so any script is representable in a fixed table. Trigram vectors are made once per process and kept.

Training data: at most `per_language` documents of each language, those with the smallest hash of doc_id among rows
that may be learned from; all other steps cover all rows. Prototypes are summed by an aggregation with one row per
language and dimension, so what reaches the driver does not grow with the input.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing could be learned; ties go to
the alphabetically first language; repeated rows give repeated rows; only doc_id, text and (for learning) lang are
read, so other columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import begins, is_held_out, keeps, table

DIM = 512
SYMBOLS = 64
BORDER = 0
PER_LANGUAGE = 1500
#: Trigram vectors that a process keeps, one byte a dimension.
KNOWN = 32768
UND = "und"
#: A document of the pipeline goes if it reaches no language's level: see learn_levels. A language's level is this part
#: of the low quantile of its own documents' cosines, where EVIDENCE of them show one, and REJECT_BELOW at least.
REJECT_BELOW = 0.05
SLACK, QUANTILE, EVIDENCE = 0.6, 0.02, 10
#: Levels go by a document's size, in powers of two, the last one open; cosines are counted in steps of 1/STEPS.
SIZES, STEPS = 16, 200


class Encoder:
    """Texts to hypervectors. State: the letters' vectors and the trigram vectors met so far."""

    def __init__(self, dim: int = DIM, seed: int = 7):
        rng = np.random.Generator(np.random.Philox(seed))
        self.letters = rng.choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, dim))
        self.rotated = np.roll(self.letters, 1, axis=1), np.roll(self.letters, 2, axis=1)
        self.row = np.full(SYMBOLS**3, -1, dtype=np.int32)
        self.known = np.empty((1024, dim), dtype=np.int8)
        self.n = 0
        # one symbol for each unit of the basic plane; letters beyond a-z share the buckets 27 to 63
        self.symbol = np.zeros(65536, dtype=np.uint8)
        for c in range(65536):
            ch = chr(c).lower()[0]  # some letters have two characters as lower case
            if "a" <= ch <= "z":
                self.symbol[c] = ord(ch) - 96
            elif chr(c).isalpha():
                self.symbol[c] = 27 + (ord(ch) * 2654435761 >> 7) % (SYMBOLS - 27)
        self.symbol[0xD800:0xE000] = SYMBOLS - 1  # halves of characters beyond the plane: see symbols_of

    def symbols_of(self, text: str) -> np.ndarray:
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
        s = self.symbol[units]
        if (pair := (units >= 0xD800) & (units < 0xE000)).any():  # only real letters of the other planes count
            far = [ch.isalpha() for ch in text if ord(ch) > 0xFFFF or 0xD800 <= ord(ch) < 0xE000]
            width = [2 if ord(ch) > 0xFFFF else 1 for ch in text if ord(ch) > 0xFFFF or 0xD800 <= ord(ch) < 0xE000]
            s = s.copy()
            s[pair] = np.where(np.repeat(far, width), SYMBOLS - 1, BORDER)
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != BORDER) | (s[:-1] != BORDER)
        return s[keep]

    def vectors_of(self, codes: np.ndarray) -> np.ndarray:
        rows = self.row[codes]
        if (rows < 0).any():
            if self.n + len(codes) > KNOWN:  # start anew: what is kept has a bound
                self.row.fill(-1)
                self.n, rows = 0, self.row[codes]
            new = codes[rows < 0]
            a, b, c = new // (SYMBOLS * SYMBOLS), new // SYMBOLS % SYMBOLS, new % SYMBOLS
            made = self.rotated[1][a] * self.rotated[0][b] * self.letters[c]
            while self.n + len(new) > len(self.known):
                self.known = np.concatenate([self.known, np.empty_like(self.known)])
            self.known[self.n : self.n + len(new)] = made
            self.row[new] = np.arange(self.n, self.n + len(new), dtype=np.int32)
            self.n += len(new)
            rows = self.row[codes]
        return self.known[rows]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each as often as it occurs."""
        v = np.zeros(self.letters.shape[1], dtype=np.float32)
        for lo in range(0, len(codes), 2048):
            v += counts[lo : lo + 2048].astype(np.float32) @ self.vectors_of(codes[lo : lo + 2048]).astype(np.float32)
        return v

    def encode(self, text: str | None) -> np.ndarray | None:
        """The document's vector at length 1, or None without letters."""
        found = self.sized(text)
        return found and found[0]

    def sized(self, text: str | None) -> tuple[np.ndarray | None, int] | None:
        """encode's vector and the power of two of the trigrams it rests on, repeated ones counting less."""
        if not text:
            return None
        s = self.symbols_of(text)
        if not (s != BORDER).any():
            return None
        s = np.concatenate([[BORDER], s, [BORDER]]).astype(np.int64)
        code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        codes, counts = np.unique(code, return_counts=True)
        v = self.bundle(codes, counts)
        norm = float(np.linalg.norm(v))
        size = min(int(math.log2(counts.sum() ** 2 / (counts.astype(float) ** 2).sum())), SIZES - 1)
        return v / norm if norm else None, size


_ENCODERS: dict[int, Encoder] = {}
keeps("language_id", _ENCODERS.clear)


def encoder(dim: int) -> Encoder:
    """One encoder a process: Python workers serve many tasks."""
    begins("language_id")
    if dim not in _ENCODERS:
        _ENCODERS[dim] = Encoder(dim)
    return _ENCODERS[dim]


def _chosen(labelled: DataFrame, per_language: int) -> DataFrame:
    """text, lang of the documents to learn from: those of each language with the smallest hash.

    Only hashes under a bound that about 1.5 * per_language documents of a language stay under are ranked, so the
    ranking of a language does not grow with the input.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53)))
    counts = rows.groupBy(F.col("lang").alias("__of")).agg(F.count("*").alias("__n"))
    # one row per language, as the prototypes that the driver holds: else the rows would meet their counts by language
    low = rows.join(F.broadcast(counts), F.col("lang") == F.col("__of")).filter(F.col("__part") * F.col("__n") < 1.5 * per_language + 100)
    w = Window.partitionBy("lang").orderBy("__part", "doc_id")
    ids = (
        low.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= per_language)
        .select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))
        .distinct()
    )
    chosen = labelled.select("doc_id", "text", "lang").join(
        F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("lang") == F.col("__lang"))
    )
    return chosen.select("text", "lang")


def _sums(chosen: DataFrame, dim: int) -> dict[str, np.ndarray]:
    """The sum of the documents' vectors by language."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sums = encoder(dim), {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                if (v := e.encode(text.as_py())) is not None:
                    key = lang.as_py()
                    sums[key] = sums[key] + v if key in sums else v.astype(np.float64)
        for lang, v in sums.items():
            # fixed point: sums do not depend on the order of the partitions
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.rint(v * 2**20).astype(np.int64))],
                names=["lang", "at", "value"],
            )

    sums = chosen.mapInArrow(bundle, "lang string, at int, value long")
    rows = sums.groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()  # languages x dim rows
    protos: dict[str, np.ndarray] = {}
    for r in rows:
        protos.setdefault(r["lang"], np.zeros(dim))[r["at"]] = r["value"] / 2**20
    return protos


def _unit(sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(sums.items())}


def learn_prototypes(labelled: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes of length 1 by language from doc_id, text, lang; rows with a null in text or lang are no examples."""
    return _unit(_sums(_chosen(labelled, per_language), dim))


def learn_levels(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Prototypes as of learn_prototypes, and by language the least cosine of a document of each size.

    A document meets its language's prototype without its own share in it. Cosines grow with size, so a size with too
    few documents takes the level of the next smaller one, or half that of the next larger one if that is more;
    documents too short to tell from noise have low levels, and so have languages with few documents.
    """
    chosen = _chosen(labelled, per_language)
    sums = _sums(chosen, DIM)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(DIM)
        for b in batches:
            rows = []
            for text, key in zip(b.column(0), b.column(1)):
                lang = key.as_py()
                v, size = e.sized(text.as_py()) or (None, 0)
                if v is not None:
                    rest = sums[lang] - v
                    norm = float(np.linalg.norm(rest))
                    if norm > 1e-3:  # else it is the language's only document
                        rows.append((lang, size, math.floor(float(rest @ v) / norm * STEPS)))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["lang", "size", "step"])

    counts = chosen.mapInArrow(measure, "lang string, size int, step int").groupBy("lang", "size", "step").agg(F.count("*").alias("n"))
    seen: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in counts.collect():  # languages x sizes x steps rows at most
        seen.setdefault((r["lang"], r["size"]), []).append((r["step"], r["n"]))
    levels = {}
    for lang in sums:
        own, level = {}, np.full(SIZES, REJECT_BELOW)
        for size in range(SIZES):
            steps = sorted(seen.get((lang, size), []))
            if (total := sum(n for _, n in steps)) >= EVIDENCE:
                below = np.cumsum([n for _, n in steps])
                own[size] = max(REJECT_BELOW, SLACK * steps[int((below > QUANTILE * total).argmax())][0] / STEPS)
            level[size] = own.get(size, level[max(size - 1, 0)])
        for size in reversed(range(SIZES - 1)):
            if size not in own:
                level[size] = max(level[size], level[size + 1] / 2)
        levels[lang] = level
    return _unit(sums), levels


def predict_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """doc_id, lang_pred, score (best cosine, at least 0), margin (to the next best); one narrow pass."""
    langs = list(prototypes)
    matrix = np.array([prototypes[k] for k in langs], dtype=np.float32).reshape(len(langs), dim)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(dim)
        for b in batches:
            preds, scores, margins = [], [], []
            for text in b.column(1):
                v = e.encode(text.as_py()) if langs else None
                if v is None:
                    preds.append(UND), scores.append(0.0), margins.append(0.0)
                    continue
                cos = matrix @ v
                best = int(np.argmax(cos))
                rest = np.partition(cos, -2)[-2] if len(langs) > 1 else 0.0
                preds.append(langs[best])
                scores.append(float(min(1.0, max(0.0, cos[best]))))
                margins.append(float(cos[best] - rest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                names=["doc_id", "lang_pred", "score", "margin"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, margin double")


def keep_known_languages(
    docs: DataFrame, prototypes: dict[str, np.ndarray], least: float = REJECT_BELOW, levels: dict[str, np.ndarray] | None = None
) -> DataFrame:
    """The rows of docs that have letters and resemble a learned language, with all their columns, in one narrow pass
    that sends nothing but texts to Python.

    A document resembles a language from that language's level for its size on, or from `least` on without levels.
    Documents with letters stay if nothing could be learned.
    """
    langs = list(prototypes)
    matrix = np.array([prototypes[k] for k in langs], dtype=np.float32).reshape(len(langs), DIM)
    level = np.array([np.full(SIZES, least) if levels is None else levels[k] for k in langs]).reshape(len(langs), SIZES)

    @F.arrow_udf("boolean")
    def known(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(DIM)
        for texts in parts:
            mask = []
            for text in texts:
                v, size = e.sized(text.as_py()) or (None, 0)
                mask.append(v is not None and (not langs or bool((matrix @ v >= level[:, size]).any())))
            yield pa.array(mask, pa.bool_())

    return docs.filter(known("text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn_prototypes(docs.filter(~is_held_out("doc_id")))
    out = predict_languages(docs, prototypes)
    return out.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin")
