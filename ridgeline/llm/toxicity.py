"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding maps every character to one byte: case, homoglyphs of other scripts, full-width forms and digits or signs
used as letters become the letter they stand for; what is no letter becomes a blank. Digits are letters only inside
a word that has a real letter, so numbers stay numbers.

The lexicon holds word beginnings and whole words with weights. It is learned from labelled documents: an entry is
taken when its documents differ between the classes beyond chance (a G test) and its weight is the log ratio of its
rates per word. One automaton finds lexicon entries and exception phrases; a find inside an exception phrase does
not count, and each word counts once, with its longest entry. A logistic model over the weight sum, the
sum normalised by length and the length turns this into a score.

Learning reads at most `examples` labelled documents, those with the smallest hash of doc_id; scoring covers all
rows in one narrow pass.

Defined results: null and empty texts score like a text without finds; without examples of both classes the lexicon
is SEED and the model DEFAULT_MODEL; of several labels of a document the largest counts; repeated rows give repeated
rows; only doc_id and text are read for scoring; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import is_held_out, table

EXAMPLES = 9000
THRESHOLD = 0.3
#: Letters that other scripts' characters imitate, and digits and signs in the place of letters.
HOMOGLYPHS = dict(zip("аеорсухкмтвнісјԁɡɩӏαοευικνρτхѕһԛԝ", "aeopcyxkmtbnicjdgilaoeuiknptxshqw"))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases whose lexicon words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "taking out the trash", "clown fish", "class clown", "not an idiot", "not stupid", "sore loser")
SEED = {w: 4.0 for w in ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")}
PREFIXES = range(3, 11)
LEAST_G, LEAST_DOCS = 18.0, 4
NAMES = ("sum", "per_root", "per_word", "log_words", "bias")
DEFAULT_MODEL = {"sum": 0.3, "per_root": 0.5, "per_word": 2.0, "log_words": 0.0, "bias": -3.0}
_LETTER, _LEET, _BLANK = 0, 1, 2


def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    to = np.full(65536, 32, dtype=np.uint8)
    kind = np.full(65536, _BLANK, dtype=np.uint8)
    for c in range(65536):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        n = unicodedata.normalize("NFKC", ch).lower()
        n = HOMOGLYPHS.get(ch.lower(), n[:1])
        if n in LEET:
            to[c], kind[c] = ord(LEET[n]), _LEET
        elif n and n.isalpha():
            # letters beyond Latin-1 share the bytes that Latin-1 has no letters for
            to[c], kind[c] = ord(n) if ord(n) < 256 else 128 + ord(n) % 32, _LETTER
        elif n.isdigit():
            to[c], kind[c] = ord("o"), _LEET
    return to, kind


_TABLES: list = []


def fold(text: str | None) -> str:
    """Words of one byte a letter, a blank between two words and at both ends."""
    if not _TABLES:
        _TABLES.extend(_fold_tables())
    to, kind = _TABLES
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), dtype="<u2")
    out, k = to[units], kind[units]
    if (k == _LEET).any():
        # runs of letters and stand-ins; those without a real letter are numbers or signs
        solid = k != _BLANK
        run = np.cumsum(~solid)
        real = np.zeros(run[-1] + 1, dtype=bool)
        real[run[k == _LETTER]] = True
        out = np.where((k == _LEET) & ~real[run], np.uint8(32), out)
        edge = (k == _LEET) & (units < 128) & np.isin(units, np.frombuffer("!$@".encode("utf-16-le"), dtype="<u2"))
        nxt = np.append(k[1:], _BLANK)  # a sign that ends a word is punctuation
        out = np.where(edge & (nxt != _LETTER), np.uint8(32), out)
    return " " + " ".join(out.tobytes().decode("latin-1").split()) + " "


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=lambda: dict(SEED))
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_MODEL))
    exceptions: tuple = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for entry, w in self.lexicon.items():
            a.add_word(f" {entry}", (len(entry) + 1, w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        a.make_automaton()
        return a


def without_covered(best: dict[int, tuple[int, float]], free: list[tuple[int, int]]) -> dict[int, tuple[int, float]]:
    """best without the starts inside one of the spans free: both in order, each looked at once."""
    spans = sorted(free)
    at = reach = 0
    gone = set()
    for s in sorted(best):
        while at < len(spans) and spans[at][0] <= s:
            reach = max(reach, spans[at][1])
            at += 1
        if s < reach:
            gone.add(s)
    return {s: x for s, x in best.items() if s not in gone}


def features(folded: str, a: ahocorasick.Automaton) -> tuple[tuple, list[tuple[int, int, float]]]:
    """The model's inputs, and the finds (start, end, weight) that count."""
    best: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (size, w) in a.iter(folded):
        start = end - size + 1
        if w is None:
            free.append((start, end))
        elif start not in best or size > best[start][0]:
            best[start] = (size, w)
    if free:
        best = without_covered(best, free)
    n = max(folded.count(" ") - 1, 1)
    total = sum(w for _, w in best.values())
    return (total, total / math.sqrt(n), total / n, math.log(n), 1.0), [(s, s + k, w) for s, (k, w) in best.items()]


def score_of(x: tuple, weights: dict[str, float]) -> float:
    z = sum(weights[k] * v for k, v in zip(NAMES, x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(folded: list[str], toxic: np.ndarray) -> dict[str, float]:
    docs = [Counter(), Counter()]
    tokens = [Counter(), Counter()]
    total = [0, 0]
    allowed = None
    for y in (1, 0):  # toxic first: only what they have often enough is counted in the others
        for text, label in zip(folded, toxic):
            if label != y:
                continue
            counts: dict[str, int] = {}
            for word, k in Counter(text.split()).items():
                total[y] += k
                for e in (word + " ", *(word[:p] for p in PREFIXES if p <= len(word))):
                    if allowed is None or e in allowed:
                        counts[e] = counts.get(e, 0) + k
            docs[y].update(counts.keys())
            tokens[y].update(counts)
        if y:
            allowed = {e for e, t in docs[1].items() if t >= LEAST_DOCS}
    n = [int((toxic == 0).sum()), int((toxic == 1).sum())]
    out = {}
    for entry, t in docs[1].items():
        c = docs[0].get(entry, 0)
        if t < LEAST_DOCS or t / n[1] < 2 * (c + 0.5) / n[0]:
            continue
        cells = ((t, n[1]), (c, n[0]))
        rate = (t + c) / (n[0] + n[1])
        g = 2 * sum(o * math.log(o / e) for k, m in cells for o, e in ((k, m * rate), (m - k, m * (1 - rate))) if o and e)
        w = math.log((tokens[1][entry] + 0.5) / total[1]) - math.log((tokens[0].get(entry, 0) + 0.5) / total[0])
        if g >= LEAST_G and w > 0.7:
            out[entry] = round(w, 6)

    # of beginnings that occur in the same places, the most specific stays
    def same(a: str, b: str) -> bool:
        return all(tokens[y].get(a, 0) == tokens[y].get(b, 0) for y in (0, 1))

    longer: dict[str, list[str]] = {}
    for entry in out:
        for p in PREFIXES:
            if p < len(entry):
                longer.setdefault(entry[:p], []).append(entry)
    return {e: w for e, w in out.items() if not any(same(e, x) for x in longer.get(e, ()))}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton's method; the columns are scaled, the last is the bias."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def learn(rows: list[tuple[str | None, int]]) -> Model:
    """From (text, label): the lexicon from two thirds of the rows, the model from the rest."""
    y = np.array([t for _, t in rows], dtype=int)
    folded = [fold(t) for t, _ in rows]
    part = np.arange(len(rows)) % 3 != 0
    if min((y[part] == 1).sum(), (y[part] == 0).sum(), (y[~part] == 1).sum(), (y[~part] == 0).sum(), 10**9) < 5:
        return Model()
    lexicon = learn_lexicon([f for f, p in zip(folded, part) if p], y[part])
    m = Model(lexicon=lexicon)
    a = m.automaton()
    x = np.array([features(f, a)[0] for f, p in zip(folded, part) if not p])
    m.weights = dict(zip(NAMES, map(float, fit_logistic(x, y[~part]))))
    return m


def learn_from(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """labels: doc_id and toxic; rows that may not be learned from must not be in it."""
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(examples)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__toxic")
    got = rows.toArrow().to_pylist()  # at most `examples` documents
    got.sort(key=lambda r: (hash((r["doc_id"], 17)), r["text"] or ""))
    return learn([(r["text"], int(r["__toxic"] > 0)) for r in got])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_finds and finds (places in the folded text, with weights)."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            out = []
            for d, t in zip(b.column(0), b.column(1)):
                x, finds = features(fold(t.as_py()), a)
                out.append({
                    "doc_id": d.as_py(), "score": score_of(x, model.weights), "n_finds": len(finds),
                    "finds": [{"start": s, "stop": e, "weight": w} for s, e, w in sorted(finds)],
                })
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    fields = pa.schema([
        ("doc_id", pa.int64()), ("score", pa.float64()), ("n_finds", pa.int64()),
        ("finds", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("weight", pa.float64())]))),
    ])
    return docs.select("doc_id", "text").mapInArrow(
        scores, "doc_id long, score double, n_finds long, finds array<struct<start:long,stop:long,weight:double>>"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_from(docs, table(spark, sf_dir, "labels").filter(~is_held_out("doc_id")))
    return score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "n_finds",
    )
