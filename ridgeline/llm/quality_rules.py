"""Quality rules: a decision list learned from labelled statistics, emitted as ordered conditional expressions.

1. One pass over the texts gives every document its statistics; texts go no further.
2. Features are whole-numbered ratios of statistics, thresholds are fixed round numbers, so that a rule reads like
   "symbol_pct > 3 and mean_word <= 12" and does not depend on partitions.
3. Sequential covering. Labelled rows that the base rules leave are split by a hash of their doc_id: two thirds grow rules, one third prunes them.
   Growing adds the condition with the largest information gain on bad documents until no good one is covered; one
   aggregation by feature, bin and label tells the counts of every possible condition, so a step costs one small
   shuffle however many rows are labelled. Pruning cuts the rule back to the length that serves best on rows it
   did not see. A rule that is not precise there ends the list; else the rows it covers are left out and the next grows.
4. The list becomes one chain of when(...).when(...).otherwise(true) over the statistics.

Defined results: a null text has no words; documents without a label, and labels that are null, teach nothing; of several
labels of one doc_id the largest counts; a null doc_id has no label; without bad examples the list is empty and keeps
everything; very long texts take time and memory in proportion; repeated rows are repeated; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import dropped, is_held_out, table, written

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in windows that repeat
WINDOW = 3
#: A rule must be right on so many percent of the rows it covers in the part that prunes, and cover so many of them.
LEAST_PRECISION, LEAST_COVERED = 97, 5
MOST_CONDITIONS, MOST_RULES = 4, 12

STATISTICS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_bare",
]

_BYTE = np.arange(256)
_KIND = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "blank": ((_BYTE >= 9) & (_BYTE <= 13)) | (_BYTE == 32),
    "symbols": np.isin(_BYTE, list(SYMBOLS)),
    "tails": (_BYTE >= 128) & (_BYTE < 192),  # bytes that begin no code point
    "letters": ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128) | (_BYTE >= 192),
}
#: ASCII bytes that are no letter or digit.
_SIGNS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= (b | 32) <= 122))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) < WINDOW:
        return 0
    code = ids[: len(ids) - WINDOW + 1]
    for k in range(1, WINDOW):
        # numbered anew at each step, so that codes never outgrow 64 bits
        code = np.unique(code, return_inverse=True)[1] * np.int64(len(number)) + ids[k : len(ids) - WINDOW + 1 + k]
    _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    hit = np.zeros(len(ids), dtype=bool)
    for k in range(WINDOW):
        hit[k : len(ids) - WINDOW + 1 + k] |= again
    return int(hit.sum())


def text_statistics(text: str | None) -> list[int]:
    """STATISTICS of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    of = np.zeros(256, np.int64)
    for lo in range(0, len(raw), 1 << 16):
        of += np.bincount(np.frombuffer(raw[lo : lo + (1 << 16)], np.uint8), minlength=256)
    n = {k: int(of[mask].sum()) for k, mask in _KIND.items()}
    words = raw.split()  # bytes.split() splits at [\x20\x09-\x0D]
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dups += line in seen
            seen.add(line)
    bare = sum(1 for w in words if not w.strip(_SIGNS))
    return [len(words), len(raw) - n["tails"] - n["blank"], n["symbols"], dups, repeated_words(words), lines, n["upper"], n["digits"], n["letters"], bare]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of each row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_statistics(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows)) or [()] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS))


_PERCENT = [0, 1, 2, 3, 5, 7, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90, 95]
#: Name, expression over the statistics, thresholds in rising order. Every feature is 0 where its divisor is. None is
#: a length or falls with it, as the share of distinct words does: length is judged by the base, and long texts are no worse.
FEATURES: list[tuple[str, str, list[int]]] = [
    ("mean_word_tenths", "10 * word_chars div n_words", [20, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 90, 100, 120, 150, 200]),
    ("symbol_pct", "100 * n_symbols div word_chars", _PERCENT),
    ("symbols_per_1000_words", "1000 * n_symbols div n_words", [0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000]),
    ("dup_line_pct", "100 * n_dup_lines div n_lines", _PERCENT),
    ("repeat_pct", "100 * n_repeat_words div n_words", _PERCENT),
    ("upper_pct", "100 * n_upper div word_chars", _PERCENT),
    ("digit_pct", "100 * n_digits div word_chars", _PERCENT),
    ("letter_pct", "100 * n_letters div word_chars", _PERCENT),
    ("bare_pct", "100 * n_bare div n_words", _PERCENT),
    ("words_per_line", "n_words div n_lines", [1, 2, 3, 5, 8, 12, 20, 50, 100, 200, 500, 1000]),
]


def feature(name: str) -> Column:
    expression = next(e for n, e, _ in FEATURES if n == name)
    return F.coalesce(F.expr(expression.replace("div n_", "div nullif(n_").replace("div word_chars", "div nullif(word_chars") + (", 0)" if " div " in expression else "")), F.lit(0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def column(self) -> Column:
        f = feature(self.feature)
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are bad; bad and good: those covered in the part that pruned."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def rule_number(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that a document meets, null if it meets none."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.column(), F.lit(k)).otherwise(out)
    return out


def verdict(rules: list[Rule]) -> Column:
    """True for documents that no rule of the list covers."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def _bins(name: str, thresholds: list[int]) -> Column:
    """How many thresholds lie below the feature."""
    f, out = feature(name), F.lit(0)
    for t in thresholds:
        out = out + (f > t).cast("int")
    return out


def _inside(conditions: list[Condition]) -> Column:
    """The conditions over stored bins."""
    out = F.lit(True)
    for c in conditions:
        k, (_, _, thresholds) = next((k, x) for k, x in enumerate(FEATURES) if x[0] == c.feature)
        at = F.col("bins")[k]
        out = out & (at > thresholds.index(c.threshold) if c.above else at <= thresholds.index(c.threshold))
    return out


def _best_condition(rows: DataFrame) -> tuple[Condition | None, int, int, int]:
    """The condition of the largest gain on rows, its bad and good rows, and the good ones before."""
    each = rows.select("bad", F.posexplode("bins").alias("f", "bin"))
    counts = each.groupBy("f", "bin").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n")).collect()  # features x bins rows at most
    table_: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        table_.setdefault(r["f"], {})[r["bin"]] = (r["bad"], r["n"] - r["bad"])
    best, gain, found = None, 0.0, (0, 0, 0)
    for k, (name, _, thresholds) in enumerate(FEATURES):
        bins = table_.get(k, {})
        bad, good = (sum(v[j] for v in bins.values()) for j in (0, 1))
        if not bad or not good:
            return None, bad, good, good
        before, low_bad, low_good = log2(bad / (bad + good)), 0, 0
        for i, t in enumerate(thresholds):
            low_bad, low_good = low_bad + bins.get(i, (0, 0))[0], low_good + bins.get(i, (0, 0))[1]
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if p and (g := p * (log2(p / (p + n)) - before)) > gain + 1e-9:
                    best, gain, found = Condition(name, above, t), g, (p, n, good)
    return best, *found


def _grown(rows: DataFrame) -> list[Condition]:
    conditions: list[Condition] = []
    while len(conditions) < MOST_CONDITIONS:
        condition, _, good, _ = _best_condition(rows.filter(_inside(conditions)))
        if condition is None:
            break
        conditions.append(condition)
        if not good:
            break
    return conditions


def _pruned(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """The beginning of the rule that serves best on rows, the shorter one of equals."""
    prefixes = [_inside(conditions[:k]) for k in range(1, len(conditions) + 1)]
    sums = [c for k, p in enumerate(prefixes) for c in (F.count_if(p & F.col("bad")).alias(f"p{k}"), F.count_if(p & ~F.col("bad")).alias(f"n{k}"))]
    r = rows.agg(*sums).first()
    worth = [((r[f"p{k}"] - r[f"n{k}"]) / max(r[f"p{k}"] + r[f"n{k}"], 1), -k) for k in range(len(prefixes))]
    k = -max(worth)[1]
    last = {(c.feature, c.above): c for c in conditions[: k + 1]}  # a later condition on one side of a feature is the tighter one
    return Rule(tuple(last.values()), r[f"p{k}"], r[f"n{k}"])


def learn_rules(stats: DataFrame, labels: DataFrame, precision: int = LEAST_PRECISION, covered: int = LEAST_COVERED) -> list[Rule]:
    """The list learned from stats (doc_id, STATISTICS) and labels (doc_id, quality; 0 is bad), over all labelled rows."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    bins = F.array(*[_bins(name, thresholds).cast("byte") for name, _, thresholds in FEATURES])
    rows = stats.filter(~base_failed()).join(one, "doc_id").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grows"), bins.alias("bins"))
    rows = written(rows, "labelled")
    rules: list[Rule] = []
    left = rows
    while len(rules) < MOST_RULES:
        conditions = _grown(left.filter("grows"))
        if not conditions:
            break
        rule = _pruned(left.filter("NOT grows"), conditions)
        if rule.bad < covered or 100 * rule.bad < precision * (rule.bad + rule.good):
            break
        rules.append(rule)
        left = left.filter(~_inside(list(rule.conditions)))
    dropped(rows)
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, STATISTICS, base_failed, rule, kept for each row; the rules)."""
    stats = written(statistics(docs), "statistics")
    rules = learn_rules(stats.filter(~F.coalesce(is_held_out("doc_id"), F.lit(False))), labels)
    out = stats.select("*", base_failed().alias("base_failed"), rule_number(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
