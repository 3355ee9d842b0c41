"""Licence scan: Aho-Corasick finds tags and notices, a shunting-yard parser evaluates licence expressions.

A text is read as words (A-Z lower-cased, everything ASCII that is no letter or digit separates). One automaton
holds the notice phrases and the tag that opens a licence expression; both are matched on word borders. The
expression after a tag is parsed by precedence (``with`` over ``and`` over ``or``) and its licences become labels.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows give repeated rows; other
columns of the input are not read and do not reach the output; a malformed expression gives the labels of its
well-formed longest prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.common import table, words_of

#: Phrases and labels that the contract of the query fixes.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases and labels of this method.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: What a find of each kind adds to the score: 1 - product of (1 - weight).
WEIGHTS = {"tag": 0.9, "base": 0.7, "more": 0.5}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_TAG_RAW = re.compile(r"(?<![a-z0-9\u0080-\U0010ffff])spdx[^a-z0-9]+license[^a-z0-9]+identifier[ \t]*:[ \t]*", re.I | re.A)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,kind:string,word:long>>, expressions array<string>, permissive boolean"
)
COPYLEFT = ("gpl", "lgpl", "agpl", "cc-by-sa", "cc-by-nc", "cc-by-nd", "all-rights-reserved", "mpl", "epl")


def expression_at(text: str, at: int = 0) -> tuple[list[tuple], int]:
    """Shunting-yard: the postfix form of the longest well-formed prefix of the licence expression at a place, and its end.

    Items are ("id", name) and ("op", name). Line ends, comment ends and the next tag close the expression.
    """
    out: list[tuple] = []
    stack: list[str] = []
    size, rest, end = 0, [], at  # the best prefix: so many items, then the operators that waited
    want, opened, pos = True, 0, at
    while m := _TOKEN.match(text, pos):
        tok, pos = m[1], m.end()
        low = tok.lower()
        if low.startswith("spdx") and _TAG_RAW.match(text, m.start(1)):
            break
        if want:
            if tok == "(":
                stack.append(tok)
                opened += 1
            elif tok == ")" or low in PRECEDENCE:
                break
            else:
                out.append(("id", low))
                want = False
        elif low in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(("op", stack.pop()))
            stack.append(low)
            want = True
        elif tok == ")" and opened:
            while stack[-1] != "(":
                out.append(("op", stack.pop()))
            stack.pop()
            opened -= 1
        else:
            break
        if not want and not opened:  # outside brackets at most one operator of each kind waits
            size, rest, end = len(out), stack[::-1], pos
    return out[:size] + [("op", x) for x in rest], end


def parse_expression(text: str) -> list[tuple]:
    return expression_at(text)[0]


def evaluate(postfix: list[tuple]) -> tuple[list[str], bool]:
    """Labels of all licences of an expression, and whether one allowed choice has no copyleft or restricted licence.

    ``or`` offers a choice, ``and`` binds both sides, ``with`` adds an exception to its left side.
    """
    stack: list[tuple[set, bool]] = []
    for kind, x in postfix:
        if kind == "id":
            label = label_of(x)
            stack.append(({label}, label not in COPYLEFT))
            continue
        (b, pb), (a, pa_) = stack.pop(), stack.pop()
        if x == "with":
            stack.append((a, pa_))
            continue
        small, large = sorted((a, b), key=len)
        large |= small  # no other item holds it
        stack.append((large, pa_ or pb if x == "or" else pa_ and pb))
    return (sorted(stack[0][0]), stack[0][1]) if stack else ([], True)


def label_of(name: str) -> str:
    """The family of an identifier: its version and suffixes go."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    return re.sub(r"-v?\d[\d.]*(-clause)?$", "", name) or name


def automaton(base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for kind, phrases in (("base", base), ("more", more), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            entries.setdefault(f" {phrase} ", []).append((kind, label))
    for key, what in entries.items():
        a.add_word(key, (len(key), what))
    a.make_automaton()
    return a


def scan_text(text: str | None, a: ahocorasick.Automaton) -> dict:
    words = words_of(text)
    joined = " " + b" ".join(words).decode("latin-1") + " "
    spans, weights, permissive, expressions, labels, base = [], [], [], [], set(), set()
    at = count = 0  # words that start before `at`
    tags = 0
    for end, (size, what) in a.iter(joined):
        start = end - size + 1
        count += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
        at = start
        for kind, label in what:
            if kind == "tag":
                tags += 1
                continue
            spans.append((label, kind, count))
            weights.append(WEIGHTS[kind])
            labels.add(label)
            permissive.append(label not in COPYLEFT)
            if kind == "base":
                base.add(label)
    if tags:
        upto = passed = 0  # words before the place that was counted last: a tag stands at a word's start
        end = 0
        while m := _TAG_RAW.search(text, end):
            postfix, end = expression_at(text, m.end())
            if not postfix:
                continue
            found, free = evaluate(postfix)
            labels.update(found)
            permissive.append(free)
            weights.append(WEIGHTS["tag"])
            expressions.append(" ".join(x for _, x in postfix))
            passed += len(words_of(text[upto : m.start()]))
            upto = m.start()
            spans += [(x, "tag", passed) for x in found]
    starts = [w for _, kind, w in spans if kind == "base"]
    miss = 1.0
    for w in weights:
        miss *= 1 - w
    spans.sort(key=lambda x: (x[2], x[1], x[0]))
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": round(1 - miss, 12),
        "spans": [{"label": x, "kind": k, "word": w} for x, k, w in spans],
        "expressions": expressions,
        "permissive": all(permissive) if permissive else None,
    }


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES) -> DataFrame:
    """One row per document with the licences that its text names; see the module for its cases. One narrow pass."""
    fields = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64())]))),
        ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(base, more)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = [scan_text(t.as_py(), a) for t in part.column(1)]
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": d.as_py(), **r} for d, r in zip(part.column(0), rows)], schema=fields
                )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
