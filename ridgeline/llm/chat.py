"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text. Turns are marked by control strings; inside texts every control string gets
one more backslash after its first character, whatever number it has, so unescaping is exact and a raw control
string occurs in the rendering only where the template put it. The rendering is encoded once, with offsets; the
spans of the assistant's texts are sorted, and two binary searches over the token offsets give each span's tokens.
The mask is over tokens; a token that also covers characters beyond a span is cut at the span's border, so the text
under the mask is the assistant's text, each character once.

Conversations are dealt by id and sorted by turn in the exchange, and pass through a task one at a time.

Defined results: a null text is empty; a null role is the empty role; turns are ordered by (turn, role, text), nulls
first, so repeated turns stay repeated; rows with a null conv_id are one conversation; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import partitions, table, written
from ridgeline.llm.packing import tokenizer_path, tokens

#: Opening and closing strings of a turn by role; other roles are named in their opening.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("", "</s>")}
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "<|role:", "|>", "<|end|>"
_TAIL = r"(?:/?s>|</?SYS>>|\|role:|\|end\|>|/?INST\])"
_ONE_MORE = re.compile(rf"([<\[])(\\*)({_TAIL})")
_ONE_LESS = re.compile(rf"([<\[])(\\*)\\({_TAIL})")


def escape(text: str) -> str:
    return _ONE_MORE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ONE_LESS.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (role, text) turns, and the sorted spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        if role in TEMPLATE:
            head, tail = TEMPLATE[role]
        else:
            head, tail = OTHER_OPEN + quote(role, safe="", errors="surrogatepass") + OTHER_NAMED, OTHER_CLOSE
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    turns, at = [], 0
    while at < len(formatted):
        role = "assistant"
        for name, (head, _) in TEMPLATE.items():
            if head and formatted.startswith(head, at):
                role, at = name, at + len(head)
        if role == "assistant" and formatted.startswith(OTHER_OPEN, at):
            end = formatted.index(OTHER_NAMED, at)
            role = unquote(formatted[at + len(OTHER_OPEN) : end], errors="surrogatepass")
            at, tail = end + len(OTHER_NAMED), OTHER_CLOSE
        else:
            tail = TEMPLATE[role][1]
        end = formatted.index(tail, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(tail)
    return turns


_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer with untrimmed offsets: without its post-processor, a blank before a word counts as covered."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        spec["post_processor"] = None
        _ENCODERS[path] = Tokenizer.from_str(json.dumps(spec))
    return _ENCODERS[path]


def encode(path: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends of a text's tokens in characters.

    Tokens of a byte-level vocabulary follow each other without a gap, so their places are the running sum of their
    bytes; a token that begins or ends inside a character covers all of it. Other texts take the tokenizer's offsets.
    """
    t = tokens(path)
    raw = t.encode_plain(text)
    if raw is None:
        e = encoder(path).encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
        return np.array(e.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1]
    ids = np.frombuffer(raw, dtype="<u4").astype(np.int32)
    stops = np.cumsum(t.sizes[ids], dtype=np.int64)
    if text.isascii():
        ends = stops.astype(np.int32)
        return ids, np.concatenate([np.zeros(1, np.int32), ends])[: len(ids)], ends
    leads = (np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80
    character = np.cumsum(leads, dtype=np.int32) - 1
    return ids, character[np.concatenate([[0], stops[:-1]])], character[stops - 1] + 1


def token_ranges(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span the range of tokens that share a character with it; empty spans have none."""
    out = []
    for lo, hi in spans:
        first = int(np.searchsorted(ends, lo, side="right"))
        last = int(np.searchsorted(starts, hi, side="left"))
        out.append((first, max(first, last) if hi > lo else first))
    return out


def text_under_mask(formatted: str, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]], ranges: list[tuple[int, int]]) -> list[str]:
    """Per span what its tokens cover inside it, every character once."""
    out = []
    for (lo, hi), (first, last) in zip(spans, ranges):
        if first >= last:
            out.append("")
            continue
        upto = np.maximum(lo, np.minimum(ends[first:last], hi))
        since = np.maximum(starts[first:last], np.concatenate([[lo], np.maximum.accumulate(upto)[:-1]]))
        new = upto > since
        since, upto = since[new], upto[new]
        gaps = np.flatnonzero(since[1:] != upto[:-1]) + 1
        at = [0, *gaps.tolist(), len(since)]
        out.append("".join(formatted[int(since[i]) : int(upto[j - 1])] for i, j in zip(at, at[1:]) if i < j))
    return out


FORMATTED = (
    "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>, "
    "spans array<struct<lo:int,hi:int,first:int,last:int>>"
)


def format_conversations(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, formatted, ids, starts and ends (offsets), mask (over tokens), spans (characters and tokens)."""
    path = path or tokenizer_path()
    spark = conversations.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    dealt = conversations.select(*order).repartition(partitions(spark), "conv_id").sortWithinPartitions(*order)
    span = pa.struct([(k, pa.int32()) for k in ("lo", "hi", "first", "last")])
    fields = pa.schema([
        ("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())), ("spans", pa.list_(span)),
    ])

    def one(conv_id: int | None, turns: list[tuple[str, str]]) -> tuple:
        formatted, spans = render(turns)
        ids, starts, ends = encode(path, formatted)
        ranges = token_ranges(starts, ends, spans)
        mask = np.zeros(len(starts), dtype=bool)
        for first, last in ranges:
            mask[first:last] = True
        return conv_id, formatted, ids, starts, ends, mask, [{"lo": a, "hi": b, "first": c, "last": d} for (a, b), (c, d) in zip(spans, ranges)]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)] or [[] for _ in fields]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in columns[2]], dtype=np.int64)]).astype(np.int32)
        for i in range(2, 6):
            values = np.concatenate(columns[i]) if out else np.empty(0)
            columns[i] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, fields.field(i).type.value_type))
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, turns, began, out = None, [], False, []
        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if began and c != open_id:
                    out.append(one(open_id, turns))
                    turns = []
                    if len(out) >= 64:
                        yield batch(out)
                        out = []
                open_id, began = c, True
                turns.append((role or "", text or ""))
        if began:
            out.append(one(open_id, turns))
        yield batch(out)

    return dealt.mapInArrow(run, FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: from the rendering, offsets and mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some rows at a time: tokens as Python objects take far more room than in the batch
        for b in (whole.slice(lo, 64) for whole in batches for lo in range(0, whole.num_rows, 64)):
            out = []
            small = [b.column(n).to_pylist() for n in ("conv_id", "formatted", "spans")]
            for conv_id, formatted, places, starts, ends, mask in zip(*small, *(b.column(n) for n in ("starts", "ends", "mask"))):
                starts, ends = starts.values.to_numpy(), ends.values.to_numpy()
                mask = mask.values.to_numpy(zero_copy_only=False)
                spans = [(s["lo"], s["hi"]) for s in places]
                ranges = [(s["first"], s["last"]) for s in places]
                assert all(mask[a:z].all() for a, z in ranges)
                loss = "".join(map(unescape, text_under_mask(formatted, starts, ends, spans, ranges)))
                turns = parse(formatted)
                digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "surrogatepass"))
                out.append({
                    "conv_id": conv_id, "n_turns": len(turns), "turns_sha256": digest.hexdigest(), "loss_chars": len(loss),
                    "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), "formatted_chars": len(formatted),
                    "n_tokens": len(mask), "n_loss_tokens": int(mask.sum()),
                })
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in READ.split(", "))])
    return formatted.mapInArrow(run, READ)


#: The conversation that the query adds: both texts look like the template's own marks.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    out = written(format_conversations(conversations.unionByName(extra)), "chat")
    return read_back(out).drop("n_tokens", "n_loss_tokens")


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|\|role:|\|end\|>|/?INST\])', '\1\2\\\3', 'g'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 18 WHEN 'assistant' THEN 4 ELSE 16 + length(role) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
