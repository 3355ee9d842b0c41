import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check_oracle

from ridgeline.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"
odd = st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|role:", "|end|>", "|>", " ", "a", "é", "\n", "😀", "中"]), max_size=9).map("".join)
roles = st.sampled_from(["user", "assistant", "system", "", "tool", "<|end|>", "a|>b%"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(roles, odd), max_size=6))
def test_round_trip(turns):
    formatted, spans = C.render(turns)
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(roles, odd), max_size=5))
def test_mask_covers_each_assistant_text_once(turns):
    import numpy as np

    formatted, spans = C.render(turns)
    offsets = np.array(C.encoder(C.tokenizer_path()).encode(formatted, add_special_tokens=False).offsets, dtype=int).reshape(-1, 2)
    ranges = C.token_ranges(offsets[:, 0], offsets[:, 1], spans)
    brute = [[k for k, (s, e) in enumerate(offsets) if s < hi and e > lo and hi > lo] for lo, hi in spans]
    assert [list(range(a, b)) for a, b in ranges] == brute
    got = C.text_under_mask(formatted, offsets[:, 0], offsets[:, 1], spans, ranges)
    assert [C.unescape(x) for x in got] == [t for r, t in turns if r == "assistant"]


def one_by_one(formatted, starts, ends, spans, ranges):
    out = []
    for (lo, hi), (first, last) in zip(spans, ranges):
        hit = sorted({c for k in range(first, last) for c in range(max(lo, int(starts[k])), min(hi, int(ends[k])))})
        out.append("".join(formatted[c] for c in hit))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(odd, st.text(st.characters(exclude_categories=["Cs"]), max_size=20)), max_size=6), st.randoms(use_true_random=False))
def test_offsets_equal_the_tokenizers(texts, r):
    text = r.choice([" ", "\n", ""]).join(texts)
    ids, starts, ends = C.encode(C.tokenizer_path(), text)
    e = C.encoder(C.tokenizer_path()).encode(text, add_special_tokens=False)
    assert ids.tolist() == e.ids and list(zip(starts.tolist(), ends.tolist())) == e.offsets
    # spans and ranges at will: the mask may leave tokens out in between
    spans, ranges = [], []
    for _ in range(4):
        lo, hi = sorted(r.randint(0, len(text)) for _ in range(2))
        first, last = sorted(r.randint(0, len(ids)) for _ in range(2))
        spans.append((lo, hi))
        ranges.append((first, last))
    assert C.text_under_mask(text, starts, ends, spans, ranges) == one_by_one(text, starts, ends, spans, ranges)


def test_special_tokens_take_the_tokenizers_offsets():
    text = "a <|endoftext|> b \U0001f600"
    ids, starts, ends = C.encode(C.tokenizer_path(), text)
    e = C.encoder(C.tokenizer_path()).encode(text, add_special_tokens=False)
    assert ids.tolist() == e.ids and list(zip(starts.tolist(), ends.tolist())) == e.offsets


def test_oracle(spark, sf):
    check_oracle(spark, C.op5_chat, C.OP5_SQL, sf)


def test_edges(spark):
    rows = [
        (1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 0, "assistant", "x"), (2, None, None, "no role"),
        (2, 5, "assistant", "long " * 30000), (3, 0, "assistant", ""), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("formatted", "ids", "mask", "spans"):
        df = df.withColumn(c, C.F.lit(1))
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].loss_chars == 1 and got[3].n_turns == 1
    assert got[2].turns_sha256 == hashlib.sha256(("\nno role\nassistant\n" + "long " * 30000 + "\n").encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0
