import re
import time

import numpy as np
from edges import DOCS, check_edges, documents
from pyspark.sql import functions as F

from ridgeline.llm import quality_rules as Q
from ridgeline.llm.common import is_held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base statistics by their definitions."""
    t = text or ""
    words = WORD.findall(t)
    lines, dups, seen = t.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dups, "n_repeat_words": len(hit)}


def test_statistics_equal_their_definitions():
    rng = np.random.default_rng(5)
    parts = ["a", "b", "été", "中文", "x#y", "\U0001f600", "\n", "\n", " ", "\t", "\x0b", "\x85", " ", "B", "|"]
    texts = ["".join(p + rng.choice(["", " ", "\n"]) for p in rng.choice(parts, int(rng.integers(0, 60)))) for _ in range(400)]
    for text in [None, "", " \n ", "a b", "a b c", "a b c a b c", "a a a a", "x\r\nx\r\n\r\n", *texts]:
        got = dict(zip(Q.STATISTICS, Q.text_statistics(text)))
        assert {k: got[k] for k in plain(text)} == plain(text), repr(text)


def test_repeats_in_texts_of_many_words():
    assert Q.repeated_words([str(i).encode() for i in range(100_000)]) == 0
    assert Q.repeated_words([str(i % 50_000).encode() for i in range(100_000)]) == 100_000


def test_time_grows_with_length():
    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"w{i} x{i % 97} y z" for i in range(n))
        began = time.process_time()
        Q.text_statistics(text)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_query_base_columns(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op12_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.rule is None)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out, rules = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter(is_held_out("doc_id") & ~F.col("base_failed")).select("quality", "kept").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert len(bad) > 30 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.99 * len(good)
    assert rules and all(str(r) for r in rules)


def made(spark, rows):
    """Statistics of 100 words each with the given symbols, upper-case letters and lines, and their labels."""
    cols = ["doc_id", *Q.STATISTICS]
    data = []
    for i, (symbols, upper, lines, _) in enumerate(rows):
        v = dict.fromkeys(Q.STATISTICS, 0) | {"n_words": 100, "word_chars": 500, "n_symbols": symbols, "n_upper": upper, "n_lines": lines, "n_letters": 450}
        data.append((i, *[v[c] for c in Q.STATISTICS]))
    stats = spark.createDataFrame(data, ", ".join(f"{c} long" for c in cols))
    return stats, spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, quality int")


def test_learns_a_conjunction_in_order(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(1500):
        symbols, upper, lines = int(rng.integers(0, 100)), int(rng.integers(0, 300)), int(rng.integers(1, 50))
        bad = (symbols >= 30 and upper < 100) or lines > 33
        rows.append((symbols, upper, lines, 0 if bad else 1))
    stats, labels = made(spark, rows)
    want = None
    for n in (1, 6):
        rules = Q.learn_rules(stats.repartition(n), labels, precision=90)
        assert want in (None, rules)  # partitions change nothing
        want = rules
    assert len(rules) >= 2 and any(len(r.conditions) > 1 for r in rules)
    got = stats.withColumn("kept", Q.verdict(rules)).join(labels, "doc_id").collect()
    wrong = sum(r.kept != bool(r.quality) for r in got)
    assert wrong <= 0.05 * len(got)
    for r in stats.select("*", Q.rule_number(rules).alias("k"), *[x.column().alias(f"r{i}") for i, x in enumerate(rules, 1)]).collect():
        assert r.k == next((i for i in range(1, len(rules) + 1) if r[f"r{i}"]), None)


def test_noise_makes_no_rules(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 9)), int(rng.integers(0, 9)), 5, int(rng.random() < 0.5)) for _ in range(600)]
    assert Q.learn_rules(*made(spark, rows)) == []
    assert Q.learn_rules(*made(spark, [(0, 0, 1, 1)] * 20)) == []


def test_edges(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (7, 1), (None, 0), (8, None), (999, 0)], "doc_id long, quality int")
    rows = check_edges(spark, lambda d: Q.judge(d, labels)[0])
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[7].n_words == 36_000 and by[7].base_failed
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "a", 1) for i in range(5)]
    assert all(r.kept for r in Q.judge(spark.createDataFrame(clean, DOCS), labels)[0].collect())
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judge(documents(spark), empty)[1] == []
