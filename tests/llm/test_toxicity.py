import zlib

import numpy as np
from edges import check_edges, documents
from timing import growth

from ridgeline.llm import toxicity as T


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = T.op2_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in held)
    precision, recall = hit / sum(p for p, _ in held), hit / sum(t for _, t in held)
    print("precision", precision, "recall", recall)
    assert precision >= 0.9 and recall >= 0.8


def test_folding():
    assert T.fold("1d10t, IDIOT! іdіоt 2024 ＩＤＩＯＴ") == " idiot idiot idiot idiot "
    assert T.fold("Café $7 ok!") == " café ok "
    assert T.fold(None) == T.fold("") == T.fold("!!! 99") == "  "


def test_exceptions_and_length():
    m = T.Model()
    a = m.automaton()
    assert T.features(T.fold("put it in the trash can"), a)[1] == []
    one, many = (T.score_of(T.features(T.fold("idiot" + " word" * n), a)[0], m.weights) for n in (3, 300))
    assert one > many
    assert len(T.features(T.fold("tr4sh trash can scum"), a)[1]) == 2


def test_lexicon_learns_words_and_beginnings():
    rng = np.random.default_rng(0)
    clean = [" " + " ".join(f"w{rng.integers(200)}x" for _ in range(40)) + " " for _ in range(400)]
    bad = [c + f"zork{rng.integers(50)}q grum " for c in clean[:80]]
    lex = T.learn_lexicon(clean + bad, np.array([0] * 400 + [1] * 80))
    assert "grum " in lex and any(k.startswith("zork") for k in lex) and not any(k.startswith("w1") for k in lex)


def test_edges(spark):
    rows = {r.doc_id: r for r in check_edges(spark, lambda d: T.score_toxicity(d, T.Model()))}
    assert rows[3].score == rows[4].score == rows[5].score and rows[3].n_finds == 0
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert T.learn_from(documents(spark), labels) == T.Model()
    assert T.learn_from(documents(spark, []), labels.limit(0)) == T.Model()


def test_exceptions_of_long_texts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        best = {int(s): (1, 1.0) for s in rng.integers(0, 60, 20)}
        free = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 60, 8), rng.integers(1, 12, 8))]
        want = {s: x for s, x in best.items() if not any(lo <= s < hi for lo, hi in free)}
        assert T.without_covered(best, free) == want and list(T.without_covered(best, free)) == list(want)
    a = T.Model().automaton()
    assert growth(lambda n: T.features(T.fold("trash can idiot " * n), a), 2000, 16000) < 24
