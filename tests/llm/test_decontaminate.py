import hashlib
import re

from edges import check_edges, documents
from oracle import check_oracle

from ridgeline.llm import decontaminate as D
from ridgeline.llm.common import WORD


def split(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    found |= wins[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog again and again the"),
    (10, "Quick brown, FOX jumps over the lazy dog again and again"),
    (2, "one"), (3, None), (4, "..."), (None, "sieht den Hund"), (5, "jumps over"), (5, "Katze"), (1, "the"),
]


def test_oracle(spark, sf):
    check_oracle(spark, D.op9_decontamination, D.OP9_SQL, sf)


def test_brute_force_with_short_items(spark):
    docs = documents(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    for limit in (D.BROADCAST_BYTES, 0):  # broadcast, and the shuffled join beyond the bound
        got = D.contamination(docs, bench(spark, ITEMS), broadcast_bytes=limit).drop("spans", "text_hash")
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_edges(spark):
    b = bench(spark, ITEMS)
    check_edges(spark, lambda d: D.contamination(d, b))
    none = D.contamination(documents(spark), bench(spark, []))
    assert none.count() == 13 and none.filter("contaminated").count() == 0


def test_removal(spark):
    docs = documents(spark, [(1, "Yes: quick brown fox jumps over the lazy dog again and again, (end).", "en", "s", 1), (2, "clean", None, None, None)])
    b = bench(spark, ITEMS[1:2])
    assert [r.doc_id for r in D.drop_contaminated(docs, b).collect()] == [2]
    cut = {r.doc_id: r.text for r in D.cut_spans(docs, b).collect()}
    assert cut == {1: "Yes, (end).", 2: "clean"}


def test_removal_goes_by_row(spark):
    rows = [(1, "Yes: quick brown fox jumps over the lazy dog again and again", "en", "s", 1), (1, "clean", None, None, None)]
    kept = D.drop_contaminated(documents(spark, rows), bench(spark, ITEMS[1:2])).collect()
    assert [r.text for r in kept] == ["clean"]
    cut = D.cut_spans(documents(spark, rows), bench(spark, ITEMS[1:2])).collect()
    assert sorted((r.text, r.n_hit) for r in cut) == [("Yes", 11), ("clean", 0)]


def test_no_python_in_plan(spark, sf):
    plan = D.op9_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
