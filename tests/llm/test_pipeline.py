import test_decontaminate as d
import test_near_dedup as n
import test_packing as p
from edges import documents

import corpus_pipeline as C


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "language_id":
            want = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
        elif name == "exact_dedup":
            best = {}
            for i, t in rows:
                key = "".join(c for c in t if c not in " \t\n\v\f\r")
                best[key] = min(best.get(key, (1, 0)), (-len(t), i))
            want = [(i, t) for i, t in rows if i in {x for _, x in best.values()}]
        elif name == "near_dedup":
            keep = {c for _, c in n.brute(rows, 5).values()}
            want = [(i, t) for i, t in rows if i in keep]
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = {x[0] for x in d.brute(rows, items) if not x[-1]}
            want = [(i, t) for i, t in rows if i in clean]
        assert got == sorted(want), name
        rows = want
    used, bound = p.check_packing(C.STAGES[-1][1](spark, docs, sf).collect(), rows)
    assert used <= bound * 1.01 + 1
    assert C.run(spark, sf).count() == sum(1 for _ in C.STAGES[-1][1](spark, docs, sf).collect())


def test_edges(spark, sf):
    docs = documents(spark)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, documents(spark, []), sf).count() == 0
