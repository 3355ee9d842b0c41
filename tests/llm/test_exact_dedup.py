import hashlib
import re

from edges import DOCS, check_edges, documents
from oracle import check_oracle

from ridgeline.llm import exact_dedup as E


def test_oracle(spark, sf):
    check_oracle(spark, E.op8_exact_dedup, E.OP8_SQL, sf)


def test_edges(spark):
    rows = check_edges(spark, E.exact_groups)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert by[3].group_size == 3 and by[3].keep_id == 5 and not by[4].kept  # null, empty, blanks: most code points
    assert by[2].keep_id == 1 and by[2].group_size == 3
    assert by[8].group_size == 1 and by[None].kept
    assert by[4].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_ties_and_fan_in(spark):
    rows = [(i, " " * (i % 3) + f"t{i % 7}", None, None, None) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS).repartition(13)
    want = {}
    for i, t, *_ in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        want.setdefault(k, []).append((-len(t), i))
    for fan in (2, 3, 16):
        for r in E.exact_groups(docs, fan).collect():
            g = want[f"t{r.doc_id % 7}"]
            assert (r.keep_id, r.group_size) == (min(g)[1], len(g))
    kept = E.drop_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(g)[1] for g in want.values())
    assert set(E.drop_copies(documents(spark)).columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_rounds_halve_the_runs(spark):
    rows = [(i, f"t{i % 5}", None, None, None) for i in range(160)]
    d = E.digests(spark.createDataFrame(rows, DOCS).repartition(8))
    level = d.selectExpr("cast(doc_id % 8 as int) AS run", *E.KEY, "struct(points, ~doc_id AS inverse, text_hash) AS best", "1L AS group_size")
    for digit, most in enumerate((4, 2, 1)):
        level = E.merge_round(level, 8, 2, digit)
        runs = level.groupBy(*E.KEY).agg({"run": "count", "group_size": "sum"}).collect()
        assert len(runs) == 5 and all(r["count(run)"] == most and r["sum(group_size)"] == 32 for r in runs)
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_rows_of_one_id_stay_by_their_texts(spark):
    rows = [(1, "aaa bbb", None, None, None), (2, "zzz yyy", None, None, None), (2, "aaa bbb", None, None, None), (2, "zzzyyy ", None, None, None)]
    kept = E.drop_copies(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text.replace(" ", "")) for r in kept) == [(1, "aaabbb"), (2, "zzzyyy")]


def test_no_python_in_plan(spark, sf):
    plan = E.op8_exact_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
