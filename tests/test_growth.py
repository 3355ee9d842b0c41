"""Queries on tables larger than the given ones, or on such as large tables make."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from sql_compare import compare

from ridgeline import catalogue as Q
from ridgeline.config import Projection
from ridgeline.operators import pool as P
from ridgeline.operators import profile as R
from ridgeline.operators import similar as N
from ridgeline.operators import state as S


def test_rank_sums_of_millions_of_rows(spark):
    """Six million rows: n1 * n2 * (n1 + n2 + 1) is beyond 64 bits."""
    n = 6_000_000
    d = spark.range(n).select((F.col("id") % 2).alias("g"), ((F.col("id") % 10) / 4).alias("value"))
    r = S.mann_whitney(d, "g", "value").first()
    # group 0 has the even values of 0..9, group 1 the odd ones; a value's n / 10 rows share their mean rank
    ranks = sum(n // 10 * (n // 10 * v + (n // 10 + 1) / 2) for v in range(0, 10, 2))
    u, mid, sd = ranks - (n // 2) * (n // 2 + 1) / 2, (n // 2) ** 2 / 2, math.sqrt((n // 2) ** 2 * (n + 1) / 12)
    assert (r.n1, r.n2) == (n // 2, n // 2)
    assert r.u1 == u and r.z == pytest.approx((u - mid) / sd, rel=1e-12)


@pytest.fixture(scope="module")
def peaked(spark, tmp_path_factory):
    """A log whose every cell holds the best x2 and x3, as in large tables: the state's x2 and x3 have no spread."""
    out = str(tmp_path_factory.mktemp("peaked"))
    one = spark.range(50 * 11).selectExpr(
        "id l_orderkey", "cast(664 as long) l_partkey", "1L l_suppkey", "cast(id % 5 as int) l_linenumber", "cast(1 + id % 50 as double) l_quantity",
        "cast(id div 50 as double) / 100 l_discount", "0.06D l_tax",
    )
    one.union(one.withColumn("l_partkey", F.col("l_partkey") + F.col("l_orderkey") % 7).withColumn("l_tax", F.lit(0.02))).write.parquet(f"{out}/lineitem.parquet")
    return out


def lineitem(folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["dbscan_modes_narrow", "scan_refined_direct", "dbscan_modes"])
def test_modes_of_parameters_without_spread(spark, peaked, name):
    assert Q.state(spark, peaked).select("x2", "x3").distinct().count() == 1
    compare(Q.QUERIES[name](spark, peaked), Q.ORACLE[name], lineitem(peaked))


def test_rounding_is_that_of_the_sql(spark):
    """-0.05 * (21.05 ** 2 + 1.74 ** 2) is a bit above -22.306505."""
    import duckdb

    x = -0.05 * (((5.5 * 5.5 + 1.8 - 11) * (5.5 * 5.5 + 1.8 - 11)) + ((5.5 + 1.8 * 1.8 - 7) * (5.5 + 1.8 * 1.8 - 7)))
    values = [x, -x, 0.5e-6, 1234567.1234565, -3.0, 0.0]
    want = duckdb.execute("SELECT round(v, 5), round(v, 6) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    got = spark.createDataFrame([(v,) for v in values], "v double").select(Q.rounded("v", 5), Q.r6("v")).collect()
    assert [tuple(r) for r in got] == want


def filters(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter (" in line]


def test_no_filter_repeats_the_target(spark, sf):
    """Where a log's value is an expression, a filter by it holds the whole expression some ten times a row."""
    log = Q.log(spark, sf)
    assert not log.schema["logl"].nullable
    seeds = P.seeds(log.select(*Q.XS, "logl"), Q.P01, Q.ROI, Q.XS)
    for d in (Q.lnl_histogram(spark, sf), seeds, log.withColumn("b", F.floor(F.col("logl") * 2.0)).join(F.broadcast(spark.range(3).toDF("b")), "b")):
        assert all("11.0" not in line for line in filters(d)), filters(d)


def test_seeds_and_histograms_pass_over_what_is_no_value(spark):
    bad = [None, float("nan"), float("-inf"), 0.0, -1.0, 10.0]
    d = spark.createDataFrame([(float(k % 2), v) for k, v in enumerate(bad)] + [(5.0, None), (5.0, float("-inf"))], "x0 double, logl double")
    p = Projection.of([0], [10], [(0.0, 10.0)])
    got = P.seeds(d.filter("logl is null or not isnan(logl)"), p, 30.0, ["x0"])
    assert {(r.i0, r.logl, r.x0) for r in got.collect()} == {(0, -1.0, 0.0), (1, 10.0, 1.0)}
    assert [(r.bin, r.n) for r in R.histogram(d, "logl", -1.0, 1.0, 4).orderBy("bin").collect()] == [(0, 1), (1, 0), (2, 1), (3, 0)]


@pytest.mark.parametrize("name", ["stream_live_profile", "stream_best_points"])
def test_files_of_streams_grow_in_number_not_in_size(spark, sf, name, monkeypatch):
    """No task of a stream takes more than a file's rows, however large the log; files are read in few batches."""
    from ridgeline.sources import store

    made = []
    plain = store.stored
    monkeypatch.setattr(store, "stored", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    monkeypatch.setattr(Q, "STREAM_ROWS", 500)
    out = Q.QUERIES[name](spark, sf)
    rows = made[0].groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in rows) <= 500 and len(rows) >= made[0].count() / 500
    con = __import__("duckdb").connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    compare(out, Q.ORACLE[name], con)


def test_similar_vectors_with_ties_copies_and_odd_ones(spark, monkeypatch):
    """Against all pairs: copies that tie, several chunks and blocks, and vectors that are null, short or not finite."""
    monkeypatch.setattr(N, "CHUNK", 40)
    monkeypatch.setattr(N, "BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows = [(i, rows[i % 7][1] if i % 3 == 0 else v) for i, v in rows]
    rows += [(300, None), (400, [1.0, 2.0]), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (500, [float("nan")] * 6), (None, [9.0] * 6)]
    d = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = d.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("q").orderBy(F.desc("dot"), "vec_id")
    want = d.join(q, F.col("vec_id") != F.col("q")).select("q", "vec_id", dot.alias("dot")).withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    got = N.most_similar(d, q, 5)
    key = lambda r: (r.q, r.rank, r.vec_id)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() == 18 * 5


def test_similar_vectors_meet_block_by_block(spark, sf):
    """No join of single vectors with single queries does the regular ones."""
    plan = Q.embedding_knn(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
