import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import pool as P
from ridgeline.operators.nearest import nearest_points
from ridgeline.operators.rank import ranked

PAIRS = [("u", "x", 12.0), ("v", "y", 3.0)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    # scattered, a cluster far denser than its surroundings, and one place that many share
    return np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(5, 0.01, (120, 2)), np.full((60, 2), 3.0)])


def tables(spark, pool, queries):
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pool)], "pid int, x double, y double")
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(queries)], "qid int, u double, v double")
    return p, q


def nested_loop(pool, queries, k):
    out = []
    for i, (a, b) in enumerate(queries):
        d = sorted((((a - c) / 12.0) ** 2 + ((b - e) / 3.0) ** 2, j) for j, (c, e) in enumerate(pool))
        out += [(i, n + 1, j) for n, (_, j) in enumerate(d[:k])]
    return sorted(out)


def test_descent_equals_the_nested_loop(spark, points):
    rng = np.random.default_rng(1)
    queries = np.concatenate([rng.uniform(-9, 9, (40, 2)), rng.normal(5, 0.01, (10, 2)), [[3.0, 3.0]]])
    p, q = tables(spark, points, queries)
    for k, leaf in ((1, 4), (4, 1)):
        got = nearest_points(q, p.repartition(3), ["qid"], PAIRS, k, ["pid"], leaf).collect()
        assert sorted((r.qid, r["rank"], r.pid) for r in got) == nested_loop(points, queries, k)


def test_edges(spark, points):
    p, q = tables(spark, points[:2], points[:5])
    assert nearest_points(q, p, ["qid"], PAIRS, 3, ["pid"]).count() == 10  # fewer points than asked for
    assert nearest_points(q, p.limit(0), ["qid"], PAIRS, 3, ["pid"]).count() == 0
    assert nearest_points(q.limit(0), p, ["qid"], PAIRS, 3, ["pid"]).count() == 0
    holes = q.withColumn("u", F.when(F.col("qid") == 0, F.col("u")))
    assert {r.qid for r in nearest_points(holes, p, ["qid"], PAIRS, 1, ["pid"]).collect()} == {0}
    one = p.withColumns({"x": F.lit(1.0), "y": F.lit(2.0)})  # a box without extent
    assert nearest_points(q, one, ["qid"], PAIRS, 1, ["pid"]).count() == 5


def test_larger_pools_meet_bucket_by_bucket(spark, points, monkeypatch):
    p, q = tables(spark, points, points[::15])
    few = sorted(map(tuple, P.nearest(q, p, ["qid"], PAIRS, 3, ["pid"], len(points)).select("qid", "rank", "pid").collect()))
    assert few == nested_loop(points, points[::15], 3)
    for rows, queries in ((P.BROADCAST_ROWS + 1, None), (len(points), P.PAIRS)):
        plan = P.nearest(q, p, ["qid"], PAIRS, 3, ["pid"], rows, queries)
        assert sorted(map(tuple, plan.select("qid", "rank", "pid").collect())) == few
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_places_in_the_order(spark, points):
    p, _ = tables(spark, points, [])
    want = sorted((float(a), float(b), i) for i, (a, b) in enumerate(points))
    for n in (1, 5):
        out, total = ranked(p.repartition(3), ["x", "y", "pid"], "place", n)
        assert total == len(points)
        assert [(r.x, r.y, r.pid) for r in sorted(out.collect(), key=lambda r: r.place)] == want
    assert ranked(p.limit(0), ["x"])[1] == 0


def test_pool_is_capped(spark, monkeypatch):
    from ridgeline.config import ScanConfig
    from ridgeline.functions.targets import Target
    from ridgeline.plans import scan as N

    monkeypatch.setattr(N, "capacity", lambda d: 50)
    monkeypatch.setattr(P, "capacity", lambda d: 50)
    scan = N.Scan(spark, Target("sphere", 2), ScanConfig())
    points = spark.range(300).select((F.col("id") / 100.0).alias("x0"), F.lit(0.0).alias("x1"))
    assert scan.initial_points(points) == 300 and scan.pool.count() == 50
    scan._into_pool(points.withColumn("logl", F.lit(-1e-9)))
    assert scan.pool.count() == 50 and scan.pool_rows == 50 and scan.pool.agg(F.min("logl")).first()[0] == -1e-9
