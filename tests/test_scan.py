import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.config import Projection, ScanConfig, VolumeConfig
from ridgeline.functions.targets import Target
from ridgeline.operators import grid as G
from ridgeline.plans.scan import PyTarget, Scan, normalised_gradient, sample_volume
from ridgeline.sources.store import stored

HIMMELBLAU = Target("himmelblau", 4)


def check_invariants(r, target, roi):
    """Stored values are the target's, counts are whole, and every neighbour of a cell in the region is there."""
    p = r.projection
    rows = r.solutions.collect()
    for row in rows:
        x = np.empty(len(p.bounds))
        for k, d in enumerate(p.dims):
            x[d] = row[f"g{k}"]
        for k, d in enumerate(p.profiled):
            x[d] = row[f"p{k}"]
            assert p.bounds[d][0] <= x[d] <= p.bounds[d][1]
        assert abs(float(target(x)) - row.logl) < 1e-9
    have = {tuple(row[c] for c in p.cells) for row in rows}
    assert len(have) == len(rows)
    top = max(row.logl for row in rows)
    for row in rows:
        if row.logl > top - roi:
            for o in G.offsets(len(p.dims)):
                n = tuple(row[c] + d for c, d in zip(p.cells, o))
                assert n in have or any(not 0 <= i <= g for i, g in zip(n, p.grid_points))
    return rows


@pytest.mark.parametrize("method", ["lbfgs", "de"])
def test_himmelblau_plane(spark, method):
    p = Projection.of([0, 1], [12, 12], HIMMELBLAU.bounds, method=method)
    r = Scan(spark, HIMMELBLAU, ScanConfig(roi_threshold=5.0, n_starts=20)).run(p)
    rows = check_invariants(r, HIMMELBLAU, 5.0)
    assert max(row.logl for row in rows) > -0.6 and 100 < r.metrics["evaluations"] < 50_000
    for row in rows:  # the profile is the first bracket alone
        want = float(Target("himmelblau", 2)(np.array([row.g0, row.g1])))
        if row.logl > max(x.logl for x in rows) - 5.0:
            assert abs(row.logl - want) < 1e-5


def test_direct_and_refined(spark):
    t = Target("sphere", 2)
    direct = Scan(spark, t).run(Projection.of([0, 1], [10, 10], t.bounds)).solutions.collect()
    assert len(direct) == 121 and all(abs(r.logl + r.g0**2 + r.g1**2) < 1e-12 for r in direct)
    s = Target("sphere", 4)
    r = Scan(spark, s, ScanConfig(roi_threshold=8.0)).run(Projection.of([0, 1], [6, 6], s.bounds, refine=2))
    check_invariants(r, s, 8.0)
    coarse = {(x.i0 * 2, x.i1 * 2): x.logl for x in r.state.collect()}
    fine = {(x.i0, x.i1): x.logl for x in r.refined.state.collect()}
    assert all(fine[k] >= v for k, v in coarse.items()) and len(fine) > len(coarse)


def test_partitions_do_not_change_results(spark):
    p = Projection.of([0], [10], HIMMELBLAU.bounds)
    out = [sorted(map(tuple, Scan(spark, HIMMELBLAU, ScanConfig(roi_threshold=5.0, n_starts=8), partitions=n).run(p).state.collect())) for n in (1, 7)]
    assert out[0] == out[1]


def test_python_target_and_failures(spark):
    def f(x):
        if x[0] > 4:
            raise RuntimeError("no value here")
        return -float((x**2).sum())

    t = PyTarget(f, [(-5, 5)] * 3)
    assert t(np.array([[5.0, 0, 0], [1.0, 0, 0]])).tolist() == [-np.inf, -1.0]
    r = Scan(spark, t, ScanConfig(roi_threshold=4.0, n_starts=8)).run(Projection.of([0], [10], t.bounds))
    assert max(x.logl for x in r.state.collect()) > -1e-6


def test_gradients_of_users():
    assert normalised_gradient([1, 2], 2).tolist() == [1, 2]
    assert np.isnan(normalised_gradient({1: 3.0}, 2)[0])
    for bad in (None, [1], {5: 1.0}, {"a": 1.0}):
        with pytest.raises(ValueError):
            normalised_gradient(bad, 2)


def test_warm_start_serves_every_projection(spark):
    log = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0)], "x0 double, x1 double, x2 double, x3 double, logl double")
    s = Target("sphere", 4)
    scan = Scan(spark, s, ScanConfig(roi_threshold=2.0))
    a, b = scan.run_all([Projection.of([0], [10], s.bounds), Projection.of([1], [10], s.bounds)], log)
    assert not a.optima and not b.optima and scan.pool is not None


def test_volume(spark):
    s = Target("sphere", 4)
    scan = Scan(spark, s, ScanConfig(roi_threshold=4.0, n_starts=8))
    r = scan.run(Projection.of([0, 1], [8, 8], s.bounds))
    band, summary = sample_volume(scan, [r], VolumeConfig(roi_threshold=4.0, n_walkers=150, n_steps=20, eval_budget=700))
    rows = band.collect()
    assert summary["n_evaluations"] <= 700 and summary["n_samples"] == len(rows) > 50
    for x in rows:
        assert abs(float(s(np.array(x[:4]))) - x.logl) < 1e-9 and all(-5 <= v <= 5 for v in x[:4])
        assert x.logl >= summary["final_max"] - 4.0


def test_planted_suspects(spark):
    from ridgeline.operators import state as S

    rows = [(i, -0.02 * i * i, 0.1 * i, -0.1 * i) if not 5 <= i <= 7 else (i, -25.0, 3.5, 3.5) for i in range(13)]
    df = spark.createDataFrame(rows, "i0 int, logl double, p0 double, p1 double")
    p = Projection.of([0], [12], [(-5, 5)] * 3)
    assert {r.i0 for r in S.suspects(df, p, ["p0", "p1"], [10.0, 10.0], 100.0).collect()} & {5, 6, 7}


def test_live_stream(spark, tmp_path):
    from ridgeline.streaming.live import live_profile, run_available

    p = Projection.of([0], [10], [(-5, 5), (-5, 5)])
    df = spark.range(100).select((F.col("id") / 10 - 5).alias("x0"), F.lit(0.0).alias("x1"), (-F.col("id")).cast("double").alias("logl"))
    df.repartition(3).write.parquet(f"{tmp_path}/log")
    out = run_available(live_profile(spark, f"{tmp_path}/log", df.schema, p), "live_test", str(tmp_path / "c"))
    want = G.with_cells(df, p).groupBy("i0").agg(F.max("logl").alias("logl"), F.count("*").alias("n"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("method", ["lbfgs", "de"])
def test_every_call_is_counted_and_logged(spark, tmp_path, method):
    import os

    folder, inner = str(tmp_path), Target("rosenbrock", 4)

    class Counting:  # leaves a file for each call, named by its number of points
        bounds = inner.bounds

        def __call__(self, x):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}-{len(x)}", "w").close()
            return inner(x)

    target = Counting()
    scan = Scan(spark, target, ScanConfig(roi_threshold=10.0, n_starts=6, generations=8, log=True))
    r = scan.run(Projection.of([0], [10], target.bounds, method=method))
    made = sum(int(n.rsplit("-", 1)[1]) for n in os.listdir(tmp_path))
    calls = scan.log().collect()
    assert r.metrics["evaluations"] == made == len(calls)
    assert {c.phase for c in calls} >= {0, 1, 2} and max(c.logl for c in calls) >= r.metrics["best"]
    again = Scan(spark, Target("rosenbrock", 4), ScanConfig(roi_threshold=10.0)).run(r.projection, scan.log())
    assert not again.optima and again.metrics["best"] >= r.metrics["best"] - 1e-9


def test_gradients_save_calls(spark):
    def f(x):
        return -float((np.asarray(x) ** 2).sum())

    bounds, config = [(-5, 5)] * 4, ScanConfig(roi_threshold=4.0, n_starts=8)
    p = Projection.of([0, 1], [6, 6], bounds)
    plain = Scan(spark, PyTarget(f, bounds), config).run(p).metrics
    user = Scan(spark, PyTarget(f, bounds, lambda x: -2 * np.asarray(x)), config).run(p).metrics
    part = Scan(spark, PyTarget(f, bounds, lambda x: {k: -2 * x[k] for k in (2, 3)}), config).run(p).metrics
    assert user["evaluations"] < plain["evaluations"]
    assert abs(user["best"]) < 1e-9 and abs(part["best"]) < 1e-9


def test_initial_points_seed_a_scan(spark):
    s = Target("sphere", 4)
    scan = Scan(spark, s, ScanConfig(roi_threshold=2.0, log=True))
    points = spark.createDataFrame([(0.1, 0.0, 0.0, 0.2), (9.0, 0.0, 0.0, 0.0)], "x0 double, x1 double, x2 double, x3 double")
    assert scan.initial_points(points) == 1
    r = scan.run(Projection.of([0], [10], s.bounds))
    assert not r.optima and scan.log().filter("phase = 0").count() == 1


def test_recheck_inside_a_wrong_patch(spark):
    s = Target("sphere", 4)
    p = Projection.of([0, 1], [12, 12], s.bounds)
    scan = Scan(spark, s, ScanConfig(roi_threshold=60.0, max_waves=3))
    good = scan.run(p).state
    wrong = (F.col("i0").between(4, 8)) & (F.col("i1").between(4, 8))
    bad = good.withColumns({"p0": F.when(wrong, 4.0).otherwise(F.col("p0")), "p1": F.when(wrong, 4.0).otherwise(F.col("p1")), "logl": F.when(wrong, F.col("logl") - 32.0).otherwise(F.col("logl"))})
    mended = {(r.i0, r.i1): r.logl for r in scan.recheck(bad, p).collect()}
    was = {(r.i0, r.i1): r.logl for r in bad.collect()}
    assert all(mended[k] >= v - 1e-12 for k, v in was.items()) and any(mended[k] > v + 1 for k, v in was.items())


def test_optima_registry_has_every_peak(spark, sf):
    from ridgeline.catalogue import QUERIES

    rows = QUERIES["optima_registry"](spark, sf).collect()
    assert sorted((r["first"], r["second"]) for r in rows) == [(a, b) for a in range(4) for b in range(4)]
    assert {(r.off, r.logl) for r in rows} == {(0.0, 0.0)}


def test_curvature_of_neighbours_saves_evaluations(spark):
    t = Target("rosenbrock", 4)
    box = [(-1.0, 2.0), *t.bounds[1:]]
    p = Projection.of([0], [30], box)
    scan = Scan(spark, t, ScanConfig(roi_threshold=10.0, n_starts=12, suspect=False), bounds=box)
    r = scan.run(p)
    check_invariants(r, t, 10.0)
    work = stored(scan._starts(r.state.filter("i0 % 2 = 1"), r.state.filter("i0 % 2 = 0"), p, 1), "work")
    assert work.filter("size(curv) > 0").count() > 10
    with_, without = (scan.optimise(w, p, "LBFGSB_LOOP").agg(F.sum("evals"), F.min("logl")).first() for w in (work, work.drop("curv")))
    assert with_[0] < 0.9 * without[0] and abs(with_[1] - without[1]) < 1e-3


def test_pairs_are_adopted_by_the_kernel():
    from ridgeline.plans import kernels as K

    a = np.diag([1.0, 50.0, 400.0])
    f = lambda x: -0.5 * np.einsum("ni,ij,nj->n", x, a, x)
    box = np.array([(-9.0, 9.0)] * 3)
    cold = K.lbfgs(f, np.array([1.0, 2.0, -1.0]), box)
    again = K.lbfgs(f, np.array([2.0, -1.0, 1.0]), box)
    taught = K.lbfgs(f, np.array([2.0, -1.0, 1.0]), box, pairs=cold.pairs)
    assert cold.pairs and taught.evals < again.evals and abs(taught.value) < 1e-6
    assert K.lbfgs(f, np.array([2.0, -1.0, 1.0]), box, pairs=[(np.ones(2), np.ones(2)), (np.ones(3), -np.ones(3))]).evals == again.evals


def test_a_gradient_that_fails_is_counted_and_replaced(spark):
    for bad in (lambda x: 1 / 0, lambda x: None, lambda x: [1.0], lambda x: {0: "a"}):
        t = PyTarget(lambda x: -float((x**2).sum()), [(-5, 5)] * 3, gradient=bad)
        r = Scan(spark, t, ScanConfig(roi_threshold=4.0, n_starts=4, suspect=False)).run(Projection.of([0], [4], t.bounds))
        assert r.metrics["best"] > -1e-6 and r.metrics["gradient_failures"] > 0 and r.metrics["saved"] == 0
    t = PyTarget(lambda x: -float((x**2).sum()), [(-5, 5)] * 3, gradient=lambda x: -2 * x)
    r = Scan(spark, t, ScanConfig(roi_threshold=4.0, n_starts=4)).run(Projection.of([0], [4], t.bounds))
    assert r.metrics["saved"] > 0 and r.metrics["gradient_failures"] == 0 and r.metrics["failed"] == 0


STATE = "i0 int, logl double, p0 double, p1 double, evals long, done boolean, phase int, curv array<struct<s: array<double>, y: array<double>>>"


def test_later_waves_look_around_what_improved(spark):
    from ridgeline.operators import state as S

    p = Projection.of([0], [10], [(-5, 5)] * 3)
    flat = spark.createDataFrame([(i, -1.0, 1.0, 1.0, 1, True, 1, None) for i in range(11)], STATE)
    assert {r.i0 for r in S.around(flat.filter("i0 = 5"), flat, p).collect()} == {4, 6}
    assert {r.i0 for r in S.around(flat.filter("i0 = 5"), flat.filter("i0 < 6"), p).collect()} == {4}
    # parameters spread from cell 0 over a strip of cells that were left at a worse optimum
    t = PyTarget(lambda x: -float((x[1] - 2) ** 2 * (x[1] + 2) ** 2 / 16 + 0.1 * (x[1] < 0) + x[2] ** 2 + 0.001 * x[0] ** 2), [(-5, 5)] * 3)
    start = [(i, float(t(np.array([i - 5.0, 2.0 if i == 0 else -2.0, 0.0]))), 2.0 if i == 0 else -2.0, 0.0, 1, True, 1, None) for i in range(11)]
    scan = Scan(spark, t, ScanConfig(roi_threshold=4.0, max_waves=30))
    out = {r.i0: r.p0 for r in scan.patch(spark.createDataFrame(start, STATE), p).collect()}
    assert all(v > 0 for v in out.values())
    tested = [n for kind, _, n in scan.waves if kind == "PATCHING_TEST"]
    assert len(tested) > 5 and max(tested[1:]) <= 3 < tested[0] + 3  # the first wave sees all, later ones the front


def test_seeds_of_a_recheck(spark):
    p = Projection.of([0], [10], [(-5, 5)] * 3)
    scan = Scan(spark, Target("sphere", 3), ScanConfig())
    flat = [(i, -15.0 if i == 5 else -1.0, 3.0 if i == 5 else 1.0, -2.0 if i == 5 else 1.0, 1, True, 1, None) for i in range(11)]
    state = spark.createDataFrame(flat, STATE)
    seeds = scan.recheck_seeds(state.filter("i0 = 5").select("i0"), state, p).first().seeds
    assert seeds == [[3.0, -2.0], [1.0, 1.0]]  # its own first, the others' once
    scan._into_pool(spark.createDataFrame([(0.0, 4.0, 4.0, -1.0), (5.0, -4.0, 4.0, -1.0)], "x0 double, x1 double, x2 double, logl double"))
    seeds = scan.recheck_seeds(state.filter("i0 = 5").select("i0"), state, p).first().seeds
    assert seeds == [[3.0, -2.0], [1.0, 1.0], [4.0, 4.0], [-4.0, 4.0]]  # then the pool's, the nearest first


def test_a_recheck_polishes_the_best_seed(spark):
    p = Projection.of([0], [30], [(-5, 5)] * 3)
    values = {3.5: -15.0, 2.0: -14.5, 1.0: -2.0}
    t = PyTarget(lambda x: next((v for k, v in values.items() if abs(x[1] - k) < 1e-3 and abs(x[2] - k) < 1e-3), -20.0), [(-5, 5)] * 3)
    phi = {15: 3.5, 17: 2.0}
    state = spark.createDataFrame([(i, -15.0 if i == 15 else -1.0, phi.get(i, 1.0), phi.get(i, 1.0), 1, True, 1, None) for i in range(31)], STATE)
    scan = Scan(spark, t, ScanConfig(roi_threshold=100.0))
    out = {r.i0: r for r in scan.recheck(state, p).collect()}
    assert out[15].logl == -2.0 and out[15].p0 == 1.0
    assert all(out[i].logl == -1.0 for i in range(31) if i != 15)
    tested = [n for kind, _, n in scan.waves if kind == "SUSPECT_RECHECK"]
    assert tested[0] >= 2 and len(tested) >= 2


def test_partners_lie_in_the_level_window(spark):
    from ridgeline.functions.sampling import uniform
    from ridgeline.plans.scan import partner_index

    for walkers, window in ((101, 7.4), (60, 0.5), (40, None), (9, 3.0)):
        for half in (0, 1):
            size = (walkers + half) // 2
            d = spark.range(walkers).filter(F.col("id") % 2 == half).withColumn("u", F.explode(F.array(*[uniform("id", F.lit(k)) for k in range(20)])))
            rows = d.select("id", partner_index(F.col("id"), half, walkers, size, window, F.col("u")).alias("k")).collect()
            seen = {}
            for r in rows:
                assert 0 <= r.k < size
                seen.setdefault(r.id, set()).add(2 * r.k + 1 - half)
            for w, partners in seen.items():
                if window is not None and window >= 1:
                    assert all(abs(w - x) <= window for x in partners)
            if window in (None, 0.5):  # no walker of the other half so near: the whole half
                assert max(len(x) for x in seen.values()) > 8


def test_volume_with_window_and_files(spark, tmp_path):
    import json

    s = Target("sphere", 4)
    scan = Scan(spark, s, ScanConfig(roi_threshold=4.0, n_starts=8))
    r = scan.run(Projection.of([0, 1], [8, 8], s.bounds))
    config = VolumeConfig(roi_threshold=4.0, n_walkers=60, n_steps=3, partner_level_window=1.0, output_file=f"{tmp_path}/v.csv")
    band, summary = sample_volume(scan, [r], config)
    told = json.loads("\n".join(x.value for x in spark.read.text(f"{tmp_path}/v_summary.json", wholetext=True).collect()))
    assert told["n_samples"] == summary["n_samples"] == spark.read.text(f"{tmp_path}/v.csv").count() == sum(told["histogram"]["counts"])
