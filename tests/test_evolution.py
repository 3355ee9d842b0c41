import numpy as np
from pyspark.sql import functions as F

from ridgeline.config import Projection, ScanConfig
from ridgeline.functions.targets import Target
from ridgeline.plans import evolution as E
from ridgeline.plans.scan import Scan

T = Target("himmelblau", 4)
P0 = Projection.of([0], [10], T.bounds, method="de_table")


def scan_of(spark, partitions=None, **more):
    scan = Scan(spark, T, ScanConfig(roi_threshold=5.0, n_starts=12, **more), partitions=partitions)
    return scan


def warm(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-6, 6, (300, 4))
    return spark.createDataFrame([(*map(float, r), float(T(r))) for r in x], "x0 double, x1 double, x2 double, x3 double, logl double")


def exact(x0):
    """The profile over x0: a one-dimensional maximum on a fine grid of x1."""
    y = np.linspace(-6, 6, 20001)
    return float((-0.05 * ((x0 * x0 + y - 11) ** 2 + (x0 + y * y - 7) ** 2)).max())


def test_profile_and_partitions(spark):
    out = []
    for n in (1, 7):
        scan = scan_of(spark, n, generations=3, log=True)
        r = scan.run(P0, warm(spark))
        rows = sorted(tuple(x) for x in r.state.select("i0", "logl", "p0", "p1", "p2", "evals").collect())
        out.append(rows)
        assert r.metrics["evaluations"] == scan.log().count()
        assert r.metrics["rounds"] >= 2
    assert out[0] == out[1]
    top = max(v[1] for v in out[0])
    assert abs(top - max(exact(-6 + 1.2 * i) for i in range(11))) < 1e-4
    missed = 0
    for i, logl, *p, _ in out[0]:
        g = -6 + 1.2 * i
        assert abs(float(T(np.array([g, *p]))) - logl) < 1e-9
        assert logl <= exact(g) + 1e-6
        missed += logl > top - 5 and abs(logl - exact(g)) > 1e-4
    assert missed <= 1  # three generations, and a cell where the best branch changes


def population(spark, n, size=3, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        members = [(float(rng.normal()), rng.uniform(-5, 5, 3).tolist()) for _ in range(size)]
        best = max(members)
        rows.append((i, [{"fit": f, "phi": x} for f, x in members], best[0], best[1], [], "active", False, 3, size, None))
    return spark.createDataFrame(
        rows, f"i0 int, members array<{E.MEMBER}>, best double, phi array<double>, gains array<double>, status string, warm boolean, window int, evals long, won array<struct<f: double, cr: double>>"
    )


def test_guard_of_cells_and_parents(spark):
    ev = E.Evolution(scan_of(spark), P0)
    assert ev.trials(population(spark, 3)) is None
    assert ev.trials(population(spark, 4)) is not None
    lost = population(spark, 5).withColumn("best", F.when(F.col("i0") < 3, F.lit(float("-inf"))).otherwise(F.col("best")))
    assert ev.trials(lost) is None  # two parents are left


def test_few_cells_go_to_the_polish(spark):
    t = Target("sphere", 2)
    p = Projection.of([0], [2], t.bounds, method="de_table")
    r = Scan(spark, t, ScanConfig(roi_threshold=1.0, n_starts=3)).run(p)
    assert r.metrics["converged"] == r.metrics["cells"] == 3 and abs(r.metrics["best"]) < 1e-6


def test_trials_are_what_they_should_be(spark):
    """Every component is the member's own, or the mutant of the archive's best (or a better neighbour) and of two
    different parents that are not it."""
    ev = E.Evolution(scan_of(spark, archive=0.01), P0)
    cells = population(spark, 6)
    ev.generation = 1
    parents = {r.i0: (r.best, np.array(r.phi)) for r in cells.collect()}
    best = max(parents, key=lambda k: parents[k][0])
    rows = ev.trials(cells).collect()
    assert len(rows) == 18
    moved = pulls = 0
    for r in rows:
        own, got = np.array(r.member.phi), np.array([r.p0, r.p1, r.p2])
        near = [k for k in (r.i0 - 1, r.i0 + 1) if k in parents]
        guide = max(near, key=lambda k: parents[k][0])
        goals = [parents[best][1]] + ([parents[guide][1]] if parents[guide][0] > parents[r.i0][0] else [])
        fits = []
        for g, goal in enumerate(goals):
            for a in parents:
                for b in parents:
                    if a != b and best not in (a, b):
                        mutant = np.clip(own + r.f * (goal - own) + r.f * (parents[a][1] - parents[b][1]), -6, 6)
                        fits.append((np.abs(np.where(np.isclose(got, own), own, mutant) - got).max(), g))
        assert min(fits)[0] < 1e-9
        changed = ~np.isclose(got, own)
        moved += int(changed.sum())
        pulls += min(fits)[1]
        assert changed.any() or np.isclose(own, parents[best][1]).any()
        assert 0 < r.f <= 1 and 0 <= r.cr <= 1
    assert 18 <= moved < 54 and pulls
    again = {(r.i0, r.slot): (r.p0, r.p1, r.p2) for r in ev.trials(cells.repartition(5)).collect()}
    assert again == {(r.i0, r.slot): (r.p0, r.p1, r.p2) for r in rows}


def test_selection_and_memory(spark):
    ev = E.Evolution(scan_of(spark), P0)
    cells = population(spark, 6)
    before = {r.i0: r for r in cells.collect()}
    trials = ev.trials(cells)
    rows = {(r.i0, r.slot): r for r in trials.collect()}
    after = ev.evolved(cells, trials).collect()
    for r in after:
        old = before[r.i0]
        wins = 0
        for slot, (a, b) in enumerate(zip(old.members, r.members)):
            t = rows[r.i0, slot]
            value = float(T(np.array([-6 + 1.2 * r.i0, t.p0, t.p1, t.p2])))
            assert abs(b.fit - max(a.fit, value)) < 1e-9
            wins += value > a.fit
        assert len(r.won) == wins and abs(r.best - max(m.fit for m in r.members)) < 1e-12
        assert r.evals == 6 and r.gains == [max(r.best - old.best, 0.0)]
    m = E.Memory(3)
    for k in range(5):
        m.add(k / 10, k / 20)
    assert m.f == [0.3, 0.4, 0.2] and m.at == 2


def test_draws(spark):
    d = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
    d = d.select(E.drawn_scale(F.lit(0.05), F.col("u")).alias("f"), E.drawn_rate(F.lit(0.5), F.col("u"), F.lit(0.0)).alias("cr"))
    rows = d.collect()
    f = np.sort([r.f for r in rows])
    assert f.min() > 0 and f.max() == 1
    rng = np.random.default_rng(0)  # the same law by drawing anew until positive
    c = 0.05 + 0.1 * np.tan(np.pi * (rng.random(400_000) - 0.5))
    c = np.minimum(c[c > 0], 1.0)
    for q in (0.1, 0.5, 0.9):
        assert abs(np.quantile(f, q) - np.quantile(c, q)) < 0.01
    assert all(0 <= r.cr <= 1 for r in rows)
