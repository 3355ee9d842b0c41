"""Density clustering and refinement by modes against small brute-force versions."""

import numpy as np
import pytest

from ridgeline.config import ConfigurationError, Projection, ScanConfig
from ridgeline.functions.targets import Target
from ridgeline.operators import cluster as C
from ridgeline.operators import state as S
from ridgeline.plans import kernels as K
from ridgeline.plans.scan import Result, Scan

BOX = [(-6.0, 6.0)] * 4


def blobs(n0, n1, seed, holes=0.2):
    """(i0, i1, p0, p1) on a grid with holes: three kinds of parameters and some noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n0 + 1):
        for j in range(n1 + 1):
            if rng.random() < holes:
                continue
            centre = [(-4, 4), (3, 3), (0, -5)][0 if i < n0 / 3 else 1 if j < n1 / 2 else 2]
            spread = 5.0 if rng.random() < 0.05 else 0.1
            rows.append((i, j, *(float(c + rng.normal(0, spread)) for c in centre)))
    return rows


def by_kernel(rows, grid, k, eps=None, weight=1.0):
    x = np.array([(r[2], r[3], r[0] / grid[0], r[1] / grid[1]) for r in sorted(rows)])
    sd = x.std(0)
    x = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
    x[:, 2:] *= weight
    return {r[:2]: int(v) for r, v in zip(sorted(rows), K.dbscan(x, eps or K.dbscan_eps(x, k), k))}


@pytest.mark.parametrize("seed,eps,least,weight", [(1, None, None, 1.0), (2, 0.45, 4, 1.0), (3, 0.3, 2, 0.5), (4, 0.05, 3, 1.0)])
def test_density_modes_equal_the_kernel(spark, seed, eps, least, weight):
    p = Projection.of([0, 1], [14, 9], BOX)
    rows = blobs(14, 9, seed)
    state = spark.createDataFrame(rows, "i0 int, i1 int, p0 double, p1 double").repartition(5)
    got = C.cluster_modes(state, p, ["p0", "p1"], weight=weight, min_samples=least, eps=eps)
    want = by_kernel(rows, p.grid_points, least or 3, eps, weight)
    assert {(r.i0, r.i1): r.label for r in got.collect()} == want
    assert (set(want.values()) == {-1}) if eps == 0.05 else eps is None or len(set(want.values())) > 1  # the least reach leaves noise only


def test_density_modes_of_few_cells(spark):
    p = Projection.of([0, 1], [4, 4], BOX)
    kinds = "i0 int, i1 int, p0 double, p1 double"
    assert C.cluster_modes(spark.createDataFrame([], kinds), p, ["p0", "p1"]).count() == 0
    assert [r.label for r in C.cluster_modes(spark.createDataFrame([(1, 1, 0.0, 0.0)], kinds), p, ["p0", "p1"]).collect()] == [0]
    same = [(i, 0, 1.0, 1.0) for i in range(3)]
    assert {r.label for r in C.cluster_modes(spark.createDataFrame(same, kinds), p, ["p0", "p1"]).collect()} == {0}


def test_more_cells_than_one_task_took(spark):
    """A grid beyond the bound of the one-task methods, with two halves that lie apart."""
    p = Projection.of([0, 1], [160, 160], BOX)
    state = spark.range(161 * 161).selectExpr("cast(id div 161 as int) i0", "cast(id % 161 as int) i1").selectExpr("i0", "i1", "if(i0 < 80, -4D, 4D) + 1e-3 * (i1 % 7) p0")
    labelled = C.cluster_modes(state, p, ["p0"], eps=0.05)
    assert {(r.half, r.label, r["count"]) for r in labelled.selectExpr("i0 < 80 half", "label").groupBy("half", "label").count().collect()} == {(True, 0, 80 * 161), (False, 1, 81 * 161)}
    with pytest.raises(ConfigurationError):
        C.cluster_modes(state, p, ["p0"], "kmeans")


def test_components_of_chains(spark):
    rng = np.random.default_rng(5)
    names = rng.permutation(400).tolist()
    edges = [(names[i], names[i + 1]) for i in range(399) if i % 100 != 99] + [(1000, 1000)]
    want = {1000: 1000}
    for lo in range(0, 400, 100):
        want |= {v: min(names[lo : lo + 100]) for v in names[lo : lo + 100]}
    got = C.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def refined(spark, rows, factor=2, **more):
    t = Target("himmelblau", 4)
    p = Projection.of([0, 1], [6, 4], BOX)
    state = spark.createDataFrame(rows, "i0 int, i1 int, p0 double, p1 double")
    scan = Scan(spark, t, ScanConfig(roi_threshold=1e6, refine_direct=True, **more))
    full = state.withColumn("logl", scan.value(p)).selectExpr("i0", "i1", "logl", "p0", "p1", "1L evals", "true done", "1 phase", "cast(null as array<struct<s: array<double>, y: array<double>>>) curv")
    coarse = Result(p, full, {"cells": len(rows), "start_evaluations": 0})
    return scan, p, coarse, scan.refine(coarse, factor)


def test_refined_cells_take_the_best_candidate(spark):
    """Two modes side by side: between them the interpolated parameters lie far off, and a mode's own win."""
    rows = [(i, j, *((3.0, 2.0) if i < 3 else (-3.779310253377747, -3.283185991286170))) for i in range(7) for j in range(5)]
    plain = refined(spark, rows, clustering=None)[3]
    scan, p, coarse, fine = refined(spark, rows, cluster_eps=0.9)
    a, b = ({(r.i0, r.i1): r for r in x.state.collect()} for x in (plain, fine))
    assert len(a) == len(b) == 13 * 9
    assert all(b[c].logl >= a[c].logl for c in a)
    for c, r in b.items():  # every new cell sits on one of the modes, nothing lies between
        assert min(abs(r.p0 - 3), abs(r.p0 + 3.779310253377747)) < 1e-9, c
    assert a[(5, 1)].p0 == pytest.approx((3.0 - 3.779310253377747) / 2) and b[(5, 1)].logl > a[(5, 1)].logl
    assert fine.metrics["tests"] == scan._tests > len(b) - len(rows)


def test_statuses_and_coverage(spark):
    kinds = "i0 int, i1 int, logl double, p0 double, p1 double, evals long, done boolean, phase int, curv array<struct<s: array<double>, y: array<double>>>"
    cells = [(0, 0, 1, True), (0, 1, 1, False), (1, 1, 2, False), (2, 2, 3, True)]
    state = spark.createDataFrame([(i, j, -1.0, 0.0, 0.0, 2, done, phase, None) for i, j, phase, done in cells], kinds)
    scan, p, *_ = refined(spark, [(0, 0, 0.0, 0.0)], clustering=None)
    m = scan._metrics(state, p, 0, 1)
    assert (m["cells"], m["converged"], m["active"], m["optimized"], m["coverage"]) == (4, 2, 1, 2, 4 / 35)
    done = {(r.i0, r.i1): r.status for r in Result(p, state, m).finished.collect()}
    assert done == {(0, 0): "converged", (1, 1): "optimized", (2, 2): "optimized"}
    assert S.coverage(state, p).first().cells == 4 and S.coverage(state.limit(0), p).first().coverage == 0


def test_few_cells_give_the_nearest_ones_parameters(spark):
    rows = [(0, 0, 3.0, 2.0), (1, 1, -2.8, 3.1), (2, 2, 1.0, 1.0)]  # three: fewer than the corners of one cell
    fine = refined(spark, rows, clustering=None)[3]
    got = {(r.i0, r.i1): (r.p0, r.p1) for r in fine.state.collect()}
    for (i, j), phi in got.items():
        near = min(rows, key=lambda r: (((i / 2 - r[0]) * 2.0) ** 2 + ((j / 2 - r[1]) * 3.0) ** 2, r[0], r[1]))
        assert phi == near[2:]
    assert len(got) > len(rows)


def test_settings_of_modes_are_checked():
    for bad in ({"clustering": "optics"}, {"cluster_eps": 0.0}):
        with pytest.raises(ConfigurationError):
            ScanConfig(**bad)
