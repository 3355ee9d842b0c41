import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.config import ConfigurationError, InvalidProjectionError, Projection, VolumeConfig, parse_n_optima, resolve_dims
from ridgeline.functions import targets as T
from ridgeline.functions.nuisance import Nuisance, default_coupling, presets
from ridgeline.functions import sampling as Q
from ridgeline.plans import kernels as K


@pytest.mark.parametrize("name", T.names())
def test_targets_reach_their_peaks(name):
    t = T.get(name)
    for peak in t.peaks:
        assert abs(float(t(np.array(peak)))) < 1e-2
    x = np.array([[lo + (hi - lo) * 0.3 for lo, hi in t.bounds]])
    assert np.isfinite(t(x)).all() and len(t.bounds) == t.dims


def test_expressions_equal_their_twins(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    for name in T.names():
        t = T.get(name)
        b = np.array(t.bounds)
        x = b[:, 0] + rng.random((20, t.dims)) * (b[:, 1] - b[:, 0])
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"x{k}" for k in range(t.dims)]).withColumn("f", t.column([f"x{k}" for k in range(t.dims)]))
        got = np.array([r.f for r in df.coalesce(1).select(F.col("f")).collect()])
        assert np.allclose(np.sort(got), np.sort(t(x)), rtol=1e-9, atol=1e-9), name


def test_unknown_target():
    with pytest.raises(ValueError, match="known"):
        T.get("nothing_2d")
    with pytest.raises(ValueError):
        T.Target("eggholder", 3)


@pytest.mark.parametrize("name", ["sphere_4d", "rosenbrock_4d", "himmelblau_4d"])
def test_gradients(name):
    t = T.get(name)
    x = np.array([0.3, -1.2, 2.0, 0.7])
    num = [(float(t(x + h)) - float(t(x - h))) / 2e-6 for h in np.eye(4) * 1e-6]
    assert np.allclose(T.gradient(t.name, x), num, rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("name", ["sphere_4d", "rosenbrock_2d", "himmelblau_4d", "levy_4d"])
def test_lbfgs_improves_inside_the_box(name):
    t = T.get(name)
    b = np.array(t.bounds)
    for seed in range(5):
        x0 = b[:, 0] + np.random.default_rng(seed).random(t.dims) * (b[:, 1] - b[:, 0])
        r = K.lbfgs(t, x0, b, 200)
        assert r.value >= float(t(x0)) and (r.x >= b[:, 0]).all() and (r.x <= b[:, 1]).all()
        assert abs(r.value - float(t(r.x))) < 1e-9
    if name == "sphere_4d":
        assert r.converged and r.value > -1e-6
        g = K.lbfgs(t, x0, b, 200, gradient=lambda x: -2 * x)
        assert g.evals < r.evals and g.value > -1e-6


def test_lbfgs_leaves_an_upper_bound():
    t = T.get("sphere_2d")
    assert K.lbfgs(t, np.array([5.0, 5.0]), np.array(t.bounds)).value > -1e-6


def test_evolve_and_registry():
    t = T.get("rastrigin_2d")
    b, rng = np.array(t.bounds), K.stream(1)
    x = K.latin_hypercube(rng, 20, b)
    y, fy, evals, _ = K.evolve(t, x, t(x), b, rng, 200, 30, 1e-9)
    assert fy.max() > -1e-2 and evals > 0 and (fy >= t(x)).all()
    reg, bounds = [], np.array([[-6.0, 6.0]] * 2)
    for p, v in (((3, 2), -0.5), ((3.05, 2.03), -0.1), ((-3, -3), -1.0)):
        K.register_optimum(reg, np.array(p), v, bounds, 0.02)
    assert [e["count"] for e in reg] == [2, 1] and reg[0]["value"] == -0.1
    ten = [{"value": 0.0, "count": 10}]
    assert K.should_stop(ten, 10, 4.0, 10, 0.5, None) and not K.should_stop(ten, 5, 4.0, 10, 0.5, None)
    assert not K.should_stop(ten, 10, 4.0, 10, 0.0, None) and K.should_stop(ten, 3, 4.0, 10, 0.5, (1, 1)) and not K.should_stop(ten, 50, 4.0, 10, 0.5, (2, None))


def test_sampling_designs():
    b = np.array([[-1.0, 3.0], [0.0, 1.0]])
    x = K.latin_hypercube(K.stream(3), 50, b)
    for k in range(2):
        u = (x[:, k] - b[k, 0]) / (b[k, 1] - b[k, 0])
        assert sorted((u * 50).astype(int)) == list(range(50))


def sobol_points(n, dims):
    """The sequence by its definition, one bit of a point's number at a time."""
    out = np.zeros((n, dims), np.uint64)
    for d in range(dims):
        for k, v in enumerate(Q.sobol_directions(d)):
            out[:, d] ^= np.where(np.arange(n) >> k & 1, np.uint64(v), np.uint64(0))
    return out


def test_sobol(spark):
    dims, shift = Q.SOBOL_DIMS, 0xDEADBEEF
    want = sobol_points(4096, dims)
    cols = [Q.sobol(F.col("id"), d, shift).alias(f"u{d}") for d in range(dims)]
    got = np.array([tuple(r) for r in spark.range(4096).select("id", *cols).orderBy("id").drop("id").collect()])
    assert (got == (want ^ np.uint64(shift)) / 2**32).all()
    assert (want[:4, 1] / 2**32).tolist() == [0.0, 0.5, 0.75, 0.25] and want[4, 1] / 2**32 == 0.625 and want[4, 2] / 2**32 == 0.375
    for d in range(dims):  # every coordinate alone, and neighbouring ones in pairs, fill their boxes evenly
        assert (np.bincount((want[:, d] >> np.uint64(20)).astype(int), minlength=4096) == 1).all()
    pair = (want[:256, 0] >> np.uint64(28)) * 16 + (want[:256, 1] >> np.uint64(28))
    assert len(set(pair.tolist())) == 256
    with pytest.raises(ValueError):
        Q.sobol_directions(dims)


def test_clustering():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[20.0, 20.0]]])
    d = K.dbscan(x, 1.0, 3)
    assert set(d) == {-1, 0, 1} and d[-1] == -1 and len(set(d[:40])) == len(set(d[40:80])) == 1
    assert len(set(K.ward(x[:80], 3.0))) == 2 and len(set(K.kmeans(x[:80]))) == 2


def test_distinct_seeds():
    kept = K.distinct_seeds([np.array([3.0, -2.0]), np.array([1.0, 1.0]), np.array([1.0, 1.0001])], np.array([10.0, 10.0]))
    assert len(kept) == 2


def test_configuration():
    p = Projection.of([1, 0], [7, 3], [(-1, 1), (-2, 2)])
    assert p.dims == (0, 1) and p.grid_points == (3, 7) and p.profiled == ()
    assert resolve_dims(["y", 0], 2, ["x", "y"]) == [1, 0]
    for bad in (["z"], [2], [0, 0], [], [True]):
        with pytest.raises(InvalidProjectionError):
            resolve_dims(bad, 2, ["x", "y"])
    for bad in (0, -1, 2.5, True, "x", {"min": 5, "max": 2}, {"foo": 1}, {"min": 0}):
        with pytest.raises(ConfigurationError):
            parse_n_optima(bad)
    for bad in ({"roi_threshold": -5}, {"n_walkers": 1}, {"n_steps": 0}, {"sigma_frac": float("inf")}, {"partner_level_window": -1}, {"warm_start": 1}, {"output_file": ""}, {"other": 1}):
        with pytest.raises(ConfigurationError):
            VolumeConfig.from_dict(bad)


def test_nuisance():
    s = T.Target("sphere", 2)
    assert np.isclose(float(Nuisance(s, 2, "additive")(np.array([1, 2, 0.1, 0.2]))), -5 - 0.5 * 0.05)
    assert np.isclose(float(Nuisance(s, 2, "shift")(np.array([1, 2, 0.5, 0.3]))), -(1.5**2 + 2.3**2) - 0.5 * 0.34)
    assert Nuisance(s, 2, "additive", "uniform")(np.array([0, 0, 2.0, 0])) == -np.inf
    assert np.isclose(float(Nuisance(s, 1, "additive", "soft_uniform")(np.array([0, 0, 3.0]))), -2.0)
    n = Nuisance(s, 2, "shift")
    assert n.profiled([1.0, 1.0]) >= n.at_constraint_mean([1.0, 1.0]) and n.bounds[2] == (-5.0, 5.0)
    assert default_coupling(2, 3, "shift").sum() == 3 and len(presets()) == 14
    with pytest.raises(ValueError):
        Nuisance(s, 2, "other")
    with pytest.raises(ValueError):
        Nuisance(s, 2, matrix=np.eye(3))


def test_nuisance_presets():
    made = presets()
    wide = made["himmelblau_4d_shift_32nuis_sigma0.5"]
    assert wide.dims == 36 and wide.bounds[4] == (-2.5, 2.5) and (wide.matrix.sum(0) == 1).all()
    assert made["sphere_10d_shift_20nuis_sigma0.5"].dims == 30 and made["rosenbrock_4d_scale_8nuis_sigma0.1"].coupling == "scale"
    for n in made.values():  # at the penalty's centre the base target is left
        at = np.full(n.base.dims, 0.5)
        assert np.isclose(n.at_constraint_mean(at), n.base(at))
    narrow = Nuisance(T.Target("sphere", 2), 2, sigma=2.0, reach=3.0)
    assert narrow.bounds[2:] == [(-6.0, 6.0)] * 2


def test_nuisance_expressions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (15, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ["x0", "x1", "x2", "x3"]).coalesce(1)
    for mode in ("shift", "scale", "rotation", "additive", "mixed"):
        for pen in ("gaussian", "uniform", "soft_uniform"):
            n = Nuisance(T.Target("rosenbrock", 2), 2, mode, pen)
            got = [r[0] for r in df.selectExpr(n.sql(["x0", "x1", "x2", "x3"])).collect()]
            assert np.allclose(got, n(x), rtol=1e-9), (mode, pen)
