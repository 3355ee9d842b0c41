"""Profile scans in bulk-synchronous rounds.

A state is a table keyed by cell. A round is: find cells to work on and their start parameters by joins and
aggregations over the last state, run one kernel row per cell (a whole optimisation inside one task, its draws keyed
by seed and cell), merge by cell, store. What the driver sees is one aggregate row a round. Only frontier cells of
the region of interest are ever made.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import Projection, ScanConfig, VolumeConfig
from ridgeline.functions.phases import JOB_PHASE
from ridgeline.functions.sampling import SOBOL_BITS, log_acceptance, sobol, stretch, umbrella, uniform
from ridgeline.operators import grid as G
from ridgeline.operators import state as S
from ridgeline.operators.cluster import cluster_modes
from ridgeline.operators.pool import capacity, nearest, pool_of
from ridgeline.operators.pool import seeds as pool_seeds
from ridgeline.operators.profile import best_per_cell, histogram
from ridgeline.plans import kernels as K
from ridgeline.sources import samples as L
from ridgeline.sources.store import discarded, stored


class PyTarget:
    """A scalar Python function as a vectorised target: exceptions, NaN and +inf become -inf."""

    def __init__(self, fn: Callable, bounds: list[tuple[float, float]], gradient: Callable | None = None):
        self.fn, self.bounds, self.gradient = fn, [(float(a), float(b)) for a, b in bounds], gradient

    @property
    def dims(self) -> int:
        return len(self.bounds)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        x = np.asarray(points, dtype=float)
        out = np.empty(x.shape[:-1])
        for at in np.ndindex(out.shape):
            try:
                v = self.fn(x[at])
                v = -np.inf if v is None else float(v)
            except Exception:  # noqa: BLE001 - a target may fail anywhere
                v = -np.inf
            out[at] = -np.inf if np.isnan(v) or v == np.inf else v
        return out


def normalised_gradient(raw, n: int) -> np.ndarray:
    """An array of length n, or a mapping of dimensions to components, as an array with NaN where it says nothing."""
    if raw is None:
        raise ValueError("the gradient function returned nothing")
    if isinstance(raw, dict):
        out = np.full(n, np.nan)
        for k, v in raw.items():
            if isinstance(k, bool) or not isinstance(k, (int, np.integer)) or not 0 <= k < n:
                raise ValueError(f"gradient key {k!r} is not in 0..{n - 1}")
            out[int(k)] = float(v)
        return out
    out = np.asarray(raw, dtype=float).reshape(-1)
    if out.shape != (n,):
        raise ValueError(f"the gradient has {out.size} components, not {n}")
    return out


CALLS = "array<struct<x: array<double>, logl: double>>"
PAIRS = "array<struct<s: array<double>, y: array<double>>>"
#: Bins of the histogram in a volume summary.
HISTOGRAM = 20
#: What an optimisation counts besides its evaluations: values that were not finite, gradient components that the
#: target's own function gave, failures of that function.
COUNTS = ["failed", "saved", "gradient_failures"]


@dataclass
class Result:
    projection: Projection
    state: DataFrame
    metrics: dict
    refined: Result | None = None
    optima: list[dict] = field(default_factory=list)

    @property
    def solutions(self) -> DataFrame:
        return G.with_coordinates(self.state, self.projection)

    @property
    def finished(self) -> DataFrame:
        """The solutions of cells that are no longer active, with their status: what a grid's export holds."""
        return self.solutions.withColumn("status", S.status()).filter(F.col("status") != "active")


class Scan:
    """Scans of one target. target: vectorised callable with `bounds`; with a `sql` method, batches are expressions."""

    def __init__(self, spark: SparkSession, target, config: ScanConfig | None = None, bounds: list | None = None, partitions: int | None = None):
        self.spark, self.target, self.config = spark, target, config or ScanConfig()
        self.bounds = [(float(a), float(b)) for a, b in (bounds or target.bounds)]
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.pool: DataFrame | None = None
        self.pool_rows = 0
        self.waves: list[tuple[str, int, int]] = []  # of patching and rechecking: kind, wave, rows tested
        self._calls: list[DataFrame] = []
        self._tests = 0  # evaluations that belong to no run of an optimiser
        self._observed: list[Observation] = []

    # -- the evaluation log ------------------------------------------------------------------------------------

    def _record(self, calls: DataFrame, phase: int | None = None) -> None:
        """Keeps evaluations x0.., logl and, unless given, phase: a view of a stored table."""
        if self.config.log:
            xs = [f"x{k}" for k in range(len(self.bounds))]
            self._calls.append(calls.select(*xs, "logl", F.col("phase") if phase is None else F.lit(phase).cast("int").alias("phase")))

    def _explode(self, raw: DataFrame) -> DataFrame:
        each = raw.select("phase", F.explode("calls").alias("c"))
        return each.select(*[F.col("c.x")[k].alias(f"x{k}") for k in range(len(self.bounds))], F.col("c.logl").alias("logl"), "phase")

    def log(self) -> DataFrame:
        """x0.., logl, phase: one row for each evaluation of the target so far (config.log), in stored tables."""
        if not self._calls:
            return self.spark.createDataFrame([], ", ".join(f"x{k} double" for k in range(len(self.bounds))) + ", logl double, phase int")
        out = self._calls[0]
        for calls in self._calls[1:]:
            out = out.unionByName(calls)
        return out

    # -- one kernel row per cell -------------------------------------------------------------------------------

    def _state_schema(self, p: Projection) -> str:
        phi = ", ".join(f"p{k} double" for k in range(len(p.profiled)))
        return ", ".join(f"{c} int" for c in p.cells) + f", logl double, {phi}, evals long, done boolean, phase int, curv {PAIRS}"

    def value(self, p: Projection) -> Column:
        """The target at a cell's node and its parameters p0, p1, ..., as an expression."""
        at = {}
        for k, d in enumerate(p.dims):
            lo, hi = p.box(k)
            at[d] = f"({lo!r}D + ({hi - lo!r}D) * i{k} / {p.grid_points[k]})"
        at |= {d: f"p{k}" for k, d in enumerate(p.profiled)}
        from ridgeline.functions.targets import sanitised

        return sanitised(F.expr(self.target.sql([at[d] for d in range(len(p.bounds))])))

    def optimise(self, work: DataFrame, p: Projection, job: str, method: str | None = None, population: int = 0) -> DataFrame:
        """work, not empty: cells, `starts` (array of start parameters, nulls dropped) and, if it has one, `curv` (curvature to
        begin with); one state row per cell."""
        target, c, names = self.target, self.config, p.cells
        method = method or p.method
        bounds = np.array([p.bounds[d] for d in p.profiled]).reshape(-1, 2)
        phase = JOB_PHASE[job]
        order = np.argsort([*p.dims, *p.profiled])
        user = getattr(target, "gradient", None) if c.gradient else None
        known = c.curvature and "curv" in work.columns

        def run(frames):
            for pdf in frames:
                rows = []
                for r in pdf.itertuples(index=False):
                    cell = [int(getattr(r, n)) for n in names]
                    fixed = np.array([p.coordinate(k, i) for k, i in enumerate(cell)])
                    calls, failed = [], [0]

                    def f(phi, fixed=fixed, calls=calls, failed=failed):
                        full = np.concatenate([np.broadcast_to(fixed, (len(phi), len(fixed))), phi], axis=1)[:, order]
                        out = target(full)
                        failed[0] += int((~np.isfinite(out)).sum())
                        if c.log:
                            calls += [{"x": x.tolist(), "logl": float(v)} for x, v in zip(full, out)]
                        return out

                    def slope(phi, fixed=fixed):
                        raw = user(np.concatenate([fixed, phi])[order])
                        return normalised_gradient(raw, len(order))[list(p.profiled)]

                    rng = K.stream(c.seed, phase, *p.dims, *cell)
                    given = [np.clip(np.asarray(s, dtype=float), bounds[:, 0], bounds[:, 1]) for s in (r.starts if r.starts is not None else []) if s is not None]
                    size = max(population or c.population, 4 if method == "de" else 1)
                    extent = bounds[:, 1] - bounds[:, 0]
                    if given:
                        near = [np.clip(g + rng.normal(0, 0.1, len(extent)) * extent, bounds[:, 0], bounds[:, 1]) for g in given[:1]] if method == "de" else []
                        start = given + near
                    else:
                        start = []
                    if len(start) < size and (method == "de" or not start):
                        start += list(K.latin_hypercube(rng, size - len(start), bounds))
                    x = np.array(start)
                    fx = f(x)
                    evals = len(x)
                    best = int(fx.argmax())
                    if method == "de":
                        # all members agree already: one generation of proof is enough
                        agree = c.early_exit and len(given) > 1 and bool((np.abs(np.array(given) - np.mean(given, 0)) / extent).max() < S.AGREE)
                        x, fx, n, _ = K.evolve(f, x, fx, bounds, rng, c.generations, 1 if agree else c.window, c.convergence, given[0] if given else None)
                        evals += n
                        best = int(fx.argmax())
                    begin = [(np.array(q["s"]), np.array(q["y"])) for q in r.curv] if known and r.curv is not None else None
                    run_ = K.lbfgs(
                        f, x[best], bounds, c.max_iter, c.ftol, gradient=slope if user is not None else None, central=c.central, pairs=begin,
                        value=float(fx[best]),
                    )
                    evals += run_.evals
                    curv = [{"s": s.tolist(), "y": y.tolist()} for s, y in run_.pairs] if c.curvature else []
                    counts = (failed[0], run_.gradients, run_.failures)
                    rows.append((*cell, run_.value, *map(float, run_.x), evals, bool(run_.converged), phase, curv, *counts, calls)[: len(cols)])
                yield pd.DataFrame(rows, columns=cols)

        cols = [*names, "logl", *[f"p{k}" for k in range(len(bounds))], "evals", "done", "phase", "curv", *COUNTS, *(["calls"] if c.log else [])]
        schema = ", ".join([self._state_schema(p), *[f"{n} long" for n in COUNTS], *([f"calls {CALLS}"] if c.log else [])])
        out = work.repartition(self.partitions, *names).mapInPandas(run, schema)
        seen = Observation()
        out = out.observe(seen, F.count("*").alias("runs"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS])
        self._observed.append(seen)
        if c.log:
            out = stored(out, "calls")
            self._record(self._explode(out))
        return out.drop(*COUNTS, "calls")

    # -- stages ------------------------------------------------------------------------------------------------

    def direct(self, p: Projection) -> DataFrame:
        """All dimensions projected: one expression over the grid."""
        cells = G.grid(self.spark, p)
        values = cells.withColumn("logl", self.value(p)) if hasattr(self.target, "sql") else self._evaluated(cells, p)
        return values.select(*p.cells, "logl").withColumns({"evals": F.lit(1).cast("long"), "done": F.lit(True), "phase": F.lit(1)})

    def _evaluated(self, cells: DataFrame, p: Projection) -> DataFrame:
        target, d = self.target, len(p.bounds)
        at = {x: f"g{k}" for k, x in enumerate(p.dims)} | {x: f"p{k}" for k, x in enumerate(p.profiled)}

        def run(frames):
            for pdf in frames:
                yield pdf.assign(logl=target(pdf[[at[k] for k in range(d)]].to_numpy(float)))

        kinds = ", ".join(f"{n} {t}" for n, t in cells.dtypes)
        return cells.mapInPandas(run, f"{kinds}, logl double")

    def multistart(self) -> tuple[list[dict], int]:
        """Optima found from a Latin hypercube of starts, in batches, until the stopping rule holds; evaluations."""
        c, bounds = self.config, np.array(self.bounds)
        target = self.target
        starts = K.latin_hypercube(K.stream(c.seed, 0), c.n_starts or min(400, 50 * len(bounds)), bounds)
        registry: list[dict] = []
        evals = 0
        user = getattr(target, "gradient", None) if c.gradient else None
        slope = (lambda x: normalised_gradient(user(x), len(x))) if user is not None else None
        phase = JOB_PHASE["INITIAL_OPTIMIZATION"]

        def run(frames):
            for pdf in frames:
                out = []
                for i, x in zip(pdf["id"], pdf["x"]):
                    calls = []

                    def f(points, calls=calls):
                        values = target(points)
                        if c.log:
                            calls += [{"x": x.tolist(), "logl": float(v)} for x, v in zip(points, values)]
                        return values

                    r = K.lbfgs(f, np.array(x), bounds, 4 * c.max_iter, c.ftol, gradient=slope, central=c.central)
                    out.append((i, r.x.tolist(), r.value, r.evals, r.converged, phase, calls))
                yield pd.DataFrame(out, columns=["id", "x", "value", "evals", "converged", "phase", "calls"])

        for lo in range(0, len(starts), c.batch):
            part = [(lo + i, s.tolist()) for i, s in enumerate(starts[lo : lo + c.batch])]
            df = self.spark.createDataFrame(part, "id int, x array<double>").repartition(min(self.partitions, len(part)))
            df = df.mapInPandas(run, f"id int, x array<double>, value double, evals long, converged boolean, phase int, calls {CALLS}")
            if c.log:
                df = stored(df, "calls")
                self._record(self._explode(df))
            rows = sorted(df.drop("calls").collect(), key=lambda r: r["id"])
            for r in rows:  # at most `batch` rows, in the order of their starts
                evals += r["evals"]
            for k, r in enumerate(rows):
                if r["converged"] and np.isfinite(r["value"]):
                    K.register_optimum(registry, np.array(r["x"]), r["value"], bounds, c.merge_radius)
                if K.should_stop(registry, lo + k + 1, c.roi_threshold, c.min_starts, c.undiscovered, c.optima_range):
                    return registry, evals
        return registry, evals

    def _merge(self, state: DataFrame, new: DataFrame, p: Projection, name: str) -> DataFrame:
        """The better of old and new by cell; counts of evaluations add up."""
        phi = [f"p{k}" for k in range(len(p.profiled))]
        both = state.unionByName(new).groupBy(*p.cells).agg(
            F.min(F.struct((-F.col("logl")).alias("v"), *phi, "done", "phase", "curv")).alias("b"), F.sum("evals").alias("evals")
        )
        cols = [*p.cells, (-F.col("b.v")).alias("logl"), *[F.col(f"b.{x}").alias(x) for x in phi], "evals", *[F.col(f"b.{x}").alias(x) for x in ("done", "phase", "curv")]]
        return stored(both.select(*cols), name)

    def _starts(self, target_cells: DataFrame, state: DataFrame, p: Projection, most: int = 2, kind: str = "moore", k: int = 1) -> DataFrame:
        """cells with `starts`, parameters of the best known neighbours, the best first, and the best one's `curv`."""
        phi = F.array(*[F.col(f"p{k}_n") for k in range(len(p.profiled))])
        keys = [f"n{j}" for j in range(len(p.dims))]
        near = G.neighbours(target_cells.select(*p.cells), p, kind, k).join(G.renamed(state, p), keys)
        best = near.groupBy(*p.cells).agg(F.sort_array(F.collect_list(F.struct((-F.col("logl_n")).alias("v"), phi.alias("phi"), F.col("curv_n").alias("curv")))).alias("l"))
        return best.select(*p.cells, F.transform(F.slice("l", 1, most), lambda x: x["phi"]).alias("starts"), F.col("l")[0]["curv"].alias("curv"))

    def _near_pool(self, cells: DataFrame, p: Projection, k: int) -> DataFrame:
        """cells, near: profiled parameters of the k pool points nearest to each cell in the projected dimensions."""
        own = [f"__g{j}" for j in range(len(p.dims))]
        at = G.with_coordinates(cells.select(*p.cells), p, "__g")
        pool = self.pool.select(*[F.col(f"x{d}").alias(f"__x{d}") for d in range(len(self.bounds))], (-F.col("logl")).alias("__worse"))
        pairs = [(g, f"__x{d}", p.box(j)[1] - p.box(j)[0]) for j, (g, d) in enumerate(zip(own, p.dims))]
        ties = ["__worse", *[f"__x{d}" for d in range(len(self.bounds))]]
        found = nearest(at, pool, p.cells, pairs, k, ties, self.pool_rows, at.count())
        phi = F.array(*[F.col(f"__x{d}") for d in p.profiled])
        ordered = found.groupBy(*p.cells).agg(F.sort_array(F.collect_list(F.struct("rank", phi.alias("phi")))).alias("l"))
        return ordered.select(*p.cells, F.transform("l", lambda x: x["phi"]).alias("near"))

    def _with_pool_start(self, work: DataFrame, p: Projection) -> DataFrame:
        """work with the nearest pool point's parameters as one more start, where there is a pool."""
        if self.pool is None or not self.config.proximity:
            return work
        near = self._near_pool(work, p, 1)
        starts = F.when(F.col("near").isNull(), F.col("starts")).otherwise(F.concat(F.coalesce("starts", F.array().cast("array<array<double>>")), "near"))
        return work.join(near, p.cells, "left").withColumn("starts", starts).drop("near")

    def initial_points(self, points: DataFrame) -> int:
        """Evaluates points x0.. inside the box and adds them to what scans start from; how many there were."""
        xs = [f"x{k}" for k in range(len(self.bounds))]
        inside = points.select(*xs).filter(G.inside(xs, self.bounds))
        if hasattr(self.target, "sql"):
            tried = inside.withColumn("logl", self.target.column(xs))
        else:
            target = self.target

            def run(frames):
                for pdf in frames:
                    yield pdf.assign(logl=target(pdf[xs].to_numpy(float)))

            tried = inside.mapInPandas(run, ", ".join(f"{x} double" for x in xs) + ", logl double")
        tried = stored(tried, "initial")
        self._record(tried, JOB_PHASE["INITIAL_POINT_EVAL"])
        self._into_pool(tried.select(*xs, "logl"))
        return tried.count()

    def _into_pool(self, points: DataFrame) -> None:
        """The best of the pool and of points x0.., logl, as many as a pool holds; ties to the smallest coordinates."""
        xs = [f"x{k}" for k in range(len(self.bounds))]
        both = points.select(*xs, "logl") if self.pool is None else self.pool.unionByName(points.select(*xs, "logl"))
        was, self.pool = self.pool, stored(pool_of(both, len(self.bounds), "logl", *xs), "pool")
        self.pool_rows = capacity(len(self.bounds))
        if was is not None:
            discarded(was)

    def run(self, p: Projection, warm: DataFrame | None = None) -> Result:
        """One projection. warm: logged points x0.. and logl; with seeds from it, or from the pool, no multistart."""
        c = self.config
        self._tests, self._observed = 0, []
        if not p.profiled:
            state = stored(self.direct(p), "direct")
            at = {d: F.col(f"g{k}") for k, d in enumerate(p.dims)}
            self._record(G.with_coordinates(state, p).select(*[at[d].alias(f"x{d}") for d in range(len(p.bounds))], "logl", "phase"))
            return Result(p, state, self._metrics(state, p, 0, 0))
        d = len(p.bounds)
        xs = [f"x{k}" for k in range(d)]
        known = None
        for points in (warm, self.pool):
            if points is not None:
                points = points.select(*xs, "logl")
                known = points if known is None else known.unionByName(points)
        optima, extra = [], 0
        seeded = None
        if known is not None:
            seeded = stored(pool_seeds(known, p, c.roi_threshold, xs), "seeds")
            if seeded.isEmpty():
                seeded = None
        if seeded is None:
            optima, extra = self.multistart()
            rows = [(*map(float, o["point"]), float(o["value"])) for o in optima]
            if not rows:
                raise ValueError("no start found a finite value")
            points = self.spark.createDataFrame(rows, ", ".join(f"{x} double" for x in xs) + ", logl double")
            seeded = best_per_cell(G.with_cells(points, p), p.cells, "logl", xs)
        phi = F.array(*[F.col(f"x{k}") for k in p.profiled])
        first = seeded.select(*p.cells, phi.alias("phi"), "logl")
        around = G.neighbours(first, p, centre=True).select(*[F.col(f"n{j}").alias(f"i{j}") for j in range(len(p.dims))], "phi", "logl")
        work = around.groupBy(*p.cells).agg(F.sort_array(F.collect_list(F.struct((-F.col("logl")).alias("v"), "phi"))).alias("l"))
        work = stored(work.select(*p.cells, F.transform(F.slice("l", 1, 3), lambda x: x["phi"]).alias("starts")), "first")
        if p.method == "de_table":
            from ridgeline.plans.evolution import evolve_table

            state, rounds = evolve_table(self, work, p)
        else:
            state, rounds = stored(self.optimise(self._with_pool_start(work, p), p, "ACTIVATE_GRID_POINT"), "state"), 1
        while p.method != "de_table":
            top = state.agg(F.max("logl").alias("m")).first()["m"]
            active = state.filter(F.col("logl") > top - c.roi_threshold)
            front = stored(G.frontier(active, state, p), "front")
            if front.isEmpty():
                break
            new = self.optimise(self._with_pool_start(self._starts(front, state, p), p), p, "LBFGSB_LOOP" if p.method == "lbfgs" else "DE_GRID_POINT")
            new, was = stored(state.unionByName(new), "state"), state
            state = new
            discarded(front, was)
            rounds += 1
        if p.patch:
            state = self.patch(state, p)
            if c.suspect:
                state = self.recheck(state, p)
        result = Result(p, state, self._metrics(state, p, extra, rounds), optima=optima)
        self._remember(result)
        if p.refine > 1:
            result.refined = self.refine(result, p.refine)
        return result

    def _tested(self, tests: DataFrame, p: Projection, phase: str, wave: int) -> DataFrame:
        """tests (cells, p0.., other columns) with the target's value, stored, counted and logged."""
        tests = G.with_coordinates(tests, p)
        tried = tests.withColumn("logl", self.value(p)) if hasattr(self.target, "sql") else self._evaluated(tests, p)
        tried = stored(tried, "tried")
        n = tried.count()
        self._tests += n
        self.waves.append((phase, wave, n))
        at = {d: F.col(f"g{k}") for k, d in enumerate(p.dims)} | {d: F.col(f"p{k}") for k, d in enumerate(p.profiled)}
        self._record(tried.select(*[at[d].alias(f"x{d}") for d in range(len(p.bounds))], "logl"), JOB_PHASE[phase])
        return tried

    def patch(self, state: DataFrame, p: Projection) -> DataFrame:
        """Waves: the best neighbour's parameters are tried at each cell, and polished where they win. The first wave
        looks at the region and its border, a later one at the neighbours of the cells that the one before improved."""
        phi = [f"p{k}" for k in range(len(p.profiled))]
        among = None
        for wave in range(self.config.max_waves):
            tests = S.patch_candidates(state, p, phi, self.config.roi_threshold) if among is None else S.better_neighbours(state, p, phi, among)
            tests = tests.select(*p.cells, F.col("logl").alias("own"), *[F.col(f"{x}_n").alias(x) for x in phi])
            tried = self._tested(tests, p, "PATCHING_TEST", wave)
            won = tried.filter(F.col("logl") > F.col("own") + self.config.convergence)
            if won.isEmpty():
                return state
            state, among = self._polished(state, won.select(*p.cells, F.array(F.array(*phi)).alias("starts")), p, "PATCHING_LBFGSB")
            if among is None:
                return state
        return state

    def _polished(self, state: DataFrame, work: DataFrame, p: Projection, job: str) -> tuple[DataFrame, DataFrame | None]:
        """state after runs from work, and the cells of state next to those that improved, None if none did."""
        merged = self._merge(state, self.optimise(work, p, job, "lbfgs"), p, "polished")
        better = S.improved(merged.select(*p.cells, (F.col("logl") - self.config.convergence).alias("logl")), state, p)
        among = stored(S.around(better, merged, p), "among")
        return merged, None if among.isEmpty() else among

    def recheck_seeds(self, odd: DataFrame, state: DataFrame, p: Projection) -> DataFrame:
        """cells, seeds: for each cell of odd its own parameters, those of the three best neighbours that are not odd and
        of the three best such cells at a distance of 2 to 3, and of the three nearest pool points; each but those
        close to an earlier one."""
        phi = [f"p{k}" for k in range(len(p.profiled))]
        extents = [p.bounds[d][1] - p.bounds[d][0] for d in p.profiled]
        sane = state.join(odd, p.cells, "left_anti")
        parts = [
            state.join(odd, p.cells, "left_semi").select(*p.cells, F.array(F.array(*phi)).alias("starts")),
            self._starts(odd, sane, p, 3).drop("curv"), self._starts(odd, sane, p, 3, "ring", 3).drop("curv"),
        ]
        if self.pool is not None and self.config.proximity:
            parts.append(self._near_pool(odd, p, 3).withColumnRenamed("near", "starts"))
        seeds = None
        for k, part in enumerate(parts):
            part = part.select(*p.cells, F.lit(k).alias("o"), "starts")
            seeds = part if seeds is None else seeds.unionByName(part)
        listed = seeds.groupBy(*p.cells).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "starts"))), lambda x: x["starts"])).alias("seeds"))
        return listed.withColumn("seeds", S.apart(F.col("seeds"), extents))

    def recheck(self, state: DataFrame, p: Projection) -> DataFrame:
        """Cells whose parameters stand out try other cells' parameters, and are polished from the best seed that gains
        more than 1e-3. Later waves look at the neighbours of the cells that improved."""
        c = self.config
        phi = [f"p{k}" for k in range(len(p.profiled))]
        extents = [p.bounds[d][1] - p.bounds[d][0] for d in p.profiled]
        odd = stored(S.suspects(state, p, phi, extents, c.roi_threshold, c.suspect_k, c.suspect_fraction).select(*p.cells), "suspects")
        if odd.isEmpty():
            return state
        for wave in range(c.max_waves):
            seeds = self.recheck_seeds(odd, state, p).filter(F.size("seeds") > 1)
            own = state.select(*p.cells, F.col("logl").alias("own"))
            each = seeds.select(*p.cells, F.explode("seeds").alias("__s")).join(own, p.cells)
            tried = self._tested(each.select(*p.cells, "own", *[F.col("__s")[k].alias(x) for k, x in enumerate(phi)]), p, "SUSPECT_RECHECK", wave)
            best = tried.filter(F.col("logl") > F.col("own") + c.suspect_gain).groupBy(*p.cells)
            won = best.agg(F.min(F.struct((-F.col("logl")).alias("v"), F.array(*phi).alias("phi"))).alias("b"))
            won = stored(won.select(*p.cells, F.array("b.phi").alias("starts")), "won")
            if won.isEmpty():
                return state
            state, odd = self._polished(state, won, p, "SUSPECT_RECHECK_LBFGSB")
            if odd is None:
                return state
        return state

    def refine(self, coarse: Result, factor: int) -> Result:
        """The grid with factor times the intervals: coarse nodes keep their values, others start from interpolated parameters
        (the nearest cell's where there are fewer cells than one has corners), or are evaluated there (refine_direct)."""
        c, p = self.config, coarse.projection
        fine = p.refined(factor)
        phi = [f"p{k}" for k in range(len(p.profiled))]
        top = coarse.state.agg(F.max("logl").alias("m")).first()["m"]
        kept = G.coarse_to_fine(coarse.state, p, factor)
        corners = G.neighbours(coarse.state.filter(F.col("logl") >= top - c.roi_threshold).select(*p.cells), p, centre=True)
        corners = corners.select(*[F.col(f"n{j}").alias(f"i{j}") for j in range(len(p.dims))]).distinct()
        cells = G.fine_cells(corners, p, factor).join(kept.select(*p.cells), p.cells, "left_anti")
        if coarse.metrics["cells"] >= 2 ** len(p.dims):
            guess = G.interpolated(cells, coarse.state, p, factor, ["logl", *phi])
        else:  # too few cells for any cell's corners
            guess = self._near_coarse(cells, coarse.state, p, factor, 1, coarse.metrics["cells"]).select(*p.cells, "logl", *phi)
        guess = guess.filter(F.col("logl") >= top - c.roi_threshold)
        work = stored(guess.select(*p.cells, F.array(F.array(*phi)).alias("starts")), "guesses")
        if work.isEmpty():
            new = None
        elif c.refine_direct:
            new = self._best_candidates(work, coarse, fine, factor)
        else:
            new = self.optimise(work, fine, "REFINEMENT_LBFGSB", "lbfgs")
        state = stored(kept if new is None else kept.unionByName(new), "refined")
        if c.patch_refined:
            state = self.patch(state, fine)
        return Result(fine, state, self._metrics(state, fine, coarse.metrics["start_evaluations"], 1))

    def _near_coarse(self, cells: DataFrame, coarse: DataFrame, p: Projection, factor: int, k: int, n: int) -> DataFrame:
        """Each fine cell with the k nearest of the n coarse cells by coordinates, ties to the smallest cell."""
        at = [f"__c{j}" for j in range(len(p.dims))]
        nodes = coarse.select(*[(F.col(c) * factor).alias(a) for c, a in zip(p.cells, at)], *[x for x in coarse.columns if x not in p.cells])
        pairs = [(c, a, p.grid_points[j] * factor / (p.box(j)[1] - p.box(j)[0])) for j, (c, a) in enumerate(zip(p.cells, at))]
        return nearest(cells.select(*p.cells), nodes, p.cells, pairs, k, at, n, cells.count())

    def mode_candidates(self, cells: DataFrame, coarse: Result, factor: int) -> DataFrame | None:
        """cells, label, p0..: for fine cells that have a mode's border among their six nearest coarse cells, and two modes
        or more, each mode's mean parameters by inverse distance. None without borders."""
        c, p = self.config, coarse.projection
        phi = [f"p{k}" for k in range(len(p.profiled))]
        modes = stored(cluster_modes(coarse.state.select(*p.cells, "logl", *phi), p, phi, c.clustering, eps=c.cluster_eps, flat=c.cluster_flat), "modes")
        edge = S.boundary_cells(modes, p).withColumn("edge", F.lit(1))
        marked = stored(modes.join(edge, p.cells, "left").fillna(0, ["edge"]), "marked")
        if marked.filter("edge = 1").isEmpty():
            return None
        six = stored(self._near_coarse(cells, marked, p, factor, 6, coarse.metrics["cells"]), "six")
        several = six.groupBy(*p.cells).agg(F.max("edge").alias("e"), F.size(F.collect_set(F.when(F.col("label") >= 0, F.col("label")))).alias("m"))
        torn = several.filter("e = 1 AND m > 1").select(*p.cells)
        return S.inverse_distance_candidates(six.filter("label >= 0").join(torn, p.cells, "left_semi"), p.cells, phi)

    def _best_candidates(self, work: DataFrame, coarse: Result, fine: Projection, factor: int) -> DataFrame:
        """State rows of the fine cells in work: the best of the interpolated parameters and each near mode's, as they are."""
        phi = [f"p{k}" for k in range(len(fine.profiled))]
        tests = work.select(*fine.cells, F.lit(-1).alias("label"), *[F.col("starts")[0][k].alias(x) for k, x in enumerate(phi)])
        modes = self.mode_candidates(work, coarse, factor) if self.config.clustering else None
        if modes is not None:
            tests = tests.unionByName(modes.select(*tests.columns))
        tried = self._tested(tests, fine, "ACTIVATE_GRID_POINT", 0)
        best = tried.groupBy(*fine.cells).agg(F.min(F.struct((-F.col("logl")).alias("v"), "label", *phi)).alias("b"))
        return best.select(
            *fine.cells, (-F.col("b.v")).alias("logl"), *[F.col(f"b.{x}").alias(x) for x in phi], F.lit(0).cast("long").alias("evals"), F.lit(True).alias("done"),
            F.lit(JOB_PHASE["ACTIVATE_GRID_POINT"]).cast("int").alias("phase"), F.lit(None).cast(PAIRS).alias("curv"),
        )

    def _remember(self, r: Result) -> None:
        p = r.projection
        s = r.solutions
        at = {d: F.col(f"g{k}") for k, d in enumerate(p.dims)} | {d: F.col(f"p{k}") for k, d in enumerate(p.profiled)}
        self._into_pool(s.select(*[at[d].alias(f"x{d}") for d in range(len(p.bounds))], "logl"))

    def _metrics(self, state: DataFrame, p: Projection, extra: int, rounds: int) -> dict:
        """Counts of a result. What optimisers counted besides evaluations was observed in the jobs that ran them."""
        at = [F.count_if(S.status() == x).alias(x) for x in ("active", "optimized")]
        r = state.agg(F.count("*").alias("cells"), F.sum("evals").alias("evals"), F.max("logl").alias("best"), F.count_if("done").alias("done"), *at).first()
        seen = [o.get for o in self._observed]
        counts = {n: sum(o[n] for o in seen) for n in ("runs", *COUNTS)}
        return {
            "cells": r["cells"], "evaluations": (r["evals"] or 0) + extra + self._tests, "start_evaluations": extra, "tests": self._tests,
            "best": r["best"], "converged": r["done"], "active": r["active"], "optimized": r["optimized"],
            "coverage": r["cells"] / math.prod(g + 1 for g in p.grid_points), "rounds": rounds, **counts,
        }

    def run_all(self, projections: list[Projection], warm: DataFrame | None = None) -> list[Result]:
        """Projections in turn; each after the first starts from what is known, and a warm start file serves all of them."""
        return [self.run(p, warm) for p in projections]


def partner_index(walker: Column, half: int, walkers: int, size: int, window: float | None, u: Column) -> Column:
    """The place, among the `size` walkers of the other half, of a walker's partner. Walkers are numbered by level, so those
    within `window` levels are a range of numbers; where it holds none of the other half, the whole half is drawn from."""
    whole = F.floor(u * size)
    if window is None:
        return whole.cast("int")
    reach, odd = math.floor(window + 1e-9), 1 - half
    low = F.greatest(F.lit(0), F.ceil((walker - reach - odd) / 2))
    high = F.least(F.lit(size - 1), F.floor((walker + reach - odd) / 2))
    return F.when(high >= low, low + F.floor(u * (high - low + 1))).otherwise(whole).cast("int")


def sample_volume(scan: Scan, results: list[Result], config: VolumeConfig, log: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Samples of the region within roi_threshold of the best value: (points x0.. and logl, summary).

    Walkers sit at levels below the maximum and move by stretch steps between two halves of the ensemble. All draws
    are hashes of (seed, sweep, walker), the frozen half is joined by walker number, and every evaluation is kept.
    """
    spark, d, seed = scan.spark, len(scan.bounds), scan.config.seed
    if any(not r.projection.profiled for r in results):
        raise ValueError("a projection spans all dimensions; its grid is the volume")
    top = max(r.metrics["best"] for r in results)
    roi, w = config.roi_threshold, config.n_walkers
    xs = [f"x{k}" for k in range(d)]
    sigma = config.sigma_frac * roi
    shifts = [int(v) for v in K.stream(seed, 77).integers(0, 1 << SOBOL_BITS, d)]
    drawn = [(F.lit(lo) + F.lit(hi - lo) * sobol(F.col("id"), k, shifts[k])).alias(xs[k]) for k, (lo, hi) in enumerate(scan.bounds)]

    # draws in growing batches, until w seeds lie inside or 10,000 a walker are drawn
    rows, lo, hi = [], 0, min(10_000 * w, 1 << 18)
    while len(rows) < w and lo < 10_000 * w:
        cand = spark.range(lo, hi).select("id", *drawn)
        inside = G.envelope(cand, [(r.projection, r.state) for r in results], top - roi).orderBy("id").limit(w - len(rows))
        rows += sorted(inside.collect(), key=lambda r: r["id"])  # at most n_walkers rows
        lo, hi = hi, min(10_000 * w, 4 * hi)
    if 2 <= len(rows) < w:
        warnings.warn(f"{len(rows)} of {w} walkers: no more of {lo} draws lie inside the envelope", stacklevel=2)
    if len(rows) < 2:
        raise ValueError("fewer than two seeds lie inside the envelope")
    w = len(rows)
    start = [(k, *[float(r[x]) for x in xs], top - (k + 0.5) / w * roi) for k, r in enumerate(rows)]
    kinds = "w int, " + ", ".join(f"{x} double" for x in xs) + ", level double"
    walkers = spark.createDataFrame(start, kinds)
    if log is not None and config.warm_start:
        # a band join: each logged point and each level meet in a bucket of width sigma
        # the product is never null: a quotient would be tested for null, with all of logl in it, where the log is read
        bucket = lambda c: F.floor(F.col(c) * F.lit(1 / sigma))
        lv = walkers.select("w", "level", F.explode(F.array(*[bucket("level") + k for k in (-1, 0, 1)])).alias("b"))
        near = log.select(*xs, "logl", bucket("logl").alias("b")).join(F.broadcast(lv), "b")
        near = near.filter(F.abs(F.col("logl") - F.col("level")) <= sigma)
        pick = near.groupBy("w").agg(F.min(F.struct(F.xxhash64("w", *xs).alias("h"), *xs)).alias("s"))
        walkers = walkers.join(pick, "w", "left").select("w", *[F.coalesce(F.col(f"s.{x}"), F.col(x)).alias(x) for x in xs], "level")

    def evaluated(df: DataFrame) -> DataFrame:
        if hasattr(scan.target, "sql"):
            return df.withColumn("logl", scan.target.column(xs))
        target = scan.target

        def run(frames):
            for pdf in frames:
                yield pdf.assign(logl=target(pdf[xs].to_numpy(float)))

        return df.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", logl double")

    def half_step(all_: DataFrame, sweep: int, half: int) -> DataFrame:
        mine, frozen = all_.filter(F.col("w") % 2 == half), all_.filter(F.col("w") % 2 != half)
        size = (w + half) // 2  # walkers of the other half
        partner = partner_index(F.col("w"), half, w, size, None if config.partner_level_window is None else config.partner_level_window * w / roi, uniform("w", F.lit(sweep), F.lit(seed)))
        z = stretch(uniform("w", F.lit(sweep), F.lit(seed + 1)))
        other = frozen.select(F.expr("cast(w div 2 as int)").alias("__k"), *[F.col(x).alias(f"{x}_o") for x in xs])
        both = mine.withColumns({"__k": partner, "z": z}).join(F.broadcast(other), "__k")
        tried = both.select(
            "w", "level", "z", F.col("logl").alias("old"), *[F.col(x).alias(f"{x}_was") for x in xs],
            *[(F.col(f"{x}_o") + F.col("z") * (F.col(x) - F.col(f"{x}_o"))).alias(x) for x in xs],
        )
        tried = evaluated(tried)
        ok = G.inside(xs, scan.bounds) if config.stay_in_box else F.lit(True)
        gain = log_acceptance(F.col("z"), d, umbrella(F.col("logl"), F.col("level"), F.lit(sigma)), umbrella(F.col("old"), F.col("level"), F.lit(sigma)))
        accept = ok & (gain > F.ln(uniform("w", F.lit(sweep), F.lit(seed + 2))))
        return tried.withColumns({"in_box": ok, "accept": accept})

    current = stored(evaluated(walkers), "walkers")
    scan._record(current, JOB_PHASE["VOLUME"])
    made = [current.select(*xs, "logl")]
    evals, sweeps, accepted, budget = w, 0, 0, config.eval_budget
    for sweep in range(config.n_steps if budget is None else max(budget // w, 1)):
        for half in (0, 1):
            size = (w + 1 - half) // 2
            if budget is not None and evals + size > budget:
                break
            step = stored(half_step(current, 2 * sweep + half, half), "step")
            scan._record(step, JOB_PHASE["VOLUME"])
            made.append(step.filter("in_box").select(*xs, "logl"))
            moved = step.select("w", *[F.when(F.col("accept"), F.col(x)).otherwise(F.col(f"{x}_was")).alias(x) for x in xs], "level", F.when(F.col("accept"), F.col("logl")).otherwise(F.col("old")).alias("logl"))
            accepted += step.agg(F.count_if("accept").alias("n")).first()["n"]
            current = stored(moved.unionByName(current.filter(F.col("w") % 2 != half)), "walkers")
            evals += size
        else:
            sweeps += 1
            continue
        break
    samples = made[0]
    for m in made[1:]:
        samples = samples.unionByName(m)
    best = max(top, samples.agg(F.max("logl").alias("m")).first()["m"])
    band = stored(samples.filter((F.col("logl") > float("-inf")) & (F.col("logl") >= best - roi)), "band")
    n = band.count()
    summary = {
        "n_walkers": w, "n_sweeps": sweeps, "n_evaluations": evals, "n_samples": n, "in_band": n / evals, "acceptance": accepted / max(evals - w, 1),
        "final_max": best, "drift": best - top,
    }
    if config.output_file:
        edges = {"lo": best - roi, "hi": best}
        counts = {r["bin"]: r["n"] for r in histogram(band, "logl", best - roi, best, HISTOGRAM).collect()} if n else {}
        summary["histogram"] = {**edges, "counts": [counts.get(k, 0) for k in range(HISTOGRAM)]}
        L.write_volume_output(band, summary, config.output_file, config.summary_file)
    return band, summary
