"""Differential evolution over the whole table of cells.

A generation reads a snapshot: every cell's members, every cell's best member as a parent, and the best tenth of these as
the archive. A trial moves a member towards a draw from the archive or, where a neighbour is better and a draw says so,
towards that neighbour, plus a difference of two parents; all are fetched by an equi-join of the trials on drawn ranks of
the parents. Draws are hashes of (seed, generation, cell, slot), so partitions and retries change nothing. Trials replace
their members where they are better; what the successful ones used feeds a memory that later generations draw from, by
one aggregate row a generation. Cells whose gains have faded are polished, and cells around the region join.

With fewer than 4 cells or 3 parents there is nothing to learn from other cells: cells go to the polish at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.config import Projection
from ridgeline.functions.phases import JOB_PHASE
from ridgeline.functions.sampling import uniform
from ridgeline.operators import grid as G
from ridgeline.operators import state as S
from ridgeline.operators.rank import ranked
from ridgeline.plans import kernels as K
from ridgeline.sources.store import discarded, stored

LEAST_CELLS, LEAST_PARENTS = 4, 3
#: The memory's size for each interval of the longest axis, its first content, spreads of draws.
MEMORY_PER_INTERVAL, MEMORY_START, SPREAD = 25, 0.5, 0.1
FROM_NEIGHBOURS, FROM_POOL, NUDGE = 0.5, 0.25, 0.1
MEMBER = "struct<fit: double, phi: array<double>>"


class Memory:
    """A ring of scales F and crossover rates CR that worked; one mean of each joins after a generation with successes."""

    def __init__(self, size: int):
        self.size, self.at = size, 0
        self.f: list[float] = []
        self.cr: list[float] = []

    def add(self, f: float, cr: float) -> None:
        if len(self.f) < self.size:
            self.f.append(f), self.cr.append(cr)
        else:
            self.f[self.at], self.cr[self.at] = f, cr
        self.at = (self.at + 1) % self.size

    def drawn(self, u: Column) -> tuple[Column, Column]:
        """F and CR at a random place; places not written yet hold the start."""
        at = F.floor(u * self.size).cast("int")

        def of(values: list[float]) -> Column:
            if not values:
                return F.lit(MEMORY_START)
            return F.when(at < len(values), F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.least(at, F.lit(len(values) - 1)) + 1)).otherwise(MEMORY_START)

        return of(self.f), of(self.cr)


def drawn_scale(centre: Column, u: Column) -> Column:
    """A Cauchy draw around centre under the condition that it is positive, at most 1."""
    below = F.lit(0.5) - F.atan(centre / SPREAD) / math.pi  # the chance of a draw below 0
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-12), centre + SPREAD * F.tan(F.lit(math.pi) * (below + (1 - below) * u - 0.5))))


def drawn_rate(centre: Column, u: Column, v: Column) -> Column:
    """A normal draw around centre, cut to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), centre + SPREAD * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)))


class Evolution:
    def __init__(self, scan, p: Projection):
        self.scan, self.p, self.c = scan, p, scan.config
        self.phi = [f"p{k}" for k in range(len(p.profiled))]
        self.bounds = [p.bounds[d] for d in p.profiled]
        self.extents = [hi - lo for lo, hi in self.bounds]
        self.memory = Memory(MEMORY_PER_INTERVAL * max(p.grid_points))
        self.generation = 0

    def draw(self, what: int, *more: str) -> Column:
        keys = [F.lit(self.c.seed), F.lit(self.generation), F.lit(what), *[F.col(c) for c in self.p.cells], *[F.col(m) for m in more]]
        return uniform(*keys)

    # -- new cells ---------------------------------------------------------------------------------------------

    def activated(self, front: DataFrame) -> DataFrame:
        """Members of new cells, evaluated: the warm start and nudges of it, draws from the pool, a Latin hypercube
        whose last place goes to the pool's nearest point. front, not empty: cells, starts (the warm start first)."""
        scan, p, c = self.scan, self.p, self.c
        size = max(c.population, 2)
        from_pool = int(FROM_POOL * size) if scan.pool is not None else 0
        if scan.pool is not None:
            if from_pool:
                front = front.join(self._from_pool(front, from_pool), p.cells, "left")
            if c.proximity:
                front = front.join(scan._near_pool(front, p, 1), p.cells, "left")
        for name in ("others", "near"):
            if name not in front.columns:
                front = front.withColumn(name, F.lit(None).cast("array<array<double>>"))
        box, seed, names = np.array(self.bounds), c.seed, p.cells
        cols = [*names, "slot", "warm", *self.phi]

        def run(frames):
            for pdf in frames:
                rows = []
                for r in pdf.itertuples(index=False):
                    cell = [int(getattr(r, n)) for n in names]
                    rng = K.stream(seed, 501, *p.dims, *cell)
                    given = [np.array(s, float) for s in (r.starts if r.starts is not None else [])]
                    warm = max(1, int(FROM_NEIGHBOURS * size)) if given else 0
                    some = [given[0], *[given[0] + rng.normal(0, NUDGE, len(box)) * (box[:, 1] - box[:, 0]) for _ in range(warm - 1)]] if warm else []
                    some += [np.array(s, float) for s in (r.others if r.others is not None else [])]
                    rest = K.latin_hypercube(rng, max(size - len(some), 0), box)
                    if len(rest) and r.near is not None and len(r.near):
                        rest[-1] = np.array(r.near[0], float)
                    some += list(rest)
                    rows += [(*cell, k, k < warm, *np.clip(x, box[:, 0], box[:, 1]).tolist()) for k, x in enumerate(some[:size])]
                yield pd.DataFrame(rows, columns=cols)

        kinds = ", ".join([*[f"{n} int" for n in names], "slot int", "warm boolean", *[f"{x} double" for x in self.phi]])
        made = front.repartition(scan.partitions, *names).mapInPandas(run, kinds)
        each = self._valued(made, "ACTIVATE_GRID_POINT")
        member = F.struct(F.col("logl").alias("fit"), F.array(*self.phi).alias("phi")).cast(MEMBER)
        # the best first: a smaller negative, then the smaller slot
        packed = each.groupBy(*names).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("slot", member.alias("m")))), lambda x: x["m"]).alias("members"),
            F.min(F.struct((-F.col("logl")).alias("v"), "slot", "warm")).alias("b"), F.count("*").alias("evals"),
        )
        return packed.select(
            *names, "members", (-F.col("b.v")).alias("best"), F.element_at("members", F.col("b.slot") + 1)["phi"].alias("phi"),
            F.array().cast("array<double>").alias("gains"), F.lit("active").alias("status"), F.col("b.warm").alias("warm"),
            F.lit(self.c.window).alias("window"), F.col("evals").cast("long").alias("evals"), F.lit(None).cast("array<struct<f: double, cr: double>>").alias("won"),
        )

    def _from_pool(self, front: DataFrame, n: int) -> DataFrame:
        """cells, others: n different pool points for each cell, by drawn ranks."""
        p = self.p
        pool, rows = ranked(self.scan.pool, [F.desc("logl"), *[f"x{d}" for d in range(len(p.bounds))]], "__rank")
        step = max(rows // max(n, 1), 1)
        first, jump = F.floor(self.draw(1) * rows), 1 + F.floor(self.draw(2) * (step - 1))
        want = front.select(*p.cells, F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(n, rows) - 1)), lambda j: (first + j * jump) % rows)).alias("__rank"))
        some = pool.select(F.col("__rank"), F.array(*[F.col(f"x{d}") for d in p.profiled]).alias("phi"))
        found = want.join(some, "__rank").groupBy(*p.cells).agg(F.array_sort(F.collect_list(F.struct("__rank", "phi"))).alias("l"))
        return found.select(*p.cells, F.transform("l", lambda x: x["phi"]).alias("others"))

    def _valued(self, points: DataFrame, job: str) -> DataFrame:
        """points (cells, p0.., others) with logl; logged if the scan keeps a log."""
        scan, p = self.scan, self.p
        at = G.with_coordinates(points, p)
        out = at.withColumn("logl", scan.value(p)) if hasattr(scan.target, "sql") else scan._evaluated(at, p)
        if self.c.log:
            out = stored(out, "trials")
            x = {d: F.col(f"g{k}") for k, d in enumerate(p.dims)} | {d: F.col(f"p{k}") for k, d in enumerate(p.profiled)}
            scan._record(out.select(*[x[d].alias(f"x{d}") for d in range(len(p.bounds))], "logl"), JOB_PHASE[job])
        return out.drop(*[f"g{k}" for k in range(len(p.dims))])

    # -- a generation ------------------------------------------------------------------------------------------

    def trials(self, cells: DataFrame) -> DataFrame | None:
        """cells, slot, p0.. (a trial for each member of each active cell), f, cr, fit (the member's value); None where
        there are too few cells or parents."""
        p, d = self.p, len(self.phi)
        parents = cells.filter(F.col("best") > float("-inf")).select(*p.cells, "best", F.col("phi").alias("__y"))
        parents, n = ranked(parents, [F.desc("best"), *p.cells], "__rank", self.scan.partitions)
        if n < max(LEAST_CELLS, LEAST_PARENTS):
            return None
        top = max(1, int(self.c.archive * n))
        state = cells.select(*p.cells, F.col("best").alias("logl"), *[F.col("phi")[k].alias(x) for k, x in enumerate(self.phi)])
        active = cells.filter("status = 'active'")
        near = S.best_neighbours(state, p, self.phi, 1, "logl", active)
        near = near.select(*p.cells, F.col("logl_n").alias("__near"), F.array(*[F.col(f"{x}_n") for x in self.phi]).alias("__guide"))
        each = active.join(near, p.cells, "left").select(*p.cells, "best", "__near", "__guide", F.posexplode("members").alias("slot", "m"))
        mu_f, mu_cr = self.memory.drawn(self.draw(3, "slot"))
        pulled = (F.col("__near") > F.col("best")) & (self.draw(6, "slot") < self.c.pull)
        each = each.select(
            *p.cells, "slot", "m", "__guide", drawn_scale(mu_f, self.draw(4, "slot")).alias("f"),
            drawn_rate(mu_cr, self.draw(5, "slot"), self.draw(7, "slot")).alias("cr"), F.coalesce(pulled, F.lit(False)).alias("__pulled"),
        )
        # two different parents, neither of them the one drawn from the archive
        best = F.floor(self.draw(8, "slot") * top)
        a = F.floor(self.draw(9, "slot") * (n - 1))
        b = F.floor(self.draw(10, "slot") * (n - 2))
        b = b + F.when(b >= a, 1).otherwise(0)
        skip = lambda r: r + F.when(r >= best, 1).otherwise(0)
        roles = F.array(*[F.struct(F.lit(k).alias("k"), r.cast("long").alias("r")) for k, r in enumerate((best, skip(a), skip(b)))])
        asked = each.withColumn("__q", F.explode(roles)).withColumn("__rank", F.col("__q.r"))
        met = asked.join(parents.select("__rank", "__y"), "__rank").groupBy(*p.cells, "slot").agg(
            *[F.first(x).alias(x) for x in ("m", "__guide", "f", "cr", "__pulled")],
            *[F.max(F.when(F.col("__q.k") == k, F.col("__y"))).alias(f"__y{k}") for k in range(3)],
        )
        goal = F.when(F.col("__pulled"), F.col("__guide")).otherwise(F.col("__y0"))
        forced = F.floor(self.draw(11, "slot") * d)
        out = {}
        for k, (x, (lo, hi)) in enumerate(zip(self.phi, self.bounds)):
            own = F.col("m.phi")[k]
            moved = own + F.col("f") * (goal[k] - own) + F.col("f") * (F.col("__y1")[k] - F.col("__y2")[k])
            crossed = (self.draw(12 + k, "slot") < F.col("cr")) | (forced == k)
            out[x] = F.greatest(F.lit(lo), F.least(F.lit(hi), F.when(crossed, moved).otherwise(own)))
        return met.select(*p.cells, "slot", "f", "cr", F.col("m").alias("member"), *[v.alias(x) for x, v in out.items()])

    def evolved(self, cells: DataFrame, trials: DataFrame) -> DataFrame:
        """cells after the generation: better trials in their members' places, gains noted, what worked in `won`."""
        p = self.p
        tried = self._valued(trials, "DE_GRID_POINT")
        better = F.col("logl") > F.col("member.fit")
        member = F.when(better, F.struct(F.col("logl").alias("fit"), F.array(*self.phi).alias("phi")).cast(MEMBER)).otherwise(F.col("member"))
        each = tried.select(*p.cells, "slot", member.alias("m"), F.when(better, F.struct("f", "cr")).alias("__won"))
        new = each.groupBy(*p.cells).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("slot", "m"))), lambda x: x["m"]).alias("__members"),
            F.min(F.struct((-F.col("m.fit")).alias("v"), "slot")).alias("__b"), F.collect_list("__won").alias("__won"), F.count("*").alias("__n"),
        )
        both = cells.drop("won").join(new, p.cells, "left")
        hit = F.col("__n").isNotNull()
        best = -F.col("__b.v")
        gain = F.when(F.col("best") > float("-inf"), F.greatest(best - F.col("best"), F.lit(0.0))).otherwise(F.when(best > float("-inf"), 1e300).otherwise(0.0))
        phi = F.when(best > F.col("best"), F.element_at("__members", F.col("__b.slot") + 1)["phi"]).otherwise(F.col("phi"))
        return both.select(
            *p.cells, F.when(hit, F.col("__members")).otherwise(F.col("members")).alias("members"),
            F.when(hit, F.greatest("best", best)).otherwise(F.col("best")).alias("best"), F.when(hit, phi).otherwise(F.col("phi")).alias("phi"),
            F.when(hit, F.slice(F.concat(F.array(gain), "gains"), 1, self.c.window)).otherwise(F.col("gains")).alias("gains"),
            "status", "warm", "window", (F.col("evals") + F.coalesce("__n", F.lit(0))).alias("evals"), F.col("__won").alias("won"),
        )

    def windows(self, cells: DataFrame) -> DataFrame:
        """Fresh cells whose warm start was best and whose neighbours agree need one generation of proof only."""
        if not self.c.early_exit:
            return cells
        p = self.p
        state = cells.select(*p.cells, *[F.col("phi")[k].alias(x) for k, x in enumerate(self.phi)])
        smooth = S.agreeing(state, p, self.phi, self.extents, self.c.agree, own=False).select(*p.cells, F.lit(True).alias("__smooth"))
        short = (F.size("gains") == 0) & F.col("warm") & F.col("__smooth")
        out = cells.join(smooth, p.cells, "left")
        return out.withColumn("window", F.when(short, 1).otherwise(F.col("window"))).drop("__smooth")

    def faded(self) -> Column:
        """Active cells whose last gains are too small on average."""
        last = F.slice("gains", 1, F.col("window"))
        mean = F.aggregate(last, F.lit(0.0), lambda t, x: t + x) / F.size(last)
        return (F.col("status") == "active") & (F.size("gains") >= F.col("window")) & (mean < self.c.convergence)

    def polished(self, cells: DataFrame, which: Column, curv: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """cells with those that `which` names polished and done; the polished states. Runs begin with the curvature of
        the best done neighbour and its parameters, where it has any."""
        scan, p = self.scan, self.p
        work = cells.filter(which).select(*p.cells, F.array("phi").alias("starts"))
        if curv is not None and self.c.curvature:
            near = scan._starts(work, curv, p, 1).withColumnRenamed("starts", "__near")
            work = work.join(near, p.cells, "left").withColumn("starts", F.when(F.col("__near").isNull(), F.col("starts")).otherwise(F.concat("starts", "__near"))).drop("__near")
        done = stored(scan.optimise(work, p, "LBFGSB", "lbfgs"), "polish")
        new = done.select(*p.cells, F.col("logl").alias("__v"), F.array(*self.phi).alias("__p"), F.col("evals").alias("__e"), F.col("done").alias("__done"))
        both = cells.join(new, p.cells, "left")
        won, hit = F.col("__v") > F.col("best"), F.col("__e").isNotNull()
        out = both.select(
            *p.cells, "members", F.greatest("best", "__v").alias("best"), F.when(won, F.col("__p")).otherwise(F.col("phi")).alias("phi"), "gains",
            F.when(hit, F.when(F.col("__done"), "optimized").otherwise("converged")).otherwise(F.col("status")).alias("status"), "warm", "window",
            (F.col("evals") + F.coalesce("__e", F.lit(0))).alias("evals"), "won",
        )
        return out, done

    # -- the stage ---------------------------------------------------------------------------------------------

    def run(self, first: DataFrame) -> tuple[DataFrame, int]:
        """From the first cells (cells, starts) to the state of all cells around the region, and the generations."""
        p, c = self.p, self.c
        cells = stored(self.windows(self.activated(first)), "population")
        curv: DataFrame | None = None
        while True:
            seen = cells.agg(
                F.max("best").alias("top"), F.count_if(F.col("status") == "active").alias("active"),
                F.count_if(self.faded()).alias("faded"),
            ).first()
            if seen["faded"] or (seen["active"] and self.generation >= c.generations):
                which = self.faded() if self.generation < c.generations else F.col("status") == "active"
                new, done = self.polished(cells, which, curv)
                cells = self._next(new, cells)
                curv = done if curv is None else curv.unionByName(done)
            inside = cells.filter(F.col("best") > seen["top"] - c.roi_threshold)
            front = stored(G.frontier(inside, cells, p), "front")
            if not front.isEmpty():
                state = cells.select(*p.cells, F.col("best").alias("logl"), *[F.col("phi")[k].alias(x) for k, x in enumerate(self.phi)], F.lit(None).cast("array<struct<s: array<double>, y: array<double>>>").alias("curv"))
                more = self.activated(self.scan._starts(front, state, p, 1).drop("curv"))
                cells = self._next(self.windows(cells.unionByName(more)), cells)
            discarded(front)
            if cells.filter("status = 'active'").isEmpty():
                break
            self.generation += 1
            trials = self.trials(cells)
            if trials is None:
                new, done = self.polished(cells, F.col("status") == "active", curv)
                cells = self._next(new, cells)
                curv = done if curv is None else curv.unionByName(done)
                continue
            cells = self._next(self.evolved(cells, trials), cells)
            won = cells.select(F.explode("won").alias("w")).select("w.f", "w.cr")
            mean = S.lehmer(won).first()
            if mean["f_mean"] is not None:
                self.memory.add(mean["f_mean"], mean["cr_mean"])
        phase = F.lit(JOB_PHASE["DE_GRID_POINT"])
        state = cells.select(
            *p.cells, F.col("best").alias("logl"), *[F.col("phi")[k].alias(x) for k, x in enumerate(self.phi)], "evals",
            (F.col("status") == "optimized").alias("done"), phase.alias("phase"),
        )
        last = curv.select(*p.cells, "curv") if curv is not None else None
        state = state.join(last, p.cells, "left") if last is not None else state.withColumn("curv", F.lit(None).cast("array<struct<s: array<double>, y: array<double>>>"))
        return stored(state, "state"), self.generation

    def _next(self, new: DataFrame, was: DataFrame) -> DataFrame:
        out = stored(new, "population")
        discarded(was)
        return out


def evolve_table(scan, first: DataFrame, p: Projection) -> tuple[DataFrame, int]:
    return Evolution(scan, p).run(first)
