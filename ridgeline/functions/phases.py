"""Which phase of a run made an evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phase numbers and the job types that belong to them.
UNKNOWN = -1
PHASES = {0: "initial", 1: "scan", 2: "refine", 3: "suspect", 4: "volume", -1: "unknown"}
JOB_PHASE = {
    "INITIAL_POINT_EVAL": 0,
    "INITIAL_OPTIMIZATION": 0,
    "ACTIVATE_GRID_POINT": 1,
    "DE_GRID_POINT": 1,
    "LBFGSB": 1,
    "LBFGSB_LOOP": 1,
    "POST_ACTIVATION_LBFGSB": 1,
    "PATCHING_TEST": 2,
    "PATCHING_LBFGSB": 2,
    "REFINEMENT_LBFGSB": 2,
    "SUSPECT_RECHECK": 3,
    "SUSPECT_RECHECK_LBFGSB": 3,
    "VOLUME": 4,
}


def phase_of(job_type: str) -> int:
    return JOB_PHASE.get(job_type, UNKNOWN)


def phase_column(job_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in JOB_PHASE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, job_type), F.lit(UNKNOWN))


def legend_column(phase: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, phase), F.lit(PHASES[UNKNOWN]))
