"""Numbered steps whose outputs are kept, so that a run can start from any of them; progress of jobs."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from ..matrix import BigMatrix
from ..sources.store import load_output, save_matrix

log = logging.getLogger("matloom")


def run_steps(spark: SparkSession, path: str, steps: Sequence[tuple[str, Callable[[BigMatrix | None], BigMatrix]]], start_from: str | None = None) -> BigMatrix:
    """Each step gets the matrix of the step before and its own is written; start_from reuses what precedes it.

    A step is named as "2-seeds-mat": its number and its name; either may be given.
    """
    names = [f"{i}-{name}" for i, (name, _) in enumerate(steps, 1)]
    first = 0
    if start_from is not None:
        first = next(i for i, full in enumerate(names) if start_from in (full, steps[i][0], str(i + 1)))
    current = load_output(spark, f"{path}/{names[first - 1]}") if first else None
    for full, (name, fn) in list(zip(names, steps))[first:]:
        log.info("step %s", full)
        spark.sparkContext.setJobGroup(full, name)
        save_matrix(fn(current), f"{path}/{full}", name)
        current = load_output(spark, f"{path}/{full}")
    return current


def progress(spark: SparkSession, group: str) -> tuple[int, int]:
    """(tasks done, tasks known) of the jobs of a group."""
    status = spark.sparkContext.statusTracker()
    done = total = 0
    for job in status.getJobIdsForGroup(group):
        for stage in (info.stageIds if (info := status.getJobInfo(job)) else ()):
            if s := status.getStageInfo(stage):
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done, total
