"""How far a long step is, as fractions from Spark's status tracker."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

EVERY = 1.0
Told = Callable[[str, float], None]


def show(step: str, fraction: float) -> None:
    print(f"  {step}: {fraction:.0%}", flush=True)


class Progress:
    """A step of one or more attempts, of which each is a job group of its own.

    The fraction is the attempts that are done, and of the one in hand the tasks
    that are done among those that Spark has been given so far. As more are given
    while it runs, the fraction is only told when it rises, and 1 only at the end.
    """

    def __init__(self, spark: SparkSession, step: str, told: Told = show, every: float = EVERY) -> None:
        self.context, self.step, self.told, self.every = spark.sparkContext, step, told, every
        self.done, self.of, self.group, self.last = 0, 1, step, 0.0
        self.over = threading.Event()

    def attempt(self, done: int, of: int) -> None:
        """The next attempt begins: ``done`` of ``of`` are behind it."""
        self.done, self.of, self.group = done, max(of, done + 1), f"{self.step}, {done + 1} of {of}"
        self.context.setJobGroup(self.group, self.group)

    def fraction(self) -> float:
        """The fraction now; what Spark has forgotten of old jobs counts for nothing."""
        tracker, tasks, complete = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in (tracker.getStageInfo(s) for s in (info.stageIds if info else [])):
                if stage:
                    tasks, complete = tasks + stage.numTasks, complete + stage.numCompletedTasks
        part = complete / tasks if tasks else 0.0
        return min((self.done + part) / self.of, 0.999)

    def tell(self, fraction: float) -> None:
        if fraction > self.last:
            self.last = fraction
            self.told(self.step, fraction)

    def watch(self) -> None:
        while not self.over.wait(self.every):
            self.tell(self.fraction())


@contextmanager
def progress(spark: SparkSession, step: str, told: Told = show, every: float = EVERY) -> Iterator[Progress]:
    """Jobs run inside belong to ``step`` wherever Spark shows jobs; fractions are told meanwhile, the time at the end."""
    began, state = time.time(), Progress(spark, step, told, every)
    spark.sparkContext.setJobGroup(step, step)
    watcher = threading.Thread(target=state.watch, daemon=True)
    watcher.start()
    try:
        yield state
        state.over.set()
        watcher.join()
        state.tell(1.0)
    finally:
        state.over.set()
        spark.sparkContext.setJobGroup("", "")
        print(f"  {step}: {time.time() - began:.1f} s")
