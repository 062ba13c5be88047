"""Runs that can be stopped: by a time limit, or from another thread.

Kernels look at their deadline while they search (see ``Parameters.time_limit_s``). Whatever runs as Spark jobs carries a
job tag, so that :meth:`Control.cancel` ends its tasks at once. Voyages are planned part by part, and each part's rows are
written when it is done, so a stopped run keeps them.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators.shared import written

#: Parts that voyages are planned in.
PARTS = 8


class Stopped(RuntimeError):
    """``reason``: ``cancelled`` or ``time_limit``."""

    def __init__(self, reason: str, elapsed_s: float):
        super().__init__(f"{reason} after {elapsed_s:.1f} s")
        self.reason, self.elapsed_s = reason, elapsed_s


class Control:
    """A stop flag and a time limit for one run (none: no limit). A parent's stop is its children's, its limit isn't."""

    def __init__(self, spark: SparkSession, time_limit_s: float | None = None, parent: Control | None = None):
        self.context, self.limit, self.parent = spark.sparkContext, time_limit_s or None, parent
        self.tag = parent.tag if parent else f"fairlead-{uuid.uuid4().hex}"
        self.begun, self.event = time.monotonic(), parent.event if parent else threading.Event()

    def cancel(self) -> None:
        """Stops the run; may be called from any thread, also before it began."""
        self.event.set()
        self.context.cancelJobsWithTag(self.tag)

    @property
    def left_s(self) -> float | None:
        return None if self.limit is None else max(0.0, self.limit - (time.monotonic() - self.begun))

    def check(self) -> None:
        """Raises :class:`Stopped` if the run must end."""
        elapsed = time.monotonic() - self.begun
        if self.event.is_set():
            raise Stopped("cancelled", elapsed)
        if self.limit is not None and elapsed > self.limit:
            raise Stopped("time_limit", elapsed)

    def run(self, work: Callable[[], DataFrame]) -> DataFrame:
        """``work()``, whose Spark jobs end when the run is cancelled; then :class:`Stopped` is raised."""
        self.check()
        self.context.addJobTag(self.tag)
        self.context.setInterruptOnCancel(True)
        try:
            return work()
        except Exception:
            self.check()
            raise
        finally:
            self.context.removeJobTag(self.tag)


def plan_in_parts(control: Control, voyages: DataFrame, work: Callable[[DataFrame, float | None], DataFrame], parts: int = PARTS) -> DataFrame:
    """The rows of ``work(some voyages, seconds left)`` for all voyages. If the run is stopped, the parts that are done
    stay, and every other voyage has a row with the stop's reason as ``status`` and nulls elsewhere."""
    part = F.pmod(F.xxhash64("voyage_id"), F.lit(parts))
    done, reason = None, None
    for i in range(parts):
        some = voyages.where(part == i)
        try:
            rows = control.run(lambda some=some: written(work(some, control.left_s), "part"))
        except Stopped as stop:
            reason = stop.reason
            rest = voyages.where(part >= i).select("voyage_id").withColumn("status", F.lit(reason))
            return rest if done is None else done.unionByName(rest, allowMissingColumns=True)
        done = rows if done is None else done.unionByName(rows)
    return done
