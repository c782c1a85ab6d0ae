"""A pipeline of named steps over frames, with a record of each.

A step says what it needs and makes; one whose needs are missing is blocked, one that fails
ends the run, and what comes after is not run. What a step makes is computed and written to the
shared folder before the step counts as completed. Records are rows like any other.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.tables import cut

RECORD = "name string, status string, started_at double, duration_s double, error string"


@dataclass
class Stage:
    name: str
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    needs: tuple[str, ...] = ()
    makes: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()


@dataclass
class Pipeline:
    """Stages in order (R12); ``capabilities`` are what this installation can do."""

    stages: list[Stage]
    capabilities: set[str] = field(default_factory=set)

    def run(self, spark: SparkSession, frames: dict[str, DataFrame], cancelled: Callable[[], bool] = lambda: False) -> tuple[dict[str, DataFrame], DataFrame]:
        """All frames after the run, and the records: COMPLETED, BLOCKED, FAILED, CANCELLED or NOT_RUN."""
        have, records, over = dict(frames), [], ""
        for s in self.stages:
            began, error, status = time.time(), None, over
            if not status and cancelled():
                status = over = "CANCELLED"
            if not status and not set(s.capabilities) <= self.capabilities:
                status, error = "BLOCKED", "capability"
            elif not status and not set(s.needs) <= have.keys():
                status, error = "BLOCKED", "needs " + ", ".join(sorted(set(s.needs) - have.keys()))
            if not status:
                try:
                    made = s.run(have)
                    if missing := set(s.makes) - made.keys():
                        raise ValueError(f"made no {', '.join(sorted(missing))}")
                    have |= {k: cut(x) for k, x in made.items()}
                    status = "COMPLETED"
                except Exception as x:  # noqa: BLE001 - a failed stage is a record
                    status, error, over = "FAILED", f"{type(x).__name__}: {x}"[:500], "NOT_RUN"
            records.append((s.name, status, began, time.time() - began, error))
        return have, spark.createDataFrame(records, RECORD)
