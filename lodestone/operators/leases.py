"""Jobs that workers hold for a while: claims, heartbeats, cancellation and fenced writes, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States from which a job can be claimed, and states in which it is over.
RUNNABLE = ["QUEUED", "RETRY_SCHEDULED", "WAITING_WORKER", "RUNNING"]
OVER = ["SUCCEEDED", "FAILED", "CANCELLED", "COMPLETED_REVIEW_HANDOFF"]


def claim(jobs: DataFrame, workers: DataFrame, now: float, seconds: float = 90.0) -> DataFrame:
    """The jobs that free workers get, one each (R3): ``id, owner, token, lease_expires_at, attempt``.

    ``jobs``: ``id, state, priority, created_at, not_before, lease_expires_at, attempt`` (null counts as 0); ``workers``:
    ``worker``, one row each. The highest priority first, then the oldest, then the least id; a running job whose lease ran
    out is claimed again. The first worker by name gets the first job. A claim's token differs from all earlier ones
    of the job. As many jobs as there are workers are kept at most, so only those are ranked in one task.
    """
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    can = jobs.where(F.col("state").isin(RUNNABLE) & (F.coalesce("not_before", F.lit(now)) <= now) & free)
    order = [F.desc("priority"), F.asc("created_at"), F.asc("id")]
    names = workers.select("worker").distinct()
    first = can.orderBy(*order).limit(names.count())
    k = F.row_number().over(Window.orderBy(*order)).alias("k")
    got = first.select("id", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"), k)
    who = names.select(F.col("worker").alias("owner"), F.row_number().over(Window.orderBy("worker")).alias("k"))
    token = F.concat(F.lit("lease_"), F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("attempt").cast("string")), 256), 1, 12))
    return got.join(who, "k").select("id", "owner", token.alias("token"), F.lit(now + seconds).alias("lease_expires_at"), "attempt")


def cancel(jobs: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """What becomes of each asked cancellation (R7): ``id, outcome, state``.

    A job that is over is refused, a running one is told, of any other only the time is noted; one that isn't there is unknown.
    """
    j = requests.select("id").distinct().join(jobs.select("id", "state"), "id", "left")
    outcome = F.when(F.col("state").isNull(), "NOT_FOUND").when(F.col("state").isin(OVER), "ALREADY_COMPLETED").otherwise("REQUESTED")
    return j.select("id", outcome.alias("outcome"), F.when(F.col("state") == "RUNNING", "CANCEL_REQUESTED").otherwise(F.col("state")).alias("state"))


def fenced(writes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whether a write is taken (R3, R6): ``write_id, outcome``; its token must be the running job's, and no cancellation asked for."""
    j = writes.join(jobs.select("id", "state", F.col("token").alias("held"), "cancel_requested_at"), "id", "left")
    stale = F.col("state").isNull() | (F.col("state") != "RUNNING") | ~F.coalesce(F.col("token") == F.col("held"), F.lit(False))
    return j.select("write_id", F.when(stale, "STALE_LEASE").when(F.col("cancel_requested_at").isNotNull(), "ALREADY_CANCELLED").otherwise("COMMITTED").alias("outcome"))
