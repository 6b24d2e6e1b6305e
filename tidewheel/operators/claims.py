"""Claiming of leased tasks: first-in-first-out, or fair with a cap on each instance; leases and their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.model import ClaimRequest


def claimable(tasks: DataFrame, kind: str, queues, now: Column) -> DataFrame:
    """Visible tasks of the queues. No queues: none. An expired lease is visible again: nothing has to reap it."""
    if not queues:
        return tasks.limit(0)
    return tasks.where((F.col("kind") == kind) & F.col("queue").isin(*queues) & (F.col("visible_at") <= now))


def fair_pick(tasks: DataFrame, limit: int, per_instance: int) -> DataFrame:
    """In order of (visible_at, id), at most per_instance of one instance (0: no cap), limit in all (0: none).

    The rank limit is applied before the shuffle too, so a flooding instance sends no more than its cap from each partition.
    """
    if limit <= 0:
        return tasks.limit(0)
    if per_instance > 0:
        turn = Window.partitionBy("instance_id").orderBy("visible_at", "id")
        tasks = tasks.withColumn("__rank", F.row_number().over(turn)).where(F.col("__rank") <= per_instance).drop("__rank")
    return tasks.orderBy("visible_at", "id").limit(limit)


def pick(tasks: DataFrame, request: ClaimRequest, now: Column) -> DataFrame:
    return fair_pick(claimable(tasks, request.kind, request.queues, now), request.limit if request.limit > 0 else 1, request.max_per_instance)


def claim(tasks: DataFrame, request: ClaimRequest, now: Column) -> DataFrame:
    """The picked tasks under lease: hidden until it ends, one attempt more, owned by the worker."""
    later = now + F.make_dt_interval(secs=F.lit(request.lease_ms / 1000))
    return pick(tasks, request, now).withColumns({"visible_at": later, "attempt": F.col("attempt") + 1, "worker_id": F.lit(request.worker_id)})


def after_key(tasks: DataFrame, visible_at: Column, task_id: int) -> DataFrame:
    """The rows after a place in claim order."""
    return tasks.where((F.col("visible_at") > visible_at) | ((F.col("visible_at") == visible_at) & (F.col("id") > task_id)))


def overfetch(limit: int) -> int:
    """Rows to read so that a fair pick of so many can be filled: four times, within 64 to 4096, never fewer than asked."""
    return max(limit, min(max(4 * limit, 64), 4096))


def secured_counts(picked: DataFrame) -> DataFrame:
    return picked.groupBy("instance_id").agg(F.count("*").alias("n"))


def owned(tasks: DataFrame, token: dict, unconditional: bool = False) -> Column:
    """Whether a row is the claim's: id, worker and attempt. Without a worker only the id counts, where that is allowed."""
    mine = F.col("id") == token["id"]
    if unconditional and not token.get("worker_id"):
        return mine
    return mine & F.coalesce((F.col("worker_id") == token["worker_id"]) & (F.col("attempt") == token["attempt"]), F.lit(False))


def _rewritten(tasks: DataFrame, where: Column, **new: Column) -> DataFrame:
    return tasks.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def _after(now: Column, ms: int) -> Column:
    return now + F.make_dt_interval(secs=F.lit(ms / 1000))


def extend_lease(tasks: DataFrame, token: dict, now: Column, lease_ms: int) -> DataFrame:
    return _rewritten(tasks, owned(tasks, token), visible_at=_after(now, lease_ms))


def record_heartbeat(tasks: DataFrame, token: dict, now: Column, lease_ms: int, details: bytes | None) -> DataFrame:
    """extend_lease and the details; without details the old ones stay."""
    new = {"visible_at": _after(now, lease_ms)} | ({"heartbeat": F.lit(details)} if details is not None else {})
    return _rewritten(tasks, owned(tasks, token), **new)


def release_lease(tasks: DataFrame, token: dict, now: Column) -> DataFrame:
    """Visible at once and without an owner; the attempt stays counted."""
    return _rewritten(tasks, owned(tasks, token, True), visible_at=now, worker_id=F.lit(None).cast("string"))


def nack(tasks: DataFrame, token: dict, now: Column, delay_ms: int) -> DataFrame:
    return _rewritten(tasks, owned(tasks, token, True), visible_at=_after(now, delay_ms), worker_id=F.lit(None).cast("string"))


def retry_activity(tasks: DataFrame, token: dict, now: Column, delay_ms: int) -> DataFrame:
    return _rewritten(tasks, owned(tasks, token) & (F.col("kind") == "activity"), visible_at=_after(now, delay_ms), worker_id=F.lit(None).cast("string"))


def backlog(tasks: DataFrame, kind: str, queues, now: Column) -> DataFrame:
    return claimable(tasks, kind, queues, now).groupBy("queue").agg(F.count("*").alias("n"))


def dense_backlog(tasks: DataFrame, kinds, queues: DataFrame, now: Column) -> DataFrame:
    """Every kind and configured queue (one column, queue), zeros too."""
    counts = tasks.where(F.col("visible_at") <= now).groupBy("kind", "queue").agg(F.count("*").alias("n"))
    grid = queues.select("queue").distinct().select("queue", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return grid.join(counts, ["kind", "queue"], "left").select("kind", "queue", F.coalesce("n", F.lit(0)).alias("n"))
