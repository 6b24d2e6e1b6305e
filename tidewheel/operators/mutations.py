"""Mutations as functions from tables and a change to new tables: nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.cron import next_cron_time
from tidewheel.functions.scalars import purge_statuses, schedule_instance_id
from tidewheel.model import DEFAULT_QUEUE, BatchTooLarge, Capabilities
from tidewheel.functions.scalars import inbox_batch_limit


def create_instances(instances: DataFrame, new: DataFrame, now: Column) -> dict[str, DataFrame]:
    """new: id, name, queue, input, parent_id, parent_seq, search_attributes, memo. Created ones get a started event and a workflow task; ids that exist, or come
    a second time, are in ``rejected``."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    numbered = new.withColumn("__n", first)
    known = instances.select("id")
    fresh = numbered.where("__n = 1").join(known, "id", "left_anti").drop("__n")
    rejected = numbered.where("__n > 1").drop("__n").unionByName(numbered.where("__n = 1").join(known, "id", "left_semi").drop("__n"))
    queue = F.coalesce(F.when(F.col("queue") != "", F.col("queue")), F.lit(DEFAULT_QUEUE))
    rows = fresh.withColumns({"queue": queue, "status": F.lit("running"), "next_seq": F.lit(2).cast("bigint"), "created_at": now, "updated_at": now})
    started = rows.select(F.col("id").alias("instance_id"), F.lit(1).cast("bigint").alias("seq"), F.lit("workflow_started").alias("type"), "name", F.lit(0).cast("bigint").alias("ref_seq"), F.col("input").alias("payload"), now.alias("recorded_at"))
    tasks = rows.select(F.lit("workflow").alias("kind"), "queue", F.col("id").alias("instance_id"), "name", now.alias("visible_at"))
    return {"instances": rows, "journal": started, "tasks": tasks, "rejected": rejected}


def deliver(items: DataFrame, seen: DataFrame) -> DataFrame:
    """The items to append: of those with one dedupe id only the first (by arrival), and none whose id was seen before; items without an id all
    pass. items: instance_id, dedupe_id, arrival. seen: instance_id, dedupe_id."""
    keyed = F.coalesce(F.col("dedupe_id"), F.lit("")) != ""
    first = F.row_number().over(Window.partitionBy("instance_id", "dedupe_id").orderBy("arrival"))
    fresh = items.where(keyed).withColumn("__n", first).where("__n = 1").drop("__n").join(seen.select("instance_id", "dedupe_id"), ["instance_id", "dedupe_id"], "left_anti")
    return fresh.unionByName(items.where(~keyed))


def check_batch(n: int, caps: Capabilities = Capabilities()) -> None:
    if n > (most := inbox_batch_limit(caps)):
        raise BatchTooLarge(f"{n} items; at most {most} go in one batch")


def terminate(tables: dict[str, DataFrame], instance_id: str, now: Column) -> dict[str, DataFrame]:
    """The instance terminated, whatever its status, and its tasks, timers, dedupe keys and inbox gone. Its parent is not told."""
    hit = F.col("id") == instance_id
    inst = tables["instances"].withColumns({"status": F.when(hit, "terminated").otherwise(F.col("status")), "completed_at": F.when(hit, now).otherwise(F.col("completed_at"))})
    return tables | {"instances": inst} | {t: tables[t].where(F.col("instance_id") != instance_id) for t in ("tasks", "timers", "signal_dedupe", "inbox")}


def complete_activities(tasks: DataFrame, instances: DataFrame, done: DataFrame) -> dict[str, DataFrame]:
    """done: task_id, worker_id, attempt, type, payload, ref_seq. Owned tasks go; their events reach running instances only. The rest is superseded."""
    t = tasks.select(F.col("id").alias("task_id"), "worker_id", "attempt", "instance_id", F.col("ref_seq").alias("task_seq"))
    held = done.join(t, ["task_id", "worker_id", "attempt"])
    running = instances.where("status = 'running'").select(F.col("id").alias("instance_id"))
    ref = F.when(F.coalesce("ref_seq", F.lit(0)) == 0, F.col("task_seq")).otherwise(F.col("ref_seq"))
    inbox = held.withColumn("ref_seq", ref).join(running, "instance_id", "left_semi").select("instance_id", "type", "ref_seq", "payload")
    return {
        "tasks": tasks.join(held.select(F.col("task_id").alias("id")), "id", "left_anti"),
        "inbox": inbox,
        "wake": inbox.select("instance_id").distinct(),
        "superseded": done.join(t, ["task_id", "worker_id", "attempt"], "left_anti"),
    }


def upsert_schedules(schedules: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """new: id, cron, workflow, queue, input, paused. Rows without id, cron or workflow, or with a bad rule, raise; the next run counts from now."""
    blank = F.exists(F.array("id", "cron", "workflow"), lambda x: F.coalesce(x, F.lit("")) == "")
    fire = next_cron_time(F.col("cron"), now)
    checked = new.withColumn("next_run_at", F.when(blank | fire.isNull(), F.raise_error(F.lit("a schedule needs an id, a workflow and a valid cron rule")).cast("timestamp")).otherwise(fire))
    checked = checked.withColumns({"queue": F.coalesce(F.when(F.col("queue") != "", F.col("queue")), F.lit(DEFAULT_QUEUE)), "updated_at": now})
    kept = schedules.join(new.select("id"), "id", "left_anti")
    return kept.unionByName(checked, allowMissingColumns=True)


def pause_schedule(schedules: DataFrame, schedule_id: str, paused: bool) -> DataFrame:
    return schedules.withColumn("paused", F.when(F.col("id") == schedule_id, F.lit(paused)).otherwise(F.col("paused")))


def purge_victims(instances: DataFrame, now: Column, older_than_ms: int, statuses=None, limit: int = 0) -> DataFrame:
    """Finished instances of the statuses that ended at least so long ago, the earliest first (limit 0: 1000)."""
    if older_than_ms < 0:
        raise ValueError("older_than_ms must not be negative")
    old = F.col("completed_at") <= now - F.make_dt_interval(secs=F.lit(older_than_ms / 1000))
    rows = instances.where(F.col("status").isin(*purge_statuses(statuses)) & F.col("completed_at").isNotNull() & old)
    return rows.orderBy("completed_at", "id").limit(limit if limit > 0 else 1000)


def purge(tables: dict[str, DataFrame], victims: DataFrame) -> dict[str, DataFrame]:
    ids = victims.select("id")
    out = {"instances": tables["instances"].join(ids, "id", "left_anti")}
    for t in ("journal", "inbox", "signal_dedupe", "tasks", "timers"):
        if t in tables:
            out[t] = tables[t].join(ids.select(F.col("id").alias("instance_id")), "instance_id", "left_anti")
    return tables | out


def due_timers(timers: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    return timers.where(F.col("fire_at") <= now).orderBy("fire_at", "instance_id", "seq").limit(limit if limit > 0 else 1)


def fire_timers(timers: DataFrame, instances: DataFrame, now: Column, limit: int = 100) -> dict[str, DataFrame]:
    """Due timers go and are counted; running instances get their events and are woken."""
    due = due_timers(timers, now, limit)
    running = instances.where("status = 'running'").select(F.col("id").alias("instance_id"))
    inbox = due.join(running, "instance_id", "left_semi").select("instance_id", F.lit("timer_fired").alias("type"), F.col("seq").alias("ref_seq"))
    return {"fired": due, "timers": timers.join(due, ["instance_id", "seq"], "left_anti"), "inbox": inbox, "wake": inbox.select("instance_id").distinct()}


def due_schedules(schedules: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    return schedules.where(~F.coalesce("paused", F.lit(False)) & (F.col("next_run_at") <= now)).orderBy("next_run_at", "id").limit(limit if limit > 0 else 1)


def claim_schedules(schedules: DataFrame, instances: DataFrame, now: Column, limit: int = 100) -> dict[str, DataFrame]:
    """Due schedules start one instance each, named by the time it was due (created is false if that exists), and move on from that time: one missed
    run is caught up a call."""
    due = due_schedules(schedules, now, limit).withColumns({"scheduled_at": F.col("next_run_at"), "instance_id": schedule_instance_id(F.col("id"), F.col("next_run_at"))})
    known = instances.select(F.col("id").alias("instance_id"), F.lit(True).alias("__known"))
    claimed = due.join(known, "instance_id", "left").withColumn("created", F.col("__known").isNull()).drop("__known")
    moved = due.select("id", next_cron_time(F.col("cron"), F.col("scheduled_at")).alias("__next"))
    after = schedules.join(moved, "id", "left").withColumn("next_run_at", F.coalesce("__next", "next_run_at")).drop("__next")
    return {"claimed": claimed, "schedules": after}
