"""Replay rules over journals as joins and windows, and aggregates of journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scalars import advancement_budget, command_cost, drain_limit, is_command, is_completion, is_terminal
from tidewheel.model import Capabilities

WARN_AT = 10_000


def _raw(payload, path: str) -> Column:
    """The JSON text at a path, with the quotes of a string; null if there is none."""
    return F.to_json(F.try_variant_get(F.try_parse_json(payload), path, "variant"))


def commands(journal: DataFrame) -> DataFrame:
    return journal.where(is_command(F.col("type")))


def completions(journal: DataFrame) -> DataFrame:
    """One row for each command that something refers to: the last completion wins."""
    last = F.max_by(F.struct("type", "payload", "seq"), "seq").alias("c")
    found = journal.where(is_completion(F.col("type")) & (F.coalesce("ref_seq", F.lit(0)) != 0)).groupBy("instance_id", "ref_seq").agg(last)
    return found.select("instance_id", F.col("ref_seq").alias("seq"), F.col("c.type").alias("completion"), F.col("c.seq").alias("completion_seq"), F.col("c.payload").alias("result"))


def correlate(journal: DataFrame) -> DataFrame:
    """Each command with its completion; without one it is pending."""
    return commands(journal).join(completions(journal), ["instance_id", "seq"], "left").withColumn("pending", F.col("completion").isNull())


def index_journal(journal: DataFrame) -> DataFrame:
    """(instance_id, next_seq, n_commands, n_signals, canceled, attributes, memo) in one pass: the last attribute and memo events win."""
    kind = F.col("type")
    return journal.groupBy("instance_id").agg(
        (F.max("seq") + 1).alias("next_seq"), F.count_if(is_command(kind)).alias("n_commands"), F.count_if(kind == "signal_received").alias("n_signals"),
        F.coalesce(F.bool_or(kind == "cancel_requested"), F.lit(False)).alias("canceled"),
        F.max_by("payload", F.when(kind == "search_attributes_updated", F.col("seq"))).alias("attributes"), F.max_by("payload", F.when(kind == "memo_updated", F.col("seq"))).alias("memo"),
    )


def match_commands(recorded: DataFrame, generated: DataFrame) -> DataFrame:
    """(instance_id, ordinal, recorded, generated, matches): the i-th command generated against the i-th recorded, by type and name. Version
    markers are passed over on both sides. A missing generated command is no violation yet, a missing record is a new command."""
    order = Window.partitionBy("instance_id").orderBy("seq")

    def numbered(df, alias):
        df = commands(df).where("type <> 'version_marker'").withColumn("ordinal", F.row_number().over(order))
        return df.select("instance_id", "ordinal", F.concat_ws("/", "type", F.coalesce("name", F.lit(""))).alias(alias))

    both = numbered(recorded, "recorded").join(numbered(generated, "generated"), ["instance_id", "ordinal"], "full")
    return both.withColumn("matches", F.coalesce(F.col("recorded") == F.col("generated"), F.lit(True)))


def signals_taken(journal: DataFrame, receives: DataFrame) -> DataFrame:
    """The n-th receive of a name (instance_id, name, n) takes the n-th signal of that name; it waits if there is none yet."""
    turn = Window.partitionBy("instance_id", "name").orderBy("seq")
    sent = journal.where("type = 'signal_received'").withColumn("n", F.row_number().over(turn))
    sent = sent.select("instance_id", "name", "n", F.col("seq").alias("signal_seq"), F.col("payload").alias("signal"))
    return receives.join(sent, ["instance_id", "name", "n"], "left")


def signal_or_timeout(waits: DataFrame) -> DataFrame:
    """waits: signal_seq, timer_seq (recorded timer or null), timer_fired. outcome: signal, timeout or wait; own_timer: the recorded timer is this wait's,
    and not that of a later one (a signal that came before it was taken without a timer)."""
    own = F.col("timer_seq").isNotNull() & (F.col("signal_seq").isNull() | (F.col("signal_seq") > F.col("timer_seq")))
    out = F.when(F.col("signal_seq").isNotNull(), "signal").when(own & F.col("timer_fired"), "timeout").otherwise("wait")
    return waits.withColumns({"own_timer": own, "outcome": out})


def await_first(futures: DataFrame, keys: list[str]) -> DataFrame:
    """futures: keys, arg_index, ready. The first ready one in argument order, -1 if none is."""
    return futures.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("ready"), F.col("arg_index"))), F.lit(-1)).alias("first_ready"))


def await_all(futures: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all are ready and, then, the first error in argument order."""
    rows = futures.groupBy(*keys).agg(F.bool_and("ready").alias("all_ready"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("arg_index"))).alias("first_error"))
    return rows.withColumn("first_error", F.when(F.col("all_ready"), F.col("first_error")))


def update_status(journal: DataFrame) -> DataFrame:
    """(instance_id, update_id, state, name, result, error, turn): completed, accepted or requested; turn numbers the open requests, the next first. An accepted one
    is ahead of all that were only requested."""
    j = journal.where(F.col("type").isin("update_requested", "update_accepted", "update_completed"))
    j = j.withColumn("update_id", F.get_json_object("payload", "$.id")).where(F.coalesce("update_id", F.lit("")) != "")
    kind = F.col("type")
    at = lambda k, c: F.min_by(c, F.when(kind == k, F.col("seq")))
    u = j.groupBy("instance_id", "update_id").agg(
        F.bool_or(kind == "update_completed").alias("done"), F.bool_or(kind == "update_accepted").alias("taken"), F.min("seq").alias("first"), F.min_by("name", "seq").alias("name"),
        at("update_completed", _raw(F.col("payload"), "$.result")).alias("result"), at("update_completed", F.get_json_object("payload", "$.error")).alias("error"),
    )
    state = F.when(F.col("done"), "completed").when(F.col("taken"), "accepted").otherwise("requested")
    turn = F.row_number().over(Window.partitionBy("instance_id", F.col("done")).orderBy(F.col("taken").desc(), "first"))
    return u.select("instance_id", "update_id", state.alias("state"), "name", "result", "error", F.when(~F.col("done"), turn).alias("turn"))


def versions(journal: DataFrame, change_id: str, low: int, high: int) -> DataFrame:
    """(instance_id, version): the recorded marker of a change; without one low where commands are recorded, else high."""
    marker = (F.col("type") == "version_marker") & (F.get_json_object("payload", "$.change_id") == change_id)
    version = F.min_by(F.get_json_object("payload", "$.version").cast("int"), F.when(marker, F.col("seq")))
    others = F.bool_or(is_command(F.col("type")) & (F.col("type") != "version_marker"))
    return journal.groupBy("instance_id").agg(F.coalesce(version, F.when(others, low), F.lit(high)).alias("version"))


def parent_notices(children: DataFrame) -> DataFrame:
    """(instance_id, ref_seq, type, payload) for the parents of finished children; a continued child tells nothing."""
    kind = F.when(F.col("status") == "completed", "child_completed").when(F.col("status").isin("failed", "canceled", "terminated", "stuck"), "child_failed")
    said = F.when(F.col("status") == "completed", F.col("result")).otherwise(F.coalesce(F.when(F.col("failure") != "", F.col("failure")), F.concat(F.lit('"'), "status", F.lit('"'))))
    rows = children.where(F.coalesce(F.col("parent_id").cast("string"), F.lit("")) != "").withColumn("type", kind).where("type is not null")
    return rows.select(F.col("parent_id").alias("instance_id"), F.col("parent_seq").alias("ref_seq"), "type", said.alias("payload"))


def effects(turn_commands: DataFrame, queue: Column) -> dict[str, DataFrame]:
    """Tasks, timers and children that new commands ask for."""
    c = turn_commands
    sched = F.from_json("payload", "input string, retry struct<initial_interval_ms:bigint,backoff_coefficient:double,max_interval_ms:bigint,max_attempts:int>, start_to_close_timeout_ms bigint")
    acts = c.where("type = 'activity_scheduled'").withColumn("s", sched)
    acts = acts.select(
        "instance_id", F.lit("activity").alias("kind"), queue.alias("queue"), "name", F.col("seq").alias("ref_seq"), F.coalesce(_raw(F.col("payload"), "$.input"), "payload").alias("input"),
        F.coalesce("s.retry.max_attempts", F.lit(0)).alias("max_attempts"), F.struct(F.col("s.retry.initial_interval_ms").alias("initial_ms"), F.col("s.retry.backoff_coefficient").alias("coef"), F.col("s.retry.max_interval_ms").alias("max_ms"), F.col("s.retry.max_attempts").alias("max_attempts")).alias("retry"),
        F.greatest(F.coalesce("s.start_to_close_timeout_ms", F.lit(0)), F.lit(0)).alias("start_to_close_ms"),
    )
    timers = c.where("type = 'timer_created'").select("instance_id", "seq", F.get_json_object("payload", "$.fire_at").cast("timestamp").alias("fire_at"))
    kids = c.where("type = 'child_scheduled'").select(
        F.get_json_object("payload", "$.child_id").alias("id"), F.get_json_object("payload", "$.name").alias("name"), queue.alias("queue"), _raw(F.col("payload"), "$.input").alias("input"),
        F.col("instance_id").alias("parent_id"), F.col("seq").alias("parent_seq"),
    )
    return {"tasks": acts, "timers": timers, "children": kids}


def orphans(instances: DataFrame, inbox: DataFrame, tasks: DataFrame) -> DataFrame:
    """Running instances with undrained events and no workflow task."""
    boxes = inbox.select(F.col("instance_id").alias("id"))
    working = tasks.where("kind = 'workflow'").select(F.col("instance_id").alias("id"))
    return instances.where("status = 'running'").join(boxes, "id", "left_semi").join(working, "id", "left_anti")


def contiguity(journal: DataFrame) -> DataFrame:
    """(instance_id, n, contiguous): seq runs from 1 without gaps or repeats."""
    return journal.groupBy("instance_id").agg(F.count("*").alias("n"), ((F.min("seq") == 1) & (F.max("seq") == F.count("*")) & (F.count_distinct("seq") == F.count("*"))).alias("contiguous"))


def next_seq(journal: DataFrame) -> DataFrame:
    return journal.groupBy("instance_id").agg((F.max("seq") + 1).alias("next_seq"))


def last_value(journal: DataFrame, kind: str) -> DataFrame:
    """The last payload of a type in each instance."""
    return journal.where(F.col("type") == kind).groupBy("instance_id").agg(F.max_by("payload", "seq").alias("payload"))


def has_event(journal: DataFrame, kind: str) -> DataFrame:
    return journal.groupBy("instance_id").agg(F.bool_or(F.col("type") == kind).alias("found"))


def size_warnings(journal: DataFrame, threshold: int = 0) -> DataFrame:
    """Instances whose journal has threshold events or more (0: the default; negative: none)."""
    rows = journal.groupBy("instance_id").agg(F.count("*").alias("n"))
    return rows.where(F.lit(False)) if threshold < 0 else rows.where(F.col("n") >= (threshold or WARN_AT))


def terminal_counts(journal: DataFrame) -> DataFrame:
    return journal.where(is_terminal(F.col("type"))).groupBy("type").agg(F.count("*").alias("n"))


def percentiles(rows: DataFrame, value: str, keys: list[str], q=(0.5, 0.95, 0.99)) -> DataFrame:
    """The element at floor(q * (n - 1)) of the ascending values, 0 for none.

    Ranked by a distributed count per distinct value rather than a list of all: a key's rows never gather in one task, only its distinct values do.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    line = Window.partitionBy(*keys).orderBy("__v")
    upto = counts.withColumn("__upto", F.sum("__c").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    picks = [F.coalesce(F.min(F.when(F.col("__upto") > F.floor(F.lit(x) * (F.col("__n") - 1)), F.col("__v"))), F.lit(0.0)).alias(f"p{round(x * 100)}") for x in q]
    return upto.groupBy(*keys).agg(*picks)


def throughput(rows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return rows.groupBy(*keys).agg(done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), (done / F.lit(seconds)).alias("per_second"))


def budget_prefix(turn_commands: DataFrame, base: Column, caps: Capabilities, keys: list[str], order: str) -> DataFrame:
    """kept: the command belongs to the longest prefix that fits the budget beside the turn's base cost."""
    line = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(command_cost(F.col("type"))).over(line)
    return turn_commands.withColumn("spent", spent).withColumn("kept", F.col("spent") <= advancement_budget(caps) - base)


def preflight(turns: DataFrame, instances: DataFrame, tasks: DataFrame) -> DataFrame:
    """``turns`` (instance_id, next_seq, task_id, worker_id, attempt) with ``conflict``: null if the turn may be applied, else why not: its instance is not found, has another next sequence, or
    the turn's token does not own a workflow task of the instance."""
    heads = instances.select(F.col("id").alias("instance_id"), F.col("next_seq").alias("__next"))
    owned = tasks.where("kind = 'workflow'").select("instance_id", F.col("id").alias("task_id"), "worker_id", "attempt", F.lit(True).alias("__own"))
    met = turns.join(heads, "instance_id", "left").join(owned, ["instance_id", "task_id", "worker_id", "attempt"], "left")
    why = F.when(F.col("__next").isNull(), "not found").when(F.col("__next") != F.col("next_seq"), "sequence").when(F.col("__own").isNull(), "token")
    return met.withColumn("conflict", why).drop("__next", "__own")


def drain(inbox: DataFrame, heads: DataFrame, caps: Capabilities = Capabilities()) -> DataFrame:
    """Each undrained event with the journal seq that it gets: next_seq on, in inbox order, up to the drain limit of a turn. heads: instance_id, next_seq."""
    place = F.row_number().over(Window.partitionBy("instance_id").orderBy("seq", "created_at", "id"))
    rows = inbox.withColumn("__place", place)
    if (most := drain_limit(caps)) is not None:
        rows = rows.where(F.col("__place") <= most)
    return rows.join(heads, "instance_id").withColumn("journal_seq", F.col("next_seq") - 1 + F.col("__place")).drop("__place")
