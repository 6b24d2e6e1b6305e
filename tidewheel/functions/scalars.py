"""Scalar functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.model import COMMANDS, COMPLETIONS, PURGE_DEFAULT, PURGEABLE, TERMINALS, Capabilities, RetryPolicy


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Event classes


def is_command(kind: Column) -> Column:
    return kind.isin(*COMMANDS)


def is_completion(kind: Column) -> Column:
    return kind.isin(*COMPLETIONS)


def is_terminal(kind: Column) -> Column:
    return kind.isin(*TERMINALS)


# Retries


def backoff_ms(attempt: Column, initial_ms=0, coefficient=0.0, max_ms=0) -> Column:
    """Delay before an attempt: the initial delay times the coefficient for each attempt before, until it reaches the maximum.

    Values of 0 or less take the defaults (1 s, 2, 60 s); attempts below 1 count as the first. The product is folded step by step
    because a coefficient below 1 must not fall back under a maximum that it once reached.
    """
    base = RetryPolicy()
    start = F.when(_c(initial_ms) > 0, _c(initial_ms)).otherwise(base.initial_ms).cast("double")
    factor = F.when(_c(coefficient) > 0, _c(coefficient)).otherwise(base.coefficient).cast("double")
    most = F.when(_c(max_ms) > 0, _c(max_ms)).otherwise(base.max_ms).cast("double")
    steps = F.when(attempt <= 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(2), F.least(attempt, F.lit(10_000)).cast("int")))
    state = F.struct(start.alias("d"), F.lit(False).alias("done"))

    def step(acc, _):
        grown = acc["d"] * factor
        return F.when(acc["done"], acc).otherwise(F.struct(F.when(grown >= most, most).otherwise(grown).alias("d"), (grown >= most).alias("done")))

    end = F.aggregate(steps, state, step)
    return F.floor(F.when(~end["done"] & (end["d"] > most), most).otherwise(end["d"])).cast("bigint")


def fails_for_good(attempt: Column, max_attempts: Column, non_retryable: Column) -> Column:
    return non_retryable | ((max_attempts > 0) & (attempt >= max_attempts))


# Attributes


def merge_attributes(base: Column, patch: Column) -> Column:
    """The patch wins; a patched empty string deletes; nothing left is null. An empty value that was there before stays."""
    none = F.create_map().cast("map<string,string>")
    base, patch = F.coalesce(base, none), F.coalesce(patch, none)
    merged = F.map_filter(F.map_zip_with(base, patch, lambda k, a, b: F.coalesce(b, a)), lambda k, v: ~(F.map_contains_key(patch, k) & (v == "")))
    return F.when(F.size(merged) > 0, merged)


def has_attributes(attributes: Column, wanted: dict[str, str]) -> Column:
    """Every wanted pair is there. Keys are names, never paths; a missing key is not an empty value."""
    out = F.lit(True)
    for k, v in sorted(wanted.items()):
        out = out & F.coalesce(F.element_at(attributes, F.lit(k)) == v, F.lit(False))
    return out


def attributes_to_json(attributes: Column) -> Column:
    return F.coalesce(F.to_json(attributes), F.lit("{}"))


def attributes_from_json(text: Column) -> Column:
    parsed = F.from_json(text, "map<string,string>")
    return F.when(F.size(parsed) > 0, parsed)


# Derived ids


def schedule_instance_id(schedule_id: Column, fire_at: Column) -> Column:
    """The id of the instance that a schedule starts at a time; firing twice names the same instance. Session zone UTC."""
    return F.concat_ws(":", schedule_id, F.date_format(fire_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def child_id(parent_id: Column, seq: Column) -> Column:
    return F.concat_ws(":", parent_id, seq.cast("string"))


def continued_id(instance_id: Column, seq: Column) -> Column:
    return F.concat_ws("~", instance_id, seq.cast("string"))


def idempotency_key(instance_id: Column, seq: Column) -> Column:
    return F.concat_ws("/", instance_id, seq.cast("string"))


def new_uuid() -> Column:
    """32 hex digits. Not repeatable: write it down as an event and read it back."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


# Times and limits


def clamp_deadline(deadline: Column, now: Column) -> Column:
    """A deadline in the past is due now; one whose UTC year is outside 1000 to 9999 is null (out of range)."""
    t = F.greatest(deadline, now)
    return F.when(F.year(t).between(1000, 9999), t)


def inbox_batch_limit(caps: Capabilities) -> int:
    return max(1, caps.max_effects // 4) if caps.max_effects > 0 else 100


def drain_limit(caps: Capabilities) -> int | None:
    """Inbox items that one turn may drain; None: all."""
    return max(1, max(2, caps.max_effects - 20) // 2) if caps.max_effects > 0 else None


def advancement_budget(caps: Capabilities) -> int:
    return caps.max_effects if caps.max_effects > 0 else 100


def advancement_ops(events: Column, children: Column, tasks: Column, timers: Column, drained: Column, terminal: Column, notify: Column, swept: bool = True) -> Column:
    """Write operations of a turn. A terminal turn makes no tasks and timers, and does not delete drained rows where they are swept."""
    open_turn = tasks + timers + drained
    return 2 + events + 3 * children + F.when(~terminal, open_turn).otherwise(F.lit(0) if swept else drained) + notify.cast("int")


def command_cost(kind: Column) -> Column:
    return F.when(kind.isin("activity_scheduled", "timer_created"), 2).when(kind == "child_scheduled", 4).otherwise(1)


def purge_statuses(statuses=None) -> tuple[str, ...]:
    """The statuses that a purge may take, each once and in order. Live and unknown ones are refused."""
    if not statuses:
        return PURGE_DEFAULT
    if bad := [s for s in statuses if s not in PURGEABLE]:
        raise ValueError(f"only finished instances can be purged, not {bad}")
    return tuple(dict.fromkeys(statuses))


# Payloads


def wrap_payload(name: Column, payload: Column) -> Column:
    """An inbox payload carries its name, if it has one: {"_name": name, "_body": payload}."""
    body = F.coalesce(payload, F.lit("null"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit('{"_name":'), F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r"^\{\"n\":(.*)\}$", 1), F.lit(',"_body":'), body, F.lit("}"))).otherwise(payload)


def unwrap_payload(stored: Column) -> tuple[Column, Column]:
    """(name, payload) of a stored inbox payload."""
    name = F.get_json_object(stored, "$._name")
    return name, F.when(name.isNull(), stored).otherwise(F.get_json_object(stored, "$._body"))


def shorten(text: Column, most: int) -> Column:
    """At most so many bytes for display (256 if not positive), then an ellipsis. A cut character is dropped whole."""
    most = most if most > 0 else 256
    start = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(start, "\ufffd+$", ""), F.lit("…")))
