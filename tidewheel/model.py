"""Data model: the seven tables, their enumerations, and the request types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Event types of a journal.
COMMANDS = (
    "activity_scheduled", "timer_created", "child_scheduled", "side_effect", "now_recorded", "version_marker",
    "search_attributes_updated", "memo_updated", "local_activity", "update_accepted", "update_completed",
)
COMPLETIONS = (
    "activity_completed", "activity_failed", "timer_fired", "child_completed", "child_failed", "signal_received",
    "cancel_requested", "update_requested",
)
TERMINALS = ("workflow_completed", "workflow_failed", "workflow_canceled", "continued_as_new")
EVENT_TYPES = ("workflow_started", *COMMANDS, *COMPLETIONS, *TERMINALS)
# Instance statuses, and those that a purge takes by default or on request.
STATUSES = ("running", "completed", "failed", "terminated", "canceled", "stuck", "continued")
PURGE_DEFAULT = ("completed", "failed", "terminated", "canceled")
PURGEABLE = (*PURGE_DEFAULT, "continued")
DEFAULT_QUEUE = "default"

_RETRY = "struct<initial_ms:bigint,coef:double,max_ms:bigint,max_attempts:int>"
DDL = {
    "instances": "id string, name string, queue string, status string, input string, result string, failure string, parent_id string, "
    "parent_seq bigint, next_seq bigint, search_attributes map<string,string>, memo map<string,string>, created_at timestamp, "
    "updated_at timestamp, completed_at timestamp",
    "journal": "instance_id string, seq bigint, type string, name string, ref_seq bigint, payload string, recorded_at timestamp",
    "inbox": "id bigint, instance_id string, seq bigint, type string, name string, ref_seq bigint, payload string, created_at timestamp",
    "signal_dedupe": "instance_id string, dedupe_id string, created_at timestamp",
    "tasks": f"id bigint, kind string, queue string, instance_id string, name string, ref_seq bigint, input string, attempt int, "
    f"max_attempts int, retry {_RETRY}, start_to_close_ms bigint, visible_at timestamp, worker_id string, heartbeat binary, created_at timestamp",
    "timers": "instance_id string, seq bigint, fire_at timestamp",
    "schedules": "id string, cron string, workflow string, queue string, input string, next_run_at timestamp, paused boolean, "
    "created_at timestamp, updated_at timestamp",
}


def schema(name: str) -> T.StructType:
    """The columns of a table. Needs a session: Spark parses the types."""
    return T.StructType.fromDDL(DDL[name])


class NotFound(LookupError):
    """The row that an operator names does not exist."""


class AlreadyExists(ValueError):
    """The id is taken."""


class Superseded(RuntimeError):
    """The claim's token no longer owns the task."""


class Conflict(RuntimeError):
    """The turn started from a state that is no longer the latest."""


class BatchTooLarge(ValueError):
    """More items than one atomic append may carry."""


@dataclass(frozen=True)
class InstanceFilter:
    """Empty values match anything; attributes must all be present and equal. limit 0 means 100."""

    status: str = ""
    name: str = ""
    search_attributes: dict[str, str] = field(default_factory=dict)
    limit: int = 0
    offset: int = 0


@dataclass(frozen=True)
class ClaimRequest:
    """max_per_instance caps the tasks of one instance in a claim; 0 leaves strict first-in-first-out."""

    kind: str
    queues: tuple[str, ...]
    limit: int = 1
    lease_ms: int = 30_000
    worker_id: str = "worker"
    max_per_instance: int = 0


@dataclass(frozen=True)
class RetryPolicy:
    initial_ms: int = 1_000
    coefficient: float = 2.0
    max_ms: int = 60_000
    max_attempts: int = 0


@dataclass(frozen=True)
class Capabilities:
    """What a store takes in one transaction; 0 effects: no limit. swept: drained inbox rows of a terminal turn are deleted later."""

    max_effects: int = 0
    fair_dispatch: bool = True
    swept: bool = True
