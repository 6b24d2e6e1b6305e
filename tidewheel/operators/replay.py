"""Replay of workflow code against a journal, as generators.

A workflow is a generator function ``flow(ctx, input)``. It yields what the context's methods return; an operation that is not complete ends the turn
there, and the next turn replays from the start against a longer journal. Commands are matched with the recorded ones by type and
name, in order; the first that differs is a determinism violation.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scalars import advancement_budget, drain_limit
from tidewheel.model import COMMANDS, COMPLETIONS, Capabilities


class Suspend(Exception):
    """The turn can't go on before something completes."""


class Determinism(Exception):
    """The code asks for another command than the journal has."""


class Canceled(Exception):
    """The instance was asked to stop, and this wait is not complete."""


class ContinueAsNew(Exception):
    def __init__(self, payload):
        super().__init__("continue as new")
        self.payload = payload


class Failed(Exception):
    """An activity or child failed; the text is its error."""


@dataclass
class Event:
    seq: int
    type: str
    name: str = ""
    ref_seq: int = 0
    payload: str | None = None


@dataclass
class Turn:
    status: str  # suspended, completed, failed, canceled, continued, stuck, violation
    commands: list[Event]
    payload: str | None = None


def _loads(text):
    return json.loads(text) if text else None


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


@dataclass
class Context:
    events: list[Event]
    now: datetime
    instance_id: str = ""
    attributes: dict = field(default_factory=dict)
    notes: dict = field(default_factory=dict)
    read_only: bool = False

    def __post_init__(self):
        self.next_seq = max((e.seq for e in self.events), default=0) + 1
        self.recorded = [e for e in self.events if e.type in COMMANDS]
        self.done = {e.ref_seq: e for e in self.events if e.type in COMPLETIONS and e.ref_seq}
        self.signals: dict[str, list[Event]] = {}
        for e in self.events:
            if e.type == "signal_received":
                self.signals.setdefault(e.name, []).append(e)
        self.canceled = any(e.type == "cancel_requested" for e in self.events)
        self.at, self.commands, self.queries, self.updates = 0, [], {}, {}

    # Commands

    def _peek(self) -> Event | None:
        return self.recorded[self.at] if self.at < len(self.recorded) else None

    def _command(self, kind: str, name: str = "", payload: str | None = None) -> Event:
        while (rec := self._peek()) is not None:
            self.at += 1
            if rec.type == "version_marker" and kind != "version_marker":
                continue
            if (rec.type, rec.name or "") != (kind, name):
                raise Determinism(f"recorded {rec.type} {rec.name}, asked for {kind} {name}")
            return rec
        if self.read_only:
            raise Suspend
        e = Event(self.next_seq, kind, name, 0, payload)
        self.next_seq += 1
        self.commands.append(e)
        return e

    def _result(self, e: Event):
        done = self.done.get(e.seq)
        if done is None:
            raise Suspend
        if done.type in ("activity_failed", "child_failed"):
            raise Failed(_loads(done.payload) or "operation failed")
        return None if done.type == "timer_fired" else _loads(done.payload)

    def start(self, activity: str, value=None, retry: dict | None = None, timeout_ms: int = 0) -> Event:
        """Schedule an activity without waiting."""
        said = {"input": value} | ({"retry": retry} if retry else {}) | ({"start_to_close_timeout_ms": timeout_ms} if timeout_ms > 0 else {})
        return self._command("activity_scheduled", activity, json.dumps(said))

    def execute(self, activity: str, value=None, **options):
        """An activity's result; it runs to its end even where the instance was canceled."""
        return self._result(self.start(activity, value, **options))

    def get(self, e: Event):
        if e.seq not in self.done and self.canceled:
            raise Canceled
        return self._result(e)

    def local(self, activity, name: str, value=None):
        """Run a function in the turn and record what came of it."""
        if self._peek() is not None:
            p = _loads(self._command("local_activity", name).payload) or {}
        else:
            if self.read_only:
                raise Suspend
            p = {"input": value}
            try:
                p["result"] = activity(value)
            except Exception as ex:  # any failure of user code is a recorded result
                p["error"] = str(ex)
            self._command("local_activity", name, json.dumps(p))
        if p.get("error"):
            raise Failed(p["error"])
        return p.get("result")

    def start_child(self, name: str, value=None) -> Event:
        return self._command("child_scheduled", name, json.dumps({"child_id": f"{self.instance_id}:{self.next_seq}", "name": name, "input": value}))

    def child(self, name: str, value=None):
        return self.get(self.start_child(name, value))

    # Time

    def clock(self) -> datetime:
        return _time(_loads(self._command("now_recorded", "", json.dumps(self.now.isoformat())).payload))

    def timer(self, seconds: float) -> Event:
        return self._command("timer_created", "", json.dumps({"fire_at": (self.now + timedelta(seconds=seconds)).isoformat()}))

    def _sleep(self, until: datetime) -> None:
        rec = self._peek()  # a recorded timer is replayed before cancellation is looked at
        if (rec is None or rec.type != "timer_created") and self.canceled:
            raise Canceled
        e = self._command("timer_created", "", json.dumps({"fire_at": until.isoformat()}))
        if e.seq not in self.done:
            raise Canceled if self.canceled else Suspend

    def sleep(self, seconds: float) -> None:
        self._sleep(self.now + timedelta(seconds=seconds))

    def sleep_until(self, until: datetime) -> None:
        until = max(until.astimezone(timezone.utc), self.clock())
        if not 1000 <= until.year <= 9999:
            raise ValueError("the deadline's year must be 1000 to 9999")
        self._sleep(until)

    # Signals and waits

    def _signal(self, name: str) -> Event | None:
        line = self.signals.get(name)
        return line[0] if line else None

    def receive(self, name: str):
        if (e := self._signal(name)) is None:
            raise Canceled if self.canceled else Suspend
        self.signals[name].pop(0)
        return _loads(e.payload)

    def receive_within(self, name: str, seconds: float):
        """(value, True), or (None, False) after the time. A signal that is there wins over the timer; a recorded timer that a signal precedes
        belongs to a later wait."""
        timer, rec, sig = None, self._peek(), self._signal(name)
        if rec is not None and rec.type == "timer_created" and not (sig is not None and sig.seq < rec.seq):
            timer = self.timer(seconds)
        if timer is None:
            if self.canceled:
                raise Canceled
            if sig is not None:
                return self.receive(name), True
            timer = self.timer(seconds)
        if self.canceled:
            raise Canceled
        if sig is not None:
            return self.receive(name), True
        if timer.seq in self.done:
            return None, False
        raise Suspend

    def first(self, *futures: Event) -> int:
        """The first in argument order that is ready; -1 for no futures."""
        if not futures:
            return -1
        for i, f in enumerate(futures):
            if f.seq in self.done:
                return i
        raise Canceled if self.canceled else Suspend

    def all(self, *futures: Event) -> None:
        if any(f.seq not in self.done for f in futures):
            raise Canceled if self.canceled else Suspend
        for f in futures:
            self._result(f)

    # Recorded values

    def side_effect(self, fn):
        if self._peek() is not None:
            return _loads(self._command("side_effect").payload)
        if self.read_only:
            raise Suspend
        return _loads(self._command("side_effect", "", json.dumps(fn())).payload)

    def new_uuid(self) -> str:
        return self.side_effect(lambda: uuid.uuid4().hex)

    def version(self, change: str, low: int, high: int) -> int:
        while (rec := self._peek()) is not None and rec.type == "version_marker":
            p = _loads(rec.payload) or {}
            if p.get("change_id") == change:
                return (_loads(self._command("version_marker", change).payload) or {}).get("version", 0)
            self.at += 1
        if self._peek() is not None:
            return low
        self._command("version_marker", change, json.dumps({"change_id": change, "version": high}))
        return high

    def _patch(self, kind: str, held: dict, patch: dict) -> dict:
        new = {k: v for k, v in {**held, **patch}.items() if not (k in patch and v == "")}
        return _loads(self._command(kind, "", json.dumps(new)).payload)

    def upsert_attributes(self, patch: dict) -> None:
        self.attributes = self._patch("search_attributes_updated", self.attributes, patch)

    def upsert_memo(self, patch: dict) -> None:
        self.notes = self._patch("memo_updated", self.notes, patch)

    def continue_as_new(self, value=None):
        raise ContinueAsNew(json.dumps(value))

    # Queries and updates

    def on_query(self, name: str, handler) -> None:
        self.queries[name] = handler

    def on_update(self, name: str, handler) -> None:
        self.updates[name] = handler

    def _update_due(self):
        """The accepted update that is not complete, else the oldest requested one: (id, name, input, accepted)."""
        asked, taken, done = {}, None, set()
        for e in [*self.events, *self.commands]:
            p = (_loads(e.payload) or {}) if e.type.startswith("update_") else {}
            if not (uid := p.get("id")):
                continue
            if e.type == "update_requested":
                asked.setdefault(uid, (e.name, p.get("input")))
            elif e.type == "update_accepted":
                taken = uid
            else:
                done.add(uid)
        if taken is not None and taken not in done:
            return taken, *asked.get(taken, ("", None)), True
        return next(((u, n, v, False) for u, (n, v) in asked.items() if u not in done), None)

    def run_updates(self) -> None:
        """Handle open updates one after the other; a handler may suspend."""
        while (due := self._update_due()) is not None:
            uid, name, value, accepted = due
            if (handler := self.updates.get(name)) is None:
                return
            if not accepted:
                self._command("update_accepted", name, json.dumps({"id": uid}))
            try:
                said = {"id": uid, "result": handler(self, value)}
            except Failed as ex:
                said = {"id": uid, "error": str(ex)}
            self._command("update_completed", name, json.dumps(said))


def run_turn(flow, events: list[Event], now: datetime, value=None, **about) -> Turn:
    """Replay and go on as far as the journal allows."""
    ctx = Context(events, now, **about)
    try:
        result = flow(ctx, value)
        turn = Turn("completed", ctx.commands, json.dumps(result))
    except Suspend:
        turn = Turn("suspended", ctx.commands)
    except Canceled:
        turn = Turn("canceled", ctx.commands)
    except ContinueAsNew as new:
        turn = Turn("continued", ctx.commands, new.payload)
    except Determinism as ex:
        return Turn("violation", [], str(ex))
    except Failed as ex:
        turn = Turn("failed", ctx.commands, json.dumps(str(ex)))
    except Exception as ex:  # an unexpected error in user code leaves the instance stuck
        return Turn("stuck", ctx.commands, str(ex))
    try:
        ctx.run_updates()
    except Suspend:
        turn = Turn("suspended", ctx.commands)
    except Determinism as ex:
        return Turn("violation", [], str(ex))
    return turn


def run_query(flow, events: list[Event], now: datetime, query: str, arg=None, value=None, **about):
    """A handler's answer on the replayed state; nothing is recorded."""
    ctx = Context(events, now, read_only=True, **about)
    try:
        flow(ctx, value)
    except (Suspend, Canceled, Failed, ContinueAsNew):
        pass
    if query not in ctx.queries:
        raise LookupError(f"no query handler {query!r}")
    return ctx.queries[query](arg)


_END = {"completed": "workflow_completed", "failed": "workflow_failed", "canceled": "workflow_canceled", "continued": "continued_as_new"}
#: Statuses of turns of which nothing is applied: the task is to be tried again later.
REFUSED = ("violation", "over_budget")
TURN_DDL = "instance_id string, status string, seq bigint, type string, name string, ref_seq bigint, payload string"
FOLD_DDL = TURN_DDL + ", inbox_id bigint, cut boolean"
_COST = {"activity_scheduled": 2, "timer_created": 2, "child_scheduled": 4}


def fitting(status: str, commands: list[Event], drained: int, caps: Capabilities, parent: bool = False) -> int | None:
    """How many of a turn's commands one commit may carry; None if not even the first one, or not all of a turn that ends. The costs are those of ``advancement_ops``."""
    budget, kids = advancement_budget(caps), sum(c.type == "child_scheduled" for c in commands)
    if status != "suspended":
        events = drained + len(commands) + (status in _END)
        cost = 2 + events + 3 * (kids + (status == "continued")) + (0 if caps.swept else drained) + (parent and status != "continued")
        return len(commands) if cost <= budget else None
    left, kept = budget - 2 - 2 * drained, 0
    for c in commands:
        left -= _COST.get(c.type, 1)
        if left < 0:
            break
        kept += 1
    return None if commands and not kept else kept


def advance(
    flow, instance_id: str, log: list[Event], drained: list[Event], now: datetime, value=None, caps: Capabilities | None = None, attributes: dict | None = None, notes: dict | None = None, parent: bool = False
) -> tuple[str, list[Event], bool]:
    """(status, new events, cut): drained inbox events take the next seqs, then the commands, then the end. With ``caps`` a turn keeps the commands that fit its budget (cut: some
    did not, and replay asks for them again), and one that ends over budget is refused."""
    seq = max((e.seq for e in log), default=0) + 1
    drained = [Event(seq + i, e.type, e.name, e.ref_seq, e.payload) for i, e in enumerate(drained)]
    turn = run_turn(flow, [*log, *drained], now, value, instance_id=instance_id, attributes=attributes or {}, notes=notes or {})
    if turn.status == "violation":
        return "violation", [], False
    keep = len(turn.commands)
    if caps is not None and (keep := fitting(turn.status, turn.commands, len(drained), caps, parent)) is None:
        return "over_budget", [], False
    new = [*drained, *turn.commands[:keep]]
    if turn.status in _END:
        new.append(Event(seq + len(new), _END[turn.status], "", 0, turn.payload))
    return turn.status, new, keep < len(turn.commands)


def fold_turns(journal: DataFrame, inbox: DataFrame, flow, now: datetime, idle_too: bool = False, about: DataFrame | None = None, caps: Capabilities | None = None) -> DataFrame:
    """One turn of every instance that has undrained events, or with idle_too of every one in ``journal``: rows of FOLD_DDL. ``flow`` is a workflow, or
    workflows by name; an instance of a name that is not there is left alone. A turn without new events is one row with a null seq. inbox_id: the inbox row that an event was drained from.

    about: instance_id, search_attributes, memo and parent_id, which the workflow's context starts with. caps: limits of a commit, which cap the drained events and the commands.
    The rows of an instance are neighbours in one sorted partition, and read one by one. Replay needs all of its journal; a long one should be continued as new.
    """
    # New names for all columns: the sides may come from one table.
    columns = {c: F.col(c) for c in ("instance_id", "seq", "type", "name", "payload")} | {"ref_seq": F.coalesce("ref_seq", F.lit(0)).cast("bigint")}
    sides = [
        journal.select(F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("id"), *[v.alias(k) for k, v in columns.items()]),
        inbox.select(F.lit(2).alias("side"), F.col("id"), *[v.alias(k) for k, v in columns.items()]),
    ]
    if about is not None:
        said = F.to_json(F.struct(F.col("search_attributes").alias("attributes"), F.col("memo").alias("notes"), F.col("parent_id").isNotNull().alias("parent")))
        sides.append(about.select(F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("id"), "instance_id", F.lit(0).cast("bigint").alias("seq"), F.lit("about").alias("type"), F.lit("").alias("name"), said.alias("payload"), F.lit(0).cast("bigint").alias("ref_seq")))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    parts = int(journal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "instance_id").sortWithinPartitions("instance_id", "side", "seq", "id")
    order = ("instance_id", "side", "id", "seq", "type", "name", "ref_seq", "payload")

    def one(key: str, told: dict, log: list[Event], box: list[tuple[int, Event]]):
        if not log or not box and not idle_too:
            return
        code = flow.get(log[0].name) if isinstance(flow, dict) else flow
        if code is None:
            return
        box = box[: drain_limit(caps)] if caps is not None else box
        status, new, cut = advance(code, key, log, [e for _, e in box], now, _loads(log[0].payload), caps, **told)
        for i, e in enumerate(new):
            yield key, status, e.seq, e.type, e.name, e.ref_seq, e.payload, box[i][0] if i < len(box) else None, cut
        if not new:
            yield key, status, None, None, None, None, None, None, cut

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in FOLD_DDL.split(", ")]
        key, told, log, box = None, {}, [], []

        def record(out):
            columns = list(zip(*out)) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for b in batches:
            out: list[tuple] = []
            for instance, side, id, seq, kind, name, ref, payload in zip(*(b.column(c).to_pylist() for c in order)):
                if instance != key:
                    out.extend(one(key, told, log, box))
                    key, told, log, box = instance, {}, [], []
                if side == 0:
                    told = _loads(payload)
                elif side == 1:
                    log.append(Event(seq, kind, name or "", ref, payload))
                else:
                    box.append((id, Event(seq, kind, name or "", ref, payload)))
            yield record(out)
        yield record(list(one(key, told, log, box)))

    return rows.select(*order).mapInArrow(run, FOLD_DDL)
