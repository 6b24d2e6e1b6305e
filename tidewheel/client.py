"""A client and a worker over a store: the facade of the engine. Each step is one commit of all the tables that it changes; if another commit came first, it is computed anew."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import activity
from tidewheel.functions.scalars import backoff_ms, continued_id, fails_for_good, idempotency_key
from tidewheel.model import AlreadyExists, Capabilities, ClaimRequest, Conflict, InstanceFilter, schema
from tidewheel.operators import claims, journal as J, mutations as M, reads, replay
from tidewheel.sources.tables import Store

OPEN = ("running",)
#: Times that a step is computed anew when other commits come first.
MOST_TRIES = 20
#: How long a refused turn waits.
NACK_MS = 10_000
#: Groups by which the rows of a poll are numbered.
_GROUPS = 64


def numbered(rows: DataFrame, base: int, *order: str) -> Column:
    """A number above ``base`` for each row, without gaps; rows of one instance are in order. Rows are numbered in groups of instances, no task sees them all."""
    group = F.pmod(F.xxhash64("instance_id"), F.lit(_GROUPS))
    sizes = {r[0]: r[1] for r in rows.groupBy(group.alias("g")).count().collect()}  # _GROUPS rows at most
    starts, n = [], base
    for g in range(_GROUPS):
        starts.append(n)
        n += sizes.get(g, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), group.cast("int") + 1)
    return start + F.row_number().over(Window.partitionBy(group).orderBy("instance_id", *order))


def filled(name: str, rows: DataFrame) -> DataFrame:
    """``rows`` with all columns of a table; those that it lacks are null."""
    for f in schema(name):
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema(name)])


def _stamp(now: datetime | None):
    return F.lit(now or datetime.now(timezone.utc))


class Client:
    """Start, look at, signal and stop instances; keep schedules."""

    def __init__(self, store: Store, caps: Capabilities = Capabilities()):
        self.store, self.spark, self.caps = store, store.spark, caps

    def _rows(self, name: str, rows: list[dict]) -> DataFrame:
        fields = schema(name).fieldNames()
        return self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema(name))

    def step(self, change):
        """``change(base)`` computes a step from the tables as of version ``base`` and commits it; computed anew if another commit came first."""
        for _ in range(MOST_TRIES):
            try:
                return change(self.store.version())
            except Conflict:
                continue
        raise Conflict(f"{MOST_TRIES} other commits came first")

    def start(self, workflow: str, value=None, id: str = "", queue: str = "", attributes: dict | None = None, memo: dict | None = None, now: datetime | None = None) -> str:
        """The new instance's id; one is made up if none is given."""
        id = id or uuid.uuid4().hex
        new = self._rows("instances", [{"id": id, "name": workflow, "queue": queue, "input": json.dumps(value), "search_attributes": attributes, "memo": memo}])
        self.create(new, now)
        return id

    def create(self, new: DataFrame, now: datetime | None = None, strict: bool = True) -> None:
        def change(base: int) -> None:
            out = M.create_instances(self.store.read("instances"), new, _stamp(now))
            if strict and not out["rejected"].isEmpty():
                raise AlreadyExists(out["rejected"].first()["id"])
            self.store.commit(append={t: filled(t, out[t]) for t in ("instances", "journal", "tasks")}, base=base)

        self.step(change)

    def get(self, id: str):
        return reads.one(reads.get_instance(self.store.read("instances"), id))

    def get_journal(self, id: str, after: int = 0) -> DataFrame:
        return reads.get_journal(self.store.read("journal"), id, after)

    def list(self, f: InstanceFilter = InstanceFilter()) -> DataFrame:
        return reads.list_instances(self.store.read("instances"), f)

    def send(self, id: str, items: list[dict], now: datetime | None = None) -> int:
        """Events (type, name, payload, ref_seq, dedupe_id) for an instance, at most as many as the store takes in one batch; returns how many were new. A sender that only
        repeats itself still wakes it."""
        M.check_batch(len(items), self.caps)
        row = self.get(id)

        def change(base: int) -> int:
            top = self.store.read("inbox").agg(F.max("id")).first()[0] or 0
            rows = [(id, i.get("dedupe_id"), top + 1 + k, i["type"], i.get("name", ""), i.get("ref_seq", 0), i.get("payload")) for k, i in enumerate(items)]
            df = self.spark.createDataFrame(rows, "instance_id string, dedupe_id string, arrival bigint, type string, name string, ref_seq bigint, payload string")
            fresh = self.store.hold(M.deliver(df, self.store.read("signal_dedupe")))
            n = fresh.count()
            box = fresh.select(F.col("arrival").alias("id"), "instance_id", F.col("arrival").alias("seq"), "type", "name", "ref_seq", "payload", _stamp(now).alias("created_at"))
            seen = fresh.where("coalesce(dedupe_id, '') <> ''").select("instance_id", "dedupe_id", _stamp(now).alias("created_at"))
            new = {"inbox": box, "signal_dedupe": seen}
            if row.status in OPEN:
                new["tasks"] = self.woken(self.spark.createDataFrame([(id,)], "instance_id string"), self.store.read("tasks"), self.store.read("instances"), now)
            try:
                self.store.commit(append=new, base=base)
            finally:
                self.store.release(fresh)
            return n

        return self.step(change)

    def woken(self, ids: DataFrame, tasks: DataFrame, instances: DataFrame, now: datetime | None = None) -> DataFrame:
        """A workflow task for each running instance that has none."""
        working = tasks.where("kind = 'workflow'").select("instance_id")
        open_ = instances.where("status = 'running'").select(F.col("id").alias("instance_id"), "queue", "name")
        idle = open_.join(ids.select("instance_id").distinct(), "instance_id", "left_semi").join(working, "instance_id", "left_anti")
        return filled("tasks", idle.select(F.lit("workflow").alias("kind"), "queue", "instance_id", "name", _stamp(now).alias("visible_at")))

    def tail(self, id: str):
        """The last run of a chain of continued runs, within a limit of hops."""
        row = self.get(id)
        for _ in range(reads.MAX_HOPS):
            if row.status != "continued":
                break
            last = self.get_journal(row.id).agg(F.max("seq")).first()[0]
            row = self.get(f"{row.id}~{last}")
        return row

    def signal(self, id: str, name: str, value=None, dedupe_id: str | None = None, now: datetime | None = None) -> int:
        return self.send(id, [{"type": "signal_received", "name": name, "payload": json.dumps(value), "dedupe_id": dedupe_id}], now)

    def signal_batch(self, id: str, signals: list[tuple], now: datetime | None = None) -> int:
        """signals: (name, value, dedupe id or None)."""
        return self.send(id, [{"type": "signal_received", "name": n, "payload": json.dumps(v), "dedupe_id": d} for n, v, d in signals], now)

    def update(self, id: str, update_id: str, name: str, value=None, now: datetime | None = None) -> int:
        return self.send(id, [{"type": "update_requested", "name": name, "payload": json.dumps({"id": update_id, "input": value}), "dedupe_id": update_id}], now)

    def update_result(self, id: str, update_id: str):
        """(result, error) of a completed update, or None."""
        row = J.update_status(self.get_journal(id)).where((F.col("update_id") == update_id) & (F.col("state") == "completed")).first()
        return None if row is None else (json.loads(row.result) if row.result else None, row.error)

    def cancel(self, id: str, now: datetime | None = None) -> None:
        """Ask the last run of the chain to stop."""
        self.send(self.tail(id).id, [{"type": "cancel_requested"}], now)

    def terminate(self, id: str, now: datetime | None = None) -> None:
        """Stop the last run of the chain, whatever it does."""
        id, names = self.tail(id).id, ("instances", "tasks", "timers", "signal_dedupe", "inbox")

        def change(base: int) -> None:
            out = M.terminate({t: self.store.read(t) for t in names}, id, _stamp(now))
            self.store.commit({t: out[t] for t in names}, base=base)

        self.step(change)

    def upsert_schedule(self, id: str, cron: str, workflow: str, queue: str = "", value=None, paused: bool = False, now: datetime | None = None) -> None:
        new = self._rows("schedules", [{"id": id, "cron": cron, "workflow": workflow, "queue": queue, "input": json.dumps(value), "paused": paused, "created_at": now}])
        self.store.replace("schedules", M.upsert_schedules(self.store.read("schedules"), new.drop("next_run_at"), _stamp(now)))

    def get_schedule(self, id: str):
        return reads.one(reads.get_schedule(self.store.read("schedules"), id))

    def pause_schedule(self, id: str, paused: bool = True) -> None:
        self.get_schedule(id)
        self.store.replace("schedules", M.pause_schedule(self.store.read("schedules"), id, paused))

    def purge(self, older_than_ms: int, statuses=None, limit: int = 0, now: datetime | None = None) -> int:
        names = ("instances", "journal", "inbox", "signal_dedupe", "tasks", "timers")

        def change(base: int) -> int:
            tables = {t: self.store.read(t) for t in names}
            victims = self.store.hold(M.purge_victims(tables["instances"], _stamp(now), older_than_ms, statuses, limit))
            if n := victims.count():
                self.store.commit(M.purge(tables, victims), base=base)
            self.store.release(victims)
            return n

        return self.step(change)

    def result(self, id: str, timeout_s: float = 0, poll_s: float = 0.2):
        """The result at the end of a chain of continued runs. Raises on any other end, and TimeoutError while it runs."""
        until = time.monotonic() + timeout_s
        while True:
            row = self.tail(id)
            if row.status == "completed":
                return json.loads(row.result) if row.result else None
            if row.status not in ("running", "continued"):
                raise RuntimeError(f"{row.id} is {row.status}: {row.failure or ''}")
            if time.monotonic() >= until:
                raise TimeoutError(row.id)
            time.sleep(poll_s)


class Worker:
    """Registered workflows and activities, and the steps that move a store on. ``poll_once`` is one round of all of them; ``counters`` counts what they did.

    A claim takes up to ``limit`` activities of ``queues`` (none given: all), at most ``max_per_instance`` of one instance, under a lease.
    """

    def __init__(self, client: Client, queues: tuple[str, ...] = (), limit: int = 10_000, max_per_instance: int = 0, lease_ms: int = 30_000, worker_id: str = ""):
        self.client, self.store, self.caps, self.workflows, self.activities = client, client.store, client.caps, {}, {}
        self.queues, self.limit, self.max_per_instance, self.lease_ms, self.worker_id = queues, limit, max_per_instance, lease_ms, worker_id or uuid.uuid4().hex
        self.counters: Counter[str] = Counter()
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()

    def workflow(self, fn, name: str = ""):
        self.workflows[name or fn.__name__] = fn
        return fn

    def activity(self, fn, name: str = ""):
        self.activities[name or fn.__name__] = fn
        return fn

    # Control

    def start(self, every_s: float = 0.5) -> None:
        """Poll in a thread until ``shutdown``."""
        if self.running():
            raise RuntimeError("the worker runs")
        self._stop.clear()

        def loop() -> None:
            while not self._stop.is_set():
                self.poll_once()
                self._stop.wait(every_s)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def shutdown(self) -> None:
        """End after the round that runs."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join()

    def poll_once(self, now: datetime | None = None) -> dict[str, int]:
        now = now or datetime.now(timezone.utc)
        return {"timers": self.fire_timers(now), "schedules": self.fire_schedules(now), "turns": self.turns(now), "activities": self.run_activities(now)}

    def query(self, id: str, name: str, arg=None):
        """A handler's answer on the journal and what is not drained yet."""
        row = self.client.get(id)
        log = [replay.Event(r.seq, r.type, r.name or "", r.ref_seq or 0, r.payload) for r in self.client.get_journal(id).collect()]
        box = reads.inbox_order(self.store.read("inbox").where(F.col("instance_id") == id)).collect()
        log += [replay.Event(len(log) + 1 + k, r.type, r.name or "", r.ref_seq or 0, r.payload) for k, r in enumerate(box)]
        about = {"attributes": row.search_attributes or {}, "notes": row.memo or {}}
        return replay.run_query(self.workflows[row.name], log, datetime.now(timezone.utc), name, arg, json.loads(row.input) if row.input else None, instance_id=id, **about)

    def update(self, id: str, name: str, value=None, update_id: str = "", now: datetime | None = None):
        """(result, error) of an update: sent, and turned by this worker until it is done. TimeoutError if the handler waits for something else."""
        update_id = update_id or uuid.uuid4().hex
        if self.client.get(id).status not in OPEN:
            raise RuntimeError(f"{id} does not run")
        self.client.update(id, update_id, name, value, now)
        while (done := self.client.update_result(id, update_id)) is None:
            if not sum(self.poll_once(now).values()):
                raise TimeoutError(update_id)
        return done

    # Steps

    def _delivered(self, events: DataFrame, now: datetime) -> DataFrame:
        """Inbox rows of events (instance_id, type, ref_seq, payload), after all that is there."""
        top = self.store.read("inbox").agg(F.max("id")).first()[0] or 0
        rows = events.withColumn("id", numbered(events, top, "ref_seq"))
        return filled("inbox", rows.withColumns({"seq": F.col("id"), "name": F.lit(""), "created_at": _stamp(now)}))

    def fire_timers(self, now: datetime) -> int:
        def change(base: int) -> int:
            instances = self.store.read("instances")
            out = M.fire_timers(self.store.read("timers"), instances, _stamp(now))
            fired = self.store.hold(out["fired"])
            if n := fired.count():
                running = instances.where("status = 'running'").select(F.col("id").alias("instance_id"))
                events = fired.join(running, "instance_id", "left_semi").select("instance_id", F.lit("timer_fired").alias("type"), F.col("seq").alias("ref_seq"), F.lit(None).cast("string").alias("payload"))
                timers = self.store.read("timers").join(fired, ["instance_id", "seq"], "left_anti")
                self.store.commit({"timers": timers}, {"inbox": self._delivered(events, now), "tasks": self.client.woken(events, self.store.read("tasks"), instances, now)}, base)
            self.store.release(fired)
            return n

        return self.client.step(change)

    def fire_schedules(self, now: datetime) -> int:
        def change(base: int) -> int:
            instances = self.store.read("instances")
            out = M.claim_schedules(self.store.read("schedules"), instances, _stamp(now))
            claimed = self.store.hold(out["claimed"])
            if n := claimed.count():
                made = M.create_instances(instances, claimed.select(F.col("instance_id").alias("id"), F.col("workflow").alias("name"), "queue", "input"), _stamp(now))
                self.store.commit({"schedules": out["schedules"]}, {t: filled(t, made[t]) for t in ("instances", "journal", "tasks")}, base)
            self.store.release(claimed)
            return n

        return self.client.step(change)

    def turns(self, now: datetime) -> int:
        """One turn of each running instance that has a workflow task. The turns are folded from one version of the tables and applied to the last one: a turn counts only if its
        instance runs and has the journal it started from, only inbox rows that it drained go, and an instance with more to drain keeps its task."""
        inst, tasks = self.store.read("instances"), self.store.read("tasks")
        due = tasks.where("kind = 'workflow'").where(F.col("visible_at") <= _stamp(now)).select("instance_id").distinct()
        due = due.join(inst.where("status = 'running'").select(F.col("id").alias("instance_id")), "instance_id", "left_semi")
        log = self.store.read("journal").join(due, "instance_id", "left_semi")
        box = self.store.read("inbox").join(due, "instance_id", "left_semi")
        about = inst.select(F.col("id").alias("instance_id"), "search_attributes", "memo", "parent_id").join(due, "instance_id", "left_semi")
        rows = self.store.hold(replay.fold_turns(log, box, dict(self.workflows), now, idle_too=True, about=about, caps=self.caps))
        ends = rows.groupBy("instance_id").agg(F.first("status").alias("turn"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("payload", "seq").alias("payload"), F.bool_or("cut").alias("cut"))
        ends = self.store.hold(ends)
        told = {r[0]: r[1] for r in ends.groupBy("turn").count().collect()}
        if told:
            self.counters.update({"workflow_tasks": sum(told.values())} | {f"terminal {t}": n for t, n in told.items() if t not in ("suspended", *replay.REFUSED)} | {f"nack {t}": told[t] for t in replay.REFUSED if t in told})
            self.counters["conflicts"] += self.client.step(lambda base: self._apply(rows, ends, now, base))
        self.store.release(rows, ends)
        return sum(n for t, n in told.items() if t not in replay.REFUSED)

    def _apply(self, rows: DataFrame, ends: DataFrame, now: datetime, base: int) -> int:
        """Commit folded turns; returns how many did not fit the tables any more."""
        inst, tasks, inbox, seen = (self.store.read(t) for t in ("instances", "tasks", "inbox", "signal_dedupe"))
        heads = inst.where("status = 'running'").select(F.col("id").alias("instance_id"), "next_seq")
        fits = (F.col("turn").isin(*replay.REFUSED)) | F.col("first").isNull() | (F.col("first") == F.col("next_seq"))
        valid = self.store.hold(ends.join(heads, "instance_id").where(fits).drop("next_seq"))
        refused = valid.where(F.col("turn").isin(*replay.REFUSED))
        done = valid.where(~F.col("turn").isin(*replay.REFUSED))
        news = self.store.hold(rows.where("seq is not null").join(done.select("instance_id"), "instance_id", "left_semi"))
        drained = news.where("inbox_id is not null").select(F.col("inbox_id").alias("id"), "instance_id")
        queue = inst.select(F.col("id").alias("instance_id"), "queue")
        fx = J.effects(news.join(queue, "instance_id"), F.col("queue"))
        ended = done.where("turn <> 'suspended'")
        live = done.where("turn = 'suspended'").select("instance_id")
        about = ended.join(inst, ended["instance_id"] == inst["id"])
        chain = about.where("turn = 'continued'").select(continued_id(F.col("id"), F.col("last")).alias("id"), "name", "queue", F.col("payload").alias("input"), "parent_id", "parent_seq")
        finished = about.select("parent_id", "parent_seq", F.col("turn").alias("status"), F.when(F.col("turn") == "completed", F.col("payload")).alias("result"), F.when(F.col("turn") != "completed", F.col("payload")).alias("failure"))
        notices = self.store.hold(J.parent_notices(finished))
        made = M.create_instances(inst, self.store.hold(fx["children"].unionByName(chain)), _stamp(now))

        left = inbox.join(drained, ["id", "instance_id"], "left_anti").join(ended.select("instance_id"), "instance_id", "left_anti")
        boxes = filled("inbox", left).unionByName(self._delivered(notices, now))
        more = left.select("instance_id").union(done.where("cut").select("instance_id")).distinct()
        spent = done.select("instance_id").join(more, "instance_id", "left_anti").union(ended.select("instance_id")).withColumn("kind", F.lit("workflow"))
        later = F.when(F.col("refused") & (F.col("kind") == "workflow"), _stamp(now) + F.make_dt_interval(secs=F.lit(NACK_MS / 1000))).otherwise(F.col("visible_at"))
        kept = tasks.join(spent, ["instance_id", "kind"], "left_anti").join(refused.select("instance_id", F.lit(True).alias("refused")), "instance_id", "left")
        kept = filled("tasks", kept.withColumn("visible_at", F.when(F.col("refused").isNull(), F.col("visible_at")).otherwise(later)))
        acts = self.store.hold(fx["tasks"].join(live, "instance_id", "left_semi"))
        top = tasks.agg(F.max("id")).first()[0] or 0
        acts = acts.withColumns({"id": numbered(acts, top, "ref_seq"), "attempt": F.lit(0), "visible_at": _stamp(now), "created_at": _stamp(now)})
        kept = kept.unionByName(filled("tasks", acts)).unionByName(filled("tasks", made["tasks"]))
        patched = filled("instances", self._patched(inst, news, done, now))
        kept = kept.unionByName(self.client.woken(notices.select("instance_id"), kept, patched, now))
        self.store.commit(
            {"instances": patched.unionByName(filled("instances", made["instances"])), "inbox": boxes, "tasks": kept, "signal_dedupe": seen.join(ended.select("instance_id"), "instance_id", "left_anti")},
            {"journal": filled("journal", news.withColumn("recorded_at", _stamp(now))).unionByName(filled("journal", made["journal"])), "timers": fx["timers"].join(live, "instance_id", "left_semi")},
            base,
        )
        return ends.count() - valid.count()

    def _patched(self, inst: DataFrame, news: DataFrame, done: DataFrame, now: datetime) -> DataFrame:
        attrs = J.last_value(news, "search_attributes_updated").select(F.col("instance_id").alias("id"), F.from_json("payload", "map<string,string>").alias("__attrs"))
        memo = J.last_value(news, "memo_updated").select(F.col("instance_id").alias("id"), F.from_json("payload", "map<string,string>").alias("__memo"))
        d = done.select(F.col("instance_id").alias("id"), "turn", "last", F.col("payload").alias("__said"))
        x = inst.join(d, "id", "left").join(attrs, "id", "left").join(memo, "id", "left")
        over = F.coalesce(F.col("turn") != "suspended", F.lit(False))
        return x.withColumns({
            "status": F.when(over, F.col("turn")).otherwise(F.col("status")),
            "result": F.when(over & F.col("turn").isin("completed", "continued"), F.col("__said")).otherwise(F.col("result")),
            "failure": F.when(over & F.col("turn").isin("failed", "stuck"), F.col("__said")).otherwise(F.col("failure")),
            "next_seq": F.coalesce(F.col("last") + 1, "next_seq"),
            "completed_at": F.when(over, _stamp(now)).otherwise(F.col("completed_at")),
            "updated_at": F.when(F.col("turn").isNotNull(), _stamp(now)).otherwise(F.col("updated_at")),
            "search_attributes": F.coalesce("__attrs", "search_attributes"),
            "memo": F.coalesce("__memo", "memo"),
        }).drop("turn", "last", "__said", "__attrs", "__memo")

    def run_activities(self, now: datetime) -> int:
        """Claim visible activities of registered names, run them, and commit their outcomes: failures wait for their next attempt, or are told for good when there is none left or the
        error is ``NonRetryable``. A task whose lease passed to another claim meanwhile is left to that."""
        names = dict(self.activities)

        def claim(base: int):
            tasks = self.store.read("tasks")
            known = tasks.where(F.col("name").isin(*names) if names else F.lit(False))
            queues = self.queues or [r[0] for r in known.select("queue").distinct().collect()]
            request = ClaimRequest("activity", tuple(queues), self.limit, self.lease_ms, self.worker_id, self.max_per_instance)
            got = self.store.hold(filled("tasks", claims.claim(known, request, _stamp(now))))
            if n := got.count():
                self.store.commit({"tasks": tasks.join(got.select("id"), "id", "left_anti").unionByName(got)}, base=base)
            return n, got

        n, got = self.client.step(claim)
        if n == 0:
            self.store.release(got)
            return 0

        def run(batches):
            import pyarrow as pa

            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary())
            for b in batches:
                out = []
                for r in b.to_pylist():
                    about = activity.Info(r["instance_id"], r["name"], r["attempt"], r["id"], r["key"])
                    details = json.loads(r["heartbeat"]) if r["heartbeat"] else None
                    value = json.loads(r["input"]) if r["input"] else None
                    result, error, noted = activity.invoke(names[r["name"]], value, about, details, (r["start_to_close_ms"] or 0) / 1000)
                    payload = json.dumps(result if error is None else str(error))
                    out.append((r["id"], "activity_completed" if error is None else "activity_failed", isinstance(error, activity.NonRetryable), payload, None if noted is None else json.dumps(noted).encode()))
                columns = zip(*out) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "type", "final", "payload", "noted"])

        parts = int(self.client.spark.conf.get("spark.sql.shuffle.partitions"))
        asked = got.select("id", "instance_id", "name", "attempt", "input", "heartbeat", "start_to_close_ms", idempotency_key(F.col("instance_id"), F.col("ref_seq")).alias("key"))
        ran = self.store.hold(asked.repartition(parts, "id").mapInArrow(run, "id bigint, type string, final boolean, payload string, noted binary"))
        met = got.join(ran, "id")
        again = (F.col("type") == "activity_failed") & ~fails_for_good(F.col("attempt"), F.coalesce("max_attempts", F.lit(0)), F.col("final"))
        wait = backoff_ms(F.col("attempt"), F.coalesce("retry.initial_ms", F.lit(0)), F.coalesce("retry.coef", F.lit(0.0)), F.coalesce("retry.max_ms", F.lit(0)))
        later = {"visible_at": _stamp(now) + F.make_dt_interval(secs=wait / 1000), "worker_id": F.lit(None).cast("string"), "heartbeat": F.coalesce("noted", "heartbeat")}
        retry = self.store.hold(filled("tasks", met.where(again).withColumns(later)))
        told = self.store.hold(met.where(~again).select(F.col("id").alias("task_id"), "worker_id", "attempt", "type", "payload", "ref_seq"))
        mine = got.select("id", "worker_id", "attempt")
        self.counters.update({"activity_tasks": n, "retries": retry.count()})

        def finish(base: int) -> None:
            tasks, instances = self.store.read("tasks"), self.store.read("instances")
            out = M.complete_activities(tasks, instances, told)
            events = self.store.hold(out["inbox"])
            waiting = retry.join(tasks.join(mine, ["id", "worker_id", "attempt"], "left_semi").select("id"), "id", "left_semi")
            kept = out["tasks"].join(waiting.select("id"), "id", "left_anti").unionByName(waiting)
            kept = kept.unionByName(self.client.woken(events, kept, instances, now))
            self.store.commit({"tasks": kept}, {"inbox": self._delivered(events, now)}, base)
            self.store.release(events)

        self.client.step(finish)
        self.store.release(got, ran, retry, told)
        return n
