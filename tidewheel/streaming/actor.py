"""The keyed state machine on Structured Streaming: one actor an instance, a mailbox of events in, journal events out."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewheel.operators.replay import TURN_DDL, Event, advance

#: Status of rows that are not journal events but starts of new instances: children, and runs that go on as new.
SPAWNED = "spawned"
INBOX_DDL = "instance_id string, id bigint, type string, name string, ref_seq bigint, payload string, dedupe_id string, ts timestamp"


class Actor(StatefulProcessor):
    """State: the journal, the dedupe keys, and whether the instance has ended. Timers fire by event time: they need a watermark that passes them."""

    def __init__(self, flow):
        self.flow = flow

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("journal", "seq bigint, type string, name string, ref_seq bigint, payload string")
        self.seen = handle.getMapState("dedupe", "dedupe_id string", "at bigint")
        self.ended = handle.getValueState("ended", "status string")

    def _turn(self, key, fresh: list[Event], now_ms: int) -> pd.DataFrame:
        log = [Event(r[0], r[1], r[2], r[3], r[4]) for r in self.log.get()]
        now = datetime.fromtimestamp(now_ms / 1000, timezone.utc)
        value = json.loads(log[0].payload) if log and log[0].payload else None
        held = {e.type: json.loads(e.payload) for e in log if e.type in ("search_attributes_updated", "memo_updated")}  # the last of either
        status, new, _ = advance(self.flow, key[0], log, fresh, now, value, attributes=held.get("search_attributes_updated"), notes=held.get("memo_updated"))
        if new:
            self.log.appendList([(e.seq, e.type, e.name, e.ref_seq, e.payload) for e in new])
        for e in new:
            if e.type == "timer_created":
                due = datetime.fromisoformat(json.loads(e.payload)["fire_at"])
                self.handle.registerTimer(max(int(due.timestamp() * 1000), now_ms + 1))
        if status not in ("suspended", "violation"):
            self.ended.update((status,))
        rows = [(key[0], status, e.seq, e.type, e.name, e.ref_seq, e.payload) for e in new]
        for e in new:
            said = json.loads(e.payload) if e.payload and e.type == "child_scheduled" else {}
            if e.type == "child_scheduled":
                rows.append((said["child_id"], SPAWNED, 1, "workflow_started", said["name"], 0, json.dumps(said.get("input"))))
            elif e.type == "continued_as_new":
                rows.append((f"{key[0]}~{e.seq}", SPAWNED, 1, "workflow_started", log[0].name, 0, e.payload))
        return pd.DataFrame(rows, columns=["instance_id", "status", "seq", "type", "name", "ref_seq", "payload"])

    def handleInputRows(self, key, rows, timerValues):
        box = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"])
        if self.ended.exists():
            return
        known, fresh, out = self.log.exists(), [], []
        for r in box.itertuples(index=False):
            if not known:
                if r.type != "workflow_started":
                    continue  # no such instance
                first = Event(1, "workflow_started", r.name or "", 0, r.payload)
                self.log.put([(1, first.type, first.name, 0, first.payload)])
                out.append((key[0], "running", 1, first.type, first.name, 0, first.payload))
                known = True
                continue
            if r.dedupe_id:
                if self.seen.containsKey((r.dedupe_id,)):
                    continue
                self.seen.updateValue((r.dedupe_id,), (int(r.id),))
            if r.type != "workflow_started":
                fresh.append(Event(0, r.type, r.name or "", int(r.ref_seq or 0), r.payload))
        if not known:
            return
        if out:
            yield pd.DataFrame(out, columns=["instance_id", "status", "seq", "type", "name", "ref_seq", "payload"])
        yield self._turn(key, fresh, int(box["ts"].max().timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.ended.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        log = [Event(r[0], r[1], r[2], r[3], r[4]) for r in self.log.get()]
        fired = {e.ref_seq for e in log if e.type == "timer_fired"}
        due = [e for e in log if e.type == "timer_created" and e.seq not in fired and datetime.fromisoformat(json.loads(e.payload)["fire_at"]).timestamp() * 1000 <= at]
        if due:
            yield self._turn(key, [Event(0, "timer_fired", "", e.seq, None) for e in due], at)

    def close(self) -> None:
        pass


def run_actors(inbox: DataFrame, flow, watermark: str = "0 seconds") -> DataFrame:
    """Journal events of all instances (rows of TURN_DDL) from a stream of INBOX_DDL. An instance starts with a workflow_started event; other events for an id that never started are
    dropped. Rows of status SPAWNED start further instances: ``spawned`` makes inbox rows of them, for the stream that feeds this one."""
    return (
        inbox.withWatermark("ts", watermark)
        .groupBy("instance_id")
        .transformWithStateInPandas(Actor(flow), outputStructType=TURN_DDL, outputMode="Append", timeMode="EventTime")
    )


def journal_sink(path: str):
    """A foreachBatch function that appends each micro-batch to its own folder: written again after a failure, it replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.where(F.col("status") != SPAWNED).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def spawned(rows: DataFrame, ts: Column) -> DataFrame:
    """Inbox rows (INBOX_DDL) that start the children and continued runs among ``run_actors``' rows. Starting an instance again has no effect."""
    new = rows.where(F.col("status") == SPAWNED)
    return new.select("instance_id", F.lit(0).cast("bigint").alias("id"), "type", "name", "ref_seq", "payload", F.lit(None).cast("string").alias("dedupe_id"), ts.alias("ts"))
