"""Claims, mutations, replay, the batch fold and the streaming actors."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewheel.model import ClaimRequest, BatchTooLarge
from tidewheel.operators import claims, journal as J, mutations as M, replay as R, reads
from tidewheel.sources.tables import Store
from tidewheel.streaming import actor

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
E = R.Event


def test_fair_pick_equals_the_greedy_walk(spark):
    rng = random.Random(3)
    rows = [(i, f"w{rng.randrange(6)}", rng.randrange(20)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, instance_id string, visible_at int")
    for limit, cap in ((10, 1), (30, 3), (7, 0), (0, 2), (500, 2)):
        want, seen = [], {}
        for i, w, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            if len(want) < limit and (cap <= 0 or seen.get(w, 0) < cap):
                seen[w] = seen.get(w, 0) + 1
                want.append(i)
        assert [r.id for r in claims.fair_pick(df, limit, cap).collect()] == want


def test_claims_without_queues_and_limits(spark):
    df = spark.createDataFrame([(1, "a", "q", "k", NOW)], "id int, instance_id string, queue string, kind string, visible_at timestamp")
    assert claims.pick(df, ClaimRequest("k", (), 5), F.lit(NOW)).count() == 0
    assert claims.pick(df, ClaimRequest("k", ("q",), 0), F.lit(NOW)).count() == 1
    assert (claims.overfetch(1), claims.overfetch(100), claims.overfetch(9000)) == (64, 400, 9000)
    with pytest.raises(BatchTooLarge):
        M.check_batch(101)


def test_delivery_is_once_per_key(spark):
    items = spark.createDataFrame([("i", "pay", 1), ("i", "pay", 2), ("i", None, 3), ("i", "", 4), ("j", "pay", 5), ("i", "old", 6)], "instance_id string, dedupe_id string, arrival int")
    seen = spark.createDataFrame([("i", "old")], "instance_id string, dedupe_id string")
    assert sorted(r.arrival for r in M.deliver(items, seen).collect()) == [1, 3, 4, 5]


def test_chain_of_32(spark):
    rows = [(i, "continued" if i < 40 else "completed", i + 1) for i in range(41)]
    got = {r.id: (r.tail, r.hops) for r in reads.continue_chain(spark.createDataFrame(rows, "id int, status string, next_id int")).collect()}
    assert got[40] == (40, 0) and got[10] == (40, 30) and got[0] == (32, 32)


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert len(store.migrate()) == 7 and store.migrate() == []
    store.validate()
    for n in (1, 2, 3):
        store.replace("timers", spark.createDataFrame([("a", n, NOW)], "instance_id string, seq bigint, fire_at timestamp"))
    store.append("timers", spark.createDataFrame([("b", 9, NOW)], "instance_id string, seq bigint, fire_at timestamp"))
    assert sorted(r.seq for r in store.read("timers").collect()) == [3, 9]


def sleeper(ctx, value):
    ctx.sleep(60)
    return "ok"


def test_replay_suspends_completes_and_finds_violations():
    t = R.run_turn(sleeper, [E(1, "workflow_started")], NOW)
    assert t.status == "suspended" and [c.type for c in t.commands] == ["timer_created"]
    t = R.run_turn(sleeper, [E(1, "workflow_started"), E(2, "timer_created"), E(3, "timer_fired", "", 2)], NOW)
    assert (t.status, t.payload, t.commands) == ("completed", '"ok"', [])
    t = R.run_turn(lambda c, v: c.execute("Refund"), [E(1, "workflow_started"), E(2, "activity_scheduled", "Charge")], NOW)
    assert t.status == "violation"


def test_cancel_with_compensation():
    def flow(ctx, value):
        try:
            ctx.sleep(3600)
        except R.Canceled:
            ctx.execute("refund")
            raise

    log = [E(1, "workflow_started"), E(2, "timer_created"), E(3, "cancel_requested")]
    t = R.run_turn(flow, log, NOW)
    assert t.status == "suspended" and t.commands[0].name == "refund"
    log += [E(4, "activity_scheduled", "refund"), E(5, "activity_completed", "", 4, "1")]
    assert R.run_turn(flow, log, NOW).status == "canceled"


def test_signal_beats_timer_and_leaves_later_timers():
    def flow(ctx, value):
        got = ctx.receive_within("s", 10)
        ctx.sleep(5)
        return got

    log = [E(1, "workflow_started"), E(2, "timer_created"), E(3, "timer_fired", "", 2), E(4, "signal_received", "s", 0, "7")]
    assert R.run_turn(flow, log, NOW).commands[0].type == "timer_created"
    log = [E(1, "workflow_started"), E(2, "signal_received", "s", 0, "7"), E(3, "timer_created"), E(4, "timer_fired", "", 3)]
    assert R.run_turn(flow, log, NOW).payload == "[7, true]"


def test_versions_updates_children_and_queries():
    def flow(ctx, value):
        ctx.on_update("add", lambda c, x: x + 1)
        ctx.on_query("state", lambda _: ver)
        ver = ctx.version("c", 1, 2)
        ctx.all(ctx.start_child("k", 1), ctx.start("a"))
        return ver

    log = [E(1, "workflow_started"), E(2, "update_requested", "add", 0, '{"id": "u", "input": 4}')]
    t = R.run_turn(flow, log, NOW, instance_id="p")
    assert [c.type for c in t.commands] == ["version_marker", "child_scheduled", "activity_scheduled", "update_accepted", "update_completed"]
    assert json.loads(t.commands[1].payload)["child_id"] == "p:4" and json.loads(t.commands[-1].payload)["result"] == 5
    assert R.run_query(flow, [*log, *t.commands], NOW, "state") == 2
    old = [E(1, "workflow_started"), E(2, "child_scheduled", "k"), E(3, "activity_scheduled", "a"), E(4, "child_completed", "", 2, "1"), E(5, "activity_failed", "", 3, '"bad"')]
    t = R.run_turn(flow, old, NOW)
    assert (t.status, t.payload) == ("failed", '"bad"')


def test_replay_at_scale():
    log = [E(1, "workflow_started")] + [e for i in range(2000) for e in (E(2 + 2 * i, "activity_scheduled", "a"), E(3 + 2 * i, "activity_completed", "", 2 + 2 * i, str(i)))]
    assert R.run_turn(lambda c, v: sum(c.execute("a") for _ in range(2000)), log, NOW).payload == str(1999 * 1000)


def test_fold_of_turns(spark):
    log = spark.createDataFrame([(f"i{k}", 1, "workflow_started", "w", 0, "5") for k in range(6)], "instance_id string, seq bigint, type string, name string, ref_seq bigint, payload string")
    box = spark.createDataFrame([(f"i{k}", k * 10 + n, n, "signal_received", "go", 0, str(n)) for k in range(6) for n in range(k)], "instance_id string, id bigint, seq bigint, type string, name string, ref_seq bigint, payload string")
    rows = R.fold_turns(log, box, lambda c, v: [v, c.receive("go"), c.receive("go")], NOW).collect()
    ends = {r.instance_id: r for r in rows if r.type == "workflow_completed"}
    assert sorted(ends) == ["i2", "i3", "i4", "i5"] and ends["i3"].payload == "[5, 0, 1]" and ends["i3"].seq == 5
    assert J.contiguity(log.select("instance_id", "seq").union(spark.createDataFrame(rows).select("instance_id", "seq"))).where("not contiguous").count() == 0


def test_budget_prefix_equals_the_greedy_loop(spark):
    from tidewheel.model import Capabilities

    rng = random.Random(5)
    kinds = ["activity_scheduled", "timer_created", "child_scheduled", "side_effect"]
    rows = [(t, i, rng.choice(kinds)) for t in range(20) for i in range(rng.randrange(1, 60))]
    got = J.budget_prefix(spark.createDataFrame(rows, "turn int, i int, type string"), F.lit(7), Capabilities(60), ["turn"], "i").where("kept").collect()
    cost = {"activity_scheduled": 2, "timer_created": 2, "child_scheduled": 4}
    want = set()
    for t in range(20):
        base = 7
        for _, i, k in [r for r in rows if r[0] == t]:
            if base + cost.get(k, 1) > 60:
                break
            base += cost.get(k, 1)
            want.add((t, i))
    assert {(r.turn, r.i) for r in got} == want


def test_streaming_actors(spark, tmp_path):
    """Two micro-batches with a restart between them: journals stay contiguous, duplicate signals and timers count once."""

    def flow(ctx, value):
        got = ctx.receive("go")
        ctx.sleep(60)
        return [value, got]

    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    first = [(f"a{k}", 1, "workflow_started", "w", 0, "1", None, t0) for k in range(4)] + [(f"a{k}", n, "signal_received", "go", 0, "2", "d", t0) for k in range(4) for n in (2, 3)]
    later = [("clock", 9, "workflow_started", "w", 0, "1", None, t0 + timedelta(hours=2)), ("a0", 4, "signal_received", "go", 0, "3", "d", t0 + timedelta(minutes=1))]
    end = [("clock", 10, "signal_received", "x", 0, "1", None, t0 + timedelta(hours=4))]
    for batch in (first, later, end):
        spark.createDataFrame(batch, actor.INBOX_DDL).coalesce(1).write.mode("append").parquet(src)
        q = (
            actor.run_actors(spark.readStream.schema(actor.INBOX_DDL).parquet(src), flow)
            .writeStream.foreachBatch(actor.journal_sink(out))
            .outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        q.stop()
    rows = spark.read.parquet(out)
    assert J.contiguity(rows).where("not contiguous").count() == 0
    done = rows.where("type = 'workflow_completed'").collect()
    assert sorted(r.instance_id for r in done) == ["a0", "a1", "a2", "a3"] and {r.payload for r in done} == {"[1, 2]"}
    assert rows.where("type = 'timer_fired'").count() == 4


def test_streaming_starts_further_instances_and_drops_unknown_ids(spark, tmp_path):
    def flow(ctx, value):
        if value == 1:
            ctx.continue_as_new(0)
        ctx.start_child("kid", 7)
        ctx.receive("never")

    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    rows = [("c", 1, "workflow_started", "w", 0, "1", None, t0), ("d", 1, "workflow_started", "w", 0, "2", None, t0), ("nobody", 2, "signal_received", "go", 0, "2", None, t0)]
    spark.createDataFrame(rows, actor.INBOX_DDL).coalesce(1).write.parquet(src)
    seen = []

    def sink(batch, epoch):
        seen.extend(actor.spawned(batch, F.lit(t0)).collect())
        actor.journal_sink(out)(batch, epoch)

    q = actor.run_actors(spark.readStream.schema(actor.INBOX_DDL).parquet(src), flow).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    log = spark.read.parquet(out)
    assert {r.instance_id for r in log.collect()} == {"c", "d"} and J.contiguity(log).where("not contiguous").count() == 0
    assert sorted((r.instance_id, r.name, r.payload) for r in seen) == [("c~2", "w", "0"), ("d:2", "kid", "7")]
