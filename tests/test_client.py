from datetime import datetime, timedelta, timezone

import pytest

from tidewheel import activity
from tidewheel.client import Client, Worker
from tidewheel.model import AlreadyExists, Capabilities, Conflict, InstanceFilter
from tidewheel.operators import journal as J, replay
from tidewheel.sources.tables import Store

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def order(ctx, oid):
    invoice = ctx.execute("charge", oid)
    ctx.upsert_attributes({"phase": "paid"})
    ctx.all(ctx.start("ship", oid), ctx.start_child("mail", invoice))
    ctx.sleep(7 * 86_400)
    note = ctx.receive("note")
    return [invoice, note]


def mail(ctx, invoice):
    return ctx.execute("send", invoice)


def test_order_from_start_to_end(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.migrate()
    client = Client(store)
    worker = Worker(client)
    worker.workflow(order)
    worker.workflow(mail)
    worker.activity(lambda oid: f"inv-{oid}", "charge")
    worker.activity(lambda oid: True, "ship")
    worker.activity(lambda inv: True, "send")
    client.start("order", "order-123", id="o1", attributes={"tenant": "acme"}, now=T0)
    with pytest.raises(AlreadyExists):
        client.start("order", "again", id="o1", now=T0)
    for k in range(5):
        worker.poll_once(T0 + timedelta(minutes=k))
    assert client.get("o1").search_attributes == {"tenant": "acme", "phase": "paid"} and client.get("o1:6").status == "completed"
    assert client.signal("o1", "note", "n1", "d", now=T0 + timedelta(hours=1)) == 1 and client.signal("o1", "note", "n2", "d", now=T0 + timedelta(hours=1)) == 0
    with pytest.raises(TimeoutError):
        client.result("o1")
    for k in range(2):
        worker.poll_once(T0 + timedelta(days=8, minutes=k))
    assert client.result("o1") == ["inv-order-123", "n1"]
    assert J.contiguity(store.read("journal")).where("not contiguous").count() == 0
    assert client.list(InstanceFilter(status="completed")).count() == 2
    assert client.purge(3_600_000, limit=1, now=T0 + timedelta(days=20)) == 1


def make(spark, tmp_path, caps=Capabilities(), **options):
    store = Store(spark, f"file://{tmp_path}/s")
    store.migrate()
    client = Client(store, caps)
    return client, Worker(client, **options)


def test_signal_during_a_turn_is_kept(spark, tmp_path, monkeypatch):
    """A signal that arrives after the turn was folded and before it is committed: the commit is computed anew, the signal stays and has a task."""
    client, worker = make(spark, tmp_path)

    def flow(ctx, value):
        return [ctx.receive("go"), ctx.receive("go")]

    worker.workflow(flow)
    id = client.start("flow", now=T0)
    client.signal(id, "go", 1, now=T0)
    apply, once = worker._apply, []

    def late(*args):
        if not once:
            once.append(client.signal(id, "go", 2, now=T0))
        return apply(*args)

    monkeypatch.setattr(worker, "_apply", late)
    worker.turns(T0)
    assert client.store.read("inbox").count() == 1 and client.store.read("tasks").count() == 1
    worker.turns(T0 + timedelta(seconds=1))
    assert client.result(id) == [1, 2] and worker.counters["workflow_tasks"] == 2
    with pytest.raises(Conflict):
        client.store.commit(append={"timers": client.store.read("timers")}, base=1)


def test_budgets_violations_and_chains(spark, tmp_path):
    client, worker = make(spark, tmp_path, Capabilities(30))

    def fan(ctx, value):
        ctx.all(*[ctx.start("a", k) for k in range(20)])
        return "all"

    def again(ctx, n):
        if n:
            ctx.continue_as_new(n - 1)
        ctx.receive("stop")

    def wide(ctx, value):
        for _ in range(10):
            ctx.start_child("again", 0)

    for fn in (fan, again, wide):
        worker.workflow(fn)
    worker.activity(lambda k: k, "a")
    ids = {name: client.start(name, 2, id=name, now=T0) for name in ("fan", "again", "wide")}
    for k in range(6):
        worker.poll_once(T0 + timedelta(seconds=k))
    assert client.result("fan") == "all" and J.contiguity(client.store.read("journal")).where("not contiguous").count() == 0
    assert worker.counters["nack over_budget"] == 1 and client.get("wide").status == "running"
    client.cancel("again", now=T0)
    assert client.tail("again").id.count("~") == 2
    worker.poll_once(T0 + timedelta(seconds=9))
    assert client.tail("again").status == "canceled" and len(ids) == 3


def test_activities_time_out_retry_and_heartbeat(spark, tmp_path):
    client, worker = make(spark, tmp_path, limit=100, max_per_instance=2)

    def flow(ctx, value):
        out = []
        for name, options in (("slow", {"timeout_ms": 200, "retry": {"max_attempts": 1}}), ("final", {"retry": {"max_attempts": 5}}), ("picky", {"retry": {"max_attempts": 3, "initial_interval_ms": 1000}})):
            try:
                out.append(ctx.execute(name, 1, **options))
            except replay.Failed as ex:
                out.append(str(ex))
        return out

    def slow(value):
        import time

        time.sleep(5)

    def final(value):
        raise activity.NonRetryable("never")

    def picky(value):
        try:
            half = activity.heartbeat_details()
        except activity.NoDetails:
            activity.record_heartbeat({"done": activity.info().attempt})
            raise ValueError("once more") from None
        return [half, activity.info().attempt, activity.info().idempotency_key]

    worker.workflow(flow)
    for fn in (slow, final, picky):
        worker.activity(fn)
    client.start("flow", id="f", now=T0)
    for k in range(8):
        worker.poll_once(T0 + timedelta(seconds=5 * k))
        if client.get("f").status != "running":
            break
    got = client.result("f")
    assert "longer than" in got[0] and got[1] == "never" and got[2][:2] == [{"done": 1}, 2] and got[2][2].startswith("f/")
    assert worker.counters["retries"] == 1 and not worker.running()


def test_fair_claims_and_updates(spark, tmp_path):
    client, worker = make(spark, tmp_path, limit=3, max_per_instance=1)

    def flow(ctx, value):
        ctx.on_update("add", lambda c, x: x + 1)
        ctx.all(*[ctx.start("a", k) for k in range(3)])
        ctx.receive("end")

    worker.workflow(flow)
    worker.activity(lambda k: k, "a")
    for id in ("x", "y"):
        client.start("flow", id=id, now=T0)
    worker.turns(T0)
    assert worker.run_activities(T0) == 2  # one of each instance
    assert worker.update("x", "add", 4, now=T0 + timedelta(seconds=1)) == (5, None)
    with pytest.raises(LookupError):
        client.get("nobody")
