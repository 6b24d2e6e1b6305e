"""Every query of the library by name, with its SQL. Times are literals and every order ends in a unique id, so results repeat."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewheel.functions import scalars as X
from tidewheel.functions.crypt import Codec, Keyring
from tidewheel.functions.cron import next_cron_time
from tidewheel.model import Capabilities, ClaimRequest, InstanceFilter
from tidewheel.operators import claims, journal as J, mutations as M, reads, replay
from tidewheel.sources import tables as S

NOW = "2024-01-20 00:00:00"
ORDERS_NOW = "2000-01-01 00:00:00"
_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _queries[fn.__name__] = fn
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return add


def queries():
    return dict(_queries)


def oracle_sql():
    return dict(_sql)


def at(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp")


_KIND = "CASE event_type WHEN 'click' THEN 'activity_scheduled' WHEN 'view' THEN 'timer_created' WHEN 'purchase' THEN 'activity_completed' WHEN 'signup' THEN 'signal_received' ELSE 'activity_failed' END"
_J = f"j AS (SELECT user_id::VARCHAR AS instance_id, event_id AS seq, {_KIND} AS type, event_type AS name, json_extract_string(props, '$.k')::BIGINT AS ref_seq, props AS payload FROM events)"
_C = "j AS (SELECT conv_id::VARCHAR AS instance_id, turn + 1 AS seq, role AS type, text AS payload FROM conversations)"
_I = "i AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderpriority AS priority, o_custkey AS parent_id, o_totalprice AS total, o_orderdate AS created_at FROM orders)"
_T = "t AS (SELECT event_id AS id, user_id::VARCHAR AS instance_id, event_type AS queue, ts AS visible_at FROM events)"

# Reads


@query(f"WITH {_I} SELECT id, status, priority FROM i WHERE id = 7")
def get_instance(spark, sf):
    return reads.get_instance(S.instances(spark, sf), 7).select("id", "status", F.element_at("search_attributes", F.lit("priority")).alias("priority"))


@query(f"WITH {_C} SELECT instance_id, seq, type FROM j WHERE instance_id = '3' AND seq > 2")
def get_journal_after(spark, sf):
    return reads.get_journal(S.journal(spark, sf), "3", 2).select("instance_id", "seq", "type")


@query(f"WITH {_I} SELECT id, status FROM i WHERE status = 'running' ORDER BY created_at, id LIMIT 100")
def list_instances(spark, sf):
    return reads.list_instances(S.instances(spark, sf), InstanceFilter(status="running")).select("id", "status")


@query(f"WITH {_I} SELECT id, priority FROM i WHERE status = 'running' AND priority = '1-URGENT' ORDER BY created_at, id LIMIT 50 OFFSET 20")
def list_by_attributes(spark, sf):
    rows = reads.list_instances(S.instances(spark, sf), InstanceFilter("running", "order", {"priority": "1-URGENT"}, 50, 20))
    return rows.select("id", F.element_at("search_attributes", F.lit("priority")).alias("priority"))


@query(f"WITH {_I} SELECT least(count(*), 40) AS shown, count(*) > 40 AS has_more FROM (SELECT id FROM i WHERE status = 'failed' ORDER BY created_at, id LIMIT 41)")
def list_page_has_more(spark, sf):
    rows, size = reads.list_page(S.instances(spark, sf), InstanceFilter("failed", limit=40))
    return rows.agg(F.least(F.count("*"), F.lit(size)).alias("shown"), (F.count("*") > size).alias("has_more"))


@query("SELECT id, place FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY 0, ts, event_id) AS place FROM events)")
def inbox_order(spark, sf):
    box = S.events(spark, sf).select(F.col("event_id").alias("id"), F.lit(0).alias("seq"), F.col("ts").alias("created_at"), "user_id")
    return box.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("seq", "created_at", "id"))).select("id", "place")


@query(f"WITH {_I}, {_T} SELECT i.id, count(t.id) AS n_inbox, arg_min(t.id, (t.visible_at, t.id)) AS first_id FROM i LEFT JOIN t ON t.instance_id = i.id::VARCHAR GROUP BY i.id")
def load_heads(spark, sf):
    inst = S.instances(spark, sf).select(F.col("id").cast("string").alias("id"), "status")
    box = S.events(spark, sf).select(F.col("user_id").cast("string").alias("instance_id"), F.lit(0).alias("seq"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.lit("signal_received").alias("type"), F.col("event_type").alias("name"), F.lit(0).alias("ref_seq"), F.col("props").alias("payload"))
    heads = reads.load_heads(inst, box)
    return heads.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.size("inbox"), F.lit(0)).cast("bigint").alias("n_inbox"), F.col("inbox")[0]["id"].alias("first_id"))


@query(f"""WITH {_I}, {_J}, l AS (SELECT instance_id, count(*) AS n, arg_min(payload, seq) AS first, max(seq) AS last FROM j GROUP BY 1)
  SELECT i.id, coalesce(l.n, 0) AS n_events, l.first AS first_payload, l.last AS last_seq FROM i LEFT JOIN l ON l.instance_id = i.id::VARCHAR""")
def load_states(spark, sf):
    inst = S.instances(spark, sf).select(F.col("id").cast("string").alias("id"), "status")
    log = S.event_journal(spark, sf)
    box = log.limit(0).withColumns({"id": F.col("seq"), "created_at": F.current_timestamp()})
    rows = reads.load_states(inst, box, log)
    last = F.element_at("journal", -1)
    return rows.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.size("journal"), F.lit(0)).cast("bigint").alias("n_events"), F.col("journal")[0]["payload"].alias("first_payload"), last["seq"].alias("last_seq"))


@query("SELECT 's3' AS id, o_orderdate AS next_run_at FROM orders WHERE o_orderkey = 3")
def get_schedule(spark, sf):
    return reads.get_schedule(_schedules(spark, sf), "s3").select("id", F.col("next_run_at").cast("timestamp_ntz").alias("next_run_at"))


@query(f"WITH {_C} SELECT instance_id, seq, instance_id::BIGINT % 5 <= 1 AS reload FROM j WHERE seq > 3 OR instance_id::BIGINT % 5 <= 1")
def journal_since(spark, sf):
    log = S.journal(spark, sf)
    part = F.col("instance_id").cast("bigint") % 5
    marks = log.groupBy("instance_id").agg(F.max("seq").alias("top")).where(part != 1)  # those of part 1 have no mark
    marks = marks.select("instance_id", F.when(part == 0, F.col("top") + 7).otherwise(F.least("top", F.lit(3))).alias("last_seq"))  # those of part 0 one beyond the journal
    return reads.journal_since(log, marks).select("instance_id", "seq", "reload")


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey + 1 END AS nxt FROM orders),
  k AS (SELECT s.id, CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.id = s.nxt) THEN s.nxt END AS nxt FROM s),
  c AS (SELECT id, id AS tail, 0 AS hops FROM k UNION ALL SELECT c.id, k.nxt, c.hops + 1 FROM c JOIN k ON k.id = c.tail WHERE k.nxt IS NOT NULL AND c.hops < 32)
  SELECT id, arg_max(tail, hops) AS tail, max(hops) AS hops FROM c GROUP BY id""")
def continue_chain(spark, sf):
    key = F.col("o_orderkey")
    inst = S.table(spark, sf, "orders").select(key.alias("id"), F.when(key % 7 != 0, "continued").otherwise("completed").alias("status"), (key + 1).alias("next_id"))
    return reads.continue_chain(inst)


# Claims

_QUEUES = ("click", "view", "purchase")
_IN = "queue IN ('click', 'view', 'purchase') AND visible_at <= TIMESTAMP '2024-01-20 00:00:00'"


@query(f"WITH {_T} SELECT id, instance_id, queue FROM t WHERE {_IN} ORDER BY visible_at, id LIMIT 50")
def claim_fifo(spark, sf):
    return claims.pick(S.tasks(spark, sf), ClaimRequest("activity", _QUEUES, 50), at()).select("id", "instance_id", "queue")


@query(f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY visible_at, id) AS n FROM t WHERE {_IN}) SELECT id, instance_id, queue FROM r WHERE n <= 2 ORDER BY visible_at, id LIMIT 50")
def claim_fair(spark, sf):
    return claims.pick(S.tasks(spark, sf), ClaimRequest("activity", _QUEUES, 50, max_per_instance=2), at()).select("id", "instance_id", "queue")


@query(f"WITH {_T} SELECT id, TIMESTAMP '2024-01-20 00:00:30' AS visible_at, 1 AS attempt, 'w1' AS worker_id FROM (SELECT * FROM t WHERE {_IN} ORDER BY visible_at, id LIMIT 20)")
def claim_apply_lease(spark, sf):
    got = claims.claim(S.tasks(spark, sf), ClaimRequest("activity", _QUEUES, 20, 30_000, "w1"), at())
    return got.select("id", F.col("visible_at").cast("timestamp_ntz").alias("visible_at"), "attempt", "worker_id")


@query(f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY visible_at, id) AS n FROM t WHERE {_IN}), p AS (SELECT * FROM r WHERE n <= 3 ORDER BY visible_at, id LIMIT 200) SELECT instance_id, count(*) AS n FROM p GROUP BY 1")
def secured_counts(spark, sf):
    return claims.secured_counts(claims.pick(S.tasks(spark, sf), ClaimRequest("activity", _QUEUES, 200, max_per_instance=3), at()))


@query(f"WITH {_T} SELECT id FROM t WHERE {_IN} AND (visible_at, id) > (TIMESTAMP '2024-01-10 00:00:00', 5) ORDER BY visible_at, id LIMIT 64")
def claim_next_page(spark, sf):
    rows = claims.after_key(claims.claimable(S.tasks(spark, sf), "activity", _QUEUES, at()), at("2024-01-10 00:00:00"), 5)
    return rows.orderBy("visible_at", "id").limit(claims.overfetch(1)).select("id")


@query(f"WITH {_T} SELECT queue, count(*) AS n FROM t WHERE {_IN} GROUP BY 1")
def backlog_by_queue(spark, sf):
    return claims.backlog(S.tasks(spark, sf), "activity", _QUEUES, at())


@query(f"WITH {_T}, g AS (SELECT k.kind, q.queue FROM (VALUES ('activity'), ('workflow')) k(kind) CROSS JOIN (SELECT n_name AS queue FROM nation UNION SELECT DISTINCT event_type FROM events) q) SELECT g.kind, g.queue, count(t.id) AS n FROM g LEFT JOIN t ON g.kind = 'activity' AND t.queue = g.queue AND t.visible_at <= TIMESTAMP '{NOW}' GROUP BY ALL")
def backlog_dense(spark, sf):
    names = S.table(spark, sf, "nation").select(F.col("n_name").alias("queue")).union(S.events(spark, sf).select("event_type").distinct())
    return claims.dense_backlog(S.tasks(spark, sf), ("activity", "workflow"), names, at())


def _leased(spark, sf):
    return S.tasks(spark, sf).withColumns({"worker_id": F.when(F.col("id") % 2 == 0, "w1").otherwise("w2"), "attempt": (F.col("id") % 3).cast("int"), "heartbeat": F.lit(None).cast("binary")})


@query(f"SELECT event_id AS id, CASE WHEN event_id = 6 THEN TIMESTAMP '2024-01-20 00:01:00' ELSE ts END AS visible_at, CASE WHEN event_id = 8 THEN NULL WHEN event_id % 2 = 0 THEN 'w1' ELSE 'w2' END AS worker_id FROM events WHERE event_id <> 8 UNION ALL SELECT 8, TIMESTAMP '{NOW}', NULL")
def lease_changes(spark, sf):
    rows = _leased(spark, sf)
    rows = claims.extend_lease(rows, {"id": 6, "worker_id": "w1", "attempt": 0}, at(), 60_000)
    rows = claims.extend_lease(rows, {"id": 7, "worker_id": "w1", "attempt": 1}, at(), 60_000)  # another worker's: no change
    rows = claims.release_lease(rows, {"id": 8, "worker_id": "w1", "attempt": 2}, at())
    return rows.select("id", F.col("visible_at").cast("timestamp_ntz").alias("visible_at"), "worker_id")


# Aggregates


@query(f"WITH {_C} SELECT instance_id, max(seq) + 1 AS next_seq FROM j GROUP BY 1")
def next_seq(spark, sf):
    return J.next_seq(S.journal(spark, sf))


@query(f"WITH {_J} SELECT instance_id, arg_max(payload, seq) AS payload FROM j WHERE type = 'signal_received' GROUP BY 1")
def last_attributes(spark, sf):
    return J.last_value(S.event_journal(spark, sf), "signal_received")


@query(f"WITH {_J} SELECT instance_id, bool_or(type = 'activity_failed') AS found FROM j GROUP BY 1")
def event_exists(spark, sf):
    return J.has_event(S.event_journal(spark, sf), "activity_failed")


@query(f"WITH {_J} SELECT instance_id, count(*) AS n FROM j GROUP BY 1 HAVING count(*) >= 60")
def journal_warn(spark, sf):
    return J.size_warnings(S.event_journal(spark, sf), 60)


@query(f"WITH {_C} SELECT instance_id, count(*) AS n, min(seq) = 1 AND max(seq) = count(*) AND count(DISTINCT seq) = count(*) AS contiguous FROM j GROUP BY 1")
def journal_contiguity(spark, sf):
    return J.contiguity(S.journal(spark, sf))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.95 * (len(v) - 1))::INT + 1] AS p95, v[floor(0.99 * (len(v) - 1))::INT + 1] AS p99 FROM s")
def latency_percentiles(spark, sf):
    return J.percentiles(S.events(spark, sf), "value", ["event_type"])


@query(f"WITH {_I} SELECT priority, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status = 'completed') / 60.0::DOUBLE AS per_second FROM i GROUP BY 1")
def throughput(spark, sf):
    rows = S.instances(spark, sf).withColumn("priority", F.element_at("search_attributes", F.lit("priority")))
    return J.throughput(rows, ["priority"], 60.0)


@query("WITH t AS (SELECT CASE event_type WHEN 'click' THEN 'workflow_completed' WHEN 'view' THEN 'workflow_failed' WHEN 'error' THEN 'workflow_canceled' ELSE event_type END AS type FROM events) SELECT type, count(*) AS n FROM t WHERE type LIKE 'workflow_%' GROUP BY 1")
def terminal_counts(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("click", "workflow_completed", "view", "workflow_failed", "error", "workflow_canceled")])
    return J.terminal_counts(S.events(spark, sf).select(F.coalesce(names[F.col("event_type")], "event_type").alias("type")))


# Journal relations

_DONE = "d AS (SELECT instance_id, ref_seq AS seq, arg_max(type, seq) AS completion, max(seq) AS completion_seq FROM j WHERE type IN ('activity_completed', 'activity_failed', 'signal_received') AND ref_seq <> 0 GROUP BY ALL)"


@query(f"WITH {_J}, {_DONE} SELECT j.instance_id, j.seq, j.type, d.completion, d.completion_seq, d.completion IS NULL AS pending FROM j LEFT JOIN d USING (instance_id, seq) WHERE j.type IN ('activity_scheduled', 'timer_created')")
def completion_correlation(spark, sf):
    return J.correlate(S.event_journal(spark, sf)).select("instance_id", "seq", "type", "completion", "completion_seq", "pending")


@query(f"WITH {_J} SELECT instance_id, max(seq) + 1 AS next_seq, count_if(type IN ('activity_scheduled', 'timer_created')) AS n_commands, count_if(type = 'signal_received') AS n_signals, bool_or(type = 'activity_failed') AS canceled FROM j GROUP BY 1")
def index_journal(spark, sf):
    kind = F.when(F.col("type") == "activity_failed", "cancel_requested").otherwise(F.col("type"))
    return J.index_journal(S.event_journal(spark, sf).withColumn("type", kind)).select("instance_id", "next_seq", "n_commands", "n_signals", "canceled")


@query(f"""WITH {_J}, c AS (SELECT * FROM j WHERE type IN ('activity_scheduled', 'timer_created')),
  a AS (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY seq) AS ordinal, type || '/' || name AS recorded FROM c),
  b AS (SELECT instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY seq) AS ordinal, type || '/' || name AS generated FROM c WHERE seq % 97 <> 0)
  SELECT instance_id, ordinal, recorded, generated, coalesce(recorded = generated, true) AS matches FROM a FULL JOIN b USING (instance_id, ordinal)""")
def command_match(spark, sf):
    log = S.event_journal(spark, sf)
    return J.match_commands(log, log.where("seq % 97 <> 0"))


@query(f"""WITH {_J}, s AS (SELECT instance_id, name, row_number() OVER (PARTITION BY instance_id, name ORDER BY seq) AS n, seq AS signal_seq FROM j WHERE type = 'signal_received'),
  r AS (SELECT instance_id, 'signup' AS name, row_number() OVER (PARTITION BY instance_id ORDER BY seq) AS n FROM j WHERE type = 'activity_scheduled')
  SELECT r.instance_id, r.name, r.n, s.signal_seq FROM r LEFT JOIN s USING (instance_id, name, n)""")
def signal_ordinal(spark, sf):
    log = S.event_journal(spark, sf)
    n = F.row_number().over(Window.partitionBy("instance_id").orderBy("seq"))
    receives = log.where("type = 'activity_scheduled'").select("instance_id", F.lit("signup").alias("name"), n.alias("n"))
    return J.signals_taken(log, receives).select("instance_id", "name", "n", "signal_seq")


@query("SELECT event_id AS id, CASE WHEN s IS NOT NULL THEN 'signal' WHEN t IS NOT NULL AND f THEN 'timeout' ELSE 'wait' END AS outcome, t IS NOT NULL AND (s IS NULL OR s > t) AS own_timer FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 11 END AS s, CASE WHEN event_id % 2 = 0 THEN event_id % 7 END AS t, event_id % 5 = 0 AS f FROM events)")
def signal_timeout(spark, sf):
    e = F.col("event_id")
    waits = S.events(spark, sf).select(e.alias("id"), F.when(e % 3 == 0, e % 11).alias("signal_seq"), F.when(e % 2 == 0, e % 7).alias("timer_seq"), (e % 5 == 0).alias("timer_fired"))
    return J.signal_or_timeout(waits).select("id", "outcome", "own_timer")


_F = f"WITH {_J}, {_DONE}, f AS (SELECT j.instance_id, j.seq // 500 AS wait_no, j.seq AS arg_index, d.completion IS NOT NULL AS ready, CASE WHEN d.completion = 'activity_failed' THEN 'failed ' || d.completion_seq END AS error FROM j LEFT JOIN d USING (instance_id, seq) WHERE j.type IN ('activity_scheduled', 'timer_created'))"


def _futures(spark, sf):
    f = J.correlate(S.event_journal(spark, sf))
    error = F.when(F.col("completion") == "activity_failed", F.concat(F.lit("failed "), "completion_seq"))
    return f.select("instance_id", F.floor(F.col("seq") / 500).alias("wait_no"), F.col("seq").alias("arg_index"), (~F.col("pending")).alias("ready"), error.alias("error"))


@query(_F + " SELECT instance_id, wait_no, coalesce(min(arg_index) FILTER (ready), -1) AS first_ready FROM f GROUP BY ALL")
def await_first(spark, sf):
    return J.await_first(_futures(spark, sf), ["instance_id", "wait_no"])


@query(_F + " SELECT instance_id, wait_no, bool_and(ready) AS all_ready, CASE WHEN bool_and(ready) THEN arg_min(error, arg_index) FILTER (error IS NOT NULL) END AS first_error FROM f GROUP BY ALL")
def await_all(spark, sf):
    return J.await_all(_futures(spark, sf), ["instance_id", "wait_no"])


_U = "CASE event_id % 3 WHEN 0 THEN 'update_requested' WHEN 1 THEN 'update_accepted' ELSE 'update_completed' END"


@query(f"""WITH u AS (SELECT user_id::VARCHAR AS instance_id, event_id AS seq, {_U} AS type, event_type AS name, (json_extract_string(props, '$.k')::BIGINT % 13)::VARCHAR AS update_id FROM events),
  g AS (SELECT instance_id, update_id, bool_or(type = 'update_completed') AS done, bool_or(type = 'update_accepted') AS taken, min(seq) AS first, arg_min(name, seq) AS name FROM u GROUP BY ALL)
  SELECT instance_id, update_id, CASE WHEN done THEN 'completed' WHEN taken THEN 'accepted' ELSE 'requested' END AS state, name,
  CASE WHEN NOT done THEN row_number() OVER (PARTITION BY instance_id, done ORDER BY taken DESC, first) END AS turn FROM g""")
def update_status(spark, sf):
    e, k = F.col("event_id"), (F.get_json_object("props", "$.k").cast("bigint") % 13).cast("string")
    kind = F.when(e % 3 == 0, "update_requested").when(e % 3 == 1, "update_accepted").otherwise("update_completed")
    log = S.events(spark, sf).select(F.col("user_id").cast("string").alias("instance_id"), e.alias("seq"), kind.alias("type"), F.col("event_type").alias("name"), F.to_json(F.struct(k.alias("id"))).alias("payload"))
    return J.update_status(log).select("instance_id", "update_id", "state", "name", "turn")


@query("SELECT user_id::VARCHAR AS instance_id, coalesce(arg_min(json_extract_string(props, '$.k')::INT, event_id) FILTER (event_id % 50 = 0), CASE WHEN bool_or(event_type = 'click') THEN 1 ELSE 4 END) AS version FROM events GROUP BY 1")
def version_markers(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 50 == 0, "version_marker").when(F.col("event_type") == "click", "activity_scheduled").otherwise("signal_received")
    said = F.to_json(F.struct(F.lit("c1").alias("change_id"), F.get_json_object("props", "$.k").cast("int").alias("version")))
    return J.versions(S.events(spark, sf).select(F.col("user_id").cast("string").alias("instance_id"), e.alias("seq"), kind.alias("type"), said.alias("payload")), "c1", 1, 4)


@query(f"WITH {_I} SELECT parent_id AS instance_id, id AS ref_seq, CASE status WHEN 'completed' THEN 'child_completed' ELSE 'child_failed' END AS type, CASE status WHEN 'completed' THEN 'done' ELSE '\"failed\"' END AS payload FROM i WHERE status <> 'running'")
def parent_notify(spark, sf):
    kids = S.instances(spark, sf).select("status", "parent_id", F.col("id").alias("parent_seq"), F.lit("done").alias("result"), F.lit("").alias("failure"))
    return J.parent_notices(kids)


@query("SELECT event_id AS seq, 'tasks' AS kind, event_type AS name, (json_extract_string(props, '$.k')::INT % 4) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'timers', strftime(ts, '%Y-%m-%d'), 0 FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'children', user_id || ':' || event_id, 0 FROM events WHERE event_type = 'purchase'")
def effects_extract(spark, sf):
    e, k = S.events(spark, sf), F.get_json_object("props", "$.k").cast("int") % 4
    kind = F.when(F.col("event_type") == "click", "activity_scheduled").when(F.col("event_type") == "view", "timer_created").when(F.col("event_type") == "purchase", "child_scheduled").otherwise("side_effect")
    act = F.to_json(F.struct(F.col("props").alias("input"), F.struct(F.lit(10).alias("initial_interval_ms"), k.alias("max_attempts")).alias("retry")))
    timer = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fire_at")))
    child = F.to_json(F.struct(X.child_id(F.col("user_id").cast("string"), F.col("event_id")).alias("child_id"), F.lit("c").alias("name")))
    cmds = e.select(F.col("user_id").cast("string").alias("instance_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("name"), F.when(kind == "activity_scheduled", act).when(kind == "timer_created", timer).otherwise(child).alias("payload"))
    out = J.effects(cmds, F.lit("default"))
    rows = out["tasks"].select(F.col("ref_seq").alias("seq"), F.lit("tasks").alias("kind"), "name", F.col("max_attempts").alias("n"))
    rows = rows.union(out["timers"].select("seq", F.lit("timers"), F.date_format("fire_at", "yyyy-MM-dd"), F.lit(0)))
    return rows.union(out["children"].select("parent_seq", F.lit("children"), "id", F.lit(0)))


@query(f"WITH {_I} SELECT id FROM i WHERE status = 'running' AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = i.id AND e.event_type = 'signup') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = i.id AND e.event_type = 'error' AND e.value < 20)")
def orphan_tasks(spark, sf):
    e = S.events(spark, sf)
    boxes = e.where("event_type = 'signup'").select(F.col("user_id").alias("instance_id"))
    tasks = e.where("event_type = 'error' and value < 20").select(F.col("user_id").alias("instance_id"), F.lit("workflow").alias("kind"))
    return J.orphans(S.instances(spark, sf), boxes, tasks).select("id")


# Mutations


@query("WITH n AS (SELECT user_id * 100 AS id, event_type AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS k FROM events) SELECT CASE WHEN k = 1 AND id NOT IN (SELECT o_orderkey FROM orders) THEN 'created' ELSE 'rejected' END AS what, id, name, count(*) AS n FROM n GROUP BY ALL")
def create_instances(spark, sf):
    new = S.events(spark, sf).select((F.col("user_id") * 100).alias("id"), F.col("event_type").alias("name"), F.lit("").alias("queue"), F.lit(None).cast("string").alias("input"))
    out = M.create_instances(S.instances(spark, sf), new, at())
    rows = out["instances"].select(F.lit("created").alias("what"), "id", "name").union(out["rejected"].select(F.lit("rejected"), "id", "name"))
    return rows.groupBy("what", "id", "name").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS n FROM e WHERE event_id >= 200)
  SELECT event_id AS id FROM r WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_id < 200 AND b.user_id = r.user_id AND b.k = r.k)""")
def signal_dedupe(spark, sf):
    e = S.events(spark, sf).select("event_id", F.col("user_id").alias("instance_id"), F.get_json_object("props", "$.k").alias("dedupe_id"), F.col("event_id").alias("arrival"))
    return M.deliver(e.where("event_id >= 200"), e.where("event_id < 200")).select(F.col("event_id").alias("id"))


@query(f"""WITH {_I}, d AS (SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 1)
  SELECT 'inbox' AS what, event_id AS id FROM d JOIN i ON i.id = d.user_id WHERE i.status = 'running' UNION ALL SELECT 'tasks', event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM d)
  UNION ALL SELECT 'superseded', event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 1""")
def complete_activity(spark, sf):
    tasks = _leased(spark, sf).withColumn("instance_id", F.col("instance_id").cast("bigint"))
    done = tasks.where("id % 2 = 0").select(F.col("id").alias("task_id"), "worker_id", F.lit(1).alias("attempt"), F.lit("activity_completed").alias("type"), F.lit("1").alias("payload"), F.lit(0).cast("bigint").alias("ref_seq"))
    out = M.complete_activities(tasks, S.instances(spark, sf), done)
    rows = lambda k, id: out[k].select(F.lit(k).alias("what"), F.col(id).alias("id"))
    return rows("inbox", "ref_seq").union(rows("tasks", "id")).union(rows("superseded", "task_id"))


@query(f"""WITH {_I} SELECT id, CASE WHEN id = 7 THEN 'terminated' ELSE status END AS status, coalesce(n, 0) AS left_children FROM i
  LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey <> 7 GROUP BY 1) USING (id)""")
def terminate_instance(spark, sf):
    kids = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"))
    out = M.terminate({"instances": S.instances(spark, sf)} | {t: kids for t in ("tasks", "timers", "signal_dedupe", "inbox")}, 7, at())
    left = out["tasks"].groupBy(F.col("instance_id").alias("id")).agg(F.count("*").alias("n"))
    return out["instances"].join(left, "id", "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("left_children"))


@query(f"SELECT o_orderkey AS instance_id, o_orderkey AS seq FROM orders WHERE o_orderdate <= TIMESTAMP '{ORDERS_NOW}' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def due_timers(spark, sf):
    timers = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("fire_at"))
    return M.due_timers(timers, at(ORDERS_NOW)).select("instance_id", "seq")


@query(f"SELECT o_orderkey AS instance_id, o_orderkey AS seq, o_orderstatus = 'O' AS delivered FROM orders WHERE o_orderdate <= TIMESTAMP '{ORDERS_NOW}' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def fire_timers(spark, sf):
    timers = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("fire_at"))
    out = M.fire_timers(timers, S.instances(spark, sf), at(ORDERS_NOW))
    got = out["inbox"].select("instance_id", F.col("ref_seq").alias("seq"), F.lit(True).alias("got"))
    return out["fired"].join(got, ["instance_id", "seq"], "left").select("instance_id", "seq", F.coalesce("got", F.lit(False)).alias("delivered"))


def _schedules(spark, sf):
    return S.table(spark, sf, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("id"), F.lit("0 * * * *").alias("cron"), F.lit("w").alias("workflow"), (F.col("o_orderstatus") == "P").alias("paused"), F.col("o_orderdate").alias("next_run_at"))


_DUE = f"SELECT 's' || o_orderkey AS id, o_orderdate AS due FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '{ORDERS_NOW}' ORDER BY o_orderdate, 's' || o_orderkey LIMIT 40"


@query(f"SELECT id FROM ({_DUE})")
def due_schedules(spark, sf):
    return M.due_schedules(_schedules(spark, sf), at(ORDERS_NOW), 40).select("id")


@query(f"SELECT id || ':' || strftime(due, '%Y-%m-%dT%H:%M:%SZ') AS instance_id, true AS created FROM ({_DUE})")
def claim_schedules(spark, sf):
    inst = S.instances(spark, sf).select(F.col("id").cast("string").alias("id"))
    return M.claim_schedules(_schedules(spark, sf), inst, at(ORDERS_NOW), 40)["claimed"].select("instance_id", "created")


@query("""SELECT o_orderkey AS id, (CASE o_orderstatus WHEN 'O' THEN date_trunc('hour', o_orderdate) + INTERVAL 1 HOUR WHEN 'F' THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH
  ELSE date_trunc('day', o_orderdate) + CASE WHEN o_orderdate < date_trunc('day', o_orderdate) + INTERVAL 390 MINUTE THEN INTERVAL 390 MINUTE ELSE INTERVAL 1830 MINUTE END END)::TIMESTAMP AS next_run FROM orders""")
def cron_next(spark, sf):
    o = S.table(spark, sf, "orders")
    rule = F.when(F.col("o_orderstatus") == "O", "@hourly").when(F.col("o_orderstatus") == "F", "0 0 1 * *").otherwise("30 6 * * *")
    return o.select(F.col("o_orderkey").alias("id"), next_cron_time(rule, F.col("o_orderdate")).cast("timestamp_ntz").alias("next_run"))


_VICTIMS = f"SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate <= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 1 HOUR ORDER BY o_orderdate, o_orderkey LIMIT 1000"


@query(_VICTIMS)
def purge_victims(spark, sf):
    return M.purge_victims(S.instances(spark, sf), at(ORDERS_NOW), 3_600_000).select("id")


@query(f"WITH v AS ({_VICTIMS}) SELECT 'instance' AS what, o_orderkey AS id, 1 AS n FROM orders WHERE o_orderkey NOT IN (SELECT id FROM v) UNION ALL SELECT 'child', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM v) GROUP BY ALL")
def purge_survivors(spark, sf):
    inst = S.instances(spark, sf)
    kids = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"))
    out = M.purge({"instances": inst, "journal": kids}, M.purge_victims(inst, at(ORDERS_NOW), 3_600_000))
    kids = out["journal"].groupBy("instance_id").agg(F.lit("child").alias("what"), F.count("*").alias("n"))
    return out["instances"].select(F.lit("instance").alias("what"), "id", F.lit(1).cast("bigint").alias("n")).union(kids.select("what", "instance_id", "n"))


# Turns


@query("SELECT o_orderkey AS id, 2 + o_custkey % 5 + 3 * (o_custkey % 2) + CASE WHEN o_orderstatus = 'O' THEN o_custkey % 3 + o_custkey % 4 + o_custkey % 6 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ops FROM orders")
def advancement_ops(spark, sf):
    o, c = S.table(spark, sf, "orders"), F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("id"), X.advancement_ops(c % 5, c % 2, c % 3, c % 4, c % 6, F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "F").alias("ops"))


@query(f"WITH {_J}, c AS (SELECT instance_id, seq, sum(CASE WHEN type IN ('activity_scheduled', 'timer_created') THEN 2 ELSE 1 END) OVER (PARTITION BY instance_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM j) SELECT instance_id, seq, spent FROM c WHERE spent <= 100 - 12")
def budget_prefix(spark, sf):
    rows = J.budget_prefix(S.event_journal(spark, sf), F.lit(12), Capabilities(), ["instance_id"], "seq")
    return rows.where("kept").select("instance_id", "seq", "spent")


@query("WITH r AS (SELECT event_id AS id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT id, 100 - 1 + n AS journal_seq FROM r WHERE n <= 30")
def drain_assign_seq(spark, sf):
    box = S.events(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").alias("instance_id"), F.lit(0).alias("seq"), F.col("ts").alias("created_at"))
    heads = box.select("instance_id").distinct().withColumn("next_seq", F.lit(100))
    return J.drain(box, heads, Capabilities(max_effects=80)).select("id", "journal_seq")


# Scalars


@query("SELECT DISTINCT user_id % 12 AS attempt, least(1000.0 * pow(2.0, greatest(user_id % 12, 1) - 1), 60000.0)::BIGINT AS wait_ms FROM events")
def retry_backoff(spark, sf):
    a = F.col("user_id") % 12
    return S.events(spark, sf).select(a.alias("attempt")).distinct().select("attempt", X.backoff_ms(F.col("attempt")).alias("wait_ms"))


@query("SELECT event_id AS id, event_type = 'error' OR (user_id % 4 > 0 AND event_id % 5 >= user_id % 4) AS fails FROM events")
def retry_decision(spark, sf):
    return S.events(spark, sf).select(F.col("event_id").alias("id"), X.fails_for_good(F.col("event_id") % 5, F.col("user_id") % 4, F.col("event_type") == "error").alias("fails"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '{\"a\":\"1\"}' WHEN event_id % 3 = 1 THEN '{\"a\":\"1\",\"b\":\"' || event_type || '\"}' ELSE '{\"a\":\"' || event_type || '\"}' END AS merged FROM events")
def merge_attributes(spark, sf):
    e, m = F.col("event_id") % 3, F.col("event_type")
    base = F.create_map(F.lit("a"), F.lit("1"))
    patch = F.when(e == 0, F.create_map(F.lit("b"), F.lit(""))).when(e == 1, F.create_map(F.lit("b"), m)).otherwise(F.create_map(F.lit("a"), m))
    return S.events(spark, sf).select(F.col("event_id").alias("id"), X.attributes_to_json(X.merge_attributes(base, patch)).alias("merged"))


@query("SELECT event_id AS id, 's' || user_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS instance_id FROM events")
def schedule_instance_id(spark, sf):
    return S.events(spark, sf).select(F.col("event_id").alias("id"), X.schedule_instance_id(F.concat(F.lit("s"), "user_id"), F.col("ts")).alias("instance_id"))


@query("SELECT event_id AS id, user_id || ':' || event_id AS child, user_id || '~' || event_id AS continued, user_id || '/' || event_id AS idem FROM events")
def derived_ids(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    return S.events(spark, sf).select(e.alias("id"), X.child_id(u, e).alias("child"), X.continued_id(u, e).alias("continued"), X.idempotency_key(u, e).alias("idem"))


@query("SELECT event_id AS id, greatest(ts, TIMESTAMP '2024-01-15 00:00:00') AS fire_at FROM events")
def sleep_until_clamp(spark, sf):
    return S.events(spark, sf).select(F.col("event_id").alias("id"), X.clamp_deadline(F.col("ts"), at("2024-01-15 00:00:00")).cast("timestamp_ntz").alias("fire_at"))


@query("SELECT event_id AS id, event_type AS name, props AS payload FROM events")
def payload_wrap(spark, sf):
    e = S.events(spark, sf).select(F.col("event_id").alias("id"), X.wrap_payload(F.col("event_type"), F.regexp_replace("props", " ", "")).alias("w"))
    name, payload = X.unwrap_payload(F.col("w"))
    return e.select("id", name.alias("name"), F.regexp_replace(payload, ":", ": ").alias("payload"))


@query("SELECT event_id AS id, props AS plain, true AS sealed FROM events")
def encrypt_roundtrip(spark, sf):
    codec = Codec(Keyring("k2", {"k1": b"1" * 32, "k2": b"2" * 32}), version=2)
    e = S.events(spark, sf).select(F.col("event_id").alias("id"), codec.encrypt(F.col("props")).alias("box"))
    return e.select("id", codec.decrypt(F.col("box")).alias("plain"), F.col("box").contains('"ct"').alias("sealed"))


# The state machine


def _flow(ctx, value):
    """Takes two signals and then sleeps for an hour."""
    a, b = ctx.receive("go"), ctx.receive("go")
    ctx.sleep(3600)
    return [a, b]


def _clicks(spark, sf):
    """Journals of one event, and clicks as signals to them."""
    e = S.events(spark, sf).where("event_type = 'click'")
    u = F.col("user_id").cast("string")
    started = e.select(u.alias("instance_id")).distinct().select("instance_id", F.lit(1).cast("bigint").alias("seq"), F.lit("workflow_started").alias("type"), F.lit("w").alias("name"), F.lit(0).cast("bigint").alias("ref_seq"), F.lit(None).cast("string").alias("payload"))
    box = e.select(u.alias("instance_id"), F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.lit("signal_received").alias("type"), F.lit("go").alias("name"), F.lit(0).cast("bigint").alias("ref_seq"), F.get_json_object("props", "$.k").alias("payload"))
    return started, box


_THEN = datetime(2024, 2, 1, tzinfo=timezone.utc)
_DRAINED = "SELECT user_id::VARCHAR AS instance_id, 'suspended' AS status, 1 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, 'signal_received' AS type, 'go' AS name, 0 AS ref_seq, json_extract_string(props, '$.k') AS payload, event_id AS inbox_id, false AS cut FROM events WHERE event_type = 'click'"


@query(_DRAINED + " UNION ALL SELECT user_id::VARCHAR, 'suspended', 2 + count(*), 'timer_created', '', 0, '{\"fire_at\": \"2024-02-01T01:00:00+00:00\"}', NULL, false FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) >= 2")
def turn_fold_batch(spark, sf):
    return replay.fold_turns(*_clicks(spark, sf), _flow, _THEN)


def _fans_out(ctx, value):
    ctx.all(*[ctx.start("a", k) for k in range(20)])


@query(f"""WITH d AS ({_DRAINED}), n AS (SELECT instance_id, least(count(*), 10) AS n FROM d GROUP BY 1)
  SELECT instance_id, count(*) AS events, max(seq) AS last_seq, true AS cut FROM (SELECT instance_id, seq FROM d WHERE seq <= 11
  UNION ALL SELECT instance_id, 1 + n + k FROM n, (SELECT unnest(range(1, 21)) AS k) WHERE 2 * k <= 40 - 2 - 2 * n) GROUP BY 1""")
def turn_budget(spark, sf):
    """Turns under a limit of 40 effects: 10 signals drained at most, and the activities that fit beside them."""
    rows = replay.fold_turns(*_clicks(spark, sf), _fans_out, _THEN, caps=Capabilities(40))
    return rows.groupBy("instance_id").agg(F.count("seq").alias("events"), F.max("seq").alias("last_seq"), F.bool_or("cut").alias("cut"))


def _ends(ctx, value):
    for _ in range(value):
        ctx.start_child("c")


@query("SELECT user_id::VARCHAR AS instance_id, CASE WHEN 2 + k + 1 + 3 * k + (user_id % 2) <= 100 THEN 'completed' ELSE 'over_budget' END AS status FROM (SELECT user_id, count(*) AS k FROM events WHERE event_type = 'click' GROUP BY 1)")
def terminal_over_budget(spark, sf):
    """Turns that end with as many children as the user has clicks: over 100 operations they are refused whole."""
    e = S.events(spark, sf).where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    started = e.select(F.col("user_id").cast("string").alias("instance_id"), F.lit(1).cast("bigint").alias("seq"), F.lit("workflow_started").alias("type"), F.lit("w").alias("name"), F.lit(0).alias("ref_seq"), F.col("n").cast("string").alias("payload"))
    about = e.select(F.col("user_id").cast("string").alias("instance_id"), F.lit(None).cast("map<string,string>").alias("search_attributes"), F.lit(None).cast("map<string,string>").alias("memo"), F.when(F.col("user_id") % 2 == 1, "p").alias("parent_id"))
    rows = replay.fold_turns(started, _clicks(spark, sf)[1].limit(0), _ends, _THEN, True, about, Capabilities())
    return rows.select("instance_id", "status").distinct()


def _notes(ctx, value):
    ctx.upsert_attributes({"b": "x", "c": ""})
    ctx.upsert_memo({"note": "m"})
    ctx.receive("never")


@query("SELECT user_id::VARCHAR AS instance_id, t.type, CASE t.type WHEN 'search_attributes_updated' THEN '{\"a\": \"' || user_id || '\", \"b\": \"x\"}' ELSE '{\"old\": \"1\", \"note\": \"m\"}' END AS payload FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), (VALUES ('search_attributes_updated'), ('memo_updated')) t(type)")
def attributes_upserted(spark, sf):
    """What instances were started with stays, unless it is patched."""
    started, box = _clicks(spark, sf)
    about = started.select("instance_id", F.create_map(F.lit("a"), "instance_id", F.lit("c"), F.lit("2")).alias("search_attributes"), F.create_map(F.lit("old"), F.lit("1")).alias("memo"), F.lit(None).cast("string").alias("parent_id"))
    return replay.fold_turns(started, box.limit(0), _notes, _THEN, True, about).select("instance_id", "type", "payload")


def _reads_back(ctx, value):
    return [ctx.clock().isoformat(), ctx.side_effect(lambda: -1), ctx.version("c", 1, 2)]


@query("SELECT user_id::VARCHAR AS instance_id, 5 AS seq, '[\"2024-01-01T00:00:00+00:00\", ' || count(*) || ', 1]' AS payload FROM events GROUP BY user_id")
def replay_recorded(spark, sf):
    """Recorded clocks, side effects and versions are read back, whatever the code would give now."""
    e = S.events(spark, sf).groupBy(F.col("user_id").cast("string").alias("instance_id")).agg(F.count("*").alias("n"))
    kinds = [("workflow_started", "w", F.lit(None)), ("now_recorded", "", F.lit('"2024-01-01T00:00:00+00:00"')), ("side_effect", "", F.col("n").cast("string")), ("version_marker", "c", F.lit('{"change_id": "c", "version": 1}'))]
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("seq"), F.lit(t).alias("type"), F.lit(n).alias("name"), F.lit(0).alias("ref_seq"), p.cast("string").alias("payload")) for k, (t, n, p) in enumerate(kinds, 1)])
    log = e.select("instance_id", F.explode(rows).alias("r")).select("instance_id", "r.*")
    out = replay.fold_turns(log, _clicks(spark, sf)[1].limit(0), _reads_back, _THEN, True)
    return out.where("type = 'workflow_completed'").select("instance_id", "seq", "payload")


@query(f"""WITH {_I}, t AS (SELECT event_id, user_id, event_id % 4 AS next_seq FROM events)
  SELECT event_id AS id, CASE WHEN i.id IS NULL THEN 'not found' WHEN t.next_seq <> 2 THEN 'sequence' WHEN event_id % 3 <> 1 THEN 'token' END AS conflict FROM t LEFT JOIN i ON i.id = t.user_id""")
def turn_preflight(spark, sf):
    """Turns of the events' users, of which each owns the task with the event's id if the attempt is 1."""
    turns = S.events(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").alias("instance_id"), (F.col("event_id") % 4).alias("next_seq"), F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 2 == 0, "w1").otherwise("w2").alias("worker_id"), F.lit(1).alias("attempt"))
    inst = S.instances(spark, sf).select("id", F.lit(2).alias("next_seq"))
    tasks = _leased(spark, sf).withColumns({"instance_id": F.col("instance_id").cast("bigint"), "kind": F.lit("workflow")})
    return J.preflight(turns, inst, tasks).select("id", "conflict")


@query(f"""SELECT event_id AS id, CASE event_id WHEN 6 THEN TIMESTAMP '2024-01-20 00:01:00' WHEN 10 THEN TIMESTAMP '2024-01-20 00:00:05' WHEN 14 THEN TIMESTAMP '2024-01-20 00:00:09' ELSE ts END AS visible_at,
  CASE WHEN event_id IN (10, 14) THEN NULL WHEN event_id % 2 = 0 THEN 'w1' ELSE 'w2' END AS worker_id, CASE WHEN event_id = 6 THEN 'half' END AS details FROM events""")
def lease_ends(spark, sf):
    """A heartbeat with details, a nack, a retry, and a retry whose attempt is an older one."""
    rows = claims.record_heartbeat(_leased(spark, sf), {"id": 6, "worker_id": "w1", "attempt": 0}, at(), 60_000, b"half")
    rows = claims.nack(rows, {"id": 10, "worker_id": "w1", "attempt": 1}, at(), 5_000)
    rows = claims.retry_activity(rows, {"id": 14, "worker_id": "w1", "attempt": 2}, at(), 9_000)
    rows = claims.retry_activity(rows, {"id": 15, "worker_id": "w2", "attempt": 2}, at(), 9_000)
    return rows.select("id", F.col("visible_at").cast("timestamp_ntz").alias("visible_at"), "worker_id", F.col("heartbeat").cast("string").alias("details"))


@query("SELECT event_id AS id, CASE WHEN strlen(props) <= 5 THEN props ELSE substr(props, 1, 5) || '…' END AS shown FROM events")
def shortened(spark, sf):
    return S.events(spark, sf).select(F.col("event_id").alias("id"), X.shorten(F.col("props"), 5).alias("shown"))


@query(f"SELECT 's' || o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN '@daily' ELSE '0 * * * *' END AS cron, CASE WHEN o_orderkey = 3 THEN true ELSE o_orderstatus = 'P' END AS paused, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2000-01-02 00:00:00' ELSE o_orderdate END AS next_run_at FROM orders")
def schedule_changes(spark, sf):
    """The open orders' schedules with another rule, and one paused."""
    rows = _schedules(spark, sf).withColumns({"queue": F.lit("default"), "input": F.lit(None).cast("string"), "updated_at": at(ORDERS_NOW)})
    new = S.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("s"), "o_orderkey").alias("id"), F.lit("@daily").alias("cron"), F.lit("w").alias("workflow"), F.lit("").alias("queue"), F.lit(None).cast("string").alias("input"), F.lit(False).alias("paused"))
    out = M.pause_schedule(M.upsert_schedules(rows, new, at(ORDERS_NOW)), "s3", True)
    return out.select("id", "cron", "paused", F.col("next_run_at").cast("timestamp_ntz").alias("next_run_at"))
