"""Point reads, range scans, listing, and loading of an instance's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scalars import has_attributes
from tidewheel.model import InstanceFilter, NotFound

MAX_HOPS = 32


def get_instance(instances: DataFrame, instance_id) -> DataFrame:
    return instances.where(F.col("id") == F.lit(instance_id))


def get_schedule(schedules: DataFrame, schedule_id: str) -> DataFrame:
    return schedules.where(F.col("id") == F.lit(schedule_id))


def one(rows: DataFrame):
    """The single row of a point read; NotFound without one."""
    if (row := rows.first()) is None:
        raise NotFound("no such row")
    return row


def get_journal(journal: DataFrame, instance_id: str, after_seq: int = 0) -> DataFrame:
    return journal.where((F.col("instance_id") == F.lit(instance_id)) & (F.col("seq") > after_seq)).orderBy("seq")


def list_instances(instances: DataFrame, f: InstanceFilter = InstanceFilter()) -> DataFrame:
    """By creation, then id. Only the conditions that are set become predicates, so those on plain columns reach the scan."""
    if f.status:
        instances = instances.where(F.col("status") == f.status)
    if f.name:
        instances = instances.where(F.col("name") == f.name)
    if f.search_attributes:
        instances = instances.where(has_attributes(F.col("search_attributes"), f.search_attributes))
    return instances.orderBy("created_at", "id").offset(max(0, f.offset)).limit(f.limit if f.limit > 0 else 100)


def list_page(instances: DataFrame, f: InstanceFilter) -> tuple[DataFrame, int]:
    """A page for display (100 by default, 500 at most) read with one row more, which tells whether another page follows."""
    size = min(f.limit if f.limit > 0 else 100, 500)
    return list_instances(instances, InstanceFilter(f.status, f.name, f.search_attributes, size + 1, f.offset)), size


def inbox_order(inbox: DataFrame) -> DataFrame:
    """Oldest first: by seq (rows from before there was one have 0), creation, id."""
    return inbox.orderBy("seq", "created_at", "id")


def load_heads(instances: DataFrame, inbox: DataFrame) -> DataFrame:
    """Each instance with its undrained events in order, without its journal."""
    item = F.struct("seq", "created_at", "id", "type", "name", "ref_seq", "payload")
    box = inbox.groupBy(F.col("instance_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("inbox"))
    return instances.join(box, "id", "left").withColumn("now", F.current_timestamp())


def load_states(instances: DataFrame, inbox: DataFrame, journal: DataFrame) -> DataFrame:
    """load_heads with the journal in order."""
    item = F.struct("seq", "type", "name", "ref_seq", "payload")
    log = journal.groupBy(F.col("instance_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("journal"))
    return load_heads(instances, inbox).join(log, "id", "left")


def journal_since(journal: DataFrame, marks: DataFrame) -> DataFrame:
    """What is new after each instance's mark (instance_id, last_seq), for caches of a prefix. An instance whose events don't begin right after its mark, or
    that has no mark, comes whole, flagged reload."""
    j, m = journal.alias("j"), marks.alias("m")
    firsts = journal.join(marks, "instance_id").where("seq > last_seq").groupBy("instance_id").agg(F.min("seq").alias("first"))
    tops = journal.groupBy("instance_id").agg(F.max("seq").alias("top"))
    state = marks.join(firsts, "instance_id", "left").join(tops, "instance_id", "left")
    state = state.select("instance_id", "last_seq", (~F.coalesce(F.when(F.col("first").isNull(), F.col("top") == F.col("last_seq")).otherwise(F.col("first") == F.col("last_seq") + 1), F.lit(False))).alias("reload"))
    met = j.join(state.alias("m"), F.col("j.instance_id") == F.col("m.instance_id"), "left")
    reload = F.coalesce(F.col("m.reload"), F.lit(True))
    return met.where(reload | (F.col("j.seq") > F.col("m.last_seq"))).select("j.*", reload.alias("reload"))


def continue_chain(instances: DataFrame, next_id: str = "next_id") -> DataFrame:
    """(id, tail, hops): where the chain of continued instances ends, at most MAX_HOPS steps on. ``instances``: id, status, and the id to
    continue at in ``next_id``; a successor that does not exist ends the chain. Pointers double, so five joins make 32 steps."""
    known = instances.select(F.col("id").alias("onward"))
    onward = instances.where("status = 'continued'").select("id", F.col(next_id).alias("onward")).join(known, "onward", "left_semi")
    at = instances.select("id").join(onward, "id", "left").select("id", F.coalesce("onward", "id").alias("tail"), F.col("onward").isNotNull().cast("int").alias("hops"))
    for _ in range(MAX_HOPS.bit_length() - 1):
        b = at.select(F.col("id").alias("tail"), F.col("tail").alias("t2"), F.col("hops").alias("h2"))
        at = at.join(b, "tail").select("id", F.col("t2").alias("tail"), (F.col("hops") + F.col("h2")).alias("hops"))
    return at
