"""Sources: parquet tables, stand-ins of the seven tables made from them, and a store of the seven tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.model import DDL, Conflict, schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times as timestamps (session zone UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as leased tasks: one queue an event type, one instance a user."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.lit("activity").alias("kind"), F.col("event_type").alias("queue"), F.col("user_id").cast("string").alias("instance_id"),
        F.col("event_type").alias("name"), F.col("event_id").alias("ref_seq"), F.col("props").alias("input"), F.lit(0).alias("attempt"), F.col("ts").alias("visible_at"),
        F.lit(None).cast("string").alias("worker_id"),
    )


KINDS = {"click": "activity_scheduled", "view": "timer_created", "purchase": "activity_completed", "signup": "signal_received", "error": "activity_failed"}


def event_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a journal: seq is the event's id (unique, growing in an instance), a completion refers to a command by ``k``."""
    kind: Column = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("instance_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("name"),
        F.get_json_object("props", "$.k").cast("bigint").alias("ref_seq"), F.col("props").alias("payload"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as journals: a turn is an event."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("instance_id"), (F.col("turn") + 1).alias("seq"), F.col("role").alias("type"), F.col("role").alias("name"), F.lit(0).cast("bigint").alias("ref_seq"), F.col("text").alias("payload")
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as instances: O running, F completed, P failed; the priority is a search attribute, the customer the parent."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("order").alias("name"), status.alias("status"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("search_attributes"),
        F.col("o_custkey").alias("parent_id"), F.col("o_totalprice").alias("result"), F.col("o_orderdate").alias("created_at"), F.when(status != "running", F.col("o_orderdate")).alias("completed_at"),
    )


class Store:
    """The seven tables as parquet folders under one path. A manifest names the folders of every table; a commit writes new folders and then one new manifest, so that changes of
    several tables become visible together or not at all. The greatest manifest counts."""

    #: Folders of a table from which on an append rewrites it as one.
    MOST_FOLDERS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _load(self, n: int) -> dict[str, list[str]]:
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{n:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _tables(self) -> dict[str, list[str]]:
        found = self._manifests()
        return self._load(found[-1]) if found else {}

    def version(self) -> int:
        """The number of the last commit, 0 before any."""
        return max(self._manifests(), default=0)

    def migrate(self) -> list[str]:
        """Create what is missing; returns the names of the tables created."""
        made = [name for name in DDL if name not in self._tables()]
        if made:
            self.commit({name: self.spark.createDataFrame([], schema(name)) for name in made})
        return made

    def validate(self) -> None:
        """Fail if a table is missing or its columns are not the model's."""
        tables = self._tables()
        for name in DDL:
            if name not in tables:
                raise LookupError(f"table {name} is missing; run migrate()")
            if [(f.name, f.dataType) for f in self.read(name).schema] != [(f.name, f.dataType) for f in schema(name)]:
                raise TypeError(f"table {name} has other columns than the model")

    def read(self, name: str) -> DataFrame:
        if (folders := self._tables().get(name)) is None:
            raise LookupError(f"table {name} is missing; run migrate()")
        return self.spark.read.schema(schema(name)).parquet(*[f"{self.path}/{name}/{f}" for f in folders])

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, base: int | None = None) -> int:
        """Replace whole tables and append to others in one step. With ``base`` the step is refused (Conflict) if there was a commit after that version; readers of older versions
        are not disturbed for two commits more. Rows may come from the tables that they replace."""
        made: dict[str, tuple[str, bool]] = {}
        tables = self._tables()
        for name, rows, whole in [*((k, v, True) for k, v in (replace or {}).items()), *((k, v, False) for k, v in (append or {}).items())]:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema(name)])
            if not whole and len(tables.get(name, ())) >= self.MOST_FOLDERS:
                rows, whole = self.read(name).unionByName(rows), True
                base = self.version() if base is None else base
            made[name] = uuid.uuid4().hex, whole
            rows.write.parquet(f"{self.path}/{name}/{made[name][0]}")
        found = self._manifests()
        last = max(found, default=0)
        if base is not None and base != last:
            raise Conflict(f"version {last} came after {base}")
        tables = self._load(last) if found else {}
        for name, (folder, whole) in made.items():
            tables[name] = [folder] if whole else [*tables.get(name, ()), folder]
        # Written aside and renamed: a reader never sees half of a manifest, and of two writers one finds its name taken.
        aside, place = self._path(f"{self.path}/_manifests/{uuid.uuid4().hex}.part"), self._path(f"{self.path}/_manifests/{last + 1:012d}")
        stream = self._fs.create(aside)
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            raise Conflict(f"version {last + 1} was taken")
        for old in found[:-2]:
            gone = {(name, f) for name, folders in self._load(old).items() for f in folders}
            for n in [*[x for x in found if x > old], last + 1]:
                gone -= {(name, f) for name, folders in self._load(n).items() for f in folders}
            for name, f in gone:
                self._fs.delete(self._path(f"{self.path}/{name}/{f}"), True)
            self._fs.delete(self._path(f"{self.path}/_manifests/{old:012d}"), False)
        return last + 1

    def replace(self, name: str, rows: DataFrame) -> None:
        self.commit({name: rows})

    def append(self, name: str, rows: DataFrame) -> None:
        self.commit(append={name: rows})

    def hold(self, rows: DataFrame) -> DataFrame:
        """A written copy of rows that depend on tables about to change: a cache would be dropped with them."""
        path = f"{self.path}/_held/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        held = self.spark.read.schema(rows.schema).parquet(path)
        held._held_path = path
        return held

    def release(self, *held: DataFrame) -> None:
        for df in held:
            self._fs.delete(self._path(df._held_path), True)
