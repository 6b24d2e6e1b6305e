"""Shared parts: tables in the shared folder, names that cannot clash, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the text contracts: a run without blanks (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may go without it and
    then gets a folder of its own; on a cluster its absence is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    return _own[app]


class Tables:
    """Intermediate results written as Parquet to the shared folder.

    A written table cuts the lineage, survives the loss of executors, and is scanned by column. ``put`` writes and
    rereads; ``drop`` deletes early what is no longer needed; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidewheel_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self._path(t._tidewheel_path), True)


#: Most ids (of 8 bytes, and little else) that are broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it has been counted and found small."""
    return F.broadcast(ids) if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else ids


def named(df: DataFrame, **needed: Column | str) -> DataFrame:
    """Only the columns needed, under the operator's own names: other columns of the input cannot clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in needed.items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """Connected components of the undirected ``edges`` (u, v: long): one row (node, root) for each node that has an
    edge, root being the smallest node reachable.

    Minimum-label hooking with pointer jumping: each round lowers the parent of a node, and of its parent, to the
    smallest grandparent among its neighbours. A hub's labels are minimised before they are shuffled, and each
    join is between two scanned tables, so that a hot node's partition can be split. The state is written each round.
    Rounds grow with the logarithm of the longest path. An empty ``edges`` gives an empty result.
    """
    both = tables.put(
        edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    )
    state = tables.put(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")))
    total = state.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    while True:
        above = state.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        jumped = state.join(above, "root").select("node", "root", "grand")
        near = jumped.select(F.col("node").alias("v"), F.col("grand").alias("label"))
        lowest = both.join(near, "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label"))
        met = jumped.join(lowest, "node")
        new = (
            met.select("node", F.least("grand", "label").alias("root"))
            .union(met.select(F.col("root").alias("node"), F.least("grand", "label").alias("root")))
            .groupBy("node")
            .agg(F.min("root").alias("root"))
        )
        old, state = state, tables.put(new)
        tables.drop(old)
        before, total = total, state.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            tables.drop(both)
            return state


def per_text(fn, ddl: str):
    """An Arrow UDF that calls ``fn`` on a batch of texts (str or None) and makes a struct column of its rows.

    Only the texts go to Python; the other columns stay in the JVM. Marked non-deterministic so that the planner runs
    it once where several of its fields are used.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(ddl).fields]

    def run(texts):
        import pyarrow as pa

        rows = list(fn(texts.to_pylist()))
        columns = list(zip(*rows)) if rows else [[] for _ in fields]
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    return arrow_udf(run, f"struct<{ddl}>").asNondeterministic()


def arrow_udf(fn, ddl: str):
    """An Arrow UDF of a function of one array, without the type hints that Spark reads its kind from."""
    import pyarrow as pa

    fn.__annotations__ = {fn.__code__.co_varnames[0]: pa.Array, "return": pa.Array}
    return F.arrow_udf(fn, ddl)


def lower(text: str) -> str:
    """A-Z lower-cased, all else as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
