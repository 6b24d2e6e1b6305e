"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into logical partitions by a hash (so a rerun, or a retry after a lost executor, deals alike). How many
rows of each partition go to each shard is drawn exactly: the counts of a uniform permutation of all rows follow a
multivariate hypergeometric law given the partition sizes and the shard sizes. Each partition then permutes
its rows and cuts them by its row of the matrix, rows are exchanged, and each shard permutes again. Every step on rows is a
DataFrame operation; the driver draws only the matrix. More than FAN shards are dealt in levels: first into groups of shards, then each group in the same way,
so that a level's matrix has at most MAX_PARTS times FAN numbers however many shards there are.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Tables, named

ROWS_A_PART, MIN_PARTS, MAX_PARTS = 16_384, 64, 16_384
#: Shards, or groups of shards, that one level deals into at most.
FAN = 256
#: Numbers of the matrix that one literal of a plan holds at most; it is written as a table.
_LITERAL = 1 << 16
#: Rows that one task permutes in a shard, about.
ROWS_A_BLOCK = 4_096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn without replacement are good. By inversion over the support, or over 12
    standard deviations about the mode where the support is wider (the rest has less than 1e-30 of the mass), for counts of any size."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (sample + 1) * (good + 1) // (n + 2)))
    var = sample * (good / n) * (bad / n) * ((n - sample) / max(1, n - 1))
    reach = int(12 * math.sqrt(max(var, 0))) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, b - a))


def communication_matrix(part_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard: the law of a uniform permutation given both margins."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = list(shard_rows), []
    for rows in part_rows:
        rest, line, todo = sum(left), [], rows
        for s, room in enumerate(left):
            rest -= room
            take = hypergeometric(rng, room, rest, todo) if s < len(left) - 1 else todo
            line.append(take)
            todo -= take
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def _levels(shards: int) -> list[int]:
    """Shards below one group at each level, from all of them down to 1; each is at most FAN times the next."""
    out = [1]
    while out[-1] < shards:
        out.append(min(shards, out[-1] * FAN))
    return out[::-1]


def _matrix_table(spark, ends: dict[tuple[int, int], list[int]], tables: Tables) -> DataFrame:
    """Rows (__group, __part, __ends), written in pieces."""
    rows, pieces, size = [], [], 0
    for (group, part), line in ends.items():
        rows.append([group, part, *line])
        size += len(line)
        if size >= _LITERAL:
            pieces, rows, size = [*pieces, rows], [], 0
    out = None
    for piece in [*pieces, rows]:
        one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(piece)), "array<array<bigint>>")).alias("x"))
        out = one if out is None else out.union(one)
    return tables.put(out.select(F.col("x")[0].cast("int").alias("__group"), F.col("x")[1].cast("int").alias("__part"), F.expr("slice(x, 3, size(x) - 2)").alias("__ends")))


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 20, key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``df`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most; which shards hold the odd rows depends on the seed. Given the same rows and seed the
    result is the same on any cluster. ``key_cols`` feed the hashes: rows alike in all of them are ordered arbitrarily among
    themselves and dealt together, so they should tell rows apart; nulls, ties and repeated rows are rows like any other. An empty table gives an empty
    table. Input columns named shard or slot are replaced. Whole rows move once for each level and once more in the shards: move narrow rows
    and join the wide ones (``shuffle_rows``).
    """
    spark, tables = df.sparkSession, Tables(df.sparkSession, "shards")
    own = [c for c in df.columns if c not in ("shard", "slot")]
    keys = [F.col(f"`{c}`") for c in key_cols]

    def rank(salt: int):
        return F.xxhash64(F.lit(seed * 64 + salt), *keys)

    rows = df.count()
    order = np.random.Generator(np.random.PCG64(seed + 1)).permutation(shards)
    shard_rows = (rows // shards + (order < rows % shards)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(shard_rows)])
    sent, levels = df.select(*own, F.lit(0).alias("__group")), _levels(shards)
    for level, (above, below) in enumerate(zip(levels, levels[1:])):
        groups = -(-shards // above)
        parts = max(1, min(MAX_PARTS // groups, max(MIN_PARTS, math.ceil(rows / groups / ROWS_A_PART))))
        dealt = sent.withColumn("__part", F.pmod(rank(2 * level), F.lit(parts)).cast("int"))
        sizes = {(r[0], r[1]): r[2] for r in dealt.groupBy("__group", "__part").count().collect()}  # MAX_PARTS rows, or one a group
        ends = {}
        for g in range(groups):
            first = g * (above // below) if level else 0
            bounds = starts[np.minimum(np.arange(g * above, min((g + 1) * above, shards) + below, below).clip(max=min((g + 1) * above, shards)), shards)]
            lines = communication_matrix([sizes.get((g, p), 0) for p in range(parts)], np.diff(bounds).tolist(), seed * 1_000_003 + level * 65_537 + g)
            ends |= {(g, p): [first, *np.cumsum(line).tolist()] for p, line in enumerate(lines)}
        table = F.broadcast(_matrix_table(spark, ends, tables))  # MAX_PARTS times FAN numbers, or FAN a group
        local = Window.partitionBy("__group", "__part").orderBy(rank(2 * level + 1), *keys)
        sent = dealt.withColumn("__r", F.row_number().over(local)).join(table, ["__group", "__part"])
        child = F.col("__ends")[0] + F.size(F.filter(F.expr("slice(__ends, 2, size(__ends) - 1)"), lambda e: e < F.col("__r")))
        sent = sent.select(*own, child.cast("int").alias("__group"))
    sent = sent.withColumnRenamed("__group", "shard")
    blocks = max(4, math.ceil(rows / shards / ROWS_A_BLOCK))
    sent = sent.withColumn("__block", F.pmod(rank(60), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    begin = sent.groupBy("shard", "__block").count().select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__block").orderBy(rank(61), *keys)
    ranked = sent.withColumn("__r", F.row_number().over(inside))
    placed = ranked.join(begin, ["shard", "__block"]).withColumn("slot", F.col("__start") + F.col("__r") - 1)
    return placed.select(*[F.col(f"`{c}`") for c in own], "shard", "slot")


def shuffle_rows(df: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """As ``shuffle_into_shards``, for wide rows: a hash of each whole row and the number of its copy are dealt; the rows themselves move once, to be joined with their places.

    Repeated rows are numbered and dealt apart. Nulls in any column are allowed, also null ids; maps do not count in the hash. An empty table gives an empty table.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in own and "map<" not in f.dataType.simpleString()]
    copy = F.row_number().over(Window.partitionBy("__hash").orderBy(F.lit(0)))
    wide = df.select(F.xxhash64(*hashed).alias("__hash"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"))
    narrow = Tables(df.sparkSession, "shard-rows").put(wide.select("__hash").withColumn("__copy", copy))
    placed = shuffle_into_shards(narrow, shards, seed, ("__hash", "__copy"))
    places = placed.groupBy("__hash").agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("__places"))  # one for each copy of a row
    met = wide.withColumn("__copy", copy).join(places.hint("shuffle_merge"), "__hash").withColumn("__place", F.col("__places")[F.col("__copy") - 1])
    return met.select(*[F.col(f"__row.`{c}`").alias(c) for c in own], F.col("__place.shard").alias("shard"), F.col("__place.slot").alias("slot"))


def op10_shuffle_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards. A null text has size 1 and the CRC of no bytes, 0. Equal texts carry equal text_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    facts = named(docs, doc_id="doc_id", size=(F.octet_length(text) + 1).cast("long"), text_crc32=F.crc32(text))
    narrow = Tables(spark, "shards").put(facts)  # the texts are read once; the shuffles carry three numbers
    out = shuffle_into_shards(narrow, 16, key_cols=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
