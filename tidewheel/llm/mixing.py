"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources ask for words in proportion to their weights; none may be repeated more than ``max_epochs`` times, and what a
clamped source leaves goes to the others by weight until none is above. A source with target t and size n gives every document
floor(t / n) times, and once more the documents that come first in a seeded order, up to the rest of the target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Tables, named, small

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows of a bucket of the seeded order, about; one task ranks the rows of the bucket in which a target is reached.
EDGE_ROWS = 4_096


def word_count(text):
    """Words of a text, null as 0: blanks between words are made single, then counted."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit("")))
    return F.when(one == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with weight and target: the total size shared by weight, clamped at max_epochs.

    One row a source, so its windows run in one task. Clamped sources are a prefix of the order by cap over weight: source j is
    clamped if the level reached with all before it clamped is at or above its own ratio. A total of 0 gives targets of 0.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_source) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    line = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(line), F.lit(0)))
    s = s.withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(line), F.lit(0)))
    s = s.withColumn("clamped", (F.col("total") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    s = s.withColumn("free", F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything))
    s = s.withColumn("free_weight", F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("free")).cast("double") / F.col("free_weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, source, size, and others) with source_size, target and copies (times the mix takes the row), replacing columns of those names.

    The words taken from a source differ from its target by half of one document at most. Each source's order is cut into
    buckets by the hash, so many that one holds some EDGE_ROWS rows; only the bucket in which the target is reached is ranked row by row, so a hot source is
    never ordered in one task. The hash takes the id and ``more`` (columns that tell rows of one id, or of none, apart): only rows alike in all of them share a bucket.
    Null sources form a source of their own, the last. Rows of size 0 and null ids are allowed; rows with the same
    id are ordered by size. A row of size 0 is taken as often as its source's rows are at least. An empty table gives an empty table.
    """
    rows_in_all = sized.count()
    digits = min(12, max(3, math.ceil(math.log(max(rows_in_all, 1) / EDGE_ROWS, 16))))
    mark = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", *more)]))
    own = [c for c in sized.columns if c not in ("source_size", "target", "copies")]
    some = F.col("__some") if "__some" in own else F.col("size") > 0  # cheaper than the size, where that is not written
    rows = sized.select(*own, mark.alias("__mark")).withColumn("__bucket", F.substring("__mark", 1, digits))
    buckets = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("n"))
    goals = water_fill(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    line = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = buckets.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0)))
    g = goals.alias("g")
    cut = (
        runs.alias("r")
        .join(g, F.expr("r.source <=> g.source"))
        .where("r.before <= g.rest")
        .groupBy(F.col("r.source").alias("source"))
        .agg(F.max(F.struct("r.__bucket", "r.before")).alias("last"))
    )
    plan = Tables(sized.sparkSession, "mix-plan").put(
        g.join(cut.alias("c"), F.expr("g.source <=> c.source"), "left")
        .select("g.source", "g.source_size", "g.target", "g.whole", "g.rest", F.col("c.last.__bucket").alias("cut_at"), F.col("c.last.before").alias("cut_before"))
    )
    plan = small(plan).alias("p")  # one row a source
    met = rows.alias("__rows").join(plan, F.expr("__rows.source <=> p.source")).select("__rows.*", "p.source_size", "p.target", "p.whole", "p.rest", "p.cut_at", "p.cut_before")
    outside = met.where("__bucket <> cut_at").withColumn("copies", F.col("whole") + ((F.col("__bucket") < F.col("cut_at")) & some).cast("long"))
    inside = Window.partitionBy("source").orderBy("__mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("cut_before") + F.sum("size").over(inside)
    edge = met.where("__bucket = cut_at").withColumn("copies", F.col("whole") + ((2 * upto - F.col("size") <= 2 * F.col("rest")) & some).cast("long"))
    keep = [*own, "source_size", "target", "copies"]
    return outside.select(*keep).union(edge.select(*keep))


def repeat_by_mix(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns. Only rows where a target is reached are shuffled. Null and empty texts, null ids and sources,
    repeated rows and an empty table: as in ``mix``."""
    own = [F.col(f"__doc.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32("text").alias("__crc"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("__some"))
    taken = mix(rows, more=("__crc",)).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "__doc").select(*own)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words that it takes of each. A null text has size 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = Tables(spark, "mix").put(named(docs, doc_id="doc_id", source="source", size=word_count(F.col("text"))))
    out = mix(sized, more=("size",))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = """
WITH e AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
d AS (SELECT *, md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || size) AS mark FROM e),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * n AS cap FROM s),
l AS (
  SELECT *, sum(n) OVER () AS total,
         coalesce(sum(cap) OVER o, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - cap_before) * weight >= cap * weight_left AS clamped FROM l),
f AS (
  SELECT *, total - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS free,
         sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS free_weight FROM c),
t AS (SELECT source, n, CASE WHEN clamped THEN cap::DOUBLE ELSE (weight * free)::DOUBLE / free_weight::DOUBLE END AS target FROM f),
g AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, g.n, g.target, g.whole, g.target - (g.whole * g.n)::DOUBLE AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target,
       (size * (whole + CASE WHEN (2 * upto - size)::DOUBLE <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
