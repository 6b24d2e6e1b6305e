"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample.

Words and word pairs are hashed into buckets. Bucket counts over all documents give the raw model, those over the documents labelled good the
target model; a document's weight is the ratio of its likelihoods. Adding seeded Gumbel noise to the log weights and taking the k
largest samples k documents without replacement, in proportion to their weights. Plain likelihoods grow with a text's length, so that among good texts the longest have
nearly all the weight; with ``standard`` the ratio is taken for a text of that many features, and short texts are drawn to the target's mean.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, Tables, lower, named, per_text, small

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Features that every text counts as having in the query, and features of prior belief that short texts get then.
STANDARD, PRIOR = 1_000.0, 100.0
SEED = 4
_BINS = 4_096

_word = re.compile(WORD).findall


def features(text: str | None) -> np.ndarray:
    """Bucket of every word and every pair of neighbours."""
    words = _word(lower(text)) if text else []
    h = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h % np.uint64(BUCKETS), (pairs ^ (pairs >> np.uint64(29))) % np.uint64(BUCKETS)]).astype(np.int64)


def count_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all texts and of those with ``good``. Added up in each task; at most BUCKETS rows reach the driver."""

    def partial(batches):
        import pyarrow as pa

        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text, good in zip(b.column("text").to_pylist(), b.column("good").to_pylist()):
                f = features(text)
                np.add.at(raw, f, 1) if len(f) < 2_000 else raw.__iadd__(np.bincount(f, minlength=BUCKETS))
                if good:
                    np.add.at(target, f, 1) if len(f) < 2_000 else target.__iadd__(np.bincount(f, minlength=BUCKETS))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["at", "raw", "target"])

    sums = rows.select("text", "good").mapInArrow(partial, "at int, raw bigint, target bigint").groupBy("at").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for at, r, t in sums:
        raw[at], target[at] = r, t
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """log p_target - log p_raw of each bucket, and its mean over target text."""
    p_target = (target + SMOOTHING * (raw + 1) / (raw + 1).mean()) / (target.sum() + SMOOTHING * len(raw))
    p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    ratio = np.log(p_target) - np.log(p_raw)
    return ratio, float((p_target * ratio).sum())


def log_weights(text: Column, ratios, mean: float, standard: float | None = None) -> Column:
    """The log likelihood ratio of each text, 0 for null and empty ones; with ``standard`` that of a text of so many features, null and empty texts having the target's mean."""

    def rows(texts):
        ratio = ratios.value
        for t in texts:
            f = features(t)
            total = float(ratio[f].sum())
            yield (total if standard is None else (total + PRIOR * mean) / (len(f) + PRIOR) * standard,)

    return per_text(rows, "weight double")(text)["weight"]


def gumbel(*keys: Column) -> Column:
    """Seeded standard Gumbel noise."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def tie(*keys: Column) -> Column:
    """A seeded number that orders rows of one score, whatever the type of their ids."""
    return F.xxhash64(F.lit(SEED + 1), *keys)


def kth_largest(scores: DataFrame, k: int, tables: Tables) -> tuple[float, int]:
    """The score and tie of rank k among ``scores`` (score, tie), by score from the greatest and tie from the least: by histograms that narrow to one bin, first of scores, then of
    the ties of one score, until few rows are left. At most _BINS rows reach the driver at once."""
    low, high, above = *scores.agg(F.min("score"), F.max("score")).first(), 0
    rows, n = scores, scores.count()

    def ranked():
        few = sorted((-score, x) for score, x in rows.collect())  # at most _BINS
        return -few[k - above - 1][0], few[k - above - 1][1]

    def narrowed(bin_of: Column, descending: bool):
        counts = dict(rows.groupBy(bin_of.alias("b")).count().collect())  # at most _BINS rows, or as many scores as lie within some ulps
        passed = above
        for b in sorted(counts, reverse=descending):
            if passed + counts[b] >= k:
                return b, passed, counts[b]
            passed += counts[b]

    while n > _BINS and low < high:
        width = (high - low) / _BINS
        apart = width > 0 and low + width > low
        bin_of = F.least(F.floor((F.col("score") - low) / width), F.lit(_BINS - 1)).cast("int") if apart else F.col("score")
        b, above, n = narrowed(bin_of, True)
        rows = tables.put(rows.where(bin_of == b))
        low, high = rows.agg(F.min("score"), F.max("score")).first()
    for shift in range(52, -1, -13):
        if n <= _BINS:
            break
        bin_of = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), shift).bitwiseAND((1 << 13) - 1)
        b, above, n = narrowed(bin_of, False)
        rows = tables.put(rows.where(bin_of == b))
    return ranked() if n <= _BINS else tuple(rows.select("score", "tie").first())


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, standard: float | None = None, label: str = "quality") -> DataFrame:
    """Rows (doc_id, log_weight, score, kept) for ``docs`` (doc_id, text), given ``labels`` (doc_id, quality, toxic).

    Kept are the k = round(share * rows) rows of the largest scores, ties by a hash of the id, which may be null or of any type; by default the share of good ones (quality 1, toxic 0) among the
    labelled. Rows alike in id and score are kept alike, so there may be a few more than k. Null and empty texts are rows like any other; texts of any length are read whole. Without a
    good label all weights are equal and the noise decides. An empty table gives an empty table.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, label)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality = 1 and coalesce(toxic, 0) = 0")).alias("good"))
    marks = tables.put(marks)
    if share is None:
        share = marks.agg(F.avg(F.col("good").cast("double"))).first()[0] or 0.0
    marked = docs.join(small(marks.where("good")), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    raw, target = count_features(marked)
    ratio, mean = log_ratios(raw, target) if target.sum() else (np.zeros(BUCKETS), 0.0)
    weight = log_weights(F.col("text"), spark.sparkContext.broadcast(ratio), mean, standard)
    scored = docs.select("doc_id", weight.alias("log_weight")).select("doc_id", "log_weight", (F.col("log_weight") + gumbel(F.col("doc_id"))).alias("score"))
    scored = tables.put(scored)
    n = scored.count()
    k = round(share * n)
    if k <= 0 or k >= n:
        return scored.withColumn("kept", F.lit(k > 0))
    edge, last = kth_largest(scored.select("score", tie(F.col("doc_id")).alias("tie")), k, tables)
    return scored.withColumn("kept", (F.col("score") > edge) | ((F.col("score") == edge) & (tie(F.col("doc_id")) <= last)))


def op4_importance_resample(spark, sf_dir: str) -> DataFrame:
    docs = named(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    labels = named(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", quality="quality", toxic="toxic")
    return resample(docs, labels, standard=STANDARD)
