"""Language of pages by Bayesian evidence fusion.

Text gives likelihoods by a model of character trigrams, fitted on labelled documents. The declared markup language is evidence as far as
declarations were seen to agree with texts. Priors form a hierarchy: all pages, the address suffix, the host; each level's counts are sums
of first posteriors over its pages (one grouped aggregation) and are smoothed by the level above. A page's own share is taken out of the
counts before they serve as its prior. Everything is multiplied and normalised.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import Tables, named, per_text
from tidewheel.llm.urls import host_and_path

BUCKETS = 1 << 15
#: Labelled documents that the text model is fitted on, about (a hash of the id selects them); all are used if there are no more.
FIT_ROWS = 20_000
#: Trigrams of a text count as so many independent ones at most.
EVIDENCE = 60.0
#: Pages that a level's prior from above counts as.
STRENGTH_SUFFIX, STRENGTH_HOST = 50.0, 10.0
KEPT_AT = 0.65

_hidden = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_tag = re.compile(r"<[^>]*>")
_html = re.compile(r"<html\b[^>]*", re.I)
_lang = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)  # xml:lang too


def page_text(page: str) -> str:
    return entities.unescape(_tag.sub(" ", _hidden.sub(" ", page)))


def declared(page: str) -> str:
    """The markup's language, lower-cased and without its region; empty if there is none."""
    for tag in _html.finditer(page):
        if found := _lang.search(tag[0]):
            return found[1].lower()
    return ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of letters, other characters as one blank."""
    points = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    x = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    return ((x ^ (x >> np.uint64(15))) % np.uint64(BUCKETS)).astype(np.int64)


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket, from ``labelled`` (text, lang). Bounded by languages times BUCKETS on the driver."""

    def partial(batches):
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64)).__iadd__(np.bincount(trigrams(text), minlength=BUCKETS))
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "at", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(partial, "lang string, at int, n bigint")
    sums = rows.groupBy("lang", "at").agg(F.sum("n")).collect()
    langs = sorted({r[0] for r in sums})
    table = np.full((len(langs), BUCKETS), 0.5)
    for lang, at, n in sums:
        table[langs.index(lang), at] += n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def evidence(page: Column, model) -> Column:
    """A struct of the declared language and the text's log likelihoods by language (log_like), less their maximum."""

    def rows(pages):
        _, table = model.value
        for p in pages:
            p = p or ""
            t = trigrams(page_text(p))
            like = table[:, t].sum(axis=1) * min(1.0, EVIDENCE / max(len(t), 1))
            yield declared(p), (like - like.max()).tolist()

    return per_text(rows, "declared string, log_like array<double>")(page)


def _softmax(logs: Column) -> Column:
    """Of an array of doubles whose greatest is not far from 0."""
    top = F.array_max(logs)
    up = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(up, F.lit(0.0), lambda a, x: a + x)
    return F.transform(up, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("first")[i]) for i in range(n)]).alias(name))


def identify(pages: DataFrame, labelled: DataFrame, label: str = "language") -> DataFrame:
    """Rows (page_id, host, declared, text_lang, lang, confidence, kept) for ``pages`` (page_id, url, html), given ``labelled`` (doc_id, text, lang).

    Null pages have no text and no declaration, null urls the empty host: their priors decide. A declared language that the model does not know is
    no evidence. Pages of any length are read whole, repeated rows judged alike, and of equal languages the first by name counts. kept: the confidence is KEPT_AT or more. Without labelled text lang is null and nothing is kept. An empty table gives an empty table.
    """
    spark, tables = pages.sparkSession, Tables(pages.sparkSession, label)
    n = labelled.count()
    chosen = labelled if n <= FIT_ROWS else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * FIT_ROWS / n))
    langs, table = fit(chosen)
    host, _ = host_and_path(F.col("url"))
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", host.alias("host"), none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    model, k = spark.sparkContext.broadcast((langs, table)), len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    told = pages.select("page_id", host.alias("host"), evidence(F.col("html"), model).alias("e")).select("page_id", "host", "e.*")
    told = told.withColumn("declared", F.when(F.col("declared").isin(*langs), F.col("declared")))
    told = tables.put(told.withColumns({"suffix": F.substring_index("host", ".", -1), "first": _softmax(F.col("log_like"))}))

    # How declarations agree with texts: P(declared | language), smoothed; and the prior of all pages. At most k * (k + 1) numbers.
    counts = {r[0]: r[1] for r in _sums(told, ["declared"], k, "c").collect()}
    all_pages = sum((np.array(c) for c in counts.values()), np.zeros(k))
    top = (all_pages + 1) / (all_pages.sum() + k)
    speaks = {d: np.log((np.array(counts.get(d, [0.0] * k)) + 1) / (all_pages + k + 1)) for d in langs}
    said = F.create_map(*[x for d in langs for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in speaks[d]]))])
    flat = F.array(*[F.lit(0.0)] * k)

    hosts = tables.put(_sums(told, ["suffix", "host"], k, "at_host"))
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.col("at_host")[i]) for i in range(k)]).alias("at_suffix"))
    levels = tables.put(hosts.join(suffixes, "suffix").select("host", "at_host", "at_suffix"))

    def smoothed(counts: Column, above: Column, strength: float) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda c, p: (F.greatest(c, F.lit(0.0)) + strength * p) / (total + strength))

    less = lambda c: F.zip_with(c, "first", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    met = told.join(levels, "host")
    met = met.withColumn("prior", smoothed(less(F.col("at_suffix")), F.array(*[F.lit(float(x)) for x in top]), STRENGTH_SUFFIX))
    met = met.withColumn("prior", smoothed(less(F.col("at_host")), F.col("prior"), STRENGTH_HOST))
    logs = F.zip_with(F.zip_with("log_like", F.transform("prior", lambda p: F.log(p + 1e-12)), lambda a, b: a + b), F.coalesce(said[F.col("declared")], flat), lambda a, b: a + b)
    met = met.withColumn("post", _softmax(logs))
    best = F.array_max("post")
    lang = names[F.array_position("post", best).cast("int") - 1]
    text_lang = names[F.array_position("first", F.array_max("first")).cast("int") - 1]
    return met.select("page_id", "host", "declared", text_lang.alias("text_lang"), lang.alias("lang"), F.round(best, 9).alias("confidence"), (best >= KEPT_AT).alias("kept"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    pages = named(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="page_id", url="url", html="html")
    return identify(pages, named(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text", lang="lang"))
