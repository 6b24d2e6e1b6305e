"""Benchmark decontamination by suffix arrays of the training text.

Each batch of documents is a shard. Its words become numbers of the benchmark's vocabulary (0: a word the benchmark does not
have, which ends any match), and the suffixes that a test window could match are sorted: the shard's suffix array. Every
suffix of the test items, cut to a window, is found in it by binary search; neighbouring hits join to longest verbatim matches
with their places and items. The benchmark is broadcast in parts of a checked size; documents never leave their rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import Tables, lower, named, per_text

WINDOW = 10
#: Bytes of benchmark text whose windows are broadcast at once (some 20 bytes for each). Larger benchmarks are cut into parts, one pass each.
MAX_BENCHMARK = 8 << 20
#: Words of documents in one suffix array, about.
SHARD_WORDS = 1 << 21

FIELDS = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "longest_words bigint, longest_start bigint, longest_item string, items array<string>, edges array<bigint>"
)
_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: str | None) -> list[str]:
    return _word(lower(text)) if text else []


class Windows:
    """The distinct windows of the test items as sorted keys, with the items and offsets where each occurs: arrays of 100 bytes a word, about."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window, self.vocabulary = window, {}
        number = self.vocabulary.setdefault
        self.items = sorted({item for item, _ in items})
        index = {item: k for k, item in enumerate(self.items)}
        rows, of, offset = [], [], []
        for item, words in items:
            ids = np.fromiter((number(w, len(self.vocabulary) + 1) for w in words), np.uint32, len(words))
            if len(ids):
                line = np.zeros(max(len(ids), window), dtype=np.uint32)
                line[: len(ids)] = ids
                rows.append(np.lib.stride_tricks.sliding_window_view(line, window))
                of.append(np.full(len(rows[-1]), index[item], dtype=np.int32))
                offset.append(np.arange(len(rows[-1]), dtype=np.int32))
        keys = self._packed(np.concatenate(rows)) if rows else np.zeros(0, dtype=f"S{4 * window}")
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else order
        #: Places of window k: item and offset at starts[k] up to starts[k + 1].
        self.item, self.offset = (np.concatenate(x)[order] if rows else order for x in (of, offset))
        self.starts = np.append(first, len(keys))
        self.low = keys[order][first]
        numbers = np.frombuffer(self.low.tobytes(), dtype=">u4").reshape(-1, window)
        self.lengths = (numbers != 0).sum(axis=1)
        self.least = int(self.lengths.min()) if len(first) else 0
        self.high = self._packed(np.where(numbers == 0, 0xFFFFFFFF, numbers))

    def _packed(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows, dtype=">u4").view(f"S{4 * self.window}").ravel()

    def search(self, texts: list[str | None]):
        """Rows of FIELDS for the texts, shard by shard."""
        shard, size = [], 0
        for t in texts:
            words = words_of(t)
            shard.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint32, len(words)))
            size += len(words)
            if size >= SHARD_WORDS:
                yield from self._shard(shard)
                shard, size = [], 0
        yield from self._shard(shard)

    def _hits(self, docs: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the shard) of every occurrence, by the shard's suffix array."""
        w, gap = self.window, np.zeros(self.window, dtype=np.uint32)
        none = np.zeros(0, dtype=np.int64)
        if not len(self.low) or not docs:
            return none, none
        text = np.concatenate([x for d in docs for x in (d, gap)])
        ends = np.where(text == 0, np.arange(len(text)), len(text))
        runs = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(text))
        places = np.flatnonzero(runs >= self.least)
        if not len(places):
            return none, none
        array = self._packed(np.lib.stride_tricks.sliding_window_view(text, w)[places])
        order = np.argsort(array, kind="stable")
        array, places = array[order], places[order]
        low, high = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        k = np.flatnonzero(high > low)
        return np.repeat(k, (high - low)[k]), places[_ranges(low[k], high[k])]

    def _shard(self, docs: list[np.ndarray]):
        w = self.window
        counts = np.array([len(d) for d in docs], dtype=np.int64)
        starts = np.cumsum(counts + w) - counts - w
        k, at = self._hits(docs, starts)
        hit = np.zeros(int((counts + w).sum()) + 1, dtype=np.int64)
        np.add.at(hit, at, 1)
        np.subtract.at(hit, at + self.lengths[k], 1)
        inside = np.cumsum(hit[:-1]) > 0
        found, longest = self._matches(k, at, np.searchsorted(starts, at, "right") - 1)
        for d, n in enumerate(counts.tolist()):
            covered = inside[starts[d] : starts[d] + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
            items = [self.items[i] for i in found.get(d, ())]
            size, start, item = longest.get(d, (0, 0, 0))
            told = (size, int(start - starts[d]), self.items[item]) if size else (0, None, None)
            n_hit = int(covered.sum())
            yield n, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, *told, items, edges.tolist()

    def _matches(self, k: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[dict, dict]:
        """Items of each document in order, and its longest verbatim match: (words, place, item), the first of the longest, of the greatest item."""
        each = (self.starts[k + 1] - self.starts[k]) if len(k) else k
        line, place = np.repeat(np.arange(len(k)), each), _ranges(self.starts[k], self.starts[k + 1]) if len(k) else k
        item, p, d, n = self.item[place], at[line], doc[line], self.lengths[k[line]]
        diagonal = p - self.offset[place]
        whole = n == self.window
        order = np.lexsort((p, diagonal, item, d, whole))
        item, p, d, n, diagonal, whole = (x[order] for x in (item, p, d, n, diagonal, whole))
        if not len(p):
            return {}, {}
        # Whole windows at neighbouring places on one diagonal are one match.
        joined = whole[1:] & whole[:-1] & (d[1:] == d[:-1]) & (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1]) & (p[1:] == p[:-1] + 1)
        first = np.flatnonzero(np.append(True, ~joined))
        size = np.diff(np.append(first, len(p))) - 1 + n[first]
        best = np.lexsort((-item[first], p[first], -size, d[first]))
        best = best[np.flatnonzero(np.append(True, np.diff(d[first][best]) != 0))]
        longest = {int(x): (int(s), int(b), int(i)) for x, s, b, i in zip(d[first][best], size[best], p[first][best], item[first][best])}
        found: dict[int, list[int]] = {}
        for x, i in np.unique(np.stack([d, item], axis=1), axis=0).tolist():
            found.setdefault(x, []).append(i)
        return found, longest


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low to high - 1 of each pair, in a row."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of MAX_BENCHMARK bytes, about, rows that share an item_id in one."""
    rows = named(benchmark, item_id="item_id", text="text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // MAX_BENCHMARK)
    return [rows] if n <= 1 else [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def _windows(part: DataFrame, window: int):
    rows = part.collect()  # MAX_BENCHMARK bytes, about
    items = [("null" if r[0] is None else str(r[0]), words_of(r[1])) for r in rows]
    return part.sparkSession.sparkContext.broadcast(Windows(sorted(items), window))


def _joined(parts: Column) -> Column:
    """One struct of FIELDS from those of all parts of the benchmark."""

    def rows(found):
        for parts in found:
            items = sorted({i for p in parts for i in p["items"]})
            n_hit, end, spans = 0, -1, []
            for a, b in sorted(x for p in parts for x in zip(p["edges"][::2], p["edges"][1::2])):
                if b > end:
                    n_hit += b - max(a, end)
                    if spans and a <= spans[-1]:
                        spans[-1] = b
                    else:
                        spans += [a, b]
                    end = b
            best = [(p["longest_words"], -p["longest_start"], p["longest_item"]) for p in parts if p["longest_words"]]
            size, start, item = max(best) if best else (0, None, None)
            start = None if start is None else -start
            yield parts[0]["n_words"], n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, size, start, item, items, spans

    return per_text(rows, FIELDS)(parts)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, label: str = "decontaminate") -> DataFrame:
    """``docs`` (text, and others) with a struct __match of FIELDS: matches of each text with the benchmark (item_id, text).

    Items without words match nothing; items of fewer words than a window are one window. A null item_id counts as the id ``null``; rows that share an id are one item. A null or empty text
    has no words; repeated rows are judged alike; a text of any length is searched whole. Of two longest matches the first counts, then that of the greater item. An empty
    table gives an empty table, an empty benchmark no match.

    A benchmark of more than MAX_BENCHMARK bytes is searched part by part: the texts with a match are written with a digest of the text, and joined by it.
    """
    parts = _parts(benchmark)
    if len(parts) == 1:
        windows = _windows(parts[0], window)
        return docs.withColumn("__match", per_text(lambda texts: windows.value.search(texts), FIELDS)(F.col("text")))
    tables, found = Tables(docs.sparkSession, label), None
    for part in parts:
        windows = _windows(part, window)
        told = docs.select("text", per_text(lambda texts, w=windows: w.value.search(texts), FIELDS)(F.col("text")).alias("m")).where("m.contaminated")
        told = tables.put(told.select(F.sha2("text", 256).alias("__digest"), "m").dropDuplicates(["__digest"]))
        windows.destroy()
        found = told if found is None else found.union(told)
    found = found.groupBy("__digest").agg(_joined(F.collect_list("m")).alias("__found"))  # one row a part
    none = _windows(parts[0].limit(0), window)
    out = docs.withColumn("__digest", F.sha2("text", 256)).join(found, "__digest", "left").drop("__digest")
    plain = per_text(lambda texts: none.value.search(texts), FIELDS)(F.col("text"))
    return out.withColumn("__match", F.coalesce("__found", plain)).drop("__found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    return matched(docs, benchmark, window).where("not __match.contaminated").drop("__match")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = named(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    found = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "__match.*").drop("items", "edges")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, least(len(ws), 10) AS n, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS pos, ws
      FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, n, pos, array_to_string(ws[pos:pos + n - 1], ' ') AS g FROM b),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, n, item, pos FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY 1),
r AS (SELECT doc_id, item, min(i) AS start, n + count(*) - 1 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - pos, n ORDER BY i) AS run FROM m WHERE n = 10) GROUP BY doc_id, item, i - pos, n, run
      UNION ALL SELECT doc_id, item, i, n FROM m WHERE n < 10),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start, item DESC) AS nth FROM r) WHERE nth = 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(l.size, 0)::BIGINT AS longest_words, (l.start - 1)::BIGINT AS longest_start, l.item AS longest_item
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)
"""
