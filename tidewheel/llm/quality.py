"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words become numbers; the hashes of all n-grams of a length come from those of the length before by one multiplication and
addition (a rolling hash over numpy arrays); equal hashes mark the words they cover, and the characters of
covered words are measured against the text's. Everything about a text is in its row: no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, named, per_text

#: Most of a text's characters that duplicated n-grams of each length may cover.
MAX_COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of a text's lines, and of its characters, that may be in repeated lines.
MAX_DUP_LINES, MAX_DUP_LINE_CHARS = 0.30, 0.20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "n_lines bigint, dup_line_chars bigint, dup_ngram_chars array<bigint>"
)
_word = re.compile(WORD).findall
_BLANK = " \t\n\x0b\x0c\r"
_MULTIPLIER, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _twice(keys: np.ndarray) -> np.ndarray | None:
    """Which keys occur more than once; None if none does."""
    line = np.sort(keys)
    if not (line[1:] == line[:-1]).any():
        return None
    order = np.argsort(keys, kind="stable")
    line = keys[order]
    same = line[1:] == line[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """The words inside the n-word windows that start where ``starts`` is true."""
    edge = np.zeros(words + 1, dtype=np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1  # starts are distinct, and so are ends
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The fields of one text. A null or empty text has no words and fails by base."""
    text = text or ""
    words = _word(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _BLANK))
    n_symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set[str] = set()
    n_lines = n_dup = dup_chars = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            n_lines += 1
            if line in seen:
                n_dup += 1
                dup_chars += len(line) - sum(map(line.count, _BLANK))
            else:
                seen.add(line)
    numbers: dict[str, int] = {}
    number = numbers.setdefault
    ids = np.fromiter((number(w, len(numbers)) for w in words), np.uint64, n)
    repeat_words = 0
    if n > 3:
        if len(numbers) < 1 << 21:  # three numbers fit in 64 bits: exact
            base = np.uint64(len(numbers))
            keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
        else:
            keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        if (again := _twice(keys)) is not None:
            repeat_words = int(_covered(again, 3, n).sum())
    coverage = [0] * len(MAX_COVERAGE)
    if repeat_words:  # else no longer window occurs twice either
        spread = (ids + np.uint64(1)) * _SPREAD
        spread ^= spread >> np.uint64(29)
        lengths = np.fromiter(map(len, words), np.int64, n)
        rolled, length = spread, 1
        for k, size in enumerate(MAX_COVERAGE):
            while length < size and len(rolled) > 1:
                rolled = rolled[:-1] * _MULTIPLIER + spread[length:]
                length += 1
            if length < size or (again := _twice(rolled)) is None:
                break
            coverage[k] = int(lengths[_covered(again, size, n)].sum())
    failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    kept = not failed and n_dup <= MAX_DUP_LINES * n_lines and dup_chars <= MAX_DUP_LINE_CHARS * word_chars
    kept = kept and all(c <= most * word_chars for c, most in zip(coverage, MAX_COVERAGE.values()))
    return n, word_chars, n_symbols, n_dup, repeat_words, failed, kept, n_lines, dup_chars, coverage


def quality(text: Column) -> Column:
    """The measures and the verdict of each text, as a struct. A null text is an empty one: no words, so it fails by base. Texts of any length are read whole; repeated rows are judged alike; there
    are no ties; other columns do not count, and an empty table gives an empty table."""
    return per_text(lambda texts: map(measure, texts), FIELDS)(text)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. Repeated rows are judged alike."""
    return docs.withColumn("__quality", quality(F.col("text"))).where("__quality.kept").drop("__quality")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = named(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    told = docs.select("doc_id", quality(F.col("text")).alias("q")).select("doc_id", "q.*")
    return told.withColumn("dup_ngram_chars", F.array_join(F.col("dup_ngram_chars").cast("array<string>"), ","))


def _covered_sql(n: int) -> str:
    """Words and characters inside n-word windows that a text has more than once."""
    grams = f"list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return (
        f"c{n} AS (SELECT doc_id, count(*) FILTER (inside) AS words, sum(length(w)) FILTER (inside) AS chars FROM ("
        f"SELECT doc_id, w, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM ("
        f"SELECT doc_id, i, w, len(g) = {n} AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM (SELECT doc_id, i, w, {grams} AS g FROM w))) GROUP BY 1)"
    )


_SIZES = (3, *MAX_COVERAGE)
_WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest({_WORDS_SQL}) AS w, generate_subscripts({_WORDS_SQL}, 1) AS i FROM d),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY 1),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (dup), 0) AS dup_line_chars FROM l GROUP BY 1),
{", ".join(_covered_sql(n) for n in _SIZES)},
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(c3.words, 0)::BIGINT AS n_repeat_words,
             {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS x{n}" for n in MAX_COVERAGE)}
      FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _SIZES)}),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, dup_line_chars,
       concat_ws(',', {", ".join(f"x{n}" for n in MAX_COVERAGE)}) AS dup_ngram_chars,
       NOT base_failed AND n_dup_lines <= {MAX_DUP_LINES}::DOUBLE * n_lines AND dup_line_chars <= {MAX_DUP_LINE_CHARS}::DOUBLE * word_chars
       {" ".join(f"AND x{n} <= {most}::DOUBLE * word_chars" for n, most in MAX_COVERAGE.items())} AS kept
FROM f
"""
