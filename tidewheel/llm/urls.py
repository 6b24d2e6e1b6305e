"""URL filters by a Bloom filter cascade.

The listed keys (rules and blocked sites) are encoded by a first Bloom filter. Asked about every key that the corpus can ask about, its key
universe, it also lets some unlisted keys pass: these go into a second filter; listed keys that pass that one go into a third, and so on
until no key is left in error. On the universe the cascade then answers exactly, with a few bits a listed key, and
pages are judged without a join. The first filter's error rate follows the ratio of listed to unlisted keys, so that the
filters' size follows the list and not the corpus; lists are cut into slices by hash, so that no slice's filters exceed a bound, and pages meet one slice after another.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import Tables, arrow_udf, lower_ascii, named

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Sites that the method blocks where no rule fits: the host or a parent of it is listed.
BLOCKED_SITES = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Listed keys of a slice, about: its filters take 8 bytes a key at most, 32 MB.
SLICE_KEYS = 4 << 20
BITMAP_BITS = 32_768  # of Spark's bitmap functions

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def positions(key: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """Bits of each key (64-bit hashes) in a level's filter, one row a hash."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a = _mixed(key.astype(np.int64).view(np.uint64) + salt)
    b = _mixed(a + salt) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)])


class Cascade:
    """levels: (bits as bytes, number of bits, number of hashes)."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def passes(self, key: np.ndarray, level: int) -> np.ndarray:
        bits, size, hashes = self.levels[level]
        at = positions(key, level, hashes, size)
        return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def member(self, key: np.ndarray) -> np.ndarray:
        """Exact for the keys of the universe; others get an answer that may be wrong."""
        out = np.full(len(key), len(self.levels) % 2 == 1)
        alive = np.arange(len(key))
        for level in range(len(self.levels)):
            passed = self.passes(key[alive], level)
            out[alive[~passed]] = level % 2 == 1
            alive = alive[passed]
        return out


def _bits_udf(level: int, hashes: int, bits: int):
    def at(keys):
        import pyarrow as pa

        flat = positions(keys.to_numpy(zero_copy_only=False), level, hashes, bits).T.ravel().astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, hashes), type=pa.int32()), pa.array(flat))

    return arrow_udf(at, "array<bigint>")


def _passes_udf(cascade, level: int):
    def passing(keys):
        import pyarrow as pa

        return pa.array(cascade.value.passes(keys.to_numpy(zero_copy_only=False), level))

    return arrow_udf(passing, "boolean")


def build_cascade(universe: DataFrame, tables: Tables) -> Cascade:
    """A cascade for ``universe`` (key_hash long, listed boolean), distinct keys.

    Keys in error halve from level to level; only those are kept for the next one. Two keys with one 64-bit hash, one
    listed and one not, could not be told apart: that raises an error rather than misjudge.
    """
    spark, cascade, level = universe.sparkSession, Cascade(), 0
    sizes = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    twins = universe.groupBy("key_hash").agg(F.max("listed").alias("a"), F.min("listed").alias("b")).where("a <> b").limit(1).count()
    if twins:
        raise ValueError("a listed and an unlisted key share a hash")
    inside, outside = universe.where("listed").select("key_hash"), universe.where("not listed").select("key_hash")
    n_in, n_out = sizes
    if n_in == 0:
        return cascade  # no levels: nothing is listed
    while True:  # keys in error halve, and each level hashes anew
        rate = min(0.5, max(1e-9, n_in / n_out / math.sqrt(2))) if level == 0 and n_out else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, -(-math.ceil(n_in * hashes * 1.4427) // 8) * 8)
        spread = inside.select(F.explode(_bits_udf(level, hashes, bits)("key_hash")).alias("bit"))
        maps = (
            spread.groupBy(F.floor(F.col("bit") / BITMAP_BITS).cast("long").alias("at"))
            .agg(F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("map"))
            .collect()  # 8 bytes a listed key of the slice at most, in maps of 4 KB
        )
        filled = np.zeros(-(-bits // BITMAP_BITS) * BITMAP_BITS // 8, dtype=np.uint8)
        for r in maps:
            filled[r["at"] * BITMAP_BITS // 8 : (r["at"] + 1) * BITMAP_BITS // 8] = np.frombuffer(r["map"], dtype=np.uint8)
        cascade.levels.append((filled[: bits // 8], bits, hashes))
        one = spark.sparkContext.broadcast(cascade)

        errors = tables.put(outside.where(_passes_udf(one, level)("key_hash")))
        n_err = errors.count()
        if n_err == 0:
            return cascade
        inside, outside, n_in, n_out, level = errors, inside, n_err, n_in, level + 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased, and the path. Both empty for null and for urls without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1))
    after = F.substring_index(after, "?", 1)
    host = F.translate(F.substring_index(after, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substring(after, F.length(F.substring_index(after, "/", 1)) + 1, F.length(after))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listing(spark, rules=RULES, sites=BLOCKED_SITES) -> DataFrame:
    """A list for ``judge`` from rules (host and path, verdict) and blocked sites (hosts)."""
    return spark.createDataFrame([*rules, *((s, "block") for s in sites)], "entry string, verdict string")


def judge(pages: DataFrame, listed: DataFrame, label: str = "urls") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for ``pages`` (page_id, url), given ``listed`` (entry, verdict: allow or block), a table of any size.

    An entry with a slash is a rule, host and path; one without is a blocked site. A rule or site fits its host and all subdomains; a rule also needs the path to begin with its own. The longest
    rule wins; where none fits the page is blocked if a site fits, else allowed. A rule both allowed and blocked is blocked. Hosts are cut at
    dots, so empty labels count as labels. Null and very long urls, repeated rows and entries are allowed; an empty table gives an empty table, an empty list allows all.
    """
    spark, tables = pages.sparkSession, Tables(pages.sparkSession, label)
    entry = F.concat(lower_ascii(F.substring_index("entry", "/", 1)), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)"))
    listed = listed.where("entry is not null").select(entry.alias("key"), (F.col("verdict") == "block").alias("blocks"))
    listed = tables.put(listed.groupBy("key").agg(F.max("blocks").alias("blocks")).where("blocks or instr(key, '/') > 0"))
    shape = listed.select(F.length("key") - F.length(F.substring_index("key", "/", 1)), F.size(F.split(F.substring_index("key", "/", 1), r"\.")))
    shape = [tuple(r) for r in shape.distinct().collect()]  # lengths of paths times numbers of labels
    lengths, labels = sorted({n for n, _ in shape if n}), max([k for _, k in shape], default=1)

    page = tables.put(pages.select("page_id", *[c.alias(n) for n, c in zip(("host", "path"), host_and_path(F.col("url")))]))

    def keys(host: Column, path: Column) -> Column:
        parts = F.split(host, r"\.")
        first = F.greatest(F.lit(1), F.size(parts) - labels + 1)
        ends = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        ends = F.when(host == "", F.array().cast("array<string>")).otherwise(ends)
        cuts = F.filter(F.array(F.lit(0), *[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
        return F.flatten(F.transform(ends, lambda e: F.transform(cuts, lambda n: F.concat(e, F.substring(path, F.lit(1), n)))))

    asked = page.groupBy("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).agg(F.lit(1))
    universe = asked.select(F.explode(keys(F.col("host"), F.col("path"))).alias("key")).groupBy("key").agg(F.lit(1))
    known = universe.join(listed, "key", "left").select(F.xxhash64("key").alias("key_hash"), "blocks")
    known = tables.put(known)
    slices = max(1, -(-known.where("blocks is not null").count() // SLICE_KEYS))
    told = page.withColumn("__keys", keys(F.col("host"), F.col("path")))
    told = told.withColumn("__hash", F.transform("__keys", lambda k: F.xxhash64(k))).withColumn("__found", F.transform("__keys", lambda k: F.lit(0)))
    for piece in range(slices):
        one = known.where(F.pmod("key_hash", F.lit(slices)) == piece)
        cascades = [build_cascade(tables.put(one.select("key_hash", F.coalesce(listed_as, F.lit(False)).alias("listed"))), tables) for listed_as in (~F.col("blocks"), F.col("blocks"))]
        both = spark.sparkContext.broadcast((piece, slices, cascades))
        told = told.withColumn("__found", F.zip_with("__found", _verdicts(both)("__hash"), lambda a, b: F.greatest(a, b)))
        if piece + 1 < slices:
            told = tables.put(told)
            both.destroy()
    hits = F.filter(F.arrays_zip("__keys", "__found"), lambda x: x["__found"] > 0)
    told = told.withColumn("__hits", F.transform(hits, lambda x: F.struct(F.length(x["__keys"]).alias("n"), x["__keys"].alias("key"), x["__found"].alias("found"))))
    told = told.withColumn("__rule", F.array_max(F.filter("__hits", lambda x: F.instr(x["key"], "/") > 0)))
    site = F.exists("__hits", lambda x: (F.instr(x["key"], "/") == 0) & (x["found"] == 2))
    verdict = F.when(F.col("__rule").isNotNull(), F.when(F.col("__rule.found") == 1, "allow").otherwise("block")).otherwise(F.when(site, "block").otherwise("allow"))
    return told.select("page_id", "host", "path", F.col("__rule.key").alias("rule"), verdict.alias("verdict"))


def _verdicts(cascades):
    """For each list of hashes: 0 unlisted or of another slice, 1 allowed, 2 blocked."""

    def run(asked):
        import pyarrow as pa

        piece, slices, (allow, block) = cascades.value
        flat = asked.flatten().to_numpy(zero_copy_only=False)
        found = np.where(block.member(flat), 2, np.where(allow.member(flat), 1, 0)).astype(np.int32)
        found[flat % slices != piece] = 0
        offsets = asked.offsets.to_numpy() - asked.offsets.to_numpy()[0]
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(found))

    return arrow_udf(run, "array<int>").asNondeterministic()


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(named(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="page_id", url="url"), listing(spark))


_FITS = "(host = '{h}' OR ends_with(host, '.{h}'))"
_SQL_RULES = " UNION ALL ".join(
    f"SELECT page_id, '{r}' AS rule, '{v}' AS verdict FROM p WHERE {_FITS.format(h=r.partition('/')[0])} AND starts_with(path, '/{r.partition('/')[2]}')" for r, v in RULES
)
OP3_SQL = f"""
WITH c AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS after FROM pages),
p AS (SELECT page_id, translate(regexp_extract(after, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(substr(after, length(regexp_extract(after, '^[^/]*')) + 1), '') AS path FROM c),
r AS ({_SQL_RULES}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM r GROUP BY page_id)
SELECT p.page_id, coalesce(p.host, '') AS host, p.path, best.rule,
       coalesce(best.verdict, CASE WHEN {' OR '.join(_FITS.format(h=s) for s in BLOCKED_SITES)} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""
