"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into m partitions, correlated bits together, and partition i gets a threshold t_i of its own, with the sum
of all t_i equal to tau - m + 1: two fingerprints that differ in tau bits or fewer then differ in t_i bits or fewer in
some partition (t_i = -1 leaves a partition out). Statistics of all fingerprints give the expected number of candidates for each
partition and threshold, and dynamic programming picks the thresholds, and m, of least cost. Fingerprints meet in buckets
(partition, value): t = 0 in their own, t = 1 where one of them reaches the other's value by one flip, t = 2 halfway, each by one flip.
Those that meet are verified.

Fingerprints that share their value in a partition with many others are a crowd, whose members are not paired with each other in buckets. For tau of 2
or less, two fingerprints within tau share a point within one bit of both; so the crowd meets at its 65 points, where at most 65 fingerprints
can be, and is linked in a star there: exact, and linear in the members. For greater tau the members meet within the values of tau + 1 partitions by leaders (see ``settled``).

64 bits miss most pairs of similarity 0.8, so near-duplicates also take candidates from bands of min-hashes: texts that share a band meet by leaders too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, Tables, components, lower, named, per_text, small

BITS = 64
SEED = 42
#: More fingerprints than this that share their value in a partition are a crowd.
HOT = 8
#: Leaders of a key that a round compares with all its members, and members that one task takes, about.
FEW, BLOCK = 256, 4_096
#: Bands of min-hashes, and min-hashes a band: texts of similarity s share a band with chance 1 - (1 - s ** ROWS) ** BANDS, 0.998 at 0.8.
BANDS, ROWS = 16, 5

_word = re.compile(WORD).findall


def shingles(text: str | None, n: int) -> tuple[list[str], list[str]]:
    """Words of the lower-cased text, and its n-word shingles: the whole sequence if it has fewer words, none if it has none."""
    words = _word(lower(text)) if text else []
    if len(words) <= n:
        return words, [" ".join(words)] if words else []
    return words, [" ".join(s) for s in zip(*(words[i:] for i in range(n)))]


def fingerprint(parts: list[str]) -> int:
    """Bit b is set if over half of the parts' hashes have it set. As a signed 64-bit number; zero for no parts."""
    if not parts:
        return 0
    digest = xxhash.xxh64_digest
    bits = np.unpackbits(np.frombuffer(b"".join([digest(s, SEED) for s in parts]), dtype=np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big", signed=True)


def prints(text: Column, n: int) -> Column:
    """A struct of the fingerprint (fp) and a 64-bit hash of the word sequence (content)."""

    def rows(texts):
        for t in texts:
            words, parts = shingles(t, n)
            yield fingerprint(parts), xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)

    return per_text(rows, "fp bigint, content bigint")(text)


_rng = np.random.default_rng(SEED)
_flip, _odd = (_rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_odd = _odd | np.uint64(1)


def band_keys(parts: list[str]) -> list[int]:
    """A hash of the min-hashes of each band, as signed 64-bit numbers; no keys for no parts."""
    if not parts:
        return []
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in parts]), dtype=np.uint64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for begin in range(0, len(h), 4096):
        least = np.minimum(least, ((h[None, begin : begin + 4096] ^ _flip) * _odd).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def banded_prints(text: Column, n: int) -> Column:
    """``prints`` with the text's band keys (bands)."""

    def rows(texts):
        for t in texts:
            words, parts = shingles(t, n)
            yield fingerprint(parts), xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63), band_keys(parts)

    return per_text(rows, "fp bigint, content bigint, bands array<bigint>")(text)


# Planning: bit statistics, groups of bits, expected candidates, thresholds


@dataclass
class Plan:
    masks: list[int]
    thresholds: list[int]
    cost: float


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both set: 64 x 64 sums, added up on the executors."""

    def partial(batches):
        import pyarrow as pa

        n, both = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for b in batches:
            raw = b.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(np.frombuffer(raw.tobytes(), dtype=np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(raw)
        if n:
            at = [-1, *range(BITS * BITS)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([n, *both.ravel().tolist()], pa.int64())], names=["at", "n"])

    sums = {r[0]: r[1] for r in fps.select("fp").mapInArrow(partial, "at int, n bigint").groupBy("at").agg(F.sum("n")).collect()}
    return sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(BITS * BITS)], dtype=np.float64).reshape(BITS, BITS)


def grouped(share: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size: each starts with the bit that is most correlated with the rest and takes, one by one,
    the free bit most correlated with the one before."""
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    free, out = list(range(BITS)), []
    for k in range(m):
        group = [max(free, key=lambda b: (phi[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < BITS // m + (k < BITS % m):
            group.append(max(free, key=lambda b: (phi[group[-1], b], -b)))
            free.remove(group[-1])
        out.append(group)
    return out


def distances(share: np.ndarray, group: list[int]) -> np.ndarray:
    """The chance that two random fingerprints differ in 0, 1, 2, ... bits of the group, by a Markov chain along it."""
    p = np.diag(share)
    agree = p**2 + (1 - p) ** 2
    state = np.zeros((len(group) + 1, 2))  # differing bits so far; whether the last bit agrees (1) or not
    state[0, 1], state[1, 0] = agree[group[0]], 1 - agree[group[0]]
    for a, b in zip(group, group[1:]):
        p11 = share[a, b]
        both = p11**2 + (p[a] - p11) ** 2 + (p[b] - p11) ** 2 + (1 - p[a] - p[b] + p11) ** 2
        if_agree = min(1.0, both / max(agree[a], 1e-12))
        if_not = min(1.0, max(0.0, (agree[b] - both) / max(1 - agree[a], 1e-12)))
        new = np.zeros_like(state)
        new[:, 1] = state[:, 1] * if_agree + state[:, 0] * if_not
        new[1:, 0] = state[:-1, 1] * (1 - if_agree) + state[:-1, 0] * (1 - if_not)
        state = new
    return state.sum(axis=1)


def plan(n: int, both: np.ndarray, tau: int, most_parts: int = 10) -> Plan:
    """The groups and thresholds of least cost: bucket rows of a fingerprint, plus the candidates that it is expected to meet."""
    share, best = both / max(n, 1), None
    for m in range(2, most_parts + 1):
        groups, goal = grouped(share, m), tau - m + 1
        table = {0: (0.0, [])}  # sum of thresholds so far -> (cost, thresholds)
        for g in groups:
            near = np.cumsum(distances(share, g))
            rows = {-1: 0, 0: 1, 1: 2 + len(g), 2: 1 + len(g)}
            cost = {t: rows[t] + (n * near[min(t, len(g))] if t >= 0 else 0) for t in rows}
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t in rows:
                    if s + t not in new or c + cost[t] < new[s + t][0]:
                        new[s + t] = (c + cost[t], [*ts, t])
            table = new
        if goal in table and (best is None or table[goal][0] < best.cost):
            best = Plan([sum(1 << b for b in g) for g in groups], table[goal][1], table[goal][0])
    if best is None:
        raise ValueError(f"no thresholds up to 2 in {most_parts} partitions reach tau = {tau}")
    return best


# Probing and verifying


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bucket(part: int, base: Column, t: int):
    return lambda flip: F.struct(F.lit(part).alias("part"), base.bitwiseXOR(flip).alias("key"), (F.lit(t != 1) | (flip == 0)).alias("own"))


def _buckets(nodes: DataFrame, how: Plan) -> DataFrame:
    """Rows (part, key, own) with the columns of ``nodes``: every bucket of a node; own is false where only a probe reaches it."""
    rows = []
    for i, (mask, t) in enumerate(zip(how.masks, how.thresholds)):
        if t < 0:
            continue
        base, flips = F.col("fp").bitwiseAND(_signed(mask)), [_signed(1 << b) for b in range(BITS) if mask >> b & 1]
        flips = F.array(*[F.lit(f).cast("bigint") for f in ([0] if t == 0 else [0, *flips])])
        rows.append(F.transform(flips, _bucket(i, base, t)))
    return nodes.select("*", F.explode(F.concat(*rows)).alias("b")).select("b.*", *nodes.columns)


def _points(hot: DataFrame) -> DataFrame:
    """Star links of the nodes (id, fp) that share a point within one bit of both."""
    flips = F.array(*[F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)) for b in range(BITS)]])
    at = hot.select("id", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
    met = at.groupBy("point").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)  # 65 at most
    return met.select(F.explode("ids").alias("v"), F.array_min("ids").alias("u")).where("u <> v").select("u", "v")


class Prints:
    """Leaders' fingerprints, and which of them are within tau bits of another."""

    kind = "bigint"

    def __init__(self, tau: int):
        self.tau, self.fps = tau, []

    def add(self, fp: int) -> None:
        self.fps.append(fp)

    def match(self, fp: int, asked: list[int]) -> np.ndarray:
        return np.bitwise_count(np.array(self.fps, dtype=np.int64)[asked].view(np.uint64) ^ np.array([fp]).view(np.uint64)) <= self.tau


class Sets:
    """Leaders' sets of hashes, and which of them have a Jaccard similarity with another."""

    kind = "array<bigint>"

    def __init__(self, similarity: float):
        self.similarity, self.sets = similarity, []

    def add(self, parts: list[int]) -> None:
        self.sets.append(np.array(parts, dtype=np.int64))

    def match(self, parts: list[int], asked: list[int]) -> np.ndarray:
        own, sizes = np.array(parts, dtype=np.int64), np.array([len(self.sets[k]) for k in asked])
        # Sizes that differ by more can't have the similarity.
        fits = np.flatnonzero((sizes >= self.similarity * len(own) - 1e-9) & (self.similarity * sizes <= len(own) + 1e-9) & (sizes > 0))
        out = np.zeros(len(asked), dtype=bool)
        if len(fits) and len(own):
            flat, sizes = np.concatenate([self.sets[asked[k]] for k in fits]), sizes[fits]
            common = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(common.astype(np.int64), np.cumsum(sizes) - sizes)
            out[fits] = both >= self.similarity * (sizes + len(own) - both)
        return out


def _by_leaders(groups: DataFrame, items: DataFrame, matcher, parts: int) -> DataFrame:
    """Links (u, v) between the leaders and all others of ``groups`` (key, id, comp, leads) whose items match, except of those connected. Groups are dealt in blocks, each
    with all its leaders first; a task holds those of one block."""
    sizes = groups.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    block = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)  # FEW leaders at most go to every block
    rows = groups.join(sizes, "key").join(items, "id").select("key", "id", "comp", "leads", "item", F.explode(block).alias("block"))
    rows = rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", F.col("leads").desc(), "id")

    def run(batches):
        import pyarrow as pa

        name = known = None
        for b in batches:
            out = [[], []]
            columns = [b.column(c) for c in ("key", "block", "id", "comp", "leads", "item")]
            for i in range(b.num_rows):
                key, block, node, comp, leads, item = (c[i].as_py() for c in columns)
                if name != (key, block):
                    name, known, leaders, above = (key, block), matcher(), [], {}

                def root(x):
                    while (y := above.get(x, x)) != x:
                        x = above[x] = above.get(y, y)
                    return x

                asked = [k for k, x in enumerate(leaders) if root(x[1]) != root(comp)]
                if asked:
                    for k in np.array(asked)[known.match(item, asked)].tolist():
                        one, two = root(comp), root(leaders[k][1])
                        if one != two:
                            above[max(one, two)] = min(one, two)
                            out[0].append(min(node, leaders[k][0]))
                            out[1].append(max(node, leaders[k][0]))
                if leads:
                    leaders.append((node, comp))
                    known.add(item)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v"])

    return rows.mapInArrow(run, "u bigint, v bigint")


def settled(cells: DataFrame, items: DataFrame, good: DataFrame, tables: Tables, verify, matcher) -> DataFrame:
    """A link (u, v) from each id to the least one that ``good`` (u, v) and more links connect it with: links are sought until no two ids of a key of ``cells`` (key, id) are apart and untried.

    First each id is compared with the least of its key (``verify``: pairs (u, v) to those that hold). An id that no link connects with it then is a leader of the key itself, and is
    compared with all others of the key (``matcher`` makes an object that compares ``items`` (id, item)), FEW a round; links join
    components, and rounds end when every id of a key is connected to its first or was a leader.
    """
    first = cells.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("other")).where("v < other").select("key", "v")
    cells = tables.put(cells.join(first, "key").select("key", "id", "v"))
    pairs = cells.where("id <> v").select(F.col("v").alias("u"), F.col("id").alias("v")).distinct()
    good = tables.put(good.union(verify(pairs.join(good, ["u", "v"], "left_anti"))))
    groups, parts = cells.select("key", "id", (F.col("id") == F.col("v")).alias("done")), int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        comp = components(good, tables).select(F.col("node").alias("id"), "root")
        good = comp.where("id <> root").select(F.col("root").alias("u"), F.col("id").alias("v"))  # from here on one link for each id
        now = tables.put(groups.join(comp, "id", "left").select("key", "id", "done", F.coalesce("root", "id").alias("comp")))
        main = now.groupBy("key").agg(F.min(F.struct(~F.col("done"), "comp")).alias("m"), F.max("comp").alias("last"), F.min("comp").alias("least")).where("least < last")
        now = now.join(main, "key").withColumn("pending", ~F.col("done") & (F.col("comp") != F.col("m.comp"))).select("key", "id", "done", "comp", "pending")
        now = tables.put(now.join(tables.put(now.where("pending").select("key").distinct()), "key"))
        if now.isEmpty():
            return good
        rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        lead = now.where("pending").select("key", "id", rank.alias("rank")).where(F.col("rank") <= FEW).select("key", "id", F.lit(True).alias("leads"))
        now = tables.put(now.join(lead, ["key", "id"], "left").withColumn("leads", F.coalesce("leads", F.lit(False))))
        good = tables.put(good.union(_by_leaders(now.select("key", "id", "comp", "leads"), items, matcher, parts).distinct()))
        groups = tables.put(now.select("key", "id", (F.col("done") | F.col("leads")).alias("done")))


def links(nodes: DataFrame, tau: int, tables: Tables) -> DataFrame:
    """Links (u, v) between ``nodes`` (id, fp: long, ids distinct) whose components are those of all pairs within tau bits.

    Pairs outside crowds, or of a member with another node, are all links: a bucket has few such. The members of a crowd are linked in stars about points (tau of 2 or less), or by leaders.
    """
    n, both = bit_counts(nodes)
    if n < 2:
        return tables.put(nodes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0))
    how = plan(n, both, tau)
    own = _buckets(nodes, Plan(how.masks, [min(t, 0) for t in how.thresholds], 0)).select("part", "key", "id", "fp")
    hot = tables.put(own.groupBy("part", "key").count().where(F.col("count") > HOT).select("part", "key"))
    crowd = tables.put(own.join(hot, ["part", "key"], "left_semi").select("id", "fp").distinct())
    nodes = tables.put(nodes.select("id", "fp").join(crowd.select("id", F.lit(True).alias("crowd")), "id", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False))))
    x, y = _buckets(nodes.where("not crowd"), how).alias("x"), _buckets(nodes, how).alias("y")
    masks = F.element_at(F.array(*[F.lit(_signed(m)) for m in how.masks]), F.col("x.part") + 1)
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    inside, reach = apart.bitwiseAND(masks), F.col("x.key").bitwiseXOR(F.col("x.fp").bitwiseAND(masks))
    d = F.bit_count(inside)
    # Pairs that meet in several buckets of a partition count in one of them.
    once = F.when(d <= 1, F.when(d == 0, reach == 0).otherwise(F.col("x.own") & F.col("y.own") & (reach == 0) | ~(F.col("x.own") & F.col("y.own"))))
    once = once.otherwise(reach < inside.bitwiseXOR(reach))
    pair = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & ((F.col("x.id") < F.col("y.id")) | F.col("y.crowd")))
    pair = pair.where((F.bit_count(apart) <= tau) & (F.col("x.own") | F.col("y.own")) & once)
    good = tables.put(pair.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct())
    if crowd.isEmpty():
        return good
    if tau <= 2:
        return tables.put(good.union(_points(crowd)))
    how = Plan([sum(1 << b for b in g) for g in grouped(both / n, tau + 1)], [0] * (tau + 1), 0)
    cells = tables.put(_buckets(crowd, how).select(F.xxhash64("part", "key").alias("key"), "id"))

    def within(pairs: DataFrame) -> DataFrame:
        one, two = (crowd.select(F.col("id").alias(c), F.col("fp").alias(f"{c}_fp")) for c in "uv")
        return pairs.join(one, "u").join(two, "v").where(F.bit_count(F.col("u_fp").bitwiseXOR(F.col("v_fp"))) <= tau).select("u", "v")

    return settled(cells, crowd.select("id", F.col("fp").alias("item")), good, tables, within, lambda: Prints(tau))


def fingerprint_components(docs: DataFrame, n: int = 3, tau: int = 2, label: str = "simhash") -> DataFrame:
    """Rows (doc_id, fp, component_id) for ``docs`` (doc_id, text): components of fingerprints within tau bits, named by the smallest id.

    Equal fingerprints are one node, so copies cost one row each and no pairs. Null and empty texts, and texts of blanks, have fingerprint
    zero and are linked like any other. A null id never names a component unless all its ids are null. Repeated rows come out as often as they came in. Texts of any length are read whole; an
    empty table gives an empty table.
    """
    tables = Tables(docs.sparkSession, label)
    told = tables.put(docs.select("doc_id", prints(F.col("text"), n)["fp"].alias("fp")))
    nodes = tables.put(told.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), tau, tables), tables)
    linked = tables.put(found.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "least"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named_nodes = linked.join(names, "root").select(F.col("node").alias("fp"), "component_id")
    every = tables.put(nodes.join(named_nodes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return told.join(every, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(text: Column, n: int) -> Column:
    """A struct of the content hash and the distinct hashes of the n-word shingles."""

    def rows(texts):
        for t in texts:
            words, parts = shingles(t, n)
            yield xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63), sorted({xxhash.xxh64_intdigest(s, SEED) - (1 << 63) for s in parts})

    return per_text(rows, "content bigint, parts array<bigint>")(text)


def drop_near_duplicates(docs: DataFrame, n: int = 5, tau: int = 2, similarity: float = 0.8, label: str = "neardup") -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, with all its columns.

    Two texts are linked if their words are the same (A-Z lower-cased), or if their SimHashes of n-word shingles are within tau bits or they share a
    band of min-hashes, and the Jaccard similarity of the shingle sets is at least ``similarity``; groups are components of links. An id is one document: rows that
    share an id stay or go together. Rows with a null id stay, but link others. Texts without words are one group. An empty table gives an empty table; a text of any length is read whole.
    """
    tables = Tables(docs.sparkSession, label)
    told = tables.put(docs.select("doc_id", banded_prints(F.col("text"), n).alias("p")).select("doc_id", "p.*"))
    nodes = tables.put(told.groupBy(F.col("content").alias("id")).agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least"), F.min("bands").alias("bands")))
    near = links(nodes.select("id", "fp"), tau, tables)
    cells = nodes.select("id", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    cells = tables.put(cells.join(shared, "key"))
    # The shingles of all candidates, written once.
    asked = tables.put(near.select(F.col("u").alias("id")).union(near.select("v")).union(cells.select("id")).distinct())
    ids = asked.join(nodes, "id").where("least is not null").select(F.col("least").alias("doc_id"))
    texts = docs.select("doc_id", "text")
    texts = texts.join(small(ids), "doc_id", "left_semi").union(texts.where("doc_id is null"))
    sets = texts.select(shingle_sets(F.col("text"), n).alias("s")).select(F.col("s.content").alias("id"), F.col("s.parts").alias("item")).join(asked, "id", "left_semi")
    sets = tables.put(sets.groupBy("id").agg(F.first("item").alias("item")))

    def verify(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets.select(F.col("id").alias("u"), F.col("item").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("item").alias("b")), "v")
        both = F.size(F.array_intersect("a", "b"))
        return met.where(both >= similarity * (F.size("a") + F.size("b") - both)).select("u", "v")

    good = settled(cells, sets, tables.put(verify(near)), tables, verify, lambda: Sets(similarity))
    found = components(good, tables)
    group = F.coalesce("root", "content")
    grouped_rows = tables.put(told.join(found, F.col("content") == F.col("node"), "left").select("doc_id", group.alias("group")))
    kept = grouped_rows.groupBy("group").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    dropped = tables.put(grouped_rows.select("doc_id").distinct().join(kept, "doc_id", "left_anti"))
    return docs.join(small(dropped), "doc_id", "left_anti")


def op1_simhash_components(spark, sf_dir: str) -> DataFrame:
    docs = named(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    out = fingerprint_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
