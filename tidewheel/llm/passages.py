"""Substring dedup: near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. Two passages of t = 46 distinct tokens (50 words) or more whose token sets have a Jaccard
similarity of 0.8 have a run of words in common: each of the m - 1 places where one run of common tokens ends and the next begins takes four tokens
from either text, so there are S >= 32 (m - 1) common tokens, and S >= t - 4 (m - 1); the longest of the m runs then has 21 tokens, 25 words (``sizes``).

Under a hash function all passages of a text whose least hash is at place c form one compact window: the nodes of the Cartesian tree over
the hashes. Here they are windows over the hashes of 15-word shingles, and the passages are the runs of 25 words, which have 11 of these: two texts that share a
run have a window with the same signature, the least hash. One hash function is therefore enough: no near-duplicate passage of distinct
tokens is missed, where signatures of short tokens need several functions and still miss some. A text of n words has about n / 6 windows, and
lines of under 15 words make no keys.

Windows of two texts with equal signatures are anchors; those whose intervals lie in one stretch of the texts are joined and verified once, token by token:
about an anchor the stretches are taken in which the tokens are common, and their sets decide.

Equal texts are one node. The texts of a key are compared with one leader, the shortest. Those that it refutes (they share a line of 25 to 49 words with it, and
no more) are compared with all others of the key; if they are many, with those that also have a token near the line in common, since a passage that is more than
the line has one.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, Tables, arrow_udf, components, lower, named, small

SHINGLE = 5
#: Least words of a passage.
MIN_WORDS = 50
SIMILARITY = 0.8
#: Texts of a key that are compared with all others of it in a round.
FEW = 256
#: Words that are hashed at once.
_STEP = 1 << 18

_word = re.compile(WORD).findall
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def sizes(min_words: int = MIN_WORDS) -> tuple[int, int, int]:
    """(t, gram, w): tokens of the least passage, words of a shingle whose hash is a signature, and shingles in a run that any two such passages share."""
    t = max(1, min_words - SHINGLE + 1)
    lost = round(8 * SIMILARITY / (1 - SIMILARITY))
    run = min(-(-max(t - 4 * (m - 1), lost * (m - 1)) // m) for m in range(1, t + 2)) + SHINGLE - 1
    w = min(max(1, run * 11 // 25), run - SHINGLE + 1)
    return t, run - w + 1, w


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    words = _word(lower(text)) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row, by a polynomial over the lower 32 bits of theirs."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    h = h & np.uint64(0xFFFFFFFF)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _PRIME
        out += h[i : len(h) - n + 1 + i]
    return mixed(out)


def tokens(text: str | None) -> np.ndarray:
    return grams(word_hashes(text), SHINGLE)


def compact_windows(h: np.ndarray, w: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, first, last): the nodes of the Cartesian tree over h that hold w places or more. c is the least of the w places that begin at any
    place from first to last (the leftmost, if several are least); where ``starts`` is false no w places begin.

    A sliding minimum over doubling lengths finds them for many texts in one array, without a stack.
    """
    if len(h) < w:
        return (np.zeros(0, dtype=np.int64),) * 3
    at, size = np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        size += step
    begin = np.arange(len(at)) if starts is None else np.flatnonzero(starts[: len(at)])
    at = at[begin]
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 3
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # the least place never moves left
    return at[new], begin[new], begin[np.append(new[1:], len(at)) - 1]


def windows(text: Column, min_words: int) -> Column:
    """A struct: content hash of the words, number of words, and the windows as arrays of signature and place (of the signature's first word). Of a signature that a text
    has at places less than a passage apart only the first is taken: one stretch holds them."""
    t, gram, w = sizes(min_words)

    def some(hashes):
        """(signature, place, number for each text) of a few texts."""
        counts = np.array([len(h) for h in hashes], dtype=np.int64)
        begin = np.cumsum(counts) - counts
        h = np.concatenate(hashes)
        left = np.repeat(begin + counts, counts) - np.arange(len(h))  # words from each place to its text's end
        g = grams(h, gram)
        c, _, _ = compact_windows(g, w, (left >= gram + w - 1) & (np.repeat(counts, counts) >= min_words))
        sig, of = g[c], np.searchsorted(begin, c, "right") - 1
        order = np.lexsort((c, sig, of))
        same = np.flatnonzero((sig[order][1:] == sig[order][:-1]) & (of[order][1:] == of[order][:-1]) & (np.diff(c[order]) < t)) + 1
        keep = np.ones(len(c), dtype=bool)
        keep[order[same]] = False
        c, sig, of = c[keep], sig[keep], of[keep]
        return sig.view(np.int64), (c - begin[of]).astype(np.int32), np.bincount(of, minlength=len(hashes))

    def run(texts):
        import pyarrow as pa

        node, n_words, parts, hashes, size = [], [], [], [], 0
        for text in texts.to_pylist():
            h = word_hashes(text)
            node.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
            n_words.append(len(h))
            hashes.append(h)
            size += len(h)
            if size >= _STEP:
                parts.append(some(hashes))
                hashes, size = [], 0
        if hashes:
            parts.append(some(hashes))
        sig, at, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=k) for k in (np.int64, np.int32, np.int64))
        wins = pa.StructArray.from_arrays([pa.array(sig), pa.array(at)], names=["key", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), wins)
        return pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(n_words, pa.int32()), lists], names=["node", "n_words", "wins"])

    return arrow_udf(run, "struct<node:bigint,n_words:int,wins:array<struct<key:bigint,at:int>>>").asNondeterministic()(text)


def coded(text: Column) -> Column:
    """A struct: content hash of the words, and the lower 32 bits of the words' hashes as bytes."""

    def run(texts):
        import pyarrow as pa

        hashes = [word_hashes(t) for t in texts.to_pylist()]
        node = pa.array([xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) for h in hashes], pa.int64())
        return pa.StructArray.from_arrays([node, pa.array([h.astype(np.uint32).tobytes() for h in hashes], pa.binary())], names=["node", "h"])

    return arrow_udf(run, "struct<node:bigint,h:binary>").asNondeterministic()(text)


def _tokens_of(h: bytes) -> np.ndarray:
    return grams(np.frombuffer(h, dtype=np.uint32).astype(np.uint64), SHINGLE)


# Verifying two texts


class Side:
    """The tokens of a text, sorted for lookups."""

    def __init__(self, tok: np.ndarray):
        self.tok, self._sorted = tok, None

    def has(self, x: np.ndarray) -> np.ndarray:
        if self._sorted is None:
            self._sorted = np.sort(self.tok)
        return _isin(x, self._sorted)


def _isin(x: np.ndarray, inorder: np.ndarray) -> np.ndarray:
    if not len(inorder):
        return np.zeros(len(x), dtype=bool)
    return inorder[np.minimum(np.searchsorted(inorder, x), len(inorder) - 1)] == x


def _gains(common: np.ndarray, need: float) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(common - need)])


def _stretch(gain: np.ndarray, p: int, t: int) -> tuple[int, int] | None:
    """First and last place of the stretch of t places or more about p with the greatest gain; None if there is no room."""
    n, reach = len(gain) - 1, 512
    if n < t:
        return None
    while True:
        lo, hi = max(0, p - reach), min(n, p + reach)
        before = -gain[lo : p + 1]
        ends = np.arange(max(p, lo + t - 1), hi)
        if len(ends):
            begins = np.minimum(p, ends - t + 1) - lo
            k = int(np.argmax(gain[ends + 1] + np.maximum.accumulate(before)[begins]))
            x, y = lo + int(np.argmax(before[: begins[k] + 1])), int(ends[k])
            if (x > lo or lo == 0) and (y < hi - 1 or hi == n):
                return x, y
        elif lo == 0 and hi == n:
            return None
        reach *= 4


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the token sets have the similarity."""
    a, b = np.unique(a), np.unique(b)
    both = int(_isin(a, b).sum())
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


#: Shares of common tokens in a stretch that are tried: that of two equally long passages of the similarity, and the least.
_NEEDS = (2 * SIMILARITY / (1 + SIMILARITY), SIMILARITY)


def _near(a: np.ndarray, b: np.ndarray, p: int, q: int, t: int, known: dict):
    """Spans about p and q whose tokens are compared with those near the other place only, up to two passages' length away; None if none is similar.
    ``known`` keeps results by the tokens nearby, which repeat in repetitive texts."""
    x, y = max(0, p - 2 * t), max(0, q - 2 * t)
    a, b, p, q = a[x : p + 2 * t + 1], b[y : q + 2 * t + 1], p - x, q - y
    key = (p, q, a.tobytes(), b.tobytes())
    if key not in known:
        known[key] = _grown(a, b, p, q, t)
    if (spans := known[key]) is None:
        return None
    (i, j), (k, m) = spans
    return (i + x, j + x), (k + y, m + y)


def _grown(a: np.ndarray, b: np.ndarray, p: int, q: int, t: int):
    common = _isin(a, np.sort(b)), _isin(b, np.sort(a))
    # Passages of the similarity have the least share on both sides, and on one side that of equally long ones.
    best = [[_most(c, at, t, need) for c, at in zip(common, (p, q))] for need in _NEEDS]
    if min(best[1]) < -1e-9 or max(best[0]) < -1e-9:
        return None
    for need in (*_NEEDS, 1.0):  # at last the stretches with the fewest tokens that are not common
        mine, last = _stretch(_gains(common[0], need), p, t), None
        while mine is not None and mine != last:
            last, ours = mine, a[mine[0] : mine[1] + 1]
            back = _stretch(_gains(_isin(b, np.sort(ours)), need), q, t)
            if back is None:
                break
            theirs = b[back[0] : back[1] + 1]
            if similar(ours, theirs):
                return mine, back
            narrow = _stretch(_gains(_isin(a, np.sort(theirs)), need), p, t)
            if narrow is None or narrow[1] - narrow[0] >= mine[1] - mine[0]:
                break
            mine = narrow
    return None


def _most(common: np.ndarray, p: int, t: int, need: float) -> float:
    """The greatest gain of a stretch of t places or more about p."""
    gain = _gains(common, need)
    found = _stretch(gain, p, t)
    return -np.inf if found is None else gain[found[1] + 1] - gain[found[0]]


def _possible(gain: np.ndarray, t: int) -> np.ndarray:
    """The places about which there is a stretch of t places or more that gains."""
    n = len(gain) - 1
    if n < t:
        return np.zeros(n, dtype=bool)
    least = np.minimum.accumulate(gain)
    ending = np.full(n, -np.inf)  # best stretch that ends at a place
    ending[t - 1 :] = gain[t:] - least[: n - t + 1]
    best, size = ending, 1
    while size < t:  # the greatest of t places in a row
        step = min(size, t - size)
        best = np.maximum(best, np.append(best[step:], np.full(step, -np.inf)))
        size += step
    far = np.maximum.accumulate(gain[::-1])[::-1]
    after = np.append(far[t:], np.full(t - 1, -np.inf))[:n]  # ends t - 1 places on, or later
    return np.maximum(best, after - least[:-1]) >= -1e-9


def compare(a: Side, b: Side, keys: list[tuple[list[int], list[int]]], t: int, gram: int):
    """Spans (first and last token) of near-duplicate passages about the anchors, and for each key whether none of its places was verified.

    keys: for each the places of its words in a and in b. About two places the stretches of a and b are taken whose tokens the other text has; if
    those are not similar (a stretch may hold two passages), the stretches whose tokens are common near the places.
    """
    mine, theirs, tried, found = [], [], {}, {}
    common = b.has(a.tok), a.has(b.tok)
    gains = {(k, need): _gains(common[k], need) for k in (0, 1) for need in _NEEDS}
    may = [_possible(gains[k, SIMILARITY], t) for k in (0, 1)]

    def about(k: int, p: int, need: float):
        if (k, p, need) not in found:
            found[k, p, need] = _stretch(gains[k, need], p, t)
        return found[k, p, need]

    def spans(p: int, q: int):
        for need in _NEEDS:
            one, two = about(0, p, need), about(1, q, need)
            if one is None or two is None:
                return None
            if (one, two) not in tried:
                tried[one, two] = similar(a.tok[one[0] : one[1] + 1], b.tok[two[0] : two[1] + 1])
            if tried[one, two]:
                return one, two
        return _near(a.tok, b.tok, p, q, t, near)

    def best(p: int, places: list[int], side: int):
        """The spans about place p of one side and one of the other's places: those with enough tokens in common nearby, the most first."""
        if len(places) > 1:
            own, other = (a.tok, b.tok) if side == 0 else (b.tok, a.tok)
            nearby = np.flatnonzero(_isin(other, np.sort(own[max(0, p - 2 * t) : p + 2 * t + 1])))
            q = np.array(places)
            n = np.searchsorted(nearby, q + 2 * t, "right") - np.searchsorted(nearby, q - 2 * t)
            places = [places[k] for k in np.argsort(-n, kind="stable").tolist() if n[k] >= SIMILARITY * t]
        pairs = ((p, q) if side == 0 else (q, p) for q in places)
        return next((s for s in (spans(*pair) for pair in pairs) if s is not None), None)

    near = {}
    half, refuted = (gram - SHINGLE) // 2, []
    for at, there in keys:
        places = [[p + half for p in at if may[0][p + half]], [q + half for q in there if may[1][q + half]]]
        held = False
        for side, sides in ((0, (mine, theirs)), (1, (theirs, mine))):
            for p in places[side] if places[1 - side] else ():
                if any(x <= p <= y and any(x2 <= q <= y2 for q in places[1 - side]) for (x, y), (x2, y2) in zip(*sides)):
                    held = True  # joined to passages found
                elif (one := best(p, places[1 - side], side)) is not None:
                    held = True
                    mine.append(one[0])
                    theirs.append(one[1])
            if not held:
                break
        refuted.append(not held)
    return mine, theirs, refuted


def _equal_run(a: np.ndarray, b: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The first and last place of the equal tokens about equal places p and q of a and b."""
    most = min(len(a) - p, len(b) - q)
    unequal = np.flatnonzero(a[p : p + most] != b[q : q + most])
    last = p + (int(unequal[0]) if len(unequal) else most) - 1
    most = min(p, q)
    unequal = np.flatnonzero(a[p - most : p][::-1] != b[q - most : q][::-1])
    return p - (int(unequal[0]) if len(unequal) else most), last


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<first:int,last:int>>"


def _verify(met: DataFrame, arrays: DataFrame, t: int, gram: int) -> DataFrame:
    """met: key, u, v, and the places of the key in u and in v. Rows (u, v, mine, theirs, rest): word spans, and the keys of which no place was verified."""
    pairs = met.groupBy("u", "v").agg(F.collect_list(F.struct("key", "places", "there")).alias("keys"))  # of one text's windows
    one = pairs.join(arrays.select(F.col("node").alias("u"), F.col("h").alias("a")), "u")
    both = one.join(arrays.select(F.col("node").alias("v"), F.col("h").alias("b")), "v")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        leader, b = None, None
        for batch in batches:
            mine, theirs, rest = [], [], []
            us, vs, told = (batch.column(c).to_pylist() for c in ("u", "v", "keys"))
            for i in range(batch.num_rows):
                if vs[i] != leader:  # rows arrive by leader
                    leader, b = vs[i], Side(_tokens_of(batch.column("b")[i].as_py()))
                a = Side(_tokens_of(batch.column("a")[i].as_py()))
                *spans, refuted = compare(a, b, [(k["places"], k["there"]) for k in told[i]], t, gram)
                for side, found in zip((mine, theirs), spans):
                    side.append([{"first": x, "last": y + SHINGLE - 1} for x, y in _merged(found)])
                rest.append([k["key"] for k, bad in zip(told[i], refuted) if bad])
            yield pa.RecordBatch.from_arrays(
                [pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(mine, kind), pa.array(theirs, kind), pa.array(rest, pa.list_(pa.int64()))],
                names=["u", "v", "mine", "theirs", "rest"],
            )

    return both.select("u", "v", "keys", "a", "b").mapInArrow(run, f"u bigint, v bigint, mine {_SPANS}, theirs {_SPANS}, rest array<bigint>")


def _told_apart(groups: DataFrame, arrays: DataFrame, t: int, gram: int) -> DataFrame:
    """``groups`` (key, base, node, at, told, with the place ``there`` of the key's leader v) under every key together with a token near it. Tokens that are equal in the leader are left out where
    ``told`` is false, that is where it refuted the text: what the text shares with others beyond that has one of the rest."""
    rows = groups.join(arrays.select("node", F.col("h").alias("a")), "node").join(arrays.select(F.col("node").alias("v"), F.col("h").alias("b")), "v")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [[], [], [], []]
            for r in b.to_pylist():
                tok, lead, p = _tokens_of(r["a"]), _tokens_of(r["b"]), r["at"]
                first, last = (0, -1) if r["told"] else _equal_run(tok, lead, p, r["there"])
                near = np.unique(np.concatenate([tok[max(0, p - t) : first], tok[last + 1 : p + gram + t]]) if last >= first else tok[max(0, p - t) : p + gram + t])
                mix = mixed(near ^ np.array([r["key"]]).view(np.uint64), 3).view(np.int64)
                out[0] += mix.tolist()
                for x, value in zip(out[1:], (r["base"], r["node"], p)):
                    x += [value] * len(mix)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["key", "base", "node", "at"])

    return rows.select("key", "base", "node", "at", "there", "told", "a", "b").mapInArrow(run, "key bigint, base bigint, node bigint, at int")


#: Texts that are compared with one group's leaders in one task, about.
BLOCK = 4_096


def _by_leaders(groups: DataFrame, arrays: DataFrame, t: int, gram: int) -> DataFrame:
    """Rows (u, v, mine, theirs): verified pairs of the leaders and all others of ``groups`` (key, base, node, at, comp, covered, leads), in which two texts that are connected and
    whose places are both covered are not compared. The groups of one base meet together, each place once; they are dealt in blocks, each with all the leaders first; only the words about a
    place travel."""
    reach = 2 * t
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    half, width = (gram - SHINGLE) // 2, 2 * reach + gram

    def cut(batches):
        import pyarrow as pa

        kinds = dict(base=pa.int64(), keys=pa.list_(pa.int64()), node=pa.int64(), at=pa.int32(), comp=pa.int64(), covered=pa.bool_(), leads=pa.bool_(), block=pa.int32(), begin=pa.int32(), h=pa.binary())
        for b in batches:
            out = []
            for r in b.to_pylist():
                h = r["h"]
                for g in r["g"]:
                    begin = max(0, g["at"] - reach)
                    g = g | {"node": r["node"], "begin": begin, "h": h[4 * begin : 4 * (g["at"] + gram + reach)]}
                    out += [g | {"block": k} for k in (range(g["blocks"]) if g["leads"] else (g["block"],))]
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in out], kind) for c, kind in kinds.items()], names=list(kinds))

    rows = groups.groupBy("base", "node", "at").agg(F.collect_list("key").alias("keys"), F.first("comp").alias("comp"), F.first("covered").alias("covered"), F.max("leads").alias("leads"))
    blocks = groups.groupBy("base").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "base").withColumn("block", F.pmod(F.xxhash64("node", "at"), F.col("blocks")).cast("int"))
    rows = rows.groupBy("node").agg(F.collect_list(F.struct("base", "keys", "at", "comp", "covered", "leads", "blocks", "block")).alias("g"))
    rows = rows.join(arrays, "node").select("node", "g", "h")
    rows = rows.mapInArrow(cut, "base bigint, keys array<bigint>, node bigint, at int, comp bigint, covered boolean, leads boolean, block int, begin int, h binary")
    rows = rows.repartition(parts, "base", "block").sortWithinPartitions("base", "block", F.col("leads").desc(), "node", "at")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        block = None

        def tell(found, out):
            for u, v, mine, theirs in found:
                for x, value in zip(out, (u, v, [mine], [theirs])):
                    x.append(value)

        def met(block, out):
            """The leaders among themselves, once all have come."""
            if block is not None and block.inorder is None:
                for n in range(1, len(block.leaders)):
                    tell(block.met(block.leaders[n], n), out)

        def record(out):
            kinds = (pa.int64(), pa.int64(), kind, kind)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["u", "v", "mine", "theirs"])

        for batch in batches:
            out = [[], [], [], []]
            for r in batch.to_pylist():
                if block is None or block.name != (r["base"], r["block"]):
                    met(block, out)
                    block = _Block((r["base"], r["block"]), t, half, width)
                r["tok"], r["p"] = _tokens_of(r["h"]), r["at"] - r["begin"] + half
                if r["leads"] and r["p"] < len(r["tok"]):
                    block.lead(r)
                else:
                    met(block, out)
                    tell(block.met(r, len(block.leaders)), out)
            yield record(out)
        met(block, out := [[], [], [], []])
        yield record(out)

    return rows.mapInArrow(run, f"u bigint, v bigint, mine {_SPANS}, theirs {_SPANS}")


class _Block:
    """The leaders of a group, each with the words about its place, and the texts that meet them one by one."""

    def __init__(self, name, t: int, half: int, width: int):
        self.name, self.t, self.half, self.width, self.middle = name, t, half, width, (width - half) // 2
        self.leaders: list[dict] = []
        self.lines, self.above, self.known, self.by_key = [], {}, {}, {}
        self.inorder = None

    def root(self, x):
        while (y := self.above.get(x, x)) != x:
            x = self.above[x] = self.above.get(y, y)
        return x

    def lead(self, r: dict) -> None:
        self.lines.append(self._line(r))
        for key in r["keys"]:
            self.by_key.setdefault(key, []).append(len(self.leaders))
        self.leaders.append(r)

    def _line(self, r: dict) -> np.ndarray:
        """The tokens about a text's place, the place in the middle; 0 is no token."""
        line = np.zeros(self.width, dtype=np.uint64)
        left, right = min(r["p"], self.middle), min(len(r["tok"]) - r["p"], self.width - self.middle)
        line[self.middle - left : self.middle + right] = r["tok"][r["p"] - left : r["p"] + right]
        return line

    def _gain(self, common: np.ndarray, need: float) -> np.ndarray:
        """Of each row, the greatest gain of t places or more about the middle."""
        t, at, share = self.t, self.middle, round(1800 * need)
        gain = np.zeros((len(common), self.width + 1), dtype=np.int32)
        np.cumsum(np.where(common, 1800 - share, -share).astype(np.int32), axis=1, out=gain[:, 1:])
        least = np.minimum.accumulate(gain[:, : at + 1], axis=1)
        best = gain[:, at + t :].max(axis=1) - least[:, at]  # ends t - 1 places on, or later
        ends = gain[:, max(at, t - 1) + 1 : at + t]
        return np.maximum(best, (ends - least[:, max(0, at - t + 1) :][:, : ends.shape[1]]).max(axis=1))

    def possible(self, r: dict, asked: np.ndarray) -> np.ndarray:
        """Those of the leaders asked with whom a text may have a passage: about the places of both there are t tokens or more of which the least share is common, and on one side
        the share of equally long passages of the similarity."""
        if self.inorder is None:  # the leaders are all there: their distinct tokens, by number
            lines = np.array(self.lines)
            self.inorder, numbers = np.unique(np.append(lines.ravel(), np.uint64(0)), return_inverse=True)
            self.numbers = numbers[:-1].reshape(lines.shape)
            self.has = np.zeros((len(lines), len(self.inorder)), dtype=bool)
            self.has[np.arange(len(lines))[:, None], self.numbers] = True
            self.has[:, 0] = False
        line = self._line(r)
        number = np.minimum(np.searchsorted(self.inorder, line), len(self.inorder) - 1)
        number[self.inorder[number] != line] = 0
        mine = np.zeros(len(self.inorder), dtype=bool)
        mine[number] = True
        mine[0] = False
        strict, least = _NEEDS
        theirs = mine[self.numbers[asked]]
        keep = self._gain(theirs, least) >= 0
        asked, theirs = asked[keep], theirs[keep]
        if len(asked):
            ours = self.has[asked][:, number]
            keep = (self._gain(ours, least) >= 0) & ((self._gain(ours, strict) >= 0) | (self._gain(theirs, strict) >= 0))
            asked = asked[keep]
        return asked

    def met(self, r: dict, n: int):
        """(u, v, span of u, span of v) of those of the first n leaders v that share a key with a text, and a passage."""
        same = lambda x: x["covered"] and r["covered"] and self.root(x["comp"]) == self.root(r["comp"])
        if r["p"] >= len(r["tok"]):
            return
        asked = {k for key in r["keys"] for k in self.by_key.get(key, ()) if k < n}
        asked = [k for k in sorted(asked) if (x := self.leaders[k])["node"] != r["node"] and not same(x)]
        if not asked:
            return
        for k in self.possible(r, np.array(asked)).tolist():
            x = self.leaders[k]
            if not same(x) and (spans := _near(r["tok"], x["tok"], r["p"], x["p"], self.t, self.known)) is not None:
                one, two = self.root(r["comp"]), self.root(x["comp"])
                self.above[max(one, two)] = min(one, two)
                r["covered"] = x["covered"] = True
                yield r["node"], x["node"], *({"first": i + y["begin"], "last": j + y["begin"] + SHINGLE - 1} for (i, j), y in zip(spans, (r, x)))


def _by_runs(groups: DataFrame, arrays: DataFrame, tables: Tables, t: int, gram: int, w: int) -> DataFrame:
    """Rows (key, base, node, at): the places of ``groups`` (key, node, at; the key is the base) under the runs of words about them that any two near-duplicate passages share, of which the window's shingle is the
    least; only runs that several texts have, and one of those that the same texts have."""
    rows = groups.groupBy("node").agg(F.collect_set("at").alias("places")).join(arrays, "node")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, bases, nodes, places = [], [], [], []
            for node, at, h in zip(b.column("node").to_pylist(), b.column("places").to_pylist(), b.column("h").to_pylist()):
                h = np.frombuffer(h, dtype=np.uint32).astype(np.uint64)
                g, runs = grams(h, gram), grams(h, gram + w - 1)
                least = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1)
                for c in at:
                    lo, hi = max(0, c - w + 1), min(len(runs), c + t)  # the places that stand for this one, too
                    found = np.unique(runs[lo:hi][least[lo:hi] == g[c]])
                    keys.append(found)
                    bases += [int(g[c : c + 1].view(np.int64)[0])] * len(found)
                    nodes += [node] * len(found)
                    places += [c] * len(found)
            keys = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            columns = [pa.array(keys), pa.array(bases, pa.int64()), pa.array(nodes, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "base", "node", "at"])

    out = tables.put(rows.select("node", "places", "h").mapInArrow(run, "key bigint, base bigint, node bigint, at int"))
    member = F.xxhash64("node", "at")
    alike = out.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"), F.sum(F.shiftright(member, 8)).alias("x"), F.bit_xor(member).alias("y")).where("a < b")
    return out.join(alike.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")


def _settled(cells: DataFrame, arrays: DataFrame, tables: Tables, t: int, gram: int, w: int) -> tuple[DataFrame, DataFrame]:
    """The verified pairs (u, v, mine, theirs) among ``cells`` (key, node, n_words, places, part), and (node, root) of the components that they make.

    First each text is compared with the leader of its keys. The places of keys where the leader refuted some are then grouped by the runs about them that near-duplicate passages
    share: an edited copy has few such runs in common with others. A text that is not connected to all of its group, or whose place no passage covers yet, is compared with all
    others of the group, FEW such texts a round; rounds end when none is left. No two texts that share a run are then untried, but those that are
    connected and have passages about it. A group that still has more than FEW such texts after a round is told apart by the tokens nearby.
    """
    # The leader is a text whose windows are mostly shared: an edited copy has many of its own.
    first = cells.groupBy("key").agg(F.min(F.struct("part", "n_words", "node", "places")).alias("lead"))
    first = tables.put(first.select("key", F.col("lead.node").alias("v"), F.col("lead.places").alias("there")))
    held = tables.put(_verify(cells.join(first, "key").where("node <> v").withColumnRenamed("node", "u"), arrays, t, gram))
    found = held.where(F.size("mine") > 0).select("u", "v", "mine", "theirs")
    refuted = tables.put(held.select(F.explode("rest").alias("key")).distinct())
    groups = tables.put(_by_runs(cells.join(refuted, "key").select("key", "node", F.explode("places").alias("at")), arrays, tables, t, gram, w))
    groups, turn, more, links = groups.withColumn("done", F.lit(False)), 0, None, found.select("u", "v")
    while True:
        comp = components(links, tables)
        sides = found.select(F.col("u").alias("node"), F.explode("mine").alias("s")).union(found.select("v", F.explode("theirs")))
        sides = sides.groupBy("node").agg(F.collect_set("s").alias("spans"))
        now = groups.join(comp, "node", "left").join(sides, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        now = now.withColumn("covered", F.coalesce(F.exists("spans", lambda s: (s["first"] <= F.col("at")) & (s["last"] >= F.col("at") + gram - 1)), F.lit(False)))
        now = tables.put(now.select("key", "base", "node", "at", "done", "comp", "covered"))
        main = now.groupBy("key").agg(F.min("comp").alias("m"), F.min(F.struct("node", "at")).alias("lead"))
        now = now.join(main, "key").withColumn("pending", ~F.col("done") & ((F.col("comp") != F.col("m")) | ~F.col("covered"))).drop("m")
        count = now.groupBy("key").agg(F.count_if("pending").alias("n")).where("n > 0")
        now = tables.put(now.join(count, "key"))
        if now.isEmpty():
            break
        links = comp.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))  # from here on one link for each text
        if turn == 1 and not (many := tables.put(now.where(F.col("n") > FEW))).isEmpty():
            told = many.select("key", "base", "node", "at", F.col("lead.node").alias("v"), F.col("lead.at").alias("there"), (~F.col("pending")).alias("told"))
            apart = tables.put(_told_apart(told, arrays, t, gram).distinct())
            shared = apart.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
            few = now.where(F.col("n") <= FEW).select("key", "base", "node", "at", "done")
            groups, turn = tables.put(few.union(apart.join(shared, "key").select("key", "base", "node", "at", F.lit(False).alias("done")))), 2
            continue
        rank = F.row_number().over(Window.partitionBy("key").orderBy("node", "at"))
        lead = now.where("pending").select("key", "node", "at", rank.alias("rank")).where(F.col("rank") <= FEW).select("key", "node", "at", F.lit(True).alias("leads"))
        now = tables.put(now.join(lead, ["key", "node", "at"], "left").withColumn("leads", F.coalesce("leads", F.lit(False))))
        more = tables.put(_by_leaders(now.select("key", "base", "node", "at", "comp", "covered", "leads"), arrays, t, gram))
        found, links = found.union(more), links.union(more.select("u", "v"))
        groups = tables.put(now.select("key", "base", "node", "at", (F.col("done") | F.col("leads")).alias("done")))
        turn += 1
    if more is None:
        return found, comp
    # About their keys the passages of the later pairs are followed as far as they go.
    pairs = found.select("u", "v").distinct().join(held.select("u", "v"), ["u", "v"], "left_anti").join(cells.select("key", F.col("node").alias("u"), "places"), "u")
    met = pairs.join(cells.select("key", F.col("node").alias("v"), F.col("places").alias("there")), ["key", "v"])
    whole = _verify(met.select("key", "u", "v", "places", "there"), arrays, t, gram).where(F.size("mine") > 0).select(found.columns)
    return found.union(tables.put(whole)), comp


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, label: str = "passages") -> DataFrame:
    """Rows (doc_id, component_id, n_representatives, n_repeated, spans), one for each row of ``docs`` (doc_id, text).

    spans: word offsets ``first-last``, comma-joined, of the passages of min_words or more that another document has too, or a near-duplicate of them; empty
    if there are none. n_repeated: words in them; n_representatives: different texts that its passages were verified with; component_id: the least id that
    passages connect it to, its own if none. Copies of min_words or more repeat as a whole; repeated rows are copies. Shorter texts, null and empty ones have no passages. A null
    id never names a component unless all ids are null. An empty table gives an empty table. A text of any length is read whole.
    """
    tables, (t, gram, w) = Tables(docs.sparkSession, label), sizes(min_words)
    told = tables.put(docs.select("doc_id", windows(F.col("text"), min_words).alias("w")).select("doc_id", "w.*"))
    rows = told.select("doc_id", "node", "n_words")
    nodes = tables.put(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("n_words").alias("n_words")))
    cells = told.select("node", "n_words", F.explode("wins").alias("w")).select("w.key", "node", "n_words", "w.at")
    shared = tables.put(cells.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key"))
    # One row for each key and text, with all the places where the text has it.
    cells = tables.put(cells.join(shared, "key").groupBy("key", "node", "n_words").agg(F.sort_array(F.collect_set("at")).alias("places")))
    own = cells.groupBy("node").agg(F.round(F.count("*") / F.first("n_words"), 2).alias("part"))
    cells = tables.put(cells.join(own, "node").select("key", "node", "n_words", "places", (-F.col("part")).alias("part")))
    asked = tables.put(cells.select("node").distinct())
    ids = nodes.join(asked, "node").select(F.col("least").alias("doc_id"))
    texts = docs.select("doc_id", "text")
    texts = texts.join(small(ids.where("doc_id is not null")), "doc_id", "left_semi").union(texts.where("doc_id is null"))
    arrays = texts.select(coded(F.col("text")).alias("c")).select("c.*").join(asked, "node", "left_semi")
    arrays = tables.put(arrays.groupBy("node").agg(F.first("h").alias("h")))
    found, roots = _settled(cells, arrays, tables, t, gram, w)

    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - 1).alias("last")))
    sides = nodes.where((F.col("n") > 1) & (F.col("n_words") >= min_words)).select("node", F.lit(None).cast("bigint").alias("with"), whole.alias("spans"))
    sides = sides.union(found.select("u", "v", "mine")).union(found.select("v", "u", "theirs"))
    sides = tables.put(sides)
    # A text's spans are folded place by place: a text has few, however many others share them.
    edges = sides.select("node", F.explode("spans").alias("s")).groupBy("node", "s.first", "s.last").agg(F.lit(1))
    spans = edges.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return F.when(s["first"] <= last["last"] + 1, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    spans = spans.select("node", F.aggregate(F.slice("spans", 2, 1 << 30), F.slice("spans", 1, 1), fold).alias("spans"))
    links = sides.where(F.col("with").isNotNull()).groupBy("node").agg(F.count_distinct("with").alias("n_representatives"))
    about = nodes.select("node", "least").join(spans, "node", "left").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    about = tables.put(about)
    names = about.groupBy("root").agg(F.min("least").alias("component_id"))
    size = F.coalesce(F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["last"] - s["first"] + 1), F.lit(0))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    names = about.join(names, "root").select("node", "component_id", F.coalesce("n_representatives", F.lit(0)).alias("n_representatives"), size.cast("bigint").alias("n_repeated"), F.coalesce(text, F.lit("")).alias("spans"))
    component = F.when(F.col("n_words") >= min_words, F.col("component_id")).otherwise(F.col("doc_id"))  # short texts are no copies
    return rows.join(names, "node").select("doc_id", component.alias("component_id"), "n_representatives", "n_repeated", "spans")


def op2_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(named(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text"))
