"""Operators on whole corpora, against brute force on small ones."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel.llm import importance, language, mixing, passages, sharding, simhash, urls
from tidewheel.llm.common import Tables, components

RNG = random.Random(7)
VOCAB = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("a", "e", "io", "u", "or", "ing")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text, times, rng=RNG):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = "edited" + str(rng.randrange(10**6))
    return " ".join(words)


def groups(links, ids):
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Tables(spark, "t")).collect()}
    want = groups(edges, {x for e in edges for x in e if e[0] != e[1]})
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Tables(spark, "t")).count() == 0


def brute_fingerprints(rows):
    out = {}
    for d, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        bits = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
        out[d] = sum(1 << b for b in range(64) if s and 2 * bits[b] > len(s))
    return out


@pytest.mark.parametrize("hot", [64, 2])
def test_simhash_components(spark, make, sf, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, "  "), (3, "a"), (4, "A b"), (5, "a B")]
    for _ in range(15):
        t = prose(400, rng)
        rows += [(len(rows) + k, edited(t, rng.randrange(4), rng)) for k in range(8)]
    fps = brute_fingerprints(rows)
    ids = sorted(fps)
    want = groups([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    got = simhash.op1_simhash_components(spark, sf(documents=make(rows + [(None, "zz yy xx ww")]))).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {d: (f"{fps[d]:016x}", want[d]) for d in ids}
    assert simhash.op1_simhash_components(spark, sf(documents=make([]))).count() == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_links_of_greater_distance(spark, monkeypatch, hot):
    """All links within tau, also where crowds meet by leaders, few a round and in blocks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "FEW", 12)
    rng = random.Random(12)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for s in seeds for _ in range(12)})
    nodes = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    want = groups([(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 8], range(len(fps)))
    df, tables = spark.createDataFrame(nodes, "id bigint, fp bigint"), Tables(spark, "t")
    got = {r.node: r.root for r in components(simhash.links(df, 8, tables), tables).collect()}
    assert all(got.get(i, i) == want[i] for i in want)


def test_crowds_make_few_rows(spark):
    """3,000 fingerprints that share 32 bits, 200 one bit off those, and 3,000 others: exact, and the buckets stay small."""
    rng = random.Random(33)
    high = rng.getrandbits(32) << 32
    fps = {high | rng.getrandbits(32) for _ in range(3000)} | {high ^ (1 << 40) | rng.getrandbits(32) for _ in range(200)} | {rng.getrandbits(64) for _ in range(3000)}
    some = rng.sample(sorted(fps), 100)
    fps = sorted(fps | {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in some})
    nodes = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    tables = Tables(spark, "t")
    found = simhash.links(spark.createDataFrame(nodes, "id bigint, fp bigint"), 2, tables)
    got = {r.node: r.root for r in components(found, tables).collect()}
    of = np.array(fps, dtype=np.uint64)
    links = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(of[i + 1 :] ^ of[i]) <= 2) + i + 1]
    want = groups(links, range(len(fps)))
    assert all(got.get(i, i) == want[i] for i in want) and found.count() <= 10 * len(links)


@pytest.mark.parametrize("few", [256, 16])
def test_near_duplicates_against_brute_force(make, monkeypatch, few):
    """Texts of one template with few to many edits: those that share a band and are similar are one group, in crowds too."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng, rows = random.Random(41), []
    for k in range(4):
        base = prose(120, rng)
        rows += [(100 * k + i, edited(base, rng.choice([0, 1, 1, 2, 4, 8]), rng)) for i in range(40)]
    sets = {d: set(simhash.shingles(t, 5)[1]) for d, t in rows}
    keys = {d: set(simhash.band_keys(simhash.shingles(t, 5)[1])) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and keys[a] & keys[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(make(rows)).select("doc_id").collect()}
    assert kept == {d for d, root in want.items() if d == root} and 8 < len(kept) < 120


def test_thresholds_fulfil_the_pigeonhole_principle():
    rng = np.random.default_rng(3)
    bits = rng.random((500, 64)) < 0.5
    bits[:, 10:20] = bits[:, :1]  # correlated
    both = bits.T.astype(float) @ bits
    for tau in (0, 1, 2, 4, 8):
        how = simhash.plan(500, both, tau)
        assert sum(how.thresholds) == tau - len(how.masks) + 1
        assert sum(how.masks) == (1 << 64) - 1 and max(how.thresholds) <= 2


def test_near_duplicates_keep_one(make):
    rng = random.Random(13)
    base = [prose(300, rng) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 1, rng)) for i, t in enumerate(base)] + [(200 + i, t.upper()) for i, t in enumerate(base)] + [(300, None), (301, ""), (None, base[0])]
    out = simhash.drop_near_duplicates(make(rows))
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(range(12)) <= set(kept) and not any(200 <= (d or 0) < 300 for d in kept)
    assert sum(100 <= (d or 0) < 200 for d in kept) <= 2  # one edited word of 300: 64 bits miss few
    assert (300 in kept) and (301 not in kept) and (None in kept)
    assert out.columns == make(rows).columns


def test_near_duplicates_of_similarity_from_08(make):
    """Recall against brute force in bands of similarity, also where many near copies share a band key."""
    rng, rows, pairs = random.Random(17), [], defaultdict(list)
    for i in range(160):
        a = prose(rng.randrange(60, 300), rng)
        b = edited(a, rng.randrange(1, 2 + len(a.split()) // 40), rng)
        x, y = (set(simhash.shingles(t, 5)[1]) for t in (a, b))
        s = len(x & y) / len(x | y)
        if s >= 0.8:
            pairs[min(int(s * 20), 19)].append(1000 + i)
            rows += [(i, a), (1000 + i, b)]
    crowd = prose(200, rng)
    rows += [(5000 + i, edited(crowd, 1, rng)) for i in range(30)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(make(rows)).select("doc_id").collect()}
    assert set(pairs) == {16, 17, 18, 19} and all(len(p) >= 10 for p in pairs.values())
    for band, ids in pairs.items():
        assert sum(i not in kept for i in ids) >= 0.97 * len(ids), band
    assert {i for i in kept if i >= 5000} == {5000}


def test_passages(make, spark, sf):
    rng = random.Random(14)
    p, q = prose(70, rng), prose(60, rng)
    rows = [(i, prose(100, rng) + " " + p + " " + prose(50 + i, rng)) for i in range(20)]
    rows += [(50, prose(80, rng) + " " + edited(q, 1, rng)), (51, q + " " + prose(200, rng)), (60, prose(300, rng)), (61, prose(30, rng)), (62, None), (63, "")]
    rows += [(70, rows[22][1]), (71, prose(20, rng)), (72, prose(20, rng)), (None, prose(40, rng) + " " + p), (73, "again"), (73, "again")]
    out = passages.op2_repeated_passages(spark, sf(documents=make(rows))).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert {d for d, r in got.items() if r.spans} == set(range(20)) | {50, 51, 60, 70, None}
    assert {got[i].component_id for i in [*range(20), None]} == {0} and got[50].component_id == got[51].component_id == 50 and got[70].component_id == 60
    assert all(r.component_id == d and not r.n_repeated and not r.n_representatives for d, r in got.items() if not r.spans)
    for i in range(20):
        a, b = map(int, got[i].spans.split(",")[0].split("-"))
        assert abs(a - 100) <= 6 and abs(b - 169) <= 6
    assert passages.op2_repeated_passages(spark, sf(documents=make([]))).count() == 0


def similar_passages(a, b, t=46):
    """Whether two texts have passages of t tokens or more with a Jaccard similarity of 0.8: every two windows are tried."""
    x, y = passages.tokens(a).tolist(), passages.tokens(b).tolist()
    if len(set(x) & set(y)) < 0.8 * t:
        return False
    at = {v: 1 << k for k, v in enumerate(dict.fromkeys(x + y))}

    def masks(tok):
        out = set()
        for i in range(len(tok) - t + 1):
            m = 0
            for j in range(i, len(tok)):
                m |= at[tok[j]]
                if j - i + 1 >= t:
                    out.add(m)
        return out

    return any((m & n).bit_count() >= 0.8 * (m | n).bit_count() for m in masks(x) for n in masks(y))


@pytest.mark.parametrize("few", [256, 2])
def test_passages_against_brute_force(make, monkeypatch, few):
    """Components and marked documents of random tables with edited passages, inserted, deleted and moved words; also where keys are told apart and leaders take turns."""
    monkeypatch.setattr(passages, "FEW", few)
    rng, rows = random.Random(26 + few), []
    shared = [prose(58, rng).split() for _ in range(6)]
    for i in range(46):
        w = list(rng.choice(shared))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = ["new" + str(rng.randrange(10**6))] * rng.randrange(2)
        if rng.random() < 0.2:
            k = rng.randrange(20, 40)
            w = w[k:] + w[:k]
        w = w[rng.choice([0, 0, 4, 12, 30]) :]
        rows.append((i, " ".join([prose(rng.randrange(1, 8), rng), *w, prose(rng.randrange(1, 8), rng)])))
    links = [(a, b) for a, x in rows for b, y in rows if a < b and similar_passages(x, y)]
    want, marked = groups(links, range(46)), {i for link in links for i in link}
    got = passages.repeated_passages(make(rows)).collect()
    assert len(links) > 30 and len(set(want.values())) > 8
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in got if r.spans} == marked == {r.doc_id for r in got if r.n_repeated >= 50}


def test_passages_beside_other_shared_passages(make):
    """30 triples: A and B share one passage, B and D another, of which A, the shortest, has an edited copy that fails."""
    rng, rows, want = random.Random(20), [], {}
    for k in range(0, 90, 3):
        p, q = prose(60, rng), prose(52, rng)
        w = q.split()
        w[10:40:6] = ["x" + str(rng.randrange(10**6)) for _ in w[10:40:6]]
        rows += [(k, p + " " + " ".join(w)), (k + 1, p + " " + prose(40, rng) + " " + q), (k + 2, q + " " + prose(120, rng))]
        want |= {k: k, k + 1: k, k + 2: k}
    assert {r.doc_id: r.component_id for r in passages.repeated_passages(make(rows)).collect()} == want


@pytest.mark.parametrize("few", [256, 8])
def test_passages_that_go_beyond_a_common_line(make, monkeypatch, few):
    """80 texts share a line of 30 words, too short for a passage. Some have more words after it, or before it, in common; one pair has an edited word between."""
    monkeypatch.setattr(passages, "FEW", few)
    rng = random.Random(28)
    line, more = prose(30, rng), [prose(28, rng) for _ in range(3)]
    rows = [(i, " ".join([prose(60, rng), line, prose(60, rng)])) for i in range(70)]
    rows += [(100 + k, " ".join([prose(50, rng), line, more[0], prose(40, rng)])) for k in range(6)] + [(200 + k, " ".join([prose(50, rng), more[1], line, prose(40, rng)])) for k in range(2)]
    rows += [(300 + k, " ".join([prose(50, rng), line, f"edit{k}", more[2], prose(40, rng)])) for k in range(2)]
    got = {r.doc_id: r for r in passages.repeated_passages(make(rows)).collect()}
    assert {d: r.component_id for d, r in got.items()} == {d: d if d < 100 else d // 100 * 100 for d in got}
    assert {d for d, r in got.items() if r.spans} == {d for d in got if d >= 100}


def test_passages_that_the_leader_has_twice(make):
    """The shortest text holds the passage at two places: both are spans."""
    rng = random.Random(24)
    p = prose(70, rng)
    rows = [(1, " ".join([prose(20, rng), p, prose(30, rng), p, prose(20, rng)])), (2, prose(150, rng) + " " + p + " " + prose(60, rng))]
    got = {r.doc_id: r for r in passages.repeated_passages(make(rows)).collect()}
    spans = [tuple(map(int, s.split("-"))) for s in got[1].spans.split(",")]
    assert len(spans) == 2 and all(abs(x - at) <= 6 and abs(y - at - 69) <= 6 for (x, y), at in zip(spans, (20, 120)))


def test_passages_in_very_long_and_repetitive_texts(make):
    """Texts of 300,000 words; of one word, of one line, and of prose: time stays in proportion to the words."""
    rng = random.Random(27)
    p, line = prose(60, rng), prose(17, rng)
    rows = [(1, "word " * 300_000), (2, "word " * 200_000 + prose(20, rng)), (3, (line + " ") * 17_000), (4, prose(10, rng) + " " + (line + " ") * 12_000)]
    rows += [(5, prose(300_000, rng) + " " + p), (6, p + " " + prose(100, rng)), (7, prose(30, rng) + " " + "word " * 30 + prose(30, rng))]
    got = {r.doc_id: r for r in passages.repeated_passages(make(rows)).collect()}
    assert {d: r.component_id for d, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert got[3].n_repeated > 280_000 and got[1].n_repeated == 300_000 and 55 <= got[5].n_repeated <= 70


def keys_of(text, min_words=50):
    _, gram, w = passages.sizes(min_words)
    g = passages.grams(passages.word_hashes(text), gram)
    return set(g[passages.compact_windows(g, w)[0]].tolist())


@pytest.mark.parametrize("change", ["edit", "insert", "delete", "move"])
def test_near_duplicate_passages_share_a_key(change):
    """Recall 1: all passages of 50 words or more and a similarity of 0.8 or more, in unlike surroundings, share a signature and are verified."""
    rng, n, t = random.Random(19), 0, passages.sizes()[0]
    while n < 300:
        p = prose(rng.choice([50, 51, 52, 60, 95, 140, 400]), rng).split()
        q = p.copy()
        for _ in range(1 if change == "move" else rng.randrange(1, 2 + len(p) // 45)):
            k = rng.randrange(len(q))
            if change == "move":
                q = q[k:] + q[:k]
            else:
                q[k : k + (change != "insert")] = [] if change == "delete" else ["new" + str(rng.randrange(10**6))]
        a, b = (" ".join([prose(60, rng), " ".join(x), prose(60, rng)]) for x in (p, q))
        x, y = (set(passages.tokens(" ".join(x)).tolist()) for x in (p, q))
        if min(len(x), len(y)) >= t and len(x & y) >= 0.8 * len(x | y):
            n += 1
            assert keys_of(a) & keys_of(b)
            gram = passages.sizes()[1]
            places = []
            for text in (a, b):
                g = passages.grams(passages.word_hashes(text), gram)
                places.append({int(g[c]): int(c) for c in passages.compact_windows(g, passages.sizes()[2])[0]})
            keys = [([places[0][k]], [places[1][k]]) for k in places[0] if k in places[1]]
            mine, theirs, refuted = passages.compare(passages.Side(passages.tokens(a)), passages.Side(passages.tokens(b)), keys, t, gram)
            assert mine and theirs and not all(refuted)


def test_runs_that_near_duplicate_passages_share():
    assert passages.sizes(50) == (46, 15, 11)
    for n in (5, 6, 10, 20, 30, 80, 200):
        t, gram, w = passages.sizes(n)
        assert t == n - 4 and 5 <= gram <= n and w >= 1


def test_compact_windows_hold_each_start_once():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, w = int(rng.integers(0, 60)), int(rng.integers(1, 12))
        h = rng.integers(0, 30, n).astype(np.uint64)
        seen = {i: c for c, first, last in zip(*passages.compact_windows(h, w)) for i in range(first, last + 1)}
        assert seen == {i: i + int(np.argmin(h[i : i + w])) for i in range(n - w + 1)}


def test_urls(spark, sf):
    odd = [None, "", "x", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://www.example.com/en/", "http://a.www.example.com/en/?q", "http://example.com/En/", "https://m.free-bets.example.com#x", "ftp://free-bets.example.org?/en/", "x://net/es/1", "a://b://net/fr/", "http://notexample.com/en/", "http://a..net/fr/x", "http://.com/"]
    pages = spark.createDataFrame([(i, u, "h", "h", "x") for i, u in enumerate(odd)], "page_id bigint, url string, html string, host string, rule string")
    got = {r.page_id: r for r in urls.op3_url_filter(spark, sf(pages=pages)).collect()}
    for i, u in enumerate(odd):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = rest.split("#")[0].split("?")[0]
        host = rest.split("/")[0].lower()
        path = rest[len(host) :]
        fits = [(len(r), r, v) for r, v in urls.RULES for h, _, p in [r.partition("/")] if ("." + host).endswith("." + h) and path.startswith("/" + p)]
        site = any(("." + host).endswith("." + s) for s in urls.BLOCKED_SITES)
        want = (max(fits)[1:] if fits else (None, "block" if site else "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u
    assert urls.op3_url_filter(spark, sf(pages=pages.limit(0))).count() == 0
    assert urls.judge(pages, urls.listing(spark, (), ()).limit(0)).where("verdict = 'allow' and rule is null").count() == len(odd)


def test_urls_with_a_long_list_in_slices(spark, monkeypatch):
    """3,000 entries in slices of some 600; rules of many lengths, repeated ones, and one that is both allowed and blocked."""
    monkeypatch.setattr(urls, "SLICE_KEYS", 600)
    rng = random.Random(30)
    entries = [(f"h{rng.randrange(900)}.net", "block") for _ in range(1000)] + [(f"H{rng.randrange(900)}.net/{'p' * rng.randrange(5)}", rng.choice(["allow", "block"])) for _ in range(2000)] + [(None, "block")]
    rows = [(i, f"https://{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(1100)}.net/{'p' * rng.randrange(7)}") for i in range(4000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(entries, "entry string, verdict string")).collect()}
    sites, rules = {e for e, v in entries if e and "/" not in e}, {}
    for e, v in entries:
        if e and "/" in e:
            rules[e.lower()] = "block" if "block" in (v, rules.get(e.lower())) else v
    for i, url in rows:
        host, path = url[8:].split("/")
        host = ".".join(host.split(".")[-2:])
        fits = [f"{host}/{path[:n]}" for n in range(len(path), -1, -1) if f"{host}/{path[:n]}" in rules]
        want = (fits[0], rules[fits[0]]) if fits else (None, "block" if host in sites else "allow")
        assert (got[i].rule, got[i].verdict) == want, url


def test_cascade_is_exact_on_its_universe(spark):
    df = spark.range(40_000).select(F.xxhash64("id").alias("key_hash"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.build_cascade(df, Tables(spark, "t"))
    pdf = df.toPandas()
    assert (cascade.member(pdf["key_hash"].to_numpy()) == pdf["listed"].to_numpy()).all()
    assert sum(len(b) for b, _, _ in cascade.levels) < 40_000 and len(cascade.levels) > 2
    none = urls.build_cascade(df.withColumn("listed", F.lit(False)), Tables(spark, "t"))
    assert not none.member(pdf["key_hash"].to_numpy()).any()


def test_mixing(spark, make, sf):
    rng = random.Random(15)
    rows = [(i, prose(rng.randrange(1, 60), rng), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(400)] + [(900, None, "a"), (901, "", None), (None, "x y", "b"), (905, "again", "a"), (905, "again", "a")]
    got = mixing.op5_mix_sources(spark, sf(documents=make(rows))).collect()
    assert len(got) == len(rows)
    sizes, src, taken, target = defaultdict(int), {}, defaultdict(int), {}
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, want, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        free = total - sum(want.values())
        share = {s: free * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    want |= share
    by_id = {d: s for d, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixing.op5_mix_sources(spark, sf(documents=make(rows).repartition(5))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.op5_mix_sources(spark, sf(documents=make([]))).count() == 0
    repeated = mixing.repeat_by_mix(make(rows))
    assert repeated.columns == make(rows).columns
    mixed, words = repeated.collect(), defaultdict(int)
    for r in mixed:
        words[r.source] += len((r.text or "").split())
    assert all(abs(words[s] - want[s]) <= 60 for s in sizes)
    assert max(Counter((r.doc_id, r.text) for r in mixed if r.doc_id not in (None, 905)).values()) <= 3
    empty = mixing.repeat_by_mix(make([(1, "one two", "a"), (2, None, "a"), (3, "", "a"), (4, "x " * 500, "b")]))
    assert Counter(r.doc_id for r in empty.where("source = 'a'").collect()) == {1: 3, 2: 3, 3: 3}


def test_sharding(spark, make, sf):
    rows = [(i, prose(i % 9 + 1)) for i in range(997)] + [(None, None), (3, "same"), (3, "same"), (1200, "")]
    got = sharding.op10_shuffle_shards(spark, sf(documents=make(rows))).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(16)) and {len(v) for v in by.values()} <= {len(rows) // 16, len(rows) // 16 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(tuple, sharding.op10_shuffle_shards(spark, sf(documents=make(rows).repartition(7))).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert sharding.op10_shuffle_shards(spark, sf(documents=make([]))).count() == 0
    kept = sharding.shuffle_rows(make(rows), 3)
    assert kept.columns == [c for c in make(rows).columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, rows))
    assert sharding.shuffle_rows(make([]), 3).count() == 0


def test_sharding_in_levels(spark, monkeypatch):
    """More shards than one level deals into, down to more shards than rows: exact sizes, gapless slots."""
    monkeypatch.setattr(sharding, "FAN", 4)
    for shards in (1, 4, 5, 23, 64, 150):
        got = sharding.shuffle_into_shards(spark.range(1000).withColumnRenamed("id", "doc_id"), shards).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert set(by) == set(range(shards)) and {len(v) for v in by.values()} <= {1000 // shards, 1000 // shards + 1}
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sorted(r.doc_id for r in got) == list(range(1000))
    assert sharding.shuffle_into_shards(spark.range(3).withColumnRenamed("id", "doc_id"), 40).count() == 3


def test_communication_matrix_has_the_margins_and_the_law():
    total = np.zeros((3, 4))
    for seed in range(400):
        m = np.array(sharding.communication_matrix([30, 0, 70], [25, 25, 40, 10], seed))
        assert m.sum(1).tolist() == [30, 0, 70] and m.sum(0).tolist() == [25, 25, 40, 10] and (m >= 0).all()
        total += m
    assert np.allclose(total / 400, np.outer([30, 0, 70], [25, 25, 40, 10]) / 100, atol=0.6)
    rng = np.random.Generator(np.random.PCG64(1))
    big = [sharding.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 400_000) < 150 and 380 < np.std(big) < 600


def labelled(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        t = prose(rng.randrange(40, 200), rng)
        if kind == "junk":
            t = " ".join(w + rng.choice(["&&&", "###"]) for w in t.split())
        if kind == "toxic":
            w = t.split()
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["vilea", "vileb", "vilec"])
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_importance_held_out_accuracy(spark, make):
    docs, labels = labelled(1200, 21)
    seen = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id bigint, quality bigint, toxic bigint")
    got = importance.resample(make(docs).select("doc_id", "text"), seen, standard=importance.STANDARD).collect()
    good = {d: q == 1 and t == 0 for d, q, t in labels}
    share = sum(v for d, v in good.items() if d % 2) / 600
    assert sum(r.kept for r in got) == round(share * 1200)
    held = [r for r in got if r.doc_id % 2 == 0]
    assert np.mean([r.kept == good[r.doc_id] for r in held]) > 0.9


def test_importance_on_odd_tables(spark, make, sf):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (2, None, None)], "doc_id bigint, quality bigint, toxic bigint")
    rows = [(1, "good words here"), (2, None), (3, ""), (3, ""), (None, "x " * 30_000)]
    assert importance.op4_importance_resample(spark, sf(documents=make(rows), labels=labels)).count() == 5
    assert importance.op4_importance_resample(spark, sf(documents=make([]), labels=labels)).count() == 0
    assert importance.op4_importance_resample(spark, sf(documents=make(rows), labels=labels.limit(0))).where("kept").count() == 0
    none = spark.createDataFrame([(None, "same")], "doc_id string, text string").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(9000)))).select("doc_id", "text")
    assert importance.resample(none, labels.limit(0), share=0.5).where("kept").count() in (0, 9000)  # one score and one id: kept alike


def test_kth_largest(spark):
    rng = random.Random(22)
    near = [1.0 + k * 2.0**-52 for k in range(6)]  # scores some ulps apart
    for values in ([rng.random() for _ in range(9000)], [1.0] * 60_000, [float(i % 3) for i in range(9000)], [rng.choice(near) for _ in range(60_000)]):
        ties = [rng.getrandbits(64) - (1 << 63) for _ in values]
        df, tables = spark.createDataFrame(list(zip(values, ties)), "score double, tie bigint"), Tables(spark, "t")
        order = sorted((-v, t) for v, t in zip(values, ties))
        for k in (1, 2500, len(values) - 1):
            score, last = importance.kth_largest(df, k, tables)
            assert (-score, last) == order[k - 1]
    same = spark.createDataFrame([(1.0, 7)] * 20_000, "score double, tie bigint")
    assert importance.kth_largest(same, 500, Tables(spark, "t")) == (1.0, 7)


def test_importance_against_brute_force(spark, make):
    """Weights by plain sums over the features of two smoothed models, and by the standard length; the k largest scores; ids null, repeated and not numbers."""
    docs, labels = labelled(300, 5)
    docs = [(f"doc {d}", t) for d, t in docs] + [(None, "a tie"), (None, "a tie"), ("doc 3", docs[3][1])]
    marks = spark.createDataFrame([(f"doc {d}", q, t) for d, q, t in labels if d % 2], "doc_id string, quality bigint, toxic bigint")
    good = {f"doc {d}" for d, q, t in labels if d % 2 and q == 1 and t == 0}
    raw, target = Counter(), Counter()
    for d, t in docs:
        f = importance.features(t).tolist()
        raw.update(f)
        if d in good:
            target.update(f)
    n = importance.BUCKETS
    r, g = (np.array([c[k] for k in range(n)], dtype=float) for c in (raw, target))
    p_target = (g + (r + 1) / (r + 1).mean()) / (g.sum() + n)
    ratio = np.log(p_target) - np.log((r + 1) / (r.sum() + n))
    rows = spark.createDataFrame(docs, "doc_id string, text string")
    for standard in (None, 1000.0):
        got = importance.resample(rows, marks, standard=standard).collect()
        by_text = {d: t for d, t in docs}
        for x in got:
            f = importance.features(by_text[x.doc_id])
            want = ratio[f].sum() if standard is None else (ratio[f].sum() + 100 * (p_target * ratio).sum()) / (len(f) + 100) * standard
            assert x.log_weight == pytest.approx(want, rel=1e-9, abs=1e-6)
        k = round(len(good) / len({d for d, _, _ in labels if d % 2}) * len(docs))
        kept = sorted((x.score for x in got), reverse=True)[:k]
        assert sorted((x.score for x in got if x.kept), reverse=True)[:k] == kept and sum(x.kept for x in got) - k in (0, 1)


def test_declared_language_wherever_it_stands():
    assert language.declared("<!--" + "licence " * 2000 + "--><html class='x' xml:lang='de-AT'>") == "de"
    assert language.declared("<html " + "data-x='y' " * 1000 + 'lang="fr"><p lang="en">') == "fr"
    assert language.declared("<html><p lang='en'>") == "" and language.declared("<html " * 20_000) == ""


def test_language(spark, make, sf):
    rng = random.Random(23)
    words = {"en": ["the", "and", "with", "thing", "which"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "été", "avec", "pour", "eau"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 80), x) for i, x in enumerate(list(words) * 20)] + [(None, None, None)], "doc_id bigint, text string, lang string")
    pages, truth = [], {}
    for i in range(150):
        lang = rng.choice(list(words))
        truth[i] = lang
        body = say(lang, 40) if i % 5 else ""
        decl = f' lang="{lang}-XX"' if i % 3 else ""
        pages.append((i, f"http://{lang}.example.{lang}/p", f"<html{decl}><script>der und nicht</script><p>{body}</p>"))
    pages += [(900, None, None), (901, "http://x.de/", ""), (902, "", "<html lang='zz'>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("lang", F.lit("x"))
    got = {r.page_id: r for r in language.op8_language_id(spark, sf(pages=df, documents=docs)).collect()}
    assert len(got) == len(pages)
    assert np.mean([got[i].lang == truth[i] for i in truth]) > 0.97  # a fifth has no text: host, suffix and markup decide
    assert language.op8_language_id(spark, sf(pages=df.limit(0), documents=docs)).count() == 0
    assert language.op8_language_id(spark, sf(pages=df, documents=docs.limit(0))).where("lang is not null").count() == 0
