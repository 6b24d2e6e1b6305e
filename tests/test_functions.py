import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewheel.functions import cron, scalars as X
from tidewheel.functions.crypt import Codec, Keyring
from tidewheel.model import Capabilities

UTC = timezone.utc


@pytest.mark.parametrize(
    "expr, after, want",
    [
        ("0 * * * *", (2026, 1, 1, 0, 0), (2026, 1, 1, 1, 0)),
        ("*/15 9-17 * * mon-fri", (2026, 1, 2, 17, 50), (2026, 1, 5, 9, 0)),
        ("0 0 13 * 5", (2026, 1, 1, 0, 0), (2026, 1, 2, 0, 0)),
        ("0 0 */2 * 1", (2026, 1, 1, 0, 0), (2026, 1, 3, 0, 0)),
        ("30 4 29 2 *", (2026, 1, 1, 0, 0), (2028, 2, 29, 4, 30)),
        ("@daily", (2026, 12, 31, 23, 59), (2027, 1, 1, 0, 0)),
        ("@every 90s", (2026, 1, 1, 0, 0), (2026, 1, 1, 0, 1, 30)),
    ],
)
def test_cron_next(expr, after, want):
    assert cron.next_time(expr, datetime(*after, tzinfo=UTC)) == datetime(*want, tzinfo=UTC)


def test_cron_is_strict_and_matches_a_minute_walk():
    rng = random.Random(1)
    for _ in range(40):
        expr = f"{rng.randrange(60)} {rng.choice(['*', '3', '1-5'])} {rng.choice(['*', '7', '1,15'])} * {rng.choice(['*', '2', 'sun'])}"
        t = datetime(2025, 5, 3, 3, 7, tzinfo=UTC) + timedelta(minutes=rng.randrange(100_000))
        (mins, hours, days, months, dows), any_day, any_dow = cron.parse(expr)
        u = t + timedelta(minutes=1)
        while True:
            d, w = u.day in days, (u.weekday() + 1) % 7 in dows
            if u.minute in mins and u.hour in hours and u.month in months and ((d and w) if any_day or any_dow else (d or w)):
                break
            u += timedelta(minutes=1)
        assert cron.next_time(expr, t) == u


@pytest.mark.parametrize("bad", ["", "* * * *", "61 * * * *", "@never", "*/0 * * * *", "5-1 * * * *"])
def test_cron_refuses(bad):
    with pytest.raises(ValueError):
        cron.next_time(bad, datetime(2026, 1, 1))


def test_backoff_equals_the_step_by_step_rule(spark):
    grid = [(a, i, c, m) for a in (0, 1, 2, 5, 40) for i in (0, 500, 90_000) for c in (0.0, 0.5, 1.0, 3.0) for m in (0, 2_000)]

    def want(a, i, c, m):
        i, c, m = i or 1000, c or 2.0, m or 60_000
        d = float(i)
        for _ in range(1, max(a, 1)):
            d *= c
            if d >= m:
                return m
        return int(min(d, m))

    df = spark.createDataFrame(grid, "a int, i bigint, c double, m bigint")
    got = df.select("a", "i", "c", "m", X.backoff_ms(F.col("a"), F.col("i"), F.col("c"), F.col("m")).alias("d")).collect()
    assert all(r.d == want(r.a, r.i, r.c, r.m) for r in got)


def test_attributes(spark):
    rng = random.Random(2)
    rows = [({k: rng.choice(["", "x", "y"]) for k in "abc" if rng.random() < 0.6}, {k: rng.choice(["", "z"]) for k in "abcd" if rng.random() < 0.5}) for _ in range(100)]
    got = spark.createDataFrame(rows, "base map<string,string>, patch map<string,string>").select("base", "patch", X.merge_attributes(F.col("base"), F.col("patch")).alias("m")).collect()
    for r in got:
        want = {k: v for k, v in {**r.base, **r.patch}.items() if not (k in r.patch and v == "")}
        assert (r.m or {}) == want


def test_payloads_and_limits(spark):
    df = spark.createDataFrame([('a"b', '{"x":1}'), ("", "[1]"), (None, None)], "n string, p string")
    w = df.select("n", "p", X.wrap_payload(F.col("n"), F.col("p")).alias("w"))
    got = w.select("n", "p", *[c.alias(k) for k, c in zip(("n2", "p2"), X.unwrap_payload(F.col("w")))]).collect()
    assert [(r.n2, r.p2) for r in got] == [('a"b', '{"x":1}'), (None, "[1]"), (None, None)]
    cut = spark.createDataFrame([("abcdef",), ("éé",), ("ab",)], "t string").select(X.shorten(F.col("t"), 3).alias("s")).collect()
    assert [r.s for r in cut] == ["abc…", "é…", "ab"]
    assert (X.inbox_batch_limit(Capabilities()), X.inbox_batch_limit(Capabilities(80)), X.drain_limit(Capabilities(80)), X.advancement_budget(Capabilities())) == (100, 20, 30, 100)
    assert X.purge_statuses(["continued", "failed", "failed"]) == ("continued", "failed")
    with pytest.raises(ValueError):
        X.purge_statuses(["running"])


@pytest.mark.parametrize("version", [1, 2])
def test_encryption(spark, version):
    keys = {"k1": b"a" * 32, "k2": b"b" * 32}
    old, new = Codec(Keyring("k1", keys), version=version), Codec(Keyring("k2", keys), version=version)
    df = spark.createDataFrame([("one",), ("",), (None,), ("plain",)], "p string")
    boxed = df.select("p", old.encrypt(F.col("p")).alias("b"))
    got = boxed.select("p", new.decrypt(F.col("b")).alias("d")).collect()
    assert all(r.p == r.d for r in got)
    assert df.select(new.decrypt(F.col("p")).alias("d")).where("d = 'plain'").count() == 1  # not an envelope
    for codec in (Codec(Keyring("k2", {"k2": keys["k2"]})), Codec(Keyring("k1", {"k1": b"c" * 32}))):
        with pytest.raises(PySparkException):
            boxed.where("p = 'one'").select(codec.decrypt(F.col("b"))).collect()
    with pytest.raises(PySparkException):
        df.where("p = 'plain'").select(Codec(Keyring("k1", keys), strict=True).decrypt(F.col("p"))).collect()
