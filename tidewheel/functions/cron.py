"""Next fire of a cron expression, in UTC."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))
MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
WEEKDAYS = {d: i for i, d in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))}
DESCRIPTORS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
HORIZON_YEARS = 5
_every = re.compile(r"^@every\s+(.+)$")
_unit = re.compile(r"([0-9]*\.?[0-9]+)(h|ms|us|ns|m|s)")
_seconds = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def _number(text: str, names: dict[str, int]) -> int:
    if text.lower() in names:
        return names[text.lower()]
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"cron: {text!r} is not a number")
    return int(text)


def _values(text: str, low: int, high: int, names: dict[str, int]) -> tuple[frozenset[int], bool]:
    """The values of one field, and whether it is a plain star."""
    out: set[int] = set()
    star = False
    for part in text.split(","):
        span, slash, step_text = part.partition("/")
        step = _number(step_text, {}) if slash else 1
        if step < 1:
            raise ValueError(f"cron: step in {part!r} must be positive")
        if span in ("*", "?"):
            a, b = low, high
            star |= step == 1
        elif "-" in span:
            a, b = (_number(x, names) for x in span.split("-", 1))
        else:
            a = _number(span, names)
            b = high if slash else a
        if not low <= a <= b <= high:
            raise ValueError(f"cron: {part!r} is outside {low}-{high}")
        out.update(range(a, b + 1, step))
    return frozenset(out), star


@lru_cache(maxsize=4096)
def parse(expr: str):
    """Sets of values for minute, hour, day, month, weekday, with the stars of day and weekday; or a delay for ``@every``."""
    text = expr.strip()
    if m := _every.match(text):
        spans = _unit.findall(m[1])
        if not spans or "".join(a + b for a, b in spans) != m[1].strip():
            raise ValueError(f"cron: bad duration in {expr!r}")
        return timedelta(seconds=max(1, int(sum(float(a) * _seconds[b] for a, b in spans))))
    if text.startswith("@"):
        if text not in DESCRIPTORS:
            raise ValueError(f"cron: unknown descriptor {expr!r}")
        text = DESCRIPTORS[text]
    parts = text.split()
    if len(parts) != 5:
        raise ValueError(f"cron: {expr!r} needs five fields")
    names = ({}, {}, {}, MONTHS, WEEKDAYS)
    got = [_values(p, low, high, n) for p, (_, low, high), n in zip(parts, FIELDS, names)]
    return [v for v, _ in got], got[2][1], got[4][1]


def next_time(expr: str, after: datetime) -> datetime | None:
    """The first fire strictly after a time (naive times are UTC), or None if there is none within five years.

    Day and weekday are alternatives unless one of them is a star.
    """
    rule = parse(expr)
    after = after.replace(tzinfo=timezone.utc) if after.tzinfo is None else after.astimezone(timezone.utc)
    if isinstance(rule, timedelta):
        return (after + rule).replace(microsecond=0)
    return _next_minute(expr, after.replace(second=0, microsecond=0))


@lru_cache(maxsize=1 << 16)
def _next_minute(expr: str, after: datetime) -> datetime | None:
    """Rules count whole minutes, so many rows ask for the same one."""
    (minutes, hours, days, months, weekdays), any_day, any_weekday = parse(expr)
    t = after + timedelta(minutes=1)
    while t.year <= after.year + HORIZON_YEARS:
        if t.month not in months:
            t = (t.replace(day=1, hour=0, minute=0) + timedelta(days=32)).replace(day=1)
            continue
        by_day, by_weekday = t.day in days, (t.weekday() + 1) % 7 in weekdays
        if not (by_day and by_weekday if any_day or any_weekday else by_day or by_weekday):
            t = t.replace(hour=0, minute=0) + timedelta(days=1)
        elif t.hour not in hours:
            t = t.replace(minute=0) + timedelta(hours=1)
        elif t.minute not in minutes:
            t += timedelta(minutes=1)
        else:
            return t
    return None


def next_cron_time(expr: Column, after: Column) -> Column:
    """The next fire as a timestamp; null for a bad expression or none to come. Batched: a cron rule has no built-in function."""

    @F.pandas_udf("timestamp")
    def run(exprs: pd.Series, times: pd.Series) -> pd.Series:
        out = []
        for e, t in zip(exprs, times):
            try:
                got = None if e is None or pd.isna(t) else next_time(e, t.to_pydatetime())
            except ValueError:
                got = None
            out.append(None if got is None else got.replace(tzinfo=None))
        return pd.Series(out, dtype="datetime64[ns]")

    return run(expr, after)
