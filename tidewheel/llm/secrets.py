"""Secret scans: patterns, and an assignment-aware lexer for source and configuration text.

The lexer finds assignments (``name = literal``, ``name: literal``, ``"name": "literal"``, ``NAME := a + "b"``), keeps a table of the
constants that a text defines, propagates them through names and concatenations, and scores each literal by the
sensitivity of the name that it reaches. A literal that scores is a span, be it in the assignment itself or where a
constant that flows there was written.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.llm.common import named, per_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more: shorter runs are dropped, and runs never touch
KINDS = ("assign", "access", "hex", "lexed")

#: Words of a name, and how much each says that it holds a secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "auth": 2, "bearer": 2, "private": 1, "access": 1, "api": 1,
    "key": 2, "signing": 1, "encryption": 1, "client": 1, "salt": 1,
}
#: Words of a name that say it holds something about a secret and not the secret.
HARMLESS = {"public": -3, "name": -2, "id": -2, "length": -3, "len": -3, "count": -3, "max": -2, "min": -2, "type": -2, "path": -2, "file": -2, "url": -2, "field": -2, "header": -2, "expires": -3, "ttl": -3}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|nil|true|false|todo|test|dummy|example|sample|placeholder|changeme|change_me|your.*|my[-_ ]?.*|<.*>|\$\{?.*|%.*%|\{\{.*)$")
LEAST_SCORE, LEAST_LENGTH = 4.5, 6

_operator = re.compile(r":=|=>|[=:]")
_first = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_in_name = _first | frozenset("0123456789.-")
_term = re.compile(r"""[ \t]*(?:([rbuf]{0,2})("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|([A-Za-z_$][A-Za-z0-9_$.]*)(?![A-Za-z0-9_$.(+/=\-])|([A-Za-z0-9+/_.=\-!@#%^&*~]+))""")
_join = re.compile(r"[ \t]*(?:\+|\.\.|\|\||(?=[\"']))")
_parts = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    """Sensitivity of a target name: of its last dotted part, split at underscores, dashes and capitals."""
    parts = [p.lower() for p in _parts.findall(re.split(r"[.$]", name)[-1])]
    pairs = ["".join(p) for p in zip(parts, parts[1:])]
    return sum(SENSITIVE.get(p, 0) + HARMLESS.get(p, 0) for p in parts) + sum(SENSITIVE.get(p, 0) for p in pairs)


def literal_score(value: str) -> float:
    """Up to 3 for a literal that looks made by a machine; below 0 for what can't be a secret."""
    if len(value) < LEAST_LENGTH or " " in value or "\t" in value or PLACEHOLDER.match(value):
        return -9.0
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(bits, 4.0) / 2 + (kinds - 1) / 2


def name_before(text: str, end: int) -> str:
    """The name, quoted or not, that ends before ``end``; empty if there is none. Read backwards: names have no operators, so all names of a text are linear."""
    if text[end - 1 : end] == "\n":
        end -= 1
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    begin = end
    while begin and text[begin - 1] in _in_name:
        begin -= 1
    while begin < end and text[begin] not in _first:
        begin += 1
    return text[begin:end]


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans (code points, end exclusive, quotes left out) of the literals that reach a sensitive name."""
    constants: dict[str, list[tuple[int, int, str]]] = {}
    spans: set[tuple[int, int]] = set()
    done = 0
    for op in _operator.finditer(text):
        if op.start() < done or text[op.end() : op.end() + 1] == "=" or text[op.start() - 1 : op.start()] in ("=", "!", "<", ">"):
            continue
        if not (name := name_before(text, op.start())):
            continue
        at, quoted, bare = op.end(), [], []
        known: set[tuple[int, int, str]] = set()  # parts of constants: one that comes again adds nothing, or sums of sums would double
        while (term := _term.match(text, at)) is not None:
            at = term.end()
            if term[2] is not None:
                quoted.append((term.start(2) + 1, term.end(2) - 1, term[2][1:-1]))
            elif term[3] is not None and term[3] in constants:
                new = [part for part in constants[term[3]] if part not in known]
                known.update(new)
                quoted += new
            elif term[3] is not None or term[4] is not None:
                k = 3 if term[3] is not None else 4
                if op[0] != ":" or text[op.end() : op.end() + 1] in (" ", "\t"):
                    bare.append((term.start(k), term.end(k), term[k]))
            if (more := _join.match(text, at)) is None:
                break
            at = more.end()
        quoted = quoted or bare[:1]  # beside literals, bare words are names that the text does not define
        if not quoted:
            continue
        done = max(done, min(at, quoted[0][1]) if quoted[0][0] >= op.end() else 0)
        constants[name] = quoted
        if (score := name_score(name)) >= 2 and score + literal_score("".join(v for _, _, v in quoted)) >= LEAST_SCORE:
            spans.update((a, b) for a, b, v in quoted if b > a)
    return sorted(spans)


def scan(text: str | None) -> tuple:
    """n_assign, n_access, n_hex, base_sha256, spans. A null text is empty."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    n_assign = len(base)
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    n_access = len(base) - n_assign
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    n_hex = len(base) - n_assign - n_access

    def line(found):
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(found))

    more = [(a, 3, b) for a, b in lexed(text)] if "=" in text or ":" in text else []
    return n_assign, n_access, n_hex, hashlib.sha256(line(base).encode()).hexdigest(), line(base + more)


def secrets(text: Column) -> Column:
    """Counts and spans of each text, as a struct. A null text is an empty one and has no spans. Texts, names and literals of any length are read whole; repeated rows are told alike; spans that
    begin at one place come in the order of their kinds; other columns do not count, and an empty table gives an empty table."""
    return per_text(lambda texts: map(scan, texts), "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")(text)


def op9_secret_scan(spark, sf_dir: str):
    docs = named(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return docs.select("doc_id", secrets(F.col("text")).alias("s")).select("doc_id", "s.*")
