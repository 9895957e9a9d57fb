"""Secrets in texts, with linking of multi-part credentials.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are always spans.
Weak candidates - a random-looking token, an account name, an endpoint - mean nothing alone.
They are joined on position: a secret part (a token, or the span of an assignment or a
hexadecimal run) is linked if an identifier (an account name or access identifier) lies within
``REACH`` characters of it in the same scope. A linked token becomes a span, the account names
that a secret part meets become spans with it, and so do endpoints within its reach. A scope is a stretch of text
without a blank line. The join is a search in sorted positions, so no pairs are written, and
spans never leave their document, so nothing is shuffled.

Defined cases: a null text is empty and has no spans; equal spans of one kind occur once;
other columns are not read by the scan and are carried along by ``redact``; repeated rows
are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of equal start are listed: base kinds, then linked ones.
BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("token", "account", "endpoint")
KINDS = BASE_KINDS + LINKED_KINDS
#: Base kinds that are the secret part of a credential, as tokens are.
SECRET_KINDS = ("assign", "hex")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this finds what `+` finds at 24 or more
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ACCOUNT = re.compile(r"\b(?:user(?:name)?|login|account|client[_-]?id)[\"']?\x20*[:=]\x20*[\"']?[\w.@-]{3,}", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(
    r"\b[a-z][a-z0-9+]{1,15}://[^\s\"'<>]{3,}|\b(?:[a-z0-9-]{1,63}\.){1,6}(?:com|net|org|io|dev|cloud|internal|local)(?::\d{2,5})?\b"
)
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

MIN_ASSIGNED, MIN_ACCESS = 6, 20
#: Characters between complementary parts of one credential.
REACH = 300
#: Bits of entropy per character from which on a mixed token looks random.
MIN_ENTROPY = 3.5

Span = tuple[int, int, str]


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _looks_random(token: str) -> bool:
    kinds = (any(map(str.isupper, token)), any(map(str.islower, token)), any(map(str.isdigit, token)))
    return all(kinds) and _entropy(token) >= MIN_ENTROPY


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the strong patterns."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def _near(span: Span, starts: list[int], others: list[Span], scope: list[int]) -> list[Span]:
    """Of other spans, sorted by start, those of the same scope that begin within reach."""
    own = bisect_right(scope, span[0])
    lower = max(span[0] - REACH, scope[own - 1] if own else 0)
    upper = min(span[1] + REACH, scope[own] if own < len(scope) else span[1] + REACH)
    return others[bisect_left(starts, lower) : bisect_left(starts, upper)]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that complement each other within a scope."""
    covered = sorted((s, e) for s, e, _ in base)
    begins = [s for s, _ in covered]
    reached = list(accumulate((e for _, e in covered), max))  # the furthest end of all spans so far

    def free(start: int, end: int) -> bool:
        k = bisect_left(begins, end)
        return not k or reached[k - 1] <= start

    tokens = [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if _looks_random(m[0]) and free(m.start(), m.end())]
    secrets = tokens + [s for s in base if s[2] in SECRET_KINDS]
    if not secrets:
        return []
    accounts = [(m.start(), m.end(), "account") for m in _ACCOUNT.finditer(text) if free(m.start(), m.end())]
    identifiers = sorted(accounts + [s for s in base if s[2] == "access"])
    if not identifiers:
        return []
    endpoints = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    scope = [m.end() for m in _BLANK_LINE.finditer(text)]
    id_starts, end_starts = [s[0] for s in identifiers], [s[0] for s in endpoints]
    found: set[Span] = set()
    for secret in secrets:
        met = _near(secret, id_starts, identifiers, scope)
        if met:
            if secret[2] == "token":
                found.add(secret)
            found.update(s for s in met if s[2] == "account")
            found.update(_near(secret, end_starts, endpoints, scope))
    return list(found)


def find_spans(text: str | None) -> list[Span]:
    """All spans in order of start, then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spans(text: Column) -> Column:
    """Array of spans (start, end, kind) in code points, end exclusive."""

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t)] for t in texts])

    return found(text)


def _redacted(text: str) -> str:
    out, at = [], 0
    for start, end, kind in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; the column ``length``, if
    there is one, is counted anew."""

    @F.pandas_udf("string")
    def masking(texts: pd.Series) -> pd.Series:
        return texts.map(_redacted, na_action="ignore")

    columns = docs.columns
    masked = docs.withColumn(text, masking(docs[text]))
    if length in columns:
        kind = docs.schema[length].dataType
        masked = masked.withColumn(length, F.char_length(F.col(text)).cast(kind))
    return masked


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and ``spans``."""
    return docs.select(docs[id], spans(docs[text]).alias("spans"))


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts and digests of a scan's spans, in built-in functions."""
    listed = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id,
        *(count(kind) for kind in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, listed), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", listed), ",").alias("spans"),
    )
