"""Secret scans with multipart credential linking.

Strong spans stand for themselves: assignments of long values, access key ids
and long hexadecimal runs.  Weak parts - account names, short or unnamed secret
values, endpoints - are reported only where complementary parts meet: around
each secret value, strong or weak, lies a scope (``REACH`` characters to both
sides, not beyond a blank line); an interval join of scopes with identifiers
and endpoints links them.  A weak secret needs an identifier or endpoint in its
scope; an identifier or endpoint needs a secret whose scope holds it.

Positions count code points, ends are exclusive.

Cases: a null text is an empty text and has no spans.  Repeated rows are each
scanned.  Very long texts are scanned whole, in time that grows with the text
and the links found.  Spans of one start stand in the order of their kinds.
Columns besides the text are not read; redaction changes the text and, where
there is one, ``n_chars``.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of kinds at one start.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
LEAST = {"assign": 12, "access": 18, "hex": 16}
REACH = 256
WEAK_LEAST = 6
REDACTED = "[REDACTED]"

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same spans as the long ones of [0-9a-f]+
_IDENTIFIER = re.compile(r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII)
_UNNAMED = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_BLANK = re.compile("(?=\n\n)")
_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{0,31}://[^\s"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b""")

Span = tuple[int, int, str]  # start, end, kind


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The strong spans, and assignments that are too short for one."""
    strong, short = [], []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            (strong if len(m[2]) >= LEAST["assign"] else short).append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        strong += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    strong += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(strong, key=_order), short


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


class _Cover:
    """The places that spans cover, as runs that don't meet."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[1]) - 1
        return k >= 0 and self.ends[k] > span[0]


def linked_spans(text: str, strong: list[Span], short: list[Span]) -> list[Span]:
    """The weak spans whose complement lies in a scope: a join of sorted intervals."""
    identifiers = [(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    endpoints = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)] if "://" in text or text.count(".") > 2 else []
    names = [s for s in strong if s[2] == "access"]
    partners = sorted(identifiers + endpoints + names)
    if not partners:
        return []
    taken = _Cover(strong)
    weak = [(a, b, "secret") for a, b, _ in short if b - a >= WEAK_LEAST and not taken.meets((a, b, ""))]
    taken = _Cover(strong + endpoints + weak)
    weak += [s for m in _UNNAMED.finditer(text) if not taken.meets(s := (m.start(), m.end(), "secret"))]
    starts, found = [p[0] for p in partners], set()
    blanks = [m.start() for m in _BLANK.finditer(text)] if "\n\n" in text else []
    for secret in [s for s in strong if s[2] != "access"] + weak:
        before = bisect_right(blanks, secret[0] - 2) - 1  # the last blank line that ends before the secret
        after = bisect_left(blanks, secret[1])
        low = max(blanks[before] + 2 if before >= 0 else 0, secret[0] - REACH)
        high = min(blanks[after] if after < len(blanks) else len(text), secret[1] + REACH)
        met = [p for p in partners[bisect_left(starts, low) : bisect_left(starts, high)] if p[1] <= high and not (p[0] < secret[1] and secret[0] < p[1])]
        if met:
            found.update([s for s in [secret] if s[2] == "secret"] + [p for p in met if p[2] != "access"])
    return list(found)


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), each by start, then kind."""
    text = text or ""
    strong, short = base_spans(text)
    return strong, sorted({*strong, *linked_spans(text, strong, short)}, key=_order)


def _told(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def secret_digest(text: Column) -> Column:
    """A struct: counts of the strong kinds, sha256 of the strong spans, all spans."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            strong, every = spans(text)
            kinds = [s[2] for s in strong]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_told(strong).encode()).hexdigest(), _told(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(text)


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: (doc_id, kind, start, end, found)."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,found:string>>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "found": t[a:b]} for a, b, k in spans(t)[1]] for t in texts])

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(scan(F.col(text_col))).alias("s")).select("doc_id", "s.*")


def redacted(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by one mark."""
    if not text or not (found := spans(text)[1]):
        return text
    out, at = [], 0
    for a, b, _ in found:
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows with their secrets replaced; all columns stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t) for t in texts], dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if size_col in docs.columns:
        changed = F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(size_col))
        out = out.withColumn(size_col, changed.cast(docs.schema[size_col].dataType))
    return out.select(docs.columns)
