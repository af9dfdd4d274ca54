"""Secret scan with multipart credential linking.

Base spans, each kind leftmost and non-overlapping: ``assign`` (a secret's name and its value), ``access``
(access identifiers with a known prefix), ``hex`` (long hexadecimal runs). They are reported as they are.

Weak parts say little alone: an ``identifier`` (user, mail, client or key id with its value, or a temporary
access key's id), a ``secret`` (a mixed run of letters and digits of at least a key's length, also right after
``NAME=``, or a secret's name with a value of any length), an ``endpoint`` (URL or host). The user, the password
and the host of a URL that holds all three are one part of each kind. A named value must look like one: after
``=``, quoted, with a digit or a sign, or alone on its line; "password: must be long" in running text is none.
Parts are joined as intervals: each reaches ``reach`` code points to both sides, within its scope. Scopes end
at blank lines, but for those between two lines that assign a value to a name. A weak secret is reported when an identifier (weak or access) is in reach, a weak identifier when a
secret (weak, assign or hex) is, an endpoint when both are. Weak parts that overlap a base span or a
reported stronger part are left out.

Spans are code points, end exclusive. Null text counts as empty. Work is per document and never leaves it:
sorted starts and binary search, so a text with many parts costs n log n. Empty input gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 200
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
MASK = "[secret]"
LINE = 4_096  # code points of a line that assigns, at most; longer lines count as running text

# Patterns of the contract and the least lengths of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_WHOLE = 12, 18

IDENTIFIER = re.compile(
    r"""(?<![a-z])(?:user(?:_?name)?|uid|login|e?-?mail|account(?:_?name)?|client_?id|access_?key_?id|key_?id|tenant)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]{3,})""",
    re.I | re.A,
)
TEMPORARY = re.compile(r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])")
IN_URL = re.compile(r"""://([^\s:/@"'<>]+):([^\s/"'<>]+)@([^\s/@"'<>]+(?:[/?#][^\s"'<>]*)?)""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
LABELLED = re.compile(
    r"""(?:password|passwd|secret|token|api_?key|(?<![a-z])(?:pwd|pass(?:phrase)?))["']?\x20*[:=]\x20*"""
    r"""(?:"(?:[^"\\\n]|\\.)++"|'(?:[^'\\\n]|\\.)++'|["']?[^\s"'<>;&,]*[^\s"'<>;&,)\]}])""",
    re.I | re.A,
)
ENDPOINT = re.compile(
    r"""(?:https?|amqps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|s3|sftp)://[^\s"'<>]+|(?<![a-z])(?:host(?:_?name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""",
    re.I | re.A,
)
BLANK_LINES = re.compile(r"\n[\x20\t\r]*\n")
# A line that assigns a value to a name: whole, and what may stand before the name on it.
ASSIGNING = re.compile(r"""[\x20\t]*(?:export\x20+|-\x20+)?["']?[A-Za-z_][A-Za-z0-9_.-]*+["']?\x20*[:=]\x20*\S[^\n]*""", re.A)
BEFORE_NAME = re.compile(r"""\n[\x20\t]*(?:export\x20+|-\x20+)?["']?[A-Za-z0-9_.-]*\Z""", re.A)
PLAIN_VALUE = re.compile(r"[A-Za-z'\u2019-]*[.!?:]*")

Span = tuple[int, int, str]  # start, end, kind


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds, by start, then kind."""
    out = [
        (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE
    ]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_WHOLE]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def _mixed(value: str) -> bool:
    return (
        any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)
    )


class _Intervals:
    """Sorted intervals; tells whether one meets a range."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.furthest: list[int] = []
        for _, end in spans:
            self.furthest.append(max(end, self.furthest[-1]) if self.furthest else end)

    def meet(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.furthest[i - 1] > start


@dataclass(slots=True)
class Parts:
    """The parts of a text that linking looks at, none of a kind overlapping a stronger one."""

    identifiers: list[tuple[int, int]]
    secrets: list[tuple[int, int]]
    endpoints: list[tuple[int, int]]


def _told(text: str, start: int, end: int) -> bool:
    """Whether a named value looks like a value, not like the next words of a sentence."""
    piece = text[start:end]
    at = min(i for i in (piece.find(":"), piece.find("=")) if i >= 0)
    value = piece[at + 1 :].lstrip(" ")
    if piece[at] == "=" or value[0] in "\"'" or not PLAIN_VALUE.fullmatch(value):
        return True
    after = text[end : end + 1]
    before = text[start - 64 : start] if start > 64 else "\n" + text[:start]
    return after in ("", "\n", "\r", ",") and BEFORE_NAME.search(before) is not None


def weak_parts(text: str, base: list[Span]) -> Parts:
    """Candidates for links. Spans of the base, then endpoints, identifiers, named secrets, runs come first."""
    logins = list(IN_URL.finditer(text)) if "://" in text else []
    identifiers = [m.span() for m in IDENTIFIER.finditer(text)] + [m.span() for m in TEMPORARY.finditer(text)]
    if not identifiers and not logins and not any(kind == "access" for _, _, kind in base):
        return Parts([], [], [])  # every link needs an identifier
    free = lambda spans, used: [x for x in spans if not used.meet(*x)]
    named = _Intervals([(m.start(1), m.end(3)) for m in logins])
    all_base = _Intervals([(s, e) for s, e, _ in base])
    endpoints = free([m.span() for m in ENDPOINT.finditer(text)], named) + [m.span(3) for m in logins]
    endpoints = free(endpoints, all_base)
    users = free([m.span(1) for m in logins], all_base)
    identifiers = free(identifiers, _Intervals([(s, e) for s, e, k in base if k != "assign"]))
    identifiers = free(free(identifiers, _Intervals(endpoints)), named) + users
    identifiers = _apart(identifiers)
    secrets = free([m.span(2) for m in logins], all_base)
    taken = _Intervals([*((s, e) for s, e, _ in base), *endpoints, *identifiers, *secrets])
    labelled = [m.span() for m in LABELLED.finditer(text)]
    secrets += [x for x in free(labelled, taken) if _told(text, *x)]
    runs = [m.span() for m in WEAK_SECRET.finditer(text) if _mixed(m[0])]
    secrets += free(free(runs, taken), _Intervals(secrets))
    return Parts(identifiers, secrets, endpoints)


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start without those that begin inside the one kept before."""
    out: list[tuple[int, int]] = []
    for span in sorted(spans):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def scope_edges(text: str) -> list[int]:
    """Where scopes begin, and an edge past the end. Blank lines inside a block of assignments end none."""
    edges = [0]
    for m in BLANK_LINES.finditer(text):
        before = text.rfind("\n", max(0, m.start() - LINE), m.start()) + 1
        known = before > 0 or m.start() <= LINE
        if not (known and ASSIGNING.fullmatch(text, before, m.start()) and ASSIGNING.match(text, m.end())):
            edges.append(m.end())
    return [*edges, len(text) + 1]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts whose complementary parts are in reach within their scope."""
    parts = weak_parts(text, base)
    known = _Intervals([(s, e) for s, e, k in base if k == "access"] + parts.identifiers)
    hidden = _Intervals([(s, e) for s, e, k in base if k != "access"] + parts.secrets)
    edges = scope_edges(text) if parts.identifiers or parts.secrets or parts.endpoints else []

    def near(span: tuple[int, int]) -> tuple[int, int]:
        i = bisect.bisect_right(edges, span[0])
        return max(span[0] - reach, edges[i - 1]), min(span[1] + reach, edges[i])

    out = [(*x, "secret") for x in parts.secrets if known.meet(*near(x))]
    out += [(*x, "identifier") for x in parts.identifiers if hidden.meet(*near(x))]
    out += [(*x, "endpoint") for x in parts.endpoints if known.meet(*near(x)) and hidden.meet(*near(x))]
    return out


def spans_of(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one whole text."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base, reach), key=_order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str | None) -> str | None:
    """The text with every stretch covered by spans replaced by MASK."""
    if not text:
        return text
    out, at = [], 0
    for start, end, _ in spans_of(text)[1]:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end), n_base of every document."""
    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>, n_base bigint"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(base: list[Span], spans: list[Span]) -> tuple:
        return [{"kind": k, "start": s, "end": e} for s, e, k in spans], len(base)

    return _mapped(docs, schema, [kind, pa.int64()], rows)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (written) of every document."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def rows(base: list[Span], spans: list[Span]) -> tuple:
        kinds = [k for _, _, k in base]
        return (
            *(kinds.count(k) for k in KINDS[:3]),
            hashlib.sha256(written(base).encode()).hexdigest(),
            written(spans),
        )

    return _mapped(docs, schema, [pa.int64()] * 3 + [pa.string()] * 2, rows)


def _mapped(docs: DataFrame, schema: str, kinds: list, rows) -> DataFrame:
    names = [c for c in schema.split("doc_id bigint, ")[1].replace("struct<kind:string,start:bigint,end:bigint>", "").split(", ")]
    names = [c.split()[0] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rows(*spans_of(t)) for t in b.column("text").to_pylist()]
            values = list(zip(*found)) or [()] * len(names)
            arrays = [pa.array(v, k) for v, k in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *names])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text``; ``n_chars``, where present, follows. No row goes."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t) for t in texts], dtype=object)

    masked = docs.withColumn("text", F.pandas_udf(each, "string")(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn(
            "n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
        )
    return masked
