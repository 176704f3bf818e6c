"""Secret scans with linking of multipart credentials.

Plain patterns find assignments, access identifiers and long hexadecimal strings. Other parts of a
credential are too weak to report on their own: a random-looking string, another identifier (of a temporary key, a user, a client), or an
endpoint. Such a weak part is reported only when complementary parts co-occur. The parts of a text are joined by overlapping intervals,
each part's interval reaching SCOPE characters to both sides within its paragraph:

    weak_secret    with an access identifier, or another identifier
    identifier     with a secret: an assigned one, or a random-looking string
    endpoint       with a secret: an assigned one or a reported weak one; or a hexadecimal string that has an access identifier

A random-looking string and an address alone vouch for nothing: both are frequent in clean text.

Spans are in code points with the end left out. Scopes never reach over a document's end, so the
interval join runs within each row and nothing is moved.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm.words import pieces

#: Code points on each side of a part within which complementary parts are linked.
SCOPE = 400
#: Bits a character that a random-looking string has at least.
LEAST_ENTROPY = 3.5

ASSIGN, ACCESS, HEX, SECRET, ENDPOINT, NAMED = KINDS = ("assign", "access", "hex", "weak_secret", "endpoint", "identifier")
ORDER = {kind: i for i, kind in enumerate(KINDS)}
BASE_KINDS = KINDS[:3]

# Patterns on UTF-8; on bytes, ignoring case concerns the letters A-Z alone.
ASSIGNMENT = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
IDENTIFIER = re.compile(rb"AKIA[A-Z0-9]+")
# Shorter runs fail the length that a hexadecimal string needs, so they are not even matched.
LONG_HEX = re.compile(rb"[0-9a-f]{24,}")
WEAK = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
ADDRESS = re.compile(rb"""https?://[^\x00-\x20"'<>|]+|[a-z0-9.-]+\.[a-z]{2,6}:[0-9]{2,5}""")
# Identifiers of temporary keys, groups, roles and users, and assigned names.
OTHER = re.compile(
    rb"""A(?:SIA|GPA|ROA|IDA|NPA)[A-Z0-9]{12,}|(?:user(?:name)?|login|client[_-]?id|key[_-]?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    re.IGNORECASE,
)
PARAGRAPH = re.compile(rb"\n[\x20\t\r]*\n")
#: A text without any of these has no base span and no identifier, and so nothing to link.
HINT = r"(?i:password|passwd|secret|token|api_?key|user|login|client|key[_-]?id|account|A(?:SIA|GPA|ROA|IDA|NPA)[A-Z0-9]{12})|AKIA[A-Z0-9]|[0-9a-f]{24}"

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, in bytes."""
    found = [(ASSIGN, *m.span()) for m in ASSIGNMENT.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(ACCESS, *m.span()) for m in IDENTIFIER.finditer(text) if m.end() - m.start() >= 20]
    found += [(HEX, *m.span()) for m in LONG_HEX.finditer(text)]
    return found


def entropy(text: bytes) -> float:
    counts = np.bincount(np.frombuffer(text, np.uint8))
    share = counts[counts > 0] / len(text)
    return float(-(share * np.log2(share)).sum())


def random_looking(text: bytes) -> bool:
    """Small letters, capitals and digits, with the entropy of a key."""
    kinds = [any(a <= c <= b for c in text) for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))]
    return all(kinds) and entropy(text) >= LEAST_ENTROPY


def weak_parts(text: bytes, base: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """The candidates of each weak kind that no plain span, and no identifier, covers a part of."""
    found: dict[str, list[tuple[int, int]]] = {}
    taken = [(a, b) for _, a, b in base]
    for kind, pattern in ((NAMED, OTHER), (SECRET, WEAK), (ENDPOINT, ADDRESS)):
        taken.sort()
        starts = [a for a, _ in taken]
        furthest = list(accumulate((b for _, b in taken), max))
        spans = [m.span() for m in pattern.finditer(text) if kind != SECRET or random_looking(m.group())]
        before = [bisect.bisect_left(starts, b) for _, b in spans]
        found[kind] = [(a, b) for (a, b), i in zip(spans, before, strict=True) if not i or furthest[i - 1] <= a]
        if kind == NAMED:
            taken += found[kind]
    return found


def linked_spans(text: bytes, base: list[tuple[str, int, int]], places: np.ndarray, scope: int) -> list[tuple[str, int, int]]:
    """The weak parts that have their complements in reach; places are the code points of bytes."""
    weak = weak_parts(text, base)
    of = lambda kind: [(a, b) for k, a, b in base if k == kind]
    breaks = [m.start() for m in PARAGRAPH.finditer(text)]

    def with_one_of(parts: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The parts that have one of the others within scope and in their paragraph: a sweep over both, sorted."""
        others = sorted(others)
        starts = [places[a] for a, _ in others]
        widest = max((int(places[b] - places[a]) for a, b in others), default=0)
        near = []
        for a, b in parts:
            lo = bisect.bisect_left(starts, places[a] - scope - widest)
            hi = bisect.bisect_right(starts, places[b] + scope)
            paragraph = bisect.bisect_right(breaks, a)
            if any(places[y] + scope >= places[a] and bisect.bisect_right(breaks, x) == paragraph for x, y in others[lo:hi]):
                near.append((a, b))
        return near

    secrets = with_one_of(weak[SECRET], of(ACCESS) + weak[NAMED])
    named = with_one_of(weak[NAMED], of(ASSIGN) + weak[SECRET])
    ends = with_one_of(weak[ENDPOINT], of(ASSIGN) + secrets + with_one_of(of(HEX), of(ACCESS)))
    return [(kind, *s) for kind, spans in ((SECRET, secrets), (ENDPOINT, ends), (NAMED, named)) for s in spans]


def text_spans(text: bytes, scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """All spans of a text, in code points, by start, then kind."""
    base = base_spans(text)
    raw = np.frombuffer(text, np.uint8)
    places = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    found = base + linked_spans(text, base, places, scope)
    found = [(kind, int(places[a]), int(places[b])) for kind, a, b in found]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def find_secrets(documents: DataFrame, text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """The documents with `secrets`, an array of (kind, start, end); whole texts, one row for each row.

    Kinds: assign, access and hex by plain patterns; weak_secret, endpoint and identifier only where complementary parts
    co-occur within `scope` code points and a paragraph. A null or empty text has none. A given column
    of that name is replaced.
    """
    documents = documents.drop("secrets")
    names = documents.columns
    schema = T.StructType([*documents.schema.fields, T.StructField("secrets", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_column):
                texts = piece.column(text_column)
                hinted = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()
                spans = [
                    [dict(zip(("kind", "start", "end"), s, strict=True)) for s in text_spans(t.as_buffer().to_pybytes(), scope)]
                    if hint
                    else []
                    for t, hint in zip(texts, hinted, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in names], pa.array(spans, kind)], names=[*names, "secrets"]
                )

    return documents.mapInArrow(run, schema)


def listed(spans: F.Column) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, the number of spans of each plain kind, the digest of the plain spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        id_column,
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of plain spans, as `digest` gives it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE_KINDS).encode()).hexdigest()
