"""Secret scan with multipart credential linking.

Base kinds are matched alone. Weak candidates - bare high-entropy values, account identifiers and endpoints - are
common in clean text, so each counts only when complementary parts stand near it: the parts of a document are intervals
of code points, joined where they overlap the interval of ``reach`` code points around each other, within a scope
(a block between blank lines). A weak secret needs an identifier or an endpoint in reach; an identifier or an endpoint needs a
secret. A document's parts never meet another document's, so the join runs inside the scan: no shuffle, no skew, memory
of one document.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; rows are handled one by one, so
repeated rows and null ids keep their place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts: an account identifier, a bare value, an endpoint.
IDENTIFIER = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|user(?:name)?|login|account(?:_?id)?|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+)|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.I | re.A)
#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")
REACH = 240
ENTROPY = 3.6

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; too short ones are dropped after matching."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def random_looking(value: str) -> bool:
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    n = len(value)
    return kinds == 3 and -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def scopes(text: str) -> list[int]:
    """Starts of blocks that blank lines set apart."""
    return [0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text))]


class Overlaps:
    """Which of some spans overlap an interval: spans by start, with the greatest end so far, so that one binary search tells."""

    def __init__(self, spans: list[Span]):
        self.starts = [s[0] for s in spans]
        self.ends = list(accumulate((s[1] for s in spans), max))

    def any(self, low: int, high: int) -> bool:
        """Whether a span begins before ``high`` and ends after ``low``."""
        i = bisect.bisect_left(self.starts, high)
        return i > 0 and self.ends[i - 1] > low


def near(spans: list[Span], parts: list[Span], starts: list[int], reach: int) -> list[bool]:
    """For each span, whether one of ``parts`` (ordered by start) overlaps the interval of ``reach`` code points around it, cut to its scope."""
    joined, out = Overlaps(parts), []
    for a, b, _ in spans:
        k = bisect.bisect_right(starts, a) - 1
        out.append(joined.any(max(starts[k], a - reach), min(starts[k + 1] if k + 1 < len(starts) else 1 << 62, b + reach)))
    return out


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that stand in one scope with their complements; a value within an identifier or an endpoint is part of it and no complement to it."""
    taken = Overlaps(base)
    found = lambda pattern, kind, test=None: [(m.start(), m.end(), kind) for m in pattern.finditer(text) if (test is None or test(m[0])) and not taken.any(m.start(), m.end())]
    values = found(VALUE, "value", random_looking)
    if not values and all(s[2] == "access" for s in base):
        return []
    identifiers, endpoints = found(IDENTIFIER, "identifier"), found(ENDPOINT, "endpoint")
    supports = sorted([s for s in base if s[2] == "access"] + identifiers + endpoints)
    if not supports:
        return []
    around = Overlaps(sorted(identifiers + endpoints))
    values = [v for v in values if not around.any(v[0], v[1])]
    starts = scopes(text)
    strong = [v for v, ok in zip(values, near(values, supports, starts, reach)) if ok]
    parts = sorted([s for s in base if s[2] != "access"] + strong)
    weak = identifiers + endpoints
    return strong + [s for s, ok in zip(weak, near(weak, parts, starts, reach)) if ok]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with each run of covered code points replaced by ``mask``."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row for each document: base counts and digest, all spans, and the text with the spans masked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, digests, spans, texts = [], {k: [] for k in KINDS[:3]}, [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, both = all_spans(text)
                ids.append(doc_id)
                for k in counts:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(render(base).encode()).hexdigest())
                spans.append(render(both))
                texts.append(redact(text, both) if both else text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(texts, pa.string())],
                [c.split(" ")[0] for c in SPANS.split(", ")],
            )

    return documents(docs).mapInArrow(scan, SPANS)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by a mask; null texts stay null."""

    @F.arrow_udf("string")
    def masked(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            spans = all_spans(text)[1] if text else []
            out.append(redact(text, spans) if spans else text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
