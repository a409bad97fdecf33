"""Secret scans with multipart credential linking.

A text is scanned for three strong kinds (``assign``, ``access``, ``hex``) and
for weak parts of credentials: identifiers (``ident``), unlabelled random
looking tokens (``secret``) and addresses (``endpoint``).  A weak part alone
means nothing, so weak parts are interval-joined inside their scope: each part
reaches ``reach`` code points to both sides but not beyond its paragraph
(paragraphs end at blank lines), and is reported only if the complementary
part lies within that reach:

* an identifier needs a secret (strong or weak) in reach,
* a weak secret needs an identifier or an endpoint in reach,
* an endpoint needs an identifier and a secret in reach.

The interval join is one binary search per part: spans are sorted by start, with
the furthest end so far.

Defined results: a null or empty text has no spans; every input row gives one
output row, repeated rows and null ids included; an empty table gives an
empty table; other columns of the input are ignored.  Rows are independent:
there is no shuffle, whole texts are read and memory is bounded by the longest
text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import keyed, map_batches

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
REACH = 400

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
IDENT = re.compile(r"""\b(?:access_?key_?id|client_?id|user(?:name)?|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.A | re.I)
IDENT_WORDS = ("key_id", "keyid", "client", "user", "login", "account")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", re.A)
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+)|(?:\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?)""", re.A | re.I)
ENDPOINT_WORDS = ("://", "host", "endpoint", "server")
PARAGRAPH_END = re.compile(r"\n[ \t]*\n")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _random_looking(s: str) -> bool:
    """Letters and digits mixed, at least 3.5 bits of entropy a character."""
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= 3.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strong kinds."""
    low = text.lower()
    out: list[tuple[str, int, int]] = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


class _Spans:
    """Sorted spans, and whether any overlaps [lo, hi): one binary search, by the
    furthest end of all spans up to a place."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.furthest = list(accumulate((e for _, e in spans), max))

    def meets(self, lo: int, hi: int) -> bool:
        i = bisect_left(self.starts, hi)
        return i > 0 and self.furthest[i - 1] > lo


def scan(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind as in ``KINDS``."""
    strong = base_spans(text)
    low = text.lower()
    ident = [m.span() for m in IDENT.finditer(text)] if any(w in low for w in IDENT_WORDS) else []
    token = [m.span() for m in TOKEN.finditer(text) if _random_looking(m[0])]
    ends = [m.span() for m in ENDPOINT.finditer(text)] if any(w in low for w in ENDPOINT_WORDS) else []
    weak: list[tuple[str, int, int]] = []
    if ident or token or ends:
        taken = _Spans([(s, e) for _, s, e in strong])
        token = [x for x in token if not taken.meets(*x)]
        cuts = [0, *(m.end() for m in PARAGRAPH_END.finditer(text)), len(text) + 1]
        by = {"ident": _Spans(ident + [(s, e) for k, s, e in strong if k == "access"]),
              "secret": _Spans(token + [(s, e) for k, s, e in strong if k in ("assign", "hex")]),
              "endpoint": _Spans(ends)}

        def has(kind: str, span: tuple[int, int]) -> bool:
            p = bisect_right(cuts, span[0])
            return by[kind].meets(max(span[0] - reach, cuts[p - 1]), min(span[1] + reach, cuts[p]))

        weak += [("ident", *x) for x in ident if has("secret", x)]
        weak += [("secret", *x) for x in token if has("ident", x) or has("endpoint", x)]
        weak += [("endpoint", *x) for x in ends if has("ident", x) and has("secret", x)]
    return sorted(strong + weak, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``(id, spans)`` per input row; spans: array of (kind, start, end) in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t.as_py() or "", reach)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(SPAN))], ["id", "spans"])

    rows = keyed(df, id_col, text_col).drop("rid")
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_secrets`` rows that reports use."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"),
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
