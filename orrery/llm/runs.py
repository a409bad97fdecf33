"""Periodic runs of words, found by internal pattern matching.

A text's words are the stretches without ASCII white space.  A run is a stretch
of words with smallest period q, at least ``max(MIN_LENGTH, TIMES * q)`` words
long, that no neighbouring word extends with the same period.

* Suffix array by prefix doubling: after round k positions are ranked by their
  next 2^k words, and only those that are not alone yet are sorted further.  The
  document's number is the first key, so all documents of a batch have one array
  in which each one's suffixes lie together and no match leaves its document.
* Dyadic blocks: at round k the blocks of m = 2^k words at multiples of m.  A
  block's rank is its interval in the suffix array.
* Wavelet tree over the suffix array: the first entry of an interval at or after
  a place (range successor) and the last one before it give the block's nearest
  occurrences in the windows of m words after and before it.
* Occurrences within such a window overlap the block, so they form an
  arithmetic progression; the nearest gives its difference, the candidate
  period q.  A run of period q holds, of the blocks with q < m <= 2q, a whole one
  whose next or previous copy, q words away, lies in the run too: the run is at
  least 4q long, the block starts within its first m words, and no nearer copy
  exists since the run's first q words are primitive.  So every run is found.
* Candidates of one period that overlap by q words are joined, extended word by
  word to both sides, and kept if long enough and of no smaller period.

Scale: no shuffle; a task holds one batch of whole documents (``BATCH`` words, or
one longer document).  Sorting and queries take O(n log n) array steps.

Defined results: a null or empty text has no words and no run; each input row
gives one output row, repeated rows included; ties between the strongest runs go
to the smallest start, then the smallest period; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.common import keyed, map_batches

MIN_LENGTH, TIMES, BATCH = 6, 4, 1 << 17
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def words_of(row_id: object, text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8: bytes.split() knows ASCII white space only."""
    return (text or "").encode().split()


# ------------------------------------------------- suffix array and blocks

def dyadic_blocks(symbols: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Suffix array of ``symbols`` and, for m = 2, 4, ... up to ``most``, the
    dyadic blocks of m symbols that occur again: (m, place, low, high), where
    [low, high) is the block's interval in the suffix array.

    Suffixes are sorted as far as blocks ask for it.  The last symbol of each
    document must be one that occurs nowhere else.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    key = symbols[sa]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(first)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = start[np.cumsum(first) - 1]
    size = np.ones(n, dtype=np.int64)  # of the group that starts at a slot
    size[start] = np.diff(np.append(start, n))
    blocks, h = [], 1
    slots = np.flatnonzero(size[rank[sa]] > 1)
    while 2 * h <= most and len(slots):
        at = sa[slots]
        # A block that is not alone ends before its document does, so at + h is inside.
        key = rank[at] * n + rank[at + h]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(first)
        rank[at] = slots[start][np.cumsum(first) - 1]
        size[slots] = 1
        size[slots[start]] = np.diff(np.append(start, len(slots)))
        h *= 2
        slots = slots[size[rank[at]] > 1]
        place = sa[slots]
        place = np.sort(place[place % h == 0])
        if len(place):
            low = rank[place]
            blocks.append((h, place, low, low + size[low]))
    return sa, blocks


class WaveletTree:
    """Levels of bits of ``values`` (0 <= value < len(values)), highest first,
    each level stably parted into zeros and ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        now = values
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            now = np.concatenate([now[~one], now[one]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[low:high] are smaller than x, for arrays of queries."""
        count = np.zeros(len(low), dtype=np.int64)
        over = x >> self.bits > 0
        count[over] = (high - low)[over]
        for k, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - k)) & 1 == 1
            a, b, total = zeros[low], zeros[high], zeros[-1]
            count += np.where(one & ~over, b - a, 0)
            low, high = np.where(one, low - a + total, a), np.where(one, high - b + total, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[low:high]."""
        found = np.zeros(len(low), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b, total = zeros[low], zeros[high], zeros[-1]
            one = k >= b - a
            found |= one.astype(np.int64) << (self.bits - 1 - level)
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, low - a + total, a), np.where(one, high - b + total, b)
        return found

    def neighbours(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of values[low:high], which hold x: the next smaller and the next larger
        one than x; x itself where there is none."""
        before = self.below(low, high, x)
        left, right = x.copy(), x.copy()
        has = np.flatnonzero(before > 0)
        left[has] = self.smallest(low[has], high[has], before[has] - 1)
        has = np.flatnonzero(before + 1 < high - low)
        right[has] = self.smallest(low[has], high[has], before[has] + 1)
        return left, right


# -------------------------------------------------------------------- runs

def _candidates(symbols: np.ndarray, most: int) -> dict[int, list[tuple[int, int]]]:
    """Stretches [from, to) with period q, by q: joined blocks and their copies."""
    sa, blocks = dyadic_blocks(symbols, most)
    if not blocks:
        return {}
    tree, period, begin, end = WaveletTree(sa), [], [], []
    for m, place, low, high in blocks:
        left, right = tree.neighbours(low, high, place)
        for other in (left, right):
            gap = np.abs(other - place)
            ok = np.flatnonzero((gap > 0) & (gap < m) & (2 * gap >= m))
            period.append(gap[ok])
            begin.append(np.minimum(place, other)[ok])
            end.append(np.maximum(place, other)[ok] + m)
    q, a, b = (np.concatenate(x) for x in (period, begin, end))
    order = np.lexsort((a, q))
    q, a, b = q[order], a[order], b[order]
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if len(q):
        # Of one period all stretches have one length, so the one before ends last.
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (b[:-1] - a[1:] < q[1:])])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(q)) - 1
        for i, j in zip(heads, tails):
            out[int(q[i])].append((int(a[i]), int(b[j])))
    return out


def _reach(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from x[a] and x[b] on are equal, walking by ``step``."""
    n, width = 0, 16
    while True:
        room = min(a, b) + 1 if step < 0 else len(x) - max(a, b)
        width = min(width, room)
        if width <= 0:
            return n
        one = x[a - width + 1 : a + 1][::-1] if step < 0 else x[a : a + width]
        two = x[b - width + 1 : b + 1][::-1] if step < 0 else x[b : b + width]
        differ = np.flatnonzero(one != two)
        if len(differ):
            return n + int(differ[0])
        n, a, b, width = n + width, a + step * width, b + step * width, width * 2


def _factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + ([q] if q > 1 else [])


def runs_of(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, given as arrays
    of word numbers >= 0, in order of start and period."""
    lengths = np.array([len(d) + 1 for d in documents], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    words = int(max((d.max() for d in documents if len(d)), default=0)) + 2
    symbols = np.empty(edges[-1], dtype=np.int64)
    for i, d in enumerate(documents):
        symbols[edges[i] : edges[i + 1] - 1] = d + (i * words + 1)
        symbols[edges[i + 1] - 1] = i * words  # ends the document
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not len(symbols):
        return found
    longest = int(lengths.max()) - 1
    for q, stretches in _candidates(symbols, max(2, 2 * (longest // TIMES))).items():
        done = -1
        for a, b in stretches:
            if b <= done:  # inside the run found before
                continue
            a -= _reach(symbols, a - 1, a - 1 + q, -1)
            b += _reach(symbols, b - q, b, 1)
            done = b
            if b - a < max(MIN_LENGTH, TIMES * q):
                continue
            x = symbols[a:b]
            if any((x[: -(q // p)] == x[q // p :]).all() for p in _factors(q)):
                continue  # the period is no smallest one
            i = int(np.searchsorted(edges, a, side="right")) - 1
            found[i].append((int(a - edges[i]), b - a, q))
    return [sorted(set(x), key=lambda r: (r[0], r[2])) for x in found]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _batches(rows: Iterator[tuple], split: Callable) -> Iterator[list[tuple]]:
    """Rows (rid, id, words) in batches of about BATCH words."""
    out, n = [], 0
    for rid, row_id, text in rows:
        words = split(row_id, text)
        if out and n + len(words) > BATCH:
            yield out
            out, n = [], 0
        out.append((rid, row_id, words))
        n += len(words)
    if out:
        yield out


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: Callable = words_of) -> DataFrame:
    """``(rid, id, n_words, runs, best, collapsed)`` per input row: all runs by
    start and period, the strongest one or null, and the text with each run cut
    to its first period, words joined by one space.  ``split`` (id, text) gives
    the words."""
    rows = keyed(df, id_col, text_col)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def struct(x: tuple[int, int, int] | None) -> dict | None:
        return None if x is None else dict(zip(("start", "length", "period"), x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def flat():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("id").type
                for i in range(batch.num_rows):
                    yield tuple(batch.column(c)[i].as_py() for c in ("rid", "id", "text"))

        for group in _batches(flat(), split):
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            docs = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for _, _, w in group]
            runs = runs_of(docs)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in group], pa.int64()), pa.array([r[1] for r in group], id_type),
                pa.array([len(r[2]) for r in group], pa.int64()),
                pa.array([[struct(x) for x in rs] for rs in runs], pa.list_(run_type)),
                pa.array([struct(strongest(rs)) for rs in runs], run_type),
                pa.array([b" ".join(collapse(r[2], rs)).decode() for r, rs in zip(group, runs)], pa.string()),
            ], ["rid", "id", "n_words", "runs", "best", "collapsed"])

    schema = f"rid bigint, id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, best {RUN}, collapsed string"
    return map_batches(rows, run, schema)
