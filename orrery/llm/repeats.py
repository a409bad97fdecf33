"""Suffix-array dedup by longest-previous-factor arrays.

Finds every string of ``length`` (200) bytes that occurs more than once in the
corpus and marks the bytes that its copies cover.  ``keep="first"`` keeps the
first copy, in the order of (row, byte), and removes the later ones;
``keep="none"`` removes them all.  Copies may overlap, and matches never cross
documents.

The strings that start in a text are its windows.  For a window at place i, the
longest-previous-factor array holds the longest match with an earlier place; in
suffix order that is the match with the previous or with the next smaller
place.  A window has an earlier copy if LPF[i] >= length; mirrored (previous
and next larger places) the array tells of later copies.

A suffix array of the whole corpus would be sorted for the sake of text that
never repeats.  So windows are first dealt to places where copies must meet:

1. Each window has an anchor: its 32-byte gram with the smallest hash, leftmost
   first.  Equal windows have equal anchors at equal offsets.  Consecutive
   windows with one anchor form a segment of 200 to 368 bytes; (anchor hash,
   content hash) rows of segments are sorted once.  About one row per 85 bytes.
2. Segments with equal content are copies as they stand.  A map task joins
   those it meets itself, so a passage that a third of the corpus shares
   shuffles one row per task and segment, not one per occurrence.
3. Anchors with different contents are what suffix order is needed for (the
   ends of copies, edits inside them).  Only those segments' bytes are fetched,
   one of each content, and dealt in shards by anchor; each shard sorts its
   windows, and LPF and its mirror are computed in suffix order.
4. An anchor with more than ``SHARD_WINDOWS`` windows of different contents (a
   line that everybody quotes, each time among other text) is split: its
   segments are cut again by a second anchor under another hash, and a third,
   so that only windows that agree on all of them stay together.  What is too
   large after ``LEVELS`` anchors goes to an exact join by 128-bit window hash.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; repeated rows are copies of each other; null ids are passed on; an
empty table gives an empty table; other columns are ignored.  Memory is bounded
by a batch of texts, the longest text and a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import keyed, map_batches, stable, store

LENGTH, GRAM = 200, 32
BUFFER = 1 << 22  # bytes looked at together; places in it take 24 bits
SHARD_WINDOWS = 120_000
LEVELS = 6
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)
PLACE = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- segments

def gram_hashes(flat: np.ndarray, level: int = 0) -> np.ndarray:
    """64-bit hash of the 32-byte gram at each place, another one for each level;
    flat: bytes with 32 bytes of padding."""
    n = len(flat) - GRAM
    word = np.array(np.lib.stride_tricks.as_strided(flat[:8].view("<u8"), (n + GRAM - 8,), (1,)))
    x = word[:n] * np.uint64(FACTORS[0])
    for k in (1, 2, 3):
        x += word[8 * k : 8 * k + n] * np.uint64(FACTORS[k])
    x ^= x >> np.uint64(29)
    x *= np.uint64(FACTORS[4])
    x ^= x >> np.uint64(32)
    for k in range(level):
        x += np.uint64(FACTORS[k % 4])
        x *= np.uint64(FACTORS[4])
        x ^= x >> np.uint64(31)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(parts: list[bytes], length: int = LENGTH, level: int = 0) -> tuple[np.ndarray, ...]:
    """(part, first window, last window, anchor hash) of the segments of some
    texts, in order; together at most about BUFFER bytes."""
    sizes = np.array([len(p) for p in parts])
    flat = np.frombuffer(b"".join(parts) + b"\0" * GRAM, dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ok = sizes >= length
    if not ok.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    x = gram_hashes(flat, level)
    least = sliding_min((x & ~PLACE) | np.arange(len(x), dtype=np.uint64), length - GRAM + 1)
    # Runs of one anchor, cut at the texts' ends.
    n = int((base[ok] + sizes[ok] - length).max()) + 1
    edge = np.ones(n, dtype=bool)
    edge[1:] = least[1:n] != least[: n - 1]
    edge[base[ok]] = True
    depth = np.zeros(n + 1, dtype=np.int32)  # which places are windows of a text
    np.add.at(depth, base[ok], 1)
    np.add.at(depth, base[ok] + sizes[ok] - length + 1, -1)
    inside = np.cumsum(depth[:n]) > 0
    first = np.flatnonzero(edge & inside)
    part = np.searchsorted(base, first, "right") - 1
    # A text of no bytes shares its base with the next one.
    last = np.minimum(np.append(first[1:], n) - 1, base[part] + sizes[part] - length)
    return part, first - base[part], last - base[part], x[(least[first] & PLACE).astype(np.int64)]


def _pieces(raw: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of parts that hold each window once."""
    for at in range(0, max(1, len(raw) - length + 1), BUFFER):
        yield at, raw[at : at + BUFFER + length - 1]


def _first_of_runs(*cols: np.ndarray) -> np.ndarray:
    new = np.zeros(len(cols[0]), dtype=bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


SEGMENT = ["h", "c", "rid", "start", "end", "copied", "later"]
SEGMENT_SQL = "h bigint, c bigint, rid bigint, start int, end int, copied boolean, later boolean"


def _segment_batch(h, c, rid, start, end, copied, later, done) -> pa.RecordBatch:
    """done: the rows that are results already, which lose their hashes."""
    mask = np.broadcast_to(done, len(rid))
    return pa.RecordBatch.from_arrays(
        [pa.array(h, mask=mask), pa.array(c, mask=mask), pa.array(rid), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
         pa.array(np.broadcast_to(copied, len(rid))), pa.array(np.broadcast_to(later, len(rid)))], SEGMENT)


def _map_segments(length: int):
    def local(rows: list[tuple]) -> pa.RecordBatch:
        rid, start, end, h, c = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((start, rid, c, h))
        rid, start, end, h, c = rid[order], start[order], end[order], h[order], c[order]
        new = _first_of_runs(h, c)
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        copied = np.repeat(size > 1, size)
        return _segment_batch(h, c, rid, start, end, copied, ~new, ~new)  # later copies are results

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            rows: list[tuple] = []
            held: list[tuple[int, int, bytes]] = []
            size = 0

            def flush() -> None:
                nonlocal size
                part, first, last, h = segments([x[2] for x in held], length)
                if len(part):
                    c = np.array([digest(held[p][2][a : b + length]) for p, a, b in zip(part.tolist(), first.tolist(), last.tolist())], dtype=np.uint64)
                    rid, at = np.array([x[0] for x in held])[part], np.array([x[1] for x in held])[part]
                    rows.append((rid, first + at, last + at + length, h.view(np.int64), c.view(np.int64)))
                held.clear()
                size = 0

            for rid, raw in zip(batch.column("rid").to_pylist(), batch.column("raw")):
                for at, piece in _pieces(raw.as_py(), length):
                    if len(piece) >= length:
                        held.append((rid, at, piece))
                        size += len(piece)
                    if size >= BUFFER // 4:
                        flush()
            if held:
                flush()
            if rows:
                yield local(rows)

    return run


def _meet_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (h, c, rid, start): copies become results; of anchors
    with different contents the first segment of each goes on (``later`` null).

    Between batches only the first row of the last content is held."""
    held = None  # columns of that row
    mixed_h = None

    def out(cols, new, keep_last: bool):
        nonlocal mixed_h
        h, c, rid, start, end, copied = cols
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        many = np.repeat((size > 1) | np.logical_or.reduceat(copied, at), size)
        # Results: every row of a content with copies.
        yield _segment_batch(h[many], c[many], rid[many], start[many], end[many], True, ~new[many], True)
        contents = np.diff(np.append(np.flatnonzero(_first_of_runs(h[at])), len(at)))
        contents = np.repeat(contents, contents)
        mixed = contents > 1
        if mixed_h is not None:
            mixed |= h[at] == mixed_h
        mixed_h = int(h[at[-1]]) if mixed[-1] else None
        if keep_last:
            mixed[-1] = False
        go = at[mixed]
        if len(go):
            b = _segment_batch(h[go], c[go], rid[go], start[go], end[go], many[go], False, False)
            yield b.set_column(6, "later", pa.nulls(len(go), pa.bool_()))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        new = _first_of_runs(cols[0], cols[1])
        yield from out(cols, new, True)
        i = np.flatnonzero(new)[-1]
        held = [x[i : i + 1].copy() for x in cols]
        held[5] = np.array([bool(cols[5][i:].any() or len(new) - i > 1)])
    if held is not None:
        # Its results are out; only as one of several contents it may still go on.
        if mixed_h is not None and held[0][0] == mixed_h:
            b = _segment_batch(*held, False, False)
            yield b.set_column(6, "later", pa.nulls(1, pa.bool_()))


# --------------------------------------------------- longest previous factor

def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at places ``at`` by their first ``length`` bytes, and
    each one's common prefix with the one before it in that order."""
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[at]
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{length}").ravel(), kind="stable")
    rows = rows[order]
    lcp = np.zeros(len(at), dtype=np.int64)
    differ = rows[1:] != rows[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return order, lcp


def _nearest_smaller(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """In suffix order: the common prefix with the nearest entry before that has
    a smaller rank, 0 if there is none.  Pointers jump over larger ranks."""
    n = len(rank)
    prev, match = np.arange(n) - 1, lcp.copy()
    todo = np.flatnonzero((prev >= 0) & (rank[np.maximum(prev, 0)] > rank))
    while len(todo):
        via = prev[todo]
        match[todo] = np.minimum(match[todo], match[via])
        prev[todo] = prev[via]
        todo = todo[(prev[todo] >= 0) & (rank[np.maximum(prev[todo], 0)] > rank[todo])]
    return np.where(prev >= 0, match, 0)


def previous_factors(order: np.ndarray, lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """LPF of each suffix: its longest match with a suffix at a smaller place
    (up to the length that lcp goes to); place: unique number by suffix."""
    rank = place[order]
    before = _nearest_smaller(rank, lcp)
    after = _nearest_smaller(rank[::-1], np.append(0, lcp[:0:-1]))[::-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


def _spans(hit: np.ndarray, rid: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows (sorted by rid, start) as (rid, start, end)."""
    r, s = rid[hit], start[hit]
    new = np.zeros(len(r), dtype=bool)
    new[:1] = True
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
    i = np.flatnonzero(new)
    return r[i], s[i], s[np.append(i[1:], len(r)) - 1] + length if len(r) else s


FOUND_SQL = "rid bigint, start int, end int, later boolean, h bigint, raw binary"


def _shard_matches(length: int, most: int, level: int):
    """Segments of mixed anchors, sorted by anchor -> marked spans.  Segments of
    anchors beyond ``most`` windows go on (``later`` null): cut by one more
    anchor, or after the last level as single windows."""

    def spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        text = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
        n = np.array([len(r[3]) - length + 1 for r in rows])
        base = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])[:-1]])
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, rid = np.repeat(base, n) + inner, np.repeat([r[1] for r in rows], n)
        start = np.repeat([r[2] for r in rows], n) + inner
        by_place = np.lexsort((start, rid))
        place = np.empty(len(at), dtype=np.int64)
        place[by_place] = np.arange(len(at))
        order, lcp = suffix_order(text, at, length)
        earlier = previous_factors(order, lcp, place) >= length
        other = previous_factors(order, lcp, -place) >= length
        for hit, later in ((earlier, True), (other & ~earlier, False)):
            r, s, e = _spans(hit[by_place], rid[by_place], start[by_place], length)
            if len(r):
                yield _found(r, s, e, later)

    def _found(r, s, e, later, h=None, raw=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(r, pa.int64()), pa.array(np.asarray(s, dtype=np.int32)), pa.array(np.asarray(e, dtype=np.int32)),
             pa.array([later] * len(r), pa.bool_()), pa.nulls(len(r), pa.int64()) if h is None else pa.array(h),
             pa.nulls(len(r), pa.binary()) if raw is None else pa.array(raw, pa.binary())],
            ["rid", "start", "end", "later", "h", "raw"])

    def split(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [r[3] for r in rows]
        if level < LEVELS:
            part, first, last, h = segments(parts, length, level)
            h = (np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)[part] * np.uint64(FACTORS[1]) ^ h).view(np.int64)
        else:
            n = np.array([len(x) - length + 1 for x in parts])
            part, first = np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            last, h = first, np.zeros(len(part), dtype=np.int64)
        rid, start = np.array([r[1] for r in rows])[part], np.array([r[2] for r in rows])[part]
        raw = [parts[p][a : b + length] for p, a, b in zip(part.tolist(), first.tolist(), last.tolist())]
        yield _found(rid, start + first, start + last + length, None, h, raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        group: list[tuple] = []
        n_shard = n_group = 0
        over = None  # an anchor that is too large for a shard
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if group and row[0] != group[0][0]:
                    if over == group[0][0]:
                        yield from split(group)
                    elif len(group) > 1:  # one content alone has no match
                        shard, n_shard = shard + group, n_shard + n_group
                    group, n_group = [], 0
                    if n_shard >= most:
                        yield from spans(shard)
                        shard, n_shard = [], 0
                group.append(row)
                n_group += len(row[3]) - length + 1
                if n_group > most:
                    over = row[0]
                    yield from split(group)
                    group, n_group = [], 0
        if group and over == group[0][0]:
            yield from split(group)
        elif len(group) > 1:
            shard += group
        if shard:
            yield from spans(shard)

    return run


# ---------------------------------------------------------------- operator

def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``(rid, start, end, later)``: spans of repeated strings, which may
    overlap; later: the string has an earlier copy, else only later ones."""
    docs = keyed(stable(df), id_col, text_col).select("rid", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("raw"))
    local = store(map_batches(docs, _map_segments(length), SEGMENT_SQL), "segments")
    met = local.where("h IS NOT NULL").select("h", "c", "rid", "start", "end", "copied")
    met = met.repartition("h").sortWithinPartitions("h", "c", "rid", "start")
    met = store(map_batches(met, _meet_segments, SEGMENT_SQL), "segments-met")
    spans = local.where("h IS NULL").union(met.where("later IS NOT NULL")).select("rid", "start", "end", "later")
    wanted = met.where("later IS NULL").groupBy("rid").agg(F.collect_list(F.struct("h", "start", "end")).alias("want"))
    bytes_of = docs.join(wanted, "rid").select("rid", F.explode(F.transform(
        "want", lambda w: F.struct(w["h"].alias("h"), w["start"].alias("start"),
                                   F.substring("raw", w["start"] + 1, w["end"] - w["start"]).alias("raw")))).alias("w"))
    rows = bytes_of.select("w.h", "rid", "w.start", "w.raw")
    for level in range(1, LEVELS + 1):
        shards = rows.repartition("h").sortWithinPartitions("h", "rid", "start")
        found = store(map_batches(shards, _shard_matches(length, shard_windows, level), FOUND_SQL), "segments-found")
        spans = spans.union(found.where("later IS NOT NULL").select("rid", "start", "end", "later"))
        rows = found.where("later IS NULL").select("h", "rid", "start", "raw", "end")
        if rows.isEmpty():
            return spans
    windows = rows.select("rid", "start", "end", F.xxhash64("raw").alias("k1"), F.xxhash64(F.lit(1), "raw").alias("k2"))
    first = windows.groupBy("k1", "k2").agg(F.min(F.struct("rid", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = F.struct("rid", "start") != F.col("first")
    return spans.union(windows.join(first, ["k1", "k2"]).select("rid", "start", "end", later.alias("later")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "first",
                   shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept_sha256)`` per input row; spans: the
    maximal removed runs as an array of (start, end) in bytes."""
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    df = stable(df)
    found = repeated_spans(df, id_col, text_col, length, shard_windows)
    if keep == "first":
        found = found.where("later")
    found = found.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    docs = keyed(df, id_col, text_col).select("rid", "id", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("raw"))
    rows = docs.join(found, "rid", "left").select("id", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, out, sha = [], [], [], []
            for raw, spans in zip(batch.column("raw"), batch.column("spans")):
                raw, runs = raw.as_py(), []
                if spans.is_valid:
                    s, e = (spans.values.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.ones(len(s), dtype=bool)
                    new[1:] = s[1:] > e[:-1]
                    at = np.flatnonzero(new)
                    runs = list(zip(s[at].tolist(), e[np.append(at[1:], len(s)) - 1].tolist()))
                edges = [0, *(x for r in runs for x in r), len(raw)]
                sha.append(hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest())
                n.append(len(raw))
                removed.append(sum(b - a for a, b in runs))
                out.append([{"start": a, "end": b} for a, b in runs])
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.list_(span)), pa.array(sha, pa.string())],
                ["id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
