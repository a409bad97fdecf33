"""SimHash near-dedup with Golay-code fuzzy hashing.

A text's 64-bit fingerprint is the majority vote of the XXH64 hashes of its
4-word shingles.  Fingerprints link at ``max_bits`` (4) or fewer differing
bits, found exactly:

* The fingerprint has three segments of 22, 21 and 21 bits.  A segment, padded
  to 23 bits, is decoded by the perfect [23, 12, 7] Golay code.  Its keys are
  the indices of all codewords within distance 4: the nearest one, and five
  more if that is at distance 3.  Any two segments at distance 2 or less share
  a key (the tests check this for every error pattern).
* Pigeonhole: with errors a <= b <= c over the segments and a + b + c <= 4,
  a + b is 2 at most.  If a = 0, one segment is equal and another within 2:
  keys (segment i, Golay key of segment j), six kinds.  If a = b = 1, two
  segments have one error each, so one half of each is equal, and the third is
  within 2: keys (half of i, half of j, Golay key of k), twelve kinds.  Each
  kind has 33 to 35 bits, so unrelated fingerprints rarely meet.
* Rows (key, fingerprint) are sorted by key; fingerprints that share a key are
  compared, and the links joined by distributed union-find.

Scale: equal fingerprints are one row from the start, so copies cost nothing.
A bucket of more than ``bucket`` different fingerprints is not compared in
pairs.  Its members go by centres instead: two fingerprints are within 4 bits
if and only if some 64-bit value is within 2 of both, so every member emits the
2081 values within 2 of it and each value links its members in a star.  That
is linear in the members however large the group, and exact too.

Defined results: a null text has no words; texts without words have
fingerprint zero, linked like any other; every input row gives one output row,
repeated rows included; null ids are never a component's id unless it has no
other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import keyed, map_batches, stable, store, without
from orrery.llm.components import components

WORDS, MAX_BITS, BUCKET, SEED = 4, 4, 512, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
GENERATOR = 0b110001110101  # the binary Golay code's x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
CHUNK = 255 * 128


# ------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_digest

    w = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < words:
        return int.from_bytes(xxh64_digest(joined, SEED), "big")
    starts = list(accumulate((len(x) + 1 for x in w), initial=0))
    n, votes = len(w) - words + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = b"".join([xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], starts[at + words : to + words])])
        rows = -(-(to - at) // 255)
        hashes += b"\0" * (rows * 255 * 8 - len(hashes))
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(rows, 255, 64)
        votes += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # 255 ones fit a byte
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(rid, id, fp)`` per input row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(fp)], ["rid", "id", "fp"])

    rows = keyed(df, id_col, text_col)
    return map_batches(rows, run, f"rid bigint, id {rows.schema['id'].dataType.simpleString()}, fp bigint")


# -------------------------------------------------------------- Golay keys

def _remainder(v: int) -> int:
    while v.bit_length() > 11:
        v ^= GENERATOR << (v.bit_length() - 12)
    return v


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and by syndrome the error
    patterns that lead to all codewords within distance 4 (six columns, the
    first repeated where there is one)."""
    low = np.array([_remainder(v) for v in range(1 << 12)], dtype=np.int32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], dtype=np.int32)
    near: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            near[low[e & 0xFFF] ^ high[e >> 12]].append(e)
    return low, high, np.array([x + x[:1] * (6 - len(x)) for x in near], dtype=np.int64)


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of 23-bit values: n x 6."""
    low, high, near = golay()
    return (segment[:, None] ^ near[low[segment & 0xFFF] ^ high[segment >> 12]]) >> 11


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all different keys of unsigned fingerprints."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    half = [(s & 0x7FF, s >> 11) for s in seg]
    code = [codewords(s) for s in seg]
    # Columns that repeat the first one bring nothing.
    fresh = [np.concatenate([np.ones((len(fp), 1), bool), c[:, 1:] != c[:, :1]], axis=1) for c in code]
    rows, keys, kind = [], [], 0

    def add(exact: np.ndarray, j: int) -> None:
        nonlocal kind
        r, col = np.nonzero(fresh[j])
        keys.append((np.int64(kind) << 58) | (exact[r] << 12) | code[j][r, col])
        rows.append(r)
        kind += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                add(seg[i], j)
    for k in range(3):
        i, j = [x for x in range(3) if x != k]
        for a in half[i]:
            for b in half[j]:
                add((a << 11) | b, k)
    return np.concatenate(rows), np.concatenate(keys)


def first_kind(diff: np.ndarray) -> np.ndarray:
    """The first kind of key that two fingerprints within 4 bits are sure to
    share, by their difference (see the module's text); kinds as in ``bucket_keys``."""
    seg = [(diff >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    err = [np.bitwise_count(s) for s in seg]
    clean = [((s & np.uint64(0x7FF)) == 0, (s >> np.uint64(11)) == 0) for s in seg]
    sure = [(err[i] == 0) & (err[j] <= 2) for i in range(3) for j in range(3) if i != j]
    for k in range(3):
        i, j = [x for x in range(3) if x != k]
        sure += [a & b & (err[k] <= 2) for a in clean[i] for b in clean[j]]
    return np.argmax(np.stack(sure), axis=0)


# ------------------------------------------------------------------- links

def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, values, whole) of rows sorted by key: whole runs of at most
    ``limit`` rows together, and parts of longer runs as they come."""
    keys = values = np.zeros(0, dtype=np.int64)
    long_key = None
    for batch in batches:
        k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if long_key is not None and len(k):
            n = int(np.searchsorted(k != long_key, True))
            if n:
                yield k[:n], v[:n], False
                k, v = k[n:], v[n:]
            if len(k):
                long_key = None
        keys, values = np.concatenate([keys, k]), np.concatenate([values, v])
        if not len(keys):
            continue
        tail = int(np.searchsorted(keys, keys[-1]))  # keys are sorted
        yield keys[:tail], values[:tail], True
        keys, values = keys[tail:], values[tail:]
        if len(keys) > limit:
            long_key = keys[0]
            yield keys, values, False
            keys = values = np.zeros(0, dtype=np.int64)
    if len(keys):
        yield keys, values, True


def _forest(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: as many rows as nodes at most."""
    nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    x, y = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints within ``max_bits`` (0,
    2 or 4) of each other; fps has one row per different fingerprint."""
    if max_bits not in (0, 2, 4):
        raise ValueError("the Golay keys hold for 4 bits at most, the centres of large buckets for even distances")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp")[at : at + 4096].to_numpy(zero_copy_only=False)
                rows, keys = bucket_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links in small buckets; (member, null) for those of large ones."""
        for keys, fp, whole in _runs(batches, bucket):
            a, b, large = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if not whole:
                large.append(fp)
            elif len(keys):
                edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                size = np.diff(np.append(edge, len(keys)))
                big = np.repeat(size > bucket, size)
                large.append(fp[big])
                left = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(edge, size)) - 1  # members after this one
                left[big] = 0
                at, step = np.flatnonzero(left >= 1), 1
                while len(at):
                    x, y = fp[at], fp[at + step]
                    diff = (x ^ y).view(np.uint64)
                    near = np.flatnonzero(np.bitwise_count(diff) <= max_bits)
                    # Pairs meet under many keys; each counts under one kind.
                    near = near[first_kind(diff[near]) == keys[at[near]] >> 58]
                    a.append(x[near])
                    b.append(y[near])
                    step += 1
                    at = at[left[at] >= step]
            x, y = _forest(a, b)
            m = np.unique(np.concatenate(large))
            if len(x) + len(m):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x, m])), pa.concat_arrays([pa.array(y), pa.nulls(len(m), pa.int64())])], ["a", "b"])

    keys = map_batches(fps.select("fp"), emit, "key bigint, fp bigint")
    found = store(map_batches(keys.repartition("key").sortWithinPartitions("key"), compare, "a bigint, b bigint").distinct(), "simhash-links")
    near = found.where("b IS NOT NULL")
    members = found.where("b IS NULL").select("a")
    if members.isEmpty():
        return near
    return near.union(_by_centres(members, max_bits))


def _by_centres(members: DataFrame, max_bits: int) -> DataFrame:
    """Links of members of large buckets by common values within half the distance."""
    near = max_bits // 2
    masks = np.array([sum(1 << p for p in c) for k in range(near + 1) for c in combinations(range(64), k)], dtype=np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                fp = batch.column(0)[at : at + 64].to_numpy(zero_copy_only=False)
                centre = (fp.view(np.uint64)[:, None] ^ masks[None, :]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(np.repeat(fp, len(masks)))], ["centre", "fp"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = hub = None
        for batch in batches:
            k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            first = np.concatenate([[last_key is None or k[0] != last_key], k[1:] != k[:-1]])
            run = np.cumsum(first)
            hubs = np.concatenate([[0 if hub is None else hub], v[first]])[run]
            last_key, hub = k[-1], hubs[-1]
            a, b = _forest([v[~first]], [hubs[~first]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    centres = map_batches(members, emit, "centre bigint, fp bigint").repartition("centre").sortWithinPartitions("centre", "fp")
    return map_batches(centres, star, "a bigint, b bigint")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(rid, id, fp, root, component_id)`` per input row; component_id is the
    smallest id of all rows that links lead to, root a fingerprint that names
    the component even if all its ids are null."""
    rows = store(fingerprints(df, id_col, text_col, words), "fingerprints")
    fps = store(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(fps, max_bits))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = store(named.join(ids, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return rows.join(named, "fp").select("rid", "id", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df``, all columns, without those that have another of their
    group before them: the row with the smallest id stays (null ids last, then
    the first in scan order)."""
    df = stable(df)
    groups = store(near_groups(df, id_col, text_col, words, max_bits), "simhash-groups")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
    best = store(groups.groupBy("root").agg(F.min(order).alias("keep")), "simhash-keepers")
    dropped = groups.select("root", "rid").join(best, "root").where(F.col("rid") != F.col("keep.rid")).select("rid")
    return without(df, dropped)
