"""Near-duplicate documents by b-bit MinHash.

A text is the set of its word shingles (``WORDS`` words, A-Z in lower case; a
text of fewer words is one shingle).  Texts link at a Jaccard similarity of
``PERCENT`` hundredths or more; linked texts are one component.

* Signature: the smallest of all shingle hashes under each of ``HASHES``
  permutations.  ``BAND`` full minima make a band key; 25 bands of five miss a
  pair at 0.85 with a probability below 1e-6, closer ones less often.
* b-bit signature: only the lowest two bits of each minimum stay, 128 of them
  packed into four 64-bit words.
* Candidates: different sets that share a band key, have sizes that allow the
  similarity, and pass the estimate: equal two-bit places, counted by bit counts
  of the exclusive or, corrected for the quarter of places that are equal by
  chance.  ``least_equal`` places the cut where a pair at the threshold is lost
  with a probability below 1e-9.
* A bucket of up to ``BUCKET`` sets is compared in pairs.  In a larger one each
  set is compared with the first one and with the one before it, which ties dense
  groups together; then all sets of large buckets that are in different
  components are compared if they share one of their rarest shingles (a prefix
  filter with lengths and places, which loses no pair) and pass the estimate.
  No bucket is capped.
* Confirmation: the exact similarity of the full sets (64-bit hashes of the
  shingles), for the pairs that 1024-bit bitmaps of the sets do not rule out.
  Distributed union-find joins the links.

Scale: equal sets are one row from the start, by map-side combine.  Band keys
are shuffled with the number of their set alone; only the rows of keys that two
sets share get the signature (64 bytes) and are shuffled with it.  The rows of a
key that fills more than ``SPLIT`` rows are dealt to several tasks, each with an
own first set.  Only texts with candidates are read again for their sets, and a
set is shuffled only for pairs that its bitmap allows.

Defined results: a null text, or one without words, has an empty set, is linked
with nothing and names its own component; each input row gives one output row,
repeated rows included; null ids never name a component that has another id;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.common import RID, keyed, map_batches, stable, store
from orrery.llm.components import components

WORDS, PERCENT = 3, 85
HASHES, BAND, BITS = 128, 5, 2
BANDS = HASHES // BAND
BUCKET, SPLIT = 32, 100_000
VOCABULARY = 1 << 20  # hashes of words kept at hand
WORDS64 = [f"s{i}" for i in range(HASHES * BITS // 64)]
MARKS = [f"m{i}" for i in range(16)]  # 64-bit words of a set's bitmap
ODD = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------- shingles

class WordHashes(dict):
    """XXH64 of words, kept for the next texts."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    x = np.full(n, min(len(w), words), dtype=np.uint64)
    for k in range(min(len(w), words)):
        x = _mix(x * ODD + h[k : k + n])
    return np.unique(x)


# -------------------------------------------------------------- signatures

@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(13)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(x: np.ndarray) -> np.ndarray:
    """The smallest hash of a non-empty set under each permutation."""
    a, b = _permutations()
    y = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(y), 2048):
        np.minimum(out, (a[:, None] * y[None, at : at + 2048] + b[:, None]).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """Keys of the bands of rows of minima: rows x BANDS."""
    part = low[:, : BANDS * BAND].reshape(len(low), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(low), BANDS))
    for k in range(BAND):
        key = _mix(key * ODD + part[:, :, k])
    return key


def pack(low: np.ndarray) -> np.ndarray:
    """The lowest two bits of rows of minima, 32 places a word: rows x 4."""
    place = (low & np.uint32(3)).astype(np.uint64).reshape(len(low), -1, 32)
    return np.bitwise_or.reduce(place << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many two-bit places of packed rows are equal."""
    d = a ^ b
    return HASHES - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def estimate(equal: np.ndarray | int) -> np.ndarray | float:
    """Similarity by the share of equal places, corrected for equality by chance."""
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


@lru_cache(maxsize=8)
def least_equal(percent: int = PERCENT, lost: float = 1e-9) -> int:
    """The cut: pairs at the threshold have fewer equal places with probability ``lost`` at most."""
    chance = 1 / (1 << BITS)
    p, below = chance + (1 - chance) * percent / 100, 0.0
    for k in range(HASHES + 1):
        below += comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > lost:
            return k
    return HASHES


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(rid, id, n, k0, k1, bands, s0..s3)`` per input row: the set's size, a
    128-bit name of the set, its band keys and packed signature (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        hashes = WordHashes()
        for batch in batches:
            sizes, low, names = [], np.zeros((batch.num_rows, HASHES), dtype=np.uint32), []
            for i, t in enumerate(batch.column("text")):
                x = shingle_set(t.as_py(), hashes, words)
                sizes.append(len(x))
                names.append(xxh128_digest(x.tobytes()))
                if len(x):
                    low[i] = minima(x)
            some = np.array(sizes, dtype=np.int64) > 0
            none = ~some
            name = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
            packed, keys = pack(low).view(np.int64), band_keys(low).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(sizes, pa.int64()),
                 pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel())),
                 *[pa.array(packed[:, i].copy(), mask=none) for i in range(len(WORDS64))]],
                ["rid", "id", "n", "k0", "k1", "bands", *WORDS64])

    rows = keyed(df, id_col, text_col)
    schema = (f"rid bigint, id {rows.schema['id'].dataType.simpleString()}, n bigint, k0 bigint, k1 bigint, bands array<bigint>, "
              + ", ".join(f"{s} bigint" for s in WORDS64))
    return map_batches(rows, run, schema)


# -------------------------------------------------------------- candidates

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray]]:
    """(whole, rows): rows sorted by their first two columns, of which whole runs
    of up to BUCKET rows come together (whole), and longer ones in parts, each
    with the run's first row and the last row of the part before in front."""
    kept, hub, last = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if hub is not None:
            same = (new[:, :2] == hub[:2]).all(axis=1)
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                yield False, np.concatenate([hub[None], last[None], new[:n]])
                last, new = new[n - 1], new[n:]
            if not len(new):
                continue
            hub = None
        kept = new if kept is None else np.concatenate([kept, new])
        tail = int(np.argmax((kept[:, :2] == kept[-1, :2]).all(axis=1)))
        if tail:
            yield True, kept[:tail]
            kept = kept[tail:]
        if len(kept) > BUCKET:
            hub, last = kept[0], kept[-1]
            yield False, np.concatenate([hub[None], kept])
            kept = None
    if kept is not None:
        yield True, kept


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of (key, part, node, n, s0..s3): pairs to confirm; b is null for
    the sets of large buckets."""
    cut = least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, rows in _runs(batches):
            node, n, sig = rows[:, 2], rows[:, 3], rows[:, 4:].view(np.uint64)
            pairs, large = [], [np.zeros(0, np.int64)]

            def compare(x: np.ndarray, y: np.ndarray) -> None:
                ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                x, y = x[ok], y[ok]
                ok = equal_places(sig[x], sig[y]) >= cut
                x, y = node[x[ok]], node[y[ok]]
                pairs.append((np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]))

            if whole:
                edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
                size = np.diff(np.append(edge, len(rows)))
                left = np.repeat(size, size) - (np.arange(len(rows)) - np.repeat(edge, size)) - 1  # members after this one
                big = np.repeat(size > BUCKET, size)
                large.append(node[big])
                hub = np.repeat(edge, size)
                at = np.flatnonzero(big & (hub < np.arange(len(rows))))
                compare(hub[at], at)
                compare(at - 1, at)
                at, step = np.flatnonzero(~big & (left >= 1)), 1
                while len(at):
                    compare(at, at + step)
                    step += 1
                    at = at[left[at] >= step]
            else:
                at = np.arange(1, len(rows))
                compare(np.zeros(len(at), dtype=np.int64), at)
                compare(at - 1, at)
                large.append(node)
            a, b = (np.concatenate(x) for x in zip(*pairs))
            m = np.unique(np.concatenate(large))
            if len(a):
                a, b = np.unique(np.stack([a, b], axis=1), axis=0).T
            if len(a) + len(m):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([a, m])), pa.concat_arrays([pa.array(np.ascontiguousarray(b)), pa.nulls(len(m), pa.int64())])], ["a", "b"])

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", F.xxhash64("key", "node"), "node")
    return map_batches(dealt, run, "a bigint, b bigint").distinct()


def _band_rows(sets: DataFrame) -> DataFrame:
    """``(key, part, node, n, s0..s3)``, one row per set and band whose key another
    set has too; keys with many rows in several parts."""
    rows = sets.select(F.explode("bands").alias("key"), "node")
    shared = store(rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "bbit-shared-keys")
    parts = F.floor(F.col("rows") / SPLIT) + 1
    rows = rows.join(shared, "key").select("key", F.pmod(F.xxhash64("node"), parts).cast("bigint").alias("part"), "node")
    return rows.join(sets.select("node", "n", *WORDS64), "node").select("key", "part", "node", "n", *WORDS64)


# ------------------------------------------------------------ confirmation

def marks(x: np.ndarray) -> np.ndarray:
    """The bitmap of a set: a bit tells whether an odd number of its hashes falls
    there.  Two sets differ in at least as many hashes as bits."""
    odd = np.bincount((x & np.uint64(64 * len(MARKS) - 1)).astype(np.int64), minlength=64 * len(MARKS)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(df: DataFrame, nodes: DataFrame, text_col: str, words: int) -> DataFrame:
    """``(node, large, n, m0..m15, x)``: the full sets and their bitmaps of the rows
    of the ``stable`` table df whose number is in ``nodes`` (node, large)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), hashes, words) for t in part.column("text")]
                size = np.array([len(x) for x in sets], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                bits = np.stack([marks(x) for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("large"), pa.array(size), *[pa.array(bits[:, i].copy()) for i in range(len(MARKS))],
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "large", "n", *MARKS, "x"])

    rows = df.select(F.col(RID).alias("node"), F.col(f"`{text_col}`").alias("text")).join(nodes, "node").select("node", "large", "text")
    return map_batches(rows, run, "node bigint, large boolean, n bigint, " + ", ".join(f"{m} bigint" for m in MARKS) + ", x array<bigint>")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that the sizes and bitmaps of their ``sets`` allow to be
    similar; exact, no similar pair goes."""
    one, two = (sets.select(F.col("node").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("n", *MARKS)]) for e in "ab")
    both = F.col("n_a") + F.col("n_b")
    differ = sum(F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS)
    # Common hashes are half of what does not differ, and similar sets have percent / (100 + percent) of both in common.
    fits = (100 + percent) * (both - differ) >= 2 * percent * both
    return pairs.join(one, "a").join(two, "b").where(fits).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("x").alias("x_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("x").alias("x_b"))
    both = F.size(F.array_intersect("x_a", "x_b"))
    similar = 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)
    # By b first: the pairs lie by b already.
    return _possible(pairs, sets, percent).join(two, "b").join(one, "a").where(similar).select("a", "b")


def _at_least(num: Column, den: int) -> Column:
    """num / den, rounded up."""
    return F.ceil(num.cast("decimal(20,0)") / den).cast("bigint")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, n, at, x, short)``: of each set the rarest shingles, which a
    similar set must share, with their places in the order of all shingles.

    Of two similar sets the smaller one (n) has a common shingle among its first
    n - 2t/(1+t) n + 1 (``short``), the larger one among its first n - t n + 1.
    """
    rows = sets.select("node", "n", F.explode("x").alias("x"))
    counts = rows.groupBy("x").agg(F.count("*").alias("rows"))
    ordered = rows.join(counts, "x").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "x"))).alias("all"))
    long = F.col("n") - _at_least(F.col("n") * percent, 100) + 1
    short = F.col("n") - _at_least(F.col("n") * (2 * percent), 100 + percent) + 1
    first = ordered.select("node", "n", F.posexplode(F.slice("all", F.lit(1), long.cast("int"))).alias("at", "one"))
    return first.select("node", "n", "at", "one.x", (F.col("at") < short).alias("short"))


def _across(sets: DataFrame, packed: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (node, n, x) with different roots (node, root)
    that can be similar by size, order of shingles and estimate; without a cap.

    A shingle whose sets all have one root gives no pair.  Of another one, sets
    of the most frequent root meet only those of other roots.
    """
    root = F.coalesce("root", "node").alias("root")
    named = _prefixes(sets, percent).join(roots, "node", "left").select("node", "n", "at", "x", "short", root)
    rows = store(named, "bbit-prefixes")
    most = rows.groupBy("x", "root").agg(F.count("*").alias("m"), F.max("short").alias("short"))
    most = most.groupBy("x").agg(F.max(F.struct("m", "root"))["root"].alias("most"), F.count("*").alias("roots"), F.max("short").alias("any"))
    rows = rows.join(most.where("roots > 1 AND any").select("x", "most"), "x").join(packed, "node").withColumn("common", F.col("root") == F.col("most"))
    meets = F.when(F.col("common"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    cols = ("node", "n", "at", "root", *WORDS64)
    one = rows.where("short").select("x", F.explode(meets).alias("common"), *[F.col(c).alias(f"{c}_a") for c in cols])
    two = rows.select("x", "common", *[F.col(c).alias(f"{c}_b") for c in cols])
    # What both share at most, if this shingle is the first that they share.
    shared = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    differ = sum(F.expr(f"bit_count(((s{i}_a ^ s{i}_b) | shiftrightunsigned(s{i}_a ^ s{i}_b, 1)) & 6148914691236517205)") for i in range(len(WORDS64)))
    fits = ((F.col("root_a") != F.col("root_b")) & (F.col("n_a") <= F.col("n_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
            & ((100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))) & (HASHES - differ >= least_equal(percent)))
    found = one.join(two, ["x", "common"]).where(fits)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def links(df: DataFrame, sets: DataFrame, text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(a, b)``: confirmed pairs of ``sets`` (node, n, bands, s0..s3; node is a
    row number of the ``stable`` table df) that join all similar ones; of sets
    that others tie together not every pair."""
    found = store(_candidates(_band_rows(sets), percent), "bbit-candidates")
    pairs, large = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("node"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("large")).union(large.select("node", F.lit(True)))
    ends = ends.groupBy("node").agg(F.max("large").alias("large"))
    full = store(_sets(df, store(ends, "bbit-ends"), text_col, words), "bbit-sets")
    confirmed = store(_confirmed(pairs, full, percent), "bbit-links")
    if large.isEmpty():
        return confirmed
    full = full.where("large")
    packed = sets.join(large, "node", "left_semi").select("node", *WORDS64)
    rest = store(_across(full, packed, components(confirmed), percent), "bbit-across")
    return confirmed.union(store(_confirmed(rest, full, percent), "bbit-links-across"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(rid, id, n_shingles, component_id, kept)`` per input row; component_id is
    the smallest id of all rows that links lead to, and kept rows have it."""
    df = stable(df)
    rows = store(sketches(df, id_col, text_col, words), "bbit-sketches")
    name = ["n", "k0", "k1"]
    groups = rows.where("n > 0").groupBy(*name).agg(
        F.min("rid").alias("node"), F.min("id").alias("first_id"), F.any_value("bands").alias("bands"), *[F.any_value(s).alias(s) for s in WORDS64])
    sets = store(groups, "bbit-distinct")
    roots = components(links(df, sets, text_col, words, percent))
    named = sets.join(roots, "node", "left").select(*name, "first_id", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = store(named.join(ids, "root").select(*name, "component_id"), "bbit-components")
    out = rows.select("rid", "id", *name).join(named, name, "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("rid", "id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
