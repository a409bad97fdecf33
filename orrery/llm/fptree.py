"""Ranked lexical search: the best documents for each item, by a document FP-tree.

Terms are the stretches of letters, digits and characters beyond ASCII; A-Z are
lower-cased.  N documents have a term, L is the number of all terms, n that of a
document's, df the number of documents that hold a term, tf how often one does.
A document's score is the sum over an item's different terms of
``w * (1e9 tf div (1000 tf + 8 m))`` with ``w = floor(1000 ln((2N + 2)/(2df + 1)))``
and ``m = 10 + 90 n N div L``, in whole numbers.

* One pass restricts each document to the items' terms: (id, n, terms, tf).  N, L
  and all df are counted over these vectors, so over all documents.
* Document FP-tree: a task takes its vectors in blocks.  For an item, the vectors
  restricted to its terms, ordered from the most frequent term to the rarest, are
  the paths of a trie; documents with the same terms share all of it, others
  their common start.  With the rows sorted by path a node is a range of rows, its
  children follow from running counts of each term.
* Branch and bound: a node's maxima of tf and minimum of m bound all scores below
  it.  Depth first, children with the higher bound first; a node whose bound is
  below the item's tenth best score so far is left out with all below it.  The
  best scores go from block to block, so later blocks are cut off sooner.
* The tenth best of all tasks are ranked in two steps.

Scale: texts are read once per slice of items; a slice (``SLICE_BYTES`` of item
text) is what tasks are given, whatever the number of items, and no number of
slices changes a result.  A task holds one block of vectors and one item's tree
of at most ``CELLS`` (rows x terms); longer items have trees of fewer rows.

Defined results: a null text has no terms; items without terms, and documents
with score 0, give no rows; equal scores by ascending id, null ids last; repeated
rows of either table are rows of their own; empty tables give an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.llm.common import keyed, map_batches, stable, store

TOP, SLICE_BYTES, BLOCK, CELLS, LEAF = 10, 4 << 20, 8192, 1 << 22, 16
SALTS = 32
#: Bytes of terms as they are (A-Z lower-cased), all others as spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return (text or "").encode().translate(TERM_BYTES).split()


# ----------------------------------------------------------------- vectors

def vectors(df: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(rid, id, n, terms, tf)`` per document: its number of terms, and which of
    the vocabulary's it has, by their number, how often."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, terms, tf = [], [0], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                count = Counter(words)
                hit = count.keys() & number.keys()
                n.append(len(words))
                terms += [number[t] for t in hit]
                tf += [count[t] for t in hit]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))],
                ["rid", "id", "n", "terms", "tf"])

    rows = keyed(df, id_col, text_col)
    schema = f"rid bigint, id {rows.schema['id'].dataType.simpleString()}, n bigint, terms array<int>, tf array<int>"
    return map_batches(rows, run, schema)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_weight(n: str, documents: int, terms: int) -> Column:
    """m of a document with n terms; by decimals, so that no product overflows."""
    return F.expr(f"10 + cast({n} AS decimal(18,0)) * cast({90 * documents} AS decimal(20,0)) div cast({max(terms, 1)} AS decimal(20,0))")


# -------------------------------------------------------------------- tree

class Best:
    """The best rows of one item so far: (-score, no id, id), sorted."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def least(self) -> int:
        """The score that a further document needs at least."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        for s, i in zip(scores.tolist(), ids):
            if s >= self.least():
                insort(self.rows, (-s, i is None, 0 if i is None else i))
                del self.rows[self.top :]


def _scores(tf: np.ndarray, m: np.ndarray | int, w: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 8 * m)) @ w


class Tree:
    """FP-tree of rows restricted to one item's terms, columns from the most
    frequent term to the rarest.  A node is (first row, row after the last,
    column of its term); its path's terms are those of all its rows."""

    def __init__(self, tf: np.ndarray, m: np.ndarray, ids: list, w: np.ndarray):
        has = tf > 0
        bits = np.packbits(has, axis=1)
        path = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(">u8").astype(np.uint64)
        order = np.lexsort(~path.T[::-1])
        self.tf, self.m, self.ids, self.w = tf[order], m[order], [ids[i] for i in order], w
        self.upto = np.zeros((len(tf) + 1, tf.shape[1]), dtype=np.int32)
        np.cumsum(has[order], axis=0, out=self.upto[1:])

    def bound(self, a: int, b: int) -> int:
        """No row of a node scores more than its maxima of tf and minimum of m."""
        return int(_scores(self.tf[a:b].max(axis=0), self.m[a:b].min(), self.w))

    def children(self, a: int, b: int, column: int) -> Iterator[tuple[int, int, int]]:
        """Nodes below a node; the rows that end at it come last, with column -1."""
        for c in range(column + 1, self.tf.shape[1]):
            n = int(self.upto[b, c] - self.upto[a, c])
            if n:
                yield a, a + n, c
                a += n
                if a == b:
                    return
        yield a, b, -1

    def search(self, best: Best) -> int:
        """Put the best rows into ``best``; returns how many nodes were opened."""
        stack, opened = [(self.bound(0, len(self.m)), 0, len(self.m), -1)], 0
        while stack:
            bound, a, b, column = stack.pop()
            if bound < best.least():
                continue
            opened += 1
            below = []
            parts = [(a, b, -1)] if b - a <= LEAF else self.children(a, b, column)
            for x, y, c in parts:
                if c < 0:
                    scores = _scores(self.tf[x:y], self.m[x:y, None], self.w)
                    best.add(scores, self.ids[x:y])
                else:
                    below.append((self.bound(x, y), x, y, c))
            stack += sorted(below)  # the highest bound is popped first
        return opened


class Block:
    """Vectors of some documents, also by term."""

    def __init__(self, ids: list, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, vocabulary: int):
        self.ids, self.m = ids, m
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(ids)), sizes)[order]
        self.tf = tf[order]
        self.start = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def search(self, terms: np.ndarray, w: np.ndarray, best: Best) -> None:
        """The best documents for an item's terms, from the most frequent to the rarest."""
        parts = [slice(self.start[t], self.start[t + 1]) for t in terms]
        most = np.array([self.tf[p].max(initial=0) for p in parts])
        if not most.any() or int(_scores(most, self.m.min(), w)) < best.least():
            return
        row = np.full(len(self.ids), -1)
        for p in parts:
            row[self.docs[p]] = 0
        hit = np.flatnonzero(row == 0)
        step = max(1, CELLS // len(terms))
        for at in range(0, len(hit), step):
            some = hit[at : at + step]
            row[:] = -1
            row[some] = np.arange(len(some))
            tf = np.zeros((len(some), len(terms)), dtype=np.int32)
            for c, p in enumerate(parts):
                r = row[self.docs[p]]
                tf[r[r >= 0], c] = self.tf[p][r >= 0]
            Tree(tf, self.m[some], [self.ids[i] for i in some], w).search(best)


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: int) -> Iterator[Block]:
    """Blocks of at most BLOCK rows (id, m, terms, tf)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            terms, tf = part.column("terms"), part.column("tf")
            sizes = np.diff(terms.offsets.to_numpy())
            yield Block(part.column("id").to_pylist(), part.column("m").to_numpy(zero_copy_only=False), sizes,
                        terms.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False), vocabulary)


# ------------------------------------------------------------------ search

def _ranked(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _one_slice(docs: DataFrame, items: list[tuple[int, str | None]], id_col: str, text_col: str, top: int) -> DataFrame:
    """``(item, id, score, rank)`` for items (number, text)."""
    own = [(item, set(terms_of(text))) for item, text in items]
    vocabulary = sorted(set().union(*[t for _, t in own]))
    rows = store(vectors(docs, vocabulary, id_col, text_col), "search-vectors")
    total = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counted = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # one row per term of the items
    df = {r.t: r.df for r in counted}
    number = {t: i for i, t in enumerate(vocabulary)}
    plans = []
    for item, terms in own:
        held = sorted((i for i in (number[t] for t in terms) if i in df), key=lambda i: (-df[i], i))
        if held:
            plans.append((item, np.array(held), np.array([weight(total.documents, df[i]) for i in held], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_types = [Best(top) for _ in plans], []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                id_types.append(batch.schema.field("id").type)
                yield batch

        for block in _blocks(typed(), len(vocabulary)):
            for (_, terms, w), b in zip(plans, best):
                block.search(terms, w, b)
        out = [(item, None if no_id else i, -s) for (item, _, _), b in zip(plans, best) for s, no_id, i in b.rows]
        if out:
            item, ids, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, id_types[0]), pa.array(score, pa.int64())], ["item", "id", "score"])

    wanted = rows.where(F.size("terms") > 0).select("id", length_weight("n", total.documents, total.terms).alias("m"), "terms", "tf")
    id_type = rows.schema["id"].dataType.simpleString()
    found = map_batches(wanted, run, f"item bigint, id {id_type}, score bigint")
    # In two steps, so that no task reads an item's rows of all tasks.
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return _ranked(_ranked(salted, ["item", "salt"], top).drop("rank", "salt"), ["item"], top)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(item_id, rank, id, score)``: for each row of ``items`` the ``top``
    documents with the highest score above 0."""
    asked = store(keyed(stable(items), item_col, item_text), "search-items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    parts = []
    for k in range(slices):
        mine = asked.where(F.pmod(F.xxhash64("rid"), F.lit(slices)) == k).select("rid", "text").collect()  # about slice_bytes
        parts.append(_one_slice(docs, [(r.rid, r.text) for r in mine], id_col, text_col, top))
    found = reduce(DataFrame.unionByName, parts)
    named = asked.select(F.col("rid").alias("item"), F.col("id").alias("item_id"))
    return found.join(named, "item").select("item_id", "rank", "id", "score")
