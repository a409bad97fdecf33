"""Packing token sequences by vector bin packing.

Examples are vectors (tokens, segments, loss-bearing tokens); a sequence has a
limit on each.  The dot-product heuristic (Panigrahy et al., "Heuristics for
Vector Bin Packing") fills one sequence at a time: of all examples that fit it
takes the one whose demand, weighted by how scarce each dimension is in the
block, points most towards what the sequence has left.

``pack_vectors`` keeps examples whole (instruction data).  ``pack_documents``
tokenizes texts and may cut: documents first give full sequences, the rests
are packed by the heuristic, and when nothing fits any more the best example
is cut so that the sequence is exactly full.  The last, open sequence of a
block is laid out in sequences of falling powers of two, which need no
padding.

Scale: packing is local.  A task reads its share of the input once, in blocks
of ``block_tokens`` tokens, and writes pieces; nothing is shuffled, no block
holds more than its bound (a longer document streams out as full sequences),
and padding is zero unless a segment limit is given.  ``sequence_id`` is made of the
partition and a counter: unique, and equal when a lost task runs again over
the same files.

Defined results: null counts as the empty text; an empty text is its end id
alone; repeated rows and null ids are packed as rows of their own; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import keyed, map_batches

CAPACITY = 1024
BLOCK_TOKENS = 1 << 21
END_ID = 0
#: Runs beyond this go to the reference tokenizer, whose cost does not explode on them.
LONG_RUN = re.compile(r"\S{4096}|\s{4096}")


class Shapes:
    """The examples not yet placed, by shape (tokens, loss), and the heuristic."""

    def __init__(self, tokens, loss, limits):
        self.limits = np.asarray(limits, dtype=float)  # tokens, segments, loss
        self.left: dict[tuple[int, int], list[int]] = {}
        for i, s in enumerate(zip(map(int, tokens), map(int, loss))):
            self.left.setdefault(s, []).append(i)
        for v in self.left.values():
            v.reverse()
        self.table = np.array(sorted(self.left), dtype=float).reshape(-1, 2)
        self.count = np.array([len(self.left[tuple(map(int, s))]) for s in self.table], dtype=np.int64)
        total = np.array([(self.table[:, 0] * self.count).sum(), self.count.sum(), (self.table[:, 1] * self.count).sum()])
        self.weight = total / self.limits
        self.weight = self.weight / max(self.weight.sum(), 1e-9)

    def __len__(self) -> int:
        return int(self.count.sum())

    def best(self, room, fit: bool = True) -> int:
        """Row of the shape with the largest dot product, -1 if none (``fit``: that fits)."""
        ok = self.count > 0
        if fit:
            ok &= (self.table[:, 0] <= room[0]) & (self.table[:, 1] <= room[2]) & (room[1] >= 1)
        if not ok.any():
            return -1
        r = self.weight * np.asarray(room, dtype=float) / self.limits
        dot = self.table[:, 0] / self.limits[0] * r[0] + r[1] / self.limits[1] + self.table[:, 1] / max(self.limits[2], 1) * r[2]
        return int(np.argmax(np.where(ok, dot, -1.0)))

    def take(self, row: int) -> int:
        self.count[row] -= 1
        return self.left[tuple(map(int, self.table[row]))].pop()


def pack_block(tokens, loss, limits) -> list[list[int]]:
    """Whole examples into bins under ``limits`` (tokens, segments, loss).  An
    example over a limit gets a bin of its own."""
    todo, bins = Shapes(tokens, loss, limits), []
    while len(todo):
        room, bin_ = list(limits), []
        while (row := todo.best(room)) >= 0:
            t, ls = todo.table[row]
            bin_.append(todo.take(row))
            room = [room[0] - t, room[1] - 1, room[2] - ls]
        if not bin_:
            bin_ = [todo.take(todo.best(room, fit=False))]
        bins.append(bin_)
    return bins


def pack_rests(rests: list[int], capacity: int, max_segments: int) -> list[list[tuple[int, int, int]]]:
    """Rests (token counts below ``capacity``, cuttable) into bins of (item, from, length)."""
    limits = (capacity, max_segments, capacity)
    todo = Shapes(rests, rests, limits)
    bins: list[list[tuple[int, int, int]]] = []
    carry: tuple[int, int, int] | None = None  # what is left of a cut example
    while len(todo) or carry:
        room, bin_ = capacity, []
        if carry:
            bin_.append(carry)
            room -= carry[2]
            carry = None
        while room and len(todo) and len(bin_) < max_segments:
            slots = max_segments - len(bin_)
            row = todo.best((room, slots, room)) if slots > 1 else -1
            if row < 0:  # nothing fits whole, or one segment is left: the largest fills the gap
                row = int(np.flatnonzero(todo.count)[-1])
                size, i = int(todo.table[row, 0]), todo.take(row)
                part = min(room, size)
                bin_.append((i, 0, part))
                if part < size:
                    carry = (i, part, size - part)
                room -= part
                continue
            bin_.append((todo.take(row), 0, int(todo.table[row, 0])))
            room -= bin_[-1][2]
        bins.append(bin_)
    last = sum(x[2] for x in bins[-1]) if bins else capacity
    if last < capacity:
        bins[-1:] = powers(bins[-1])
    return bins


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in order, laid out in bins of falling powers of two."""
    total, out, queue = sum(p[2] for p in pieces), [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, bin_ = total & (1 << bit), []
        while room:
            i, at, n = queue.pop(0)
            bin_.append((i, at, min(n, room)))
            if n > room:
                queue.insert(0, (i, at + room, n - room))
            room -= bin_[-1][2]
        if bin_:
            out.append(bin_)
    return out


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> uint32 ids, as the ``tokenizers`` file as loaded gives with
    ``add_special_tokens=False``.  With the same vocabulary as a rank file,
    tiktoken computes the same ids about three times as fast; texts with very
    long runs, or with the string of an added token (which is one id), go to
    ``tokenizers`` itself."""
    slow = None
    with open(json_path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens") or []]
    has_added = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def by_file(text: str) -> np.ndarray:
        nonlocal slow
        if slow is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(json_path)
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if not ranks_path:
        return by_file
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(text: str) -> np.ndarray:
        if has_added.search(text) or (len(text) >= 4096 and LONG_RUN.search(text)):
            return by_file(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return by_ranks


#: Before a single space between two non-spaces every pre-tokenizer of this family cuts.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
CHUNK = 1 << 18


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of a long text whose ids concatenate to the ids of the whole."""
    at = 0
    while len(text) - at > size:
        m = SAFE_CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(df: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   max_segments: int | None = None, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``with_ids`` the ids themselves (binary, little-endian
    unsigned 32-bit).  Every id of a document, its end id included, lies in
    exactly one piece; offsets are gapless from 0 in each sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern)
        base, n_seq = TaskContext.get().partitionId() << 33, 0
        kind = None
        out: list[tuple] = []
        block: list[tuple] = []  # (id, ids of the rest, place of the rest, doc_tokens)
        held = 0

        def piece(doc, at, ids, total, seq, offset):
            raw = ids.astype("<u4").tobytes()
            out.append((doc, at, len(ids), zlib.crc32(raw), total, base + seq, offset, *([raw] if with_ids else [])))

        def close() -> None:
            nonlocal n_seq, held
            for bin_ in pack_rests([len(x[1]) for x in block], capacity, max_segments or capacity):
                offset = 0
                for i, at, n in bin_:
                    doc, ids, place, total = block[i]
                    piece(doc, place + at, ids[at : at + n], total, n_seq, offset)
                    offset += n
                n_seq += 1
            block.clear()
            held = 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * (7 + with_ids)
            arrays = [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[7], pa.binary())], [*names, "ids"]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            kind = batch.column("id").type
            for doc, text in zip(batch.column("id"), batch.column("text")):
                doc, parts = doc.as_py(), [encode(x) for x in chunks(text.as_py() or "")]
                ids = np.concatenate([*parts, np.array([END_ID], dtype=np.uint32)])
                total, full = len(ids), len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    piece(doc, at, ids[at : at + capacity], total, n_seq, 0)
                    n_seq += 1
                if full < total:
                    block.append((doc, ids[full:].copy(), full, total))
                    held += total - full
                if held >= block_tokens:
                    close()
                if len(out) >= 20_000:
                    yield batch_of()
        close()
        if kind is not None:
            yield batch_of()

    rows = keyed(df, id_col, text_col).drop("rid")
    kind_sql = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind_sql}, {PIECE}" + ", ids binary" * with_ids)


def pack_vectors(df: DataFrame, id_cols: list[str], tokens: str, loss: str, capacity: int, max_segments: int, max_loss: int,
                 block_rows: int = 50_000) -> DataFrame:
    """Whole examples (instruction data): ``(<id_cols>, tokens, loss, sequence_id)``.
    Null counts are zero; an example over a limit gets a sequence of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_seq = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            nonlocal n_seq
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            seq = np.zeros(t.num_rows, dtype=np.int64)
            for bin_ in pack_block(t["tokens"].to_pylist(), t["loss"].to_pylist(), (capacity, max_segments, max_loss)):
                seq[bin_] = n_seq
                n_seq += 1
            return t.append_column("sequence_id", pa.array(seq)).to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= block_rows:
                yield close()
        if held:
            yield close()

    count = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(n) for c, n in ((tokens, "tokens"), (loss, "loss"))]
    rows = df.select(*[F.col(f"`{c}`") for c in id_cols], *count)
    return map_batches(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint")


def conversation_sizes(df: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "conv_id",
                       role_col: str = "role", text_col: str = "text", learnt_role: str = "assistant") -> DataFrame:
    """``(<id_col>, tokens, loss, turns)`` per conversation: all tokens, an end id a
    turn included, and those of the turns that a model learns from.  A null text
    is an empty one; turns without a conversation's id are one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            n = [1 + sum(len(encode(c)) for c in chunks(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("role"), pa.array(n, pa.int64())], ["id", "role", "n"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").alias("text"))
    sized = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, role string, n bigint")
    learnt = F.sum(F.when(F.col("role") == learnt_role, F.col("n")).otherwise(0))
    return sized.groupBy("id").agg(F.sum("n").alias("tokens"), learnt.alias("loss"), F.count("*").alias("turns")).withColumnRenamed("id", id_col)
