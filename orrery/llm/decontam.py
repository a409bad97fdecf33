"""Benchmark decontamination: BM25 over an inverted index of test items.

Every training text is a series of overlapping passages, each as long as two
strides; a stride is at least as long as the longest item, so each item that a
text holds lies whole in some passage.  Each passage is a query (its different
words) against the index of items.  A term's impact on an item is its BM25
weight divided by the item's score for its own words, so scores lie in 0 to 1
and one threshold fits all items.

Retrieval is block-max WAND, run for a batch of passages at once: items lie in
blocks, a table holds each term's largest impact in each block, and a passage
goes into a block only if the sum of its terms' largest impacts there reaches
the threshold.  First with repeats (an upper bound made of sums per stride),
then with different words, then the block's items are scored exactly.  Nothing
above the threshold is missed and no candidate is capped.

Verification: an item's question (all sentences but the last) and its answer
(the last one; the only one is both) must each have ``overlap`` (0.8) or more
of their 5-word shingles in the passage.

Scale: whole texts are read without a shuffle.  The index is broadcast, at most
about ``index_bytes`` of item text at a time; a larger set of items is taken in
several passes, split by a hash.  Document frequencies, mean length and the
longest item are counted over all items first, so the passes' number changes no
result.  A long text is searched in runs of strides, so memory does not grow
with it.

Defined results: words are runs of letters and digits, lower-cased; null or
empty texts and items match nothing; an item or part shorter than five words is
one shingle; repeated rows of either table give a row each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orrery.llm.common import keyed, map_batches, stable, store, without

K1, B, THRESHOLD = 1.2, 0.75, 0.5
WORDS, OVERLAP = 5, 0.8
MIN_STRIDE, BLOCK_ITEMS, INDEX_BYTES = 64, 4, 1 << 20
RUN_WORDS = 1 << 14  # words of a text whose bounds are held at once
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(w: list[str], n: int = WORDS) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def parts(text: str) -> list[list[str]]:
    """Words of question and answer."""
    s = [x for x in map(words, SENTENCE_END.split(text.strip())) if x]
    return [[w for x in s[:-1] for w in x], s[-1]] if len(s) > 1 else [s[0], s[0]]


@dataclass
class Index:
    items: list  # ids
    texts: list[list[list[str]]]  # question and answer words
    vocabulary: dict[str, int]
    terms: list[np.ndarray]  # by item: its terms
    impacts: list[np.ndarray]  # by item: their impacts
    block_max: np.ndarray  # term (the last row: no term) x block
    stride: int


@dataclass
class Statistics:
    """Over all items with a word: their number, words and longest, and in how
    many a word occurs."""

    items: int
    words: int
    longest: int
    df: dict[str, int]


def statistics(rows: list[tuple]) -> Statistics:
    """Of the rows (item id, text) themselves."""
    sizes = [words(t) for _, t in rows if words(t)]
    return Statistics(len(sizes), sum(map(len, sizes)), max(map(len, sizes), default=0), Counter(w for ws in sizes for w in set(ws)))


def build_index(rows: list[tuple], block_items: int = BLOCK_ITEMS, over: Statistics | None = None) -> Index | None:
    """rows: (item id, text); ``over``: the statistics of all items, if these are a part."""
    over = over or statistics(rows)
    rows = [(i, t, words(t)) for i, t in rows]
    rows = [r for r in rows if r[2]]
    if not rows:
        return None
    # Items that share rare words side by side: blocks then bound tightly.
    df, n_items, mean = over.df, over.items, over.words / over.items
    rows.sort(key=lambda r: (min(r[2], key=lambda w: (df[w], w)), str(r[0])))
    vocabulary = {w: k for k, w in enumerate(sorted({w for r in rows for w in r[2]}))}
    block_max = np.zeros((len(vocabulary) + 1, -(-len(rows) // block_items)), dtype=np.float32)
    terms, impacts = [], []
    for k, (_, _, ws) in enumerate(rows):
        tf = Counter(ws)
        t = np.array([vocabulary[w] for w in tf], dtype=np.int64)
        idf = np.array([math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) for w in tf])
        f = np.array(list(tf.values()), dtype=float)
        w = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean))
        w = (w / w.sum()).astype(np.float32)
        terms.append(t)
        impacts.append(w)
        np.maximum.at(block_max[:, k // block_items], t, w)
    return Index([r[0] for r in rows], [parts(r[1]) for r in rows], vocabulary, terms, impacts, block_max,
                 max(MIN_STRIDE, over.longest))


def _promising(index: Index, ids: np.ndarray, low: float) -> Iterator[int]:
    """Passages in which some block's bound, with repeats, reaches ``low``; a run
    of strides at a time."""
    step = index.stride
    run = max(1, RUN_WORDS // step) * step
    last = None
    for at in range(0, len(ids), run):
        part = ids[at : at + run]
        sums = np.add.reduceat(index.block_max.take(part, axis=0), np.arange(0, len(part), step), axis=0)
        both = sums if last is None else np.concatenate([last, sums])
        bound = both[:-1] + both[1:] if len(both) > 1 else both
        first = at // step - (last is not None)
        if len(ids) > at + run and len(both) == 1:  # one stride so far, more to come
            last = sums[-1:]
            continue
        yield from (first + np.flatnonzero((bound >= low).any(axis=1))).tolist()
        last = sums[-1:]


def retrieve(index: Index, ids: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, item, score) at or above the threshold; ids: term of each word
    of one text (last row of the table: none).  Passage p covers strides p and p + 1."""
    step, low = index.stride, threshold - 1e-4
    found = []
    scratch = np.zeros(len(index.block_max), dtype=bool)
    for p in _promising(index, ids, low):
        query = np.unique(ids[p * step : (p + 2) * step])
        blocks = np.flatnonzero(index.block_max[query].sum(axis=0) >= low)
        if not len(blocks):
            continue
        scratch[query] = True
        size = -(-len(index.items) // index.block_max.shape[1])
        for b in blocks:
            for i in range(b * size, min(len(index.items), (b + 1) * size)):
                score = float(index.impacts[i][scratch[index.terms[i]]].sum())
                if score >= low:
                    found.append((int(p), i, round(min(1.0, score), 6)))
        scratch[query] = False
    return found


def overlaps(index: Index, item: int, passage: set) -> list[float]:
    out = []
    for part in index.texts[item]:
        s = shingles(part)
        if len(part) >= WORDS:
            out.append(len(s & passage) / len(s))
        else:  # one short shingle: a run of the passage's words
            short = next(iter(s))
            out.append(float(any(short == g[k : k + len(short)] for g in passage for k in range(len(g) - len(short) + 1))))
    return out


def matches(index: Index, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
    """(item, score, question overlap, answer overlap) that a text holds, the best passage of each."""
    w = words(text)
    if not w:
        return []
    none = len(index.vocabulary)
    ids = np.fromiter((index.vocabulary.get(x, none) for x in w), dtype=np.int32, count=len(w))
    best: dict[int, tuple] = {}
    sets: dict[int, set] = {}
    for p, i, score in retrieve(index, ids, threshold):
        if p not in sets:
            sets = {p: shingles(w[p * index.stride : (p + 2) * index.stride])}
        q, a = overlaps(index, i, sets[p])
        if min(q, a) >= overlap:
            best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (score, q, a))
    return [(i, *x) for i, x in sorted(best.items())]


def _all_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers of items, words and longest over all items, and (word, df), counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [words(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, ws), pa.int64()), pa.array([sorted(set(w)) for w in ws], pa.list_(pa.string()))], ["n", "words"])

    seen = store(map_batches(items.select("text"), run, "n bigint, words array<string>").where("n > 0"), "item-words")
    total = seen.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"))
    return total, store(seen.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "item-df")


def _over(counted: tuple[DataFrame, DataFrame], rows: list[tuple]) -> Statistics:
    """The statistics of all items for the words of ``rows``."""
    total, df = counted
    mine = df.sparkSession.createDataFrame([(w,) for w in sorted({w for _, t in rows for w in words(t)})], "word string")
    return Statistics(*total.first(), {r.word: r.df for r in df.join(mine, "word").collect()})


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``(rid, id, item_id, score, question_overlap, answer_overlap)``: a row for
    each input row and item that it holds."""
    rows = keyed(df, id_col, text_col)
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("text IS NOT NULL")
    kinds = rows.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = f"rid bigint, id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // index_bytes)
    out = df.sparkSession.createDataFrame([], schema)
    counted = _all_items(items) if n > 1 else None
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        mine = [tuple(r) for r in part.collect()]  # about index_bytes of text
        index = build_index(mine, over=counted and _over(counted, mine))
        if index:
            shared = df.sparkSession.sparkContext.broadcast(index)
            found = map_batches(rows, _searcher(shared, threshold, overlap, to_arrow_type(items.schema["item"].dataType)), schema)
            out = found if k == 0 else out.union(found)
    return out


def _searcher(shared, threshold: float, overlap: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            at, hits = [], []
            for k, text in enumerate(batch.column("text")):
                m = matches(index, text.as_py(), threshold, overlap)
                at += [k] * len(m)
                hits += m
            if hits:
                take = pa.array(at, pa.int64())
                cols = list(zip(*hits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(take), batch.column("id").take(take), pa.array([index.items[i] for i in cols[0]], kind),
                     *(pa.array(c, pa.float64()) for c in cols[1:])],
                    ["rid", "id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns, that hold no item."""
    df = stable(df)
    return without(df, find_leaks(df, benchmark, id_col, text_col, **options).select("rid").distinct())
