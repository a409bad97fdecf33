"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios (Wang and Manning, "Baselines and
Bigrams").

Features are the character (byte) n-grams of 4, 5 and 6 of the lower-cased
text, hashed to 2^18 buckets for each length and counted as present or absent.
The log-count ratio of each is computed from the labelled sample; the
``n_features`` ratios that stand out most for their support enter a logistic
regression on the scaled features, with L2 penalty, trained in numpy.

Scale: the fit uses at most ``sample_rows`` labelled rows, positives and
negatives apart, chosen by a hash and weighted back to their true shares.
Counting is a Spark aggregation; the driver gets ``n_features`` features and
the few of them that each sampled row has.  Scoring is one pass over whole
texts without a shuffle.

Defined results: a null text scores as an empty one, that is by the intercept;
every input row gives one output row, repeated rows and null ids included; a
row labelled twice is learnt from twice; null labels are no labels; with no
labelled text every score is 0; an empty table gives an empty table; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import map_batches, store, training_row

SIZES, BITS = (4, 5, 6), 18
SAMPLE_ROWS, N_FEATURES = 12_000, 2048
THRESHOLD = 0.3
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
CHUNK = 1 << 20


@dataclass
class Model:
    buckets: np.ndarray  # feature -> bucket, sorted
    weights: np.ndarray
    intercept: float


def grams(raw: bytes) -> np.ndarray:
    """Buckets of all n-grams of a lower-cased text, in order, lengths one after another."""
    text = np.frombuffer(raw.lower() + b"\0" * 8, dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(text[:8].view("<u8"), (max(len(raw), 1),), (1,)) if len(raw) else np.zeros(0, "<u8")
    out = []
    for k, n in enumerate(SIZES):
        w = words[: max(0, len(raw) - n + 1)] & np.uint64((1 << 8 * n) - 1)
        w = w * np.uint64(MULTIPLIERS[k])
        out.append((w >> np.uint64(64 - BITS)).astype(np.int32) + (k << BITS))
    return np.concatenate(out)


def chunked_grams(text: str | None) -> Iterator[np.ndarray]:
    """``grams`` of a text in parts, so that a very long one costs bounded memory."""
    raw = (text or "").encode()
    for at in range(0, max(1, len(raw)), CHUNK):
        yield grams(raw[at : at + CHUNK + max(SIZES) - 1])


def present(text: str | None) -> np.ndarray:
    parts = [np.unique(g) for g in chunked_grams(text)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def selected(text: str | None, lookup: np.ndarray) -> np.ndarray:
    """The chosen features that a text has; lookup: bucket -> feature + 1 or 0."""
    found = []
    for g in chunked_grams(text):
        f = lookup.take(g)
        found.append(f[f > 0])
    return np.unique(np.concatenate(found)) - 1


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int):
    y = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    y = y.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & training_row(F.col("id")))
    counts = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    share = [min(1.0, sample_rows / 2 / counts.get(k, 1)) for k in (0, 1)]
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    ids = y.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).orderBy(draw, "id").limit(2 * sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # ids: at most 2 * sample_rows rows, so it may be broadcast.
    return store(texts.join(F.broadcast(ids), "id").repartition(8, "id"), "toxicity-sample"), share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES) -> Model | None:
    rows, share = _sample(docs, labels, id_col, text_col, label_col, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(SIZES) << BITS), dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                n[y][present(text.as_py())] += 1
        f = np.flatnonzero(n.any(axis=0))
        for i in range(0, len(f), 100_000):
            part = f[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[1][part]), pa.array(n[0][part])], ["f", "pos", "neg"])

    total = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = total.get(1, 0), total.get(0, 0)
    if not n_pos or not n_neg:
        return None if not n_pos + n_neg else Model(np.zeros(0, np.int64), np.zeros(0), 20.0 if n_pos else -20.0)
    counts = map_batches(rows.select("text", "y"), count, "f int, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.log((F.col("pos") + 1.0) / (n_pos + 2.0)) - F.log((F.col("neg") + 1.0) / (n_neg + 2.0))
    # A two-proportion z score: how much the ratio stands out for the feature's support.
    both = (F.col("pos") + F.col("neg")) / float(n_pos + n_neg)
    z = F.abs(F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-12)
    top = counts.where("pos + neg >= 5").select("f", ratio.alias("r"), z.alias("z")).orderBy(F.desc("z"), "f").limit(n_features).collect()
    top.sort(key=lambda r: r.f)
    buckets, r = np.array([t.f for t in top], dtype=np.int64), np.array([t.r for t in top])
    lookup = _lookup(buckets)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [selected(t.as_py(), lookup) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(f, pa.list_(pa.int32()))], ["id", "y", "f"])

    kind = rows.schema["id"].dataType.simpleString()
    got = map_batches(rows.select("id", "text", "y"), chosen, f"id {kind}, y int, f array<int>").toArrow()
    order = np.lexsort((got["y"].to_numpy(), got["id"].to_numpy()))
    y = got["y"].to_numpy()[order].astype(float)
    lists = got["f"].take(pa.array(order)).combine_chunks()
    cols = lists.flatten().to_numpy(zero_copy_only=False)
    who = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    w, b = logistic(who, cols, r, y, weight)
    return Model(buckets, w * r, b)


def _lookup(buckets: np.ndarray) -> np.ndarray:
    lookup = np.zeros(len(SIZES) << BITS, dtype=np.int32)
    lookup[buckets] = np.arange(1, len(buckets) + 1)
    return lookup


def logistic(who, cols, r, y, weight, penalty: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights on the ratio-scaled features ``r[cols]``, by accelerated gradient descent."""
    x = r[cols]
    n = len(y)
    weight = weight / weight.sum()
    sq = np.bincount(who, x * x, n)
    rate = 1 / (0.25 * np.sum(weight * (sq + 1)) * 1.2 + penalty)
    w, b = np.zeros(len(r)), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(who, x * pw[cols], n) + pb, -30, 30)))
        d = weight * (p - y)
        nw = pw - rate * (np.bincount(cols, x * d[who], len(r)) + penalty * pw)
        nb = pb - rate * d.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per input row, in 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(model.buckets) if model else None
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model:
                for i, text in enumerate(batch.column("text")):
                    z = model.weights[selected(text.as_py(), lookup)].sum() + model.intercept
                    out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out)], ["id", "score"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
