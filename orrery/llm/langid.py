"""Language identification by a byte convolutional network.

Windows of 256 bytes go through a byte embedding, convolutions of widths 2, 3
and 4, max pooling over the window and a softmax.  The network is trained in
numpy with Adam on windows of labelled texts.  A text's probabilities are the
mean over all its windows, which overlap by three bytes, so whole texts count
and no n-gram is lost at a window's edge.

Applied, the embedding and the filters fold into two tables indexed by byte
pairs: a filter's response at a place is the sum of two table rows, so a batch
of windows costs two gathers, one sum and one maximum.

Scale: training reads at most about ``sample_rows`` labelled rows, spread
evenly over all labels (one row of each at least) and chosen by a hash, at most ``sample_windows`` windows of each; the driver holds nothing else.  The
model (about 60 kB) goes to the tasks with their code; prediction is one pass
without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
every input row gives one output row, repeated rows and null ids included;
an empty table gives an empty table; without any labelled text every row is
``und``; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import keyed, map_batches, stable, training_row, without

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
STRIDE = WINDOW - max(WIDTHS) + 1
SAMPLE_ROWS, SAMPLE_WINDOWS = 3000, 4
EPOCHS, BATCH, SEED = 5, 128, 7
MAX_FLOOR = 0.45  # a language that holds half of the probability is always enough
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 256 x DIM
    conv: list[np.ndarray]  # for each width: width x DIM x FILTERS
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    floor: float = 0.0  # texts of a whole window that score less have no clear language

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For byte pairs: what places 0-1 and places 2-3 of every filter add."""
        per = [self.embed @ w for w in self.conv]  # width x 256 x FILTERS
        n = FILTERS * len(WIDTHS)
        first, second = np.zeros((256, 256, n), np.float32), np.zeros((256, 256, n), np.float32)
        for k, (width, t) in enumerate(zip(WIDTHS, per)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            first[:, :, cols] = t[0][:, None] + t[1][None, :]
            if width > 2:
                second[:, :, cols] = t[2][:, None] + (t[3][None, :] if width > 3 else 0)
        return first.reshape(65536, n), second.reshape(65536, n)


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, zero padded: n x WINDOW bytes."""
    n = max(1, -(-(len(raw) - max(WIDTHS) + 1) // STRIDE))
    flat = np.zeros((n - 1) * STRIDE + WINDOW, dtype=np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)[: len(flat)]
    return np.lib.stride_tricks.as_strided(flat, (n, WINDOW), (STRIDE, 1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: Model, tables: tuple[np.ndarray, np.ndarray], x: np.ndarray, step: int = 32) -> np.ndarray:
    first, second = tables
    pooled = np.empty((len(x), first.shape[1]), np.float32)
    for i in range(0, len(x), step):
        b = x[i : i + step].astype(np.int32)
        pair = (b[:, :-1] << 8) | b[:, 1:]
        resp = first.take(pair[:, :-2], axis=0)
        resp += second.take(pair[:, 2:], axis=0)
        pooled[i : i + step] = resp.max(axis=1)
    return _softmax(np.maximum(pooled + model.conv_bias, 0) @ model.out + model.out_bias)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Model:
    """Adam on the cross entropy; max pooling sends a gradient to one place a filter only."""
    rng = np.random.default_rng(SEED)
    n_out = len(languages)
    p = {"e": rng.normal(0, 0.5, (256, DIM)), "b": np.zeros(FILTERS * len(WIDTHS)),
         "o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_out)), "c": np.zeros(n_out)}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0

    def model() -> Model:
        return Model(languages, p["e"], [p[f"w{w}"] for w in WIDTHS], p["b"], p["o"], p["c"])

    rows = np.arange(BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            xb, yb, nb = x[pick].astype(np.int64), y[pick], len(pick)
            first, second = model().tables()
            pair = (xb[:, :-1] << 8) | xb[:, 1:]
            resp = first[pair[:, :-2]] + second[pair[:, 2:]]
            at = resp.argmax(axis=1)  # nb x filters
            pooled = np.take_along_axis(resp, at[:, None], axis=1)[:, 0] + p["b"]
            hidden = np.maximum(pooled, 0)
            d = _softmax(hidden @ p["o"] + p["c"])
            d[rows[:nb], yb] -= 1
            d /= nb
            g = {"o": hidden.T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
            dh = (d @ p["o"].T) * (pooled > 0)
            g["b"] = dh.sum(0)
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    table = np.zeros((256, FILTERS), np.float32)  # gradient by byte at place j
                    byte = xb[rows[:nb, None], at[:, cols] + j]
                    np.add.at(table, (byte, np.arange(FILTERS)[None, :]), dh[:, cols])
                    g[f"w{w}"][j] = p["e"].T @ table
                    g["e"] += table @ p[f"w{w}"][j].T
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model()


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
        sample_windows: int = SAMPLE_WINDOWS) -> Model | None:
    """Train on a bounded sample of the labelled rows that may be learnt from."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = rows.where(training_row(F.col("id")) & F.col("label").isNotNull() & F.col("text").isNotNull())
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per label
    if not counts:
        return None
    languages, quota = sorted(counts), max(1, sample_rows // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, quota / n))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    raw = F.col("text").cast("binary")
    last = F.greatest(F.length(raw) - WINDOW, F.lit(0))
    # Windows spread evenly over the text; a text of one window gives one.
    cut = F.transform(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(sample_windows - 1)),
                                                  lambda i: F.floor(last * i / max(1, sample_windows - 1)).cast("int"))),
                      lambda at: F.substring(raw, at + 1, F.lit(WINDOW)))
    picked = rows.where(F.col("text").rlike(r"\p{L}") & (draw < share[F.col("label")]))
    got = picked.select("label", cut.alias("parts"), draw.alias("draw")).orderBy("draw").limit(2 * max(sample_rows, len(counts))).collect()
    if not got:
        return None
    x = np.zeros((sum(len(r.parts) for r in got), WINDOW), dtype=np.uint8)
    y, k = np.zeros(len(x), dtype=np.int64), 0
    for r in sorted(got, key=lambda r: (r.draw, r.label)):
        for part in r.parts:
            x[k, : len(part)], y[k] = np.frombuffer(bytes(part), dtype=np.uint8), languages.index(r.label)
            k += 1
    model = train(x, y, languages)
    model.floor = _floor(model, x, [len(r.parts) for r in sorted(got, key=lambda r: (r.draw, r.label))])
    return model


def _floor(model: Model, x: np.ndarray, parts: list[int]) -> float:
    """Twice as unsure as the least sure hundredth of the sampled texts that fill
    a window, at most MAX_FLOOR: a model of few rows, unsure of all texts, has a
    low floor."""
    p = probabilities(model, model.tables(), x)
    edges = np.concatenate([[0], np.cumsum(parts)])
    scores = [p[a:b].mean(axis=0).max() for a, b in zip(edges, edges[1:]) if x[a, -1]]
    return float(np.clip(2 * float(np.quantile(scores, 0.01)) - 1, 0, MAX_FLOOR)) if scores else 0.0


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(rid, id, lang_pred, score, n_bytes)`` per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            pred, score, n_bytes = [], [], []
            held, sizes = [], []
            for text in batch.column("text"):
                s = text.as_py()
                raw = (s or "").encode()
                n_bytes.append(len(raw))
                if model is None or s is None or not any(map(str.isalpha, s)):
                    sizes.append(0)
                    continue
                held.append(windows(raw))
                sizes.append(len(held[-1]))
                if sum(map(len, held)) >= 4096 or len(sizes) >= 2048:
                    _flush(model, tables, held, sizes, pred, score)
            _flush(model, tables, held, sizes, pred, score)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(n_bytes, pa.int64())], ["rid", "id", "lang_pred", "score", "n_bytes"])

    rows = keyed(df, id_col, text_col)
    return map_batches(rows, run, f"rid bigint, id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, n_bytes bigint")


def _flush(model, tables, held, sizes, pred, score) -> None:
    if held:
        p = probabilities(model, tables, np.concatenate(held)).astype(np.float64)
    at = 0
    for n in sizes:
        if n:
            mean = p[at : at + n].mean(axis=0)
            at += n
            best = int(mean.argmax())
            pred.append(model.languages[best])
            score.append(float(min(1.0, max(0.0, mean[best]))))
        else:
            pred.append(UNDETERMINED)
            score.append(0.0)
    held.clear()
    sizes.clear()


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_score: float | None = None) -> DataFrame:
    """The rows of ``df``, all columns, with a determined language: texts with a
    letter, and of ``WINDOW`` bytes or more only those whose language scores
    ``min_score`` (by default the model's floor) or more.  Without any labelled
    row all texts with a letter stay."""
    df = stable(df)
    model = fit(df, id_col, text_col, label_col)
    if model is None:
        return without(df, keyed(df, id_col, text_col).where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))
    found = predict(df, model, id_col, text_col)
    unsure = (F.col("n_bytes") >= WINDOW) & (F.col("score") < (model.floor if min_score is None else min_score))
    return without(df, found.where((F.col("lang_pred") == UNDETERMINED) | unsure))
