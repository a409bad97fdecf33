"""Faults found by review, each with a test of its own."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from orrery.llm import decontam, langid, packing, secrets, simhash, toxicity
from orrery.llm.queries import QUERIES, tokenizer_files

SF = "/root/testdata/sf0.001"


def test_decontamination_is_the_same_in_any_number_of_slices(spark, make):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{text(rng.randrange(8, 60))}. {text(rng.randrange(5, 40))}.") for i in range(80)]
    docs = []
    for i, t in items:  # copies with words left out, near the threshold
        w = t.split()
        docs.append((i, text(60) + " " + " ".join(x for x in w if rng.random() > 0.03) + " " + text(60)))
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = [sorted(map(tuple, decontam.find_leaks(make(docs), bench, threshold=0.3, overlap=0.5, index_bytes=n).drop("rid").collect()))
            for n in (1 << 20, 4000, 900)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 20


def test_decontamination_bounds_do_not_grow_with_the_text(monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(30))) for i in range(40)]
    index = decontam.build_index(rows)
    text = " ".join(f"w{rng.randrange(500)}" if rng.random() < 0.3 else "other" for _ in range(5000)).split()
    for _, t in rows[:10]:
        at = rng.randrange(4000)
        text[at:at] = t.split()
    ids = np.array([index.vocabulary.get(w, len(index.vocabulary)) for w in text], dtype=np.int32)
    found = []
    for n in (1 << 20, 200, 64, 1):
        monkeypatch.setattr(decontam, "RUN_WORDS", n)
        found.append(sorted(decontam.retrieve(index, ids, 0.5)))
    assert found[0] and all(f == found[0] for f in found)


def test_packing_ids_of_special_token_strings(make):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_files()["tokenizer_path"])
    encode = packing.encoder(**dict(zip(("json_path", "ranks_path", "pattern"), tokenizer_files().values())))
    for t in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext", "plain words"):
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
    many = [(i, "a") for i in range(3000)]  # short rows: no sequence is padded for a number of segments
    got = packing.pack_documents(make(many).coalesce(1), **tokenizer_files()).toPandas().groupby("sequence_id").length.sum()
    assert (got[(got & (got - 1)) != 0] == packing.CAPACITY).all()


def test_secret_scan_is_linear_in_the_parts():
    part = "user=alice{0} Zx9aB7cD3eF1gH5iJ{0}kL2 https://h{0}.example.com/p password=abcdefgh{0} "
    took = []
    for n in (2000, 20_000):
        text = "".join(part.format(i) for i in range(n))
        start = time.time()
        spans = secrets.scan(text)
        took.append(time.time() - start)
        assert len(spans) >= 3 * n
    assert took[1] < 30 * max(took[0], 0.05)


def test_span_overlap_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 20)) for a in (rng.randrange(100) for _ in range(rng.randrange(0, 8)))]
        lo = rng.randrange(100)
        hi = lo + rng.randrange(1, 30)
        assert secrets._Spans(spans).meets(lo, hi) == any(a < hi and lo < b for a, b in spans)


def test_language_stage_uses_the_score(make):
    en, de = "the quick dog and the cat went there. ", "der schnelle hund und die katze über straße. "
    rows = [(i, (en if i % 2 else de) * 12, "en" if i % 2 else "de") for i in range(300)]
    df = make(rows + [(900, "en", None), (901, "!?", None)])
    assert langid.keep_identified(df).count() == 301  # clean texts stay, short ones too
    model = langid.fit(df)
    scores = {r.id: r.score for r in langid.predict(df, model).collect()}
    least = sorted(scores[i] for i, _, _ in rows)[30]
    kept = {r.doc_id for r in langid.keep_identified(df, min_score=least).collect()}
    assert kept == {i for i, _, _ in rows if scores[i] >= least} | {900}


def test_floor_follows_the_model():
    """A model that is unsure of everything drops nothing; no floor is above MAX_FLOOR."""
    rng = np.random.default_rng(0)
    model = langid.train(rng.integers(1, 256, (40, 256)).astype(np.uint8), np.arange(40) % 2, ["a", "b"], epochs=0)
    x = rng.integers(1, 256, (200, 256)).astype(np.uint8)
    model.out, model.out_bias = model.out * 0, model.out_bias * 0  # one half each, whatever the text
    assert langid._floor(model, x, [4] * 50) < 0.01
    model.out_bias = np.array([50.0, -50.0], np.float32)
    assert langid._floor(model, x, [4] * 50) == langid.MAX_FLOOR and langid._floor(model, x * 0, [4] * 50) == 0.0


def test_language_stage_without_labels_keeps_texts(make):
    df = make([(1, "some text", None), (2, None, None), (3, "12 !", None), (4, "été", None)])
    assert sorted(r.doc_id for r in langid.keep_identified(df).collect()) == [1, 4]


def test_more_than_64_languages_are_learnt(make):
    rows = [(i, f"l{i % 70} " * 20, f"lang{i % 70:02}") for i in range(700)]
    assert len(langid.fit(make(rows), sample_windows=1).languages) == 70


def test_odd_distances_are_refused(spark):
    fps = spark.createDataFrame([(1,)], "fp bigint")
    for n in (1, 3, 5):
        with pytest.raises(ValueError):
            simhash.links(fps, max_bits=n)


def test_language_scores_equal_a_plain_network(make):
    """Embedding, convolutions, max pooling and softmax as their definitions say."""
    en, de = "the quick dog and the cat went there. ", "der schnelle hund und die katze über straße. "
    rows = [(i, (en if i % 2 else de) * 4, "en" if i % 2 else "de") for i in range(120)]
    model = langid.fit(make(rows))
    texts = [(1, "a"), (2, en * 20), (3, de + en), (4, "xyz 123 über")]
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(make(texts), model).collect()}
    for i, text in texts:
        raw, total, n = text.encode(), np.zeros(2), 0
        at = 0
        while True:
            window = (raw[at : at + 256] + b"\0" * 256)[:256]
            e = model.embed[np.frombuffer(window, np.uint8)].astype(float)
            hidden = []
            for w, conv in zip(langid.WIDTHS, model.conv):
                place = [sum(e[t + j] @ conv[j].astype(float) for j in range(w)) for t in range(256 - 3)]
                hidden.append(np.max(place, axis=0))
            z = np.maximum(np.concatenate(hidden) + model.conv_bias, 0) @ model.out + model.out_bias
            p = np.exp(z - z.max())
            total, n = total + p / p.sum(), n + 1
            at += 253
            if at + 3 >= len(raw):
                break
        assert got[i][0] == model.languages[int(total.argmax())] and abs(got[i][1] - total.max() / n) < 1e-4


def test_toxicity_ratios_and_optimum(spark, make):
    """Log-count ratios by plain counting; the weights are where the loss has no slope."""
    rng = random.Random(3)
    words = ["good", "calm", "kind", "tree", "awful", "nasty", "river", "stone"]
    rows = [(i, " ".join(rng.choice(words[:4] + words[6:] if i % 3 else words[3:]) for _ in range(8))) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    model = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), n_features=60)
    learnt = [(t, y) for (i, t), (_, y) in zip(rows, labels) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    count = {0: Counter(), 1: Counter()}
    for t, y in learnt:
        count[y].update({int(b) for b in toxicity.grams(t.encode())})
    n = {y: sum(1 for _, v in learnt if v == y) for y in (0, 1)}
    ratio = np.array([math.log((count[1][int(f)] + 1) / (n[1] + 2)) - math.log((count[0][int(f)] + 1) / (n[0] + 2)) for f in model.buckets])
    x = np.array([[f in {int(b) for b in toxicity.grams(t.encode())} for f in map(int, model.buckets)] for t, _ in learnt]) * ratio
    y = np.array([v for _, v in learnt])
    w = model.weights / ratio
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    slope = x.T @ (p - y) / len(y) + 1e-4 * w
    assert np.abs(slope).max() < 2e-3 and abs((p - y).mean()) < 2e-3
    got = {r.id: r.score for r in toxicity.score(make(rows[:20]), model).collect()}
    for i, t in rows[:20]:
        z = sum(float(v) for f, v in zip(model.buckets, model.weights) if int(f) in {int(b) for b in toxicity.grams(t.encode())}) + model.intercept
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_conversations_under_three_limits(spark):
    import pandas as pd
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_files()["tokenizer_path"])
    conv = pd.read_parquet(f"{SF}/conversations.parquet")
    conv["n"] = [1 + len(tok.encode(t or "", add_special_tokens=False).ids) for t in conv.text]
    got = QUERIES["pack_conversations"](spark, SF).toPandas().set_index("conv_id")
    want = conv.groupby("conv_id").n.sum()
    learnt = conv[conv.role == "assistant"].groupby("conv_id").n.sum().reindex(want.index).fillna(0)
    assert (got.tokens.sort_index() == want.sort_index()).all() and (got.loss.sort_index() == learnt.sort_index()).all()
    bins = got.groupby("sequence_id").agg(tokens=("tokens", "sum"), loss=("loss", "sum"), n=("tokens", "size"))
    alone = bins.n == 1
    assert ((bins.tokens <= 2048) | alone).all() and ((bins.loss <= 1024) | alone).all() and (bins.n <= 8).all()
    least = max(want.sum() / 2048, learnt.sum() / 1024, len(want) / 8)
    assert len(bins) <= 1.5 * least + 2
