"""Ranked search by FP-tree, and b-bit MinHash near-dedup, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from orrery.llm import bbit, fptree
from orrery.llm.queries import QUERIES
from tests.llm.test_near import union

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------- ranked search

def brute_search(docs, items, top=10):
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for _, t in docs]
    tf = [Counter(t) for t in terms]
    n, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc_id, _), c, t in zip(docs, tf, terms):
            m = 10 + 90 * len(t) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m))
                    for x in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) if c[x])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    text = "Ab-c1_éİx\x00y\x7fZ{q} r 5"
    assert [t.decode() for t in fptree.terms_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def random_texts(rng, n, words, most):
    vocabulary = [f"w{i}" for i in range(words)]
    return [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(words)], k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_search_equals_scoring_every_document(spark, make, slice_bytes):
    """One slice of items and many give the same rows, copies and ties included."""
    rng = random.Random(5)
    texts = random_texts(rng, 250, 60, 80)
    docs = [(i, t) for i, t in enumerate(texts + texts[:60])]
    items = [(i, t) for i, t in enumerate(random_texts(rng, 12, 60, 25))]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(fptree.search(make(docs).repartition(5), frame, slice_bytes=slice_bytes)) == brute_search(docs, items)


def test_tree_leaves_nodes_out():
    """Bounds hold, and most of a tree is never opened."""
    rng = np.random.default_rng(2)
    w = np.sort(rng.integers(200, 9000, 20))
    tf = (rng.random((4000, 20)) < np.linspace(0.7, 0.01, 20)) * rng.integers(1, 6, (4000, 20))
    tf = tf[tf.any(axis=1)].astype(np.int32)
    m = rng.integers(10, 400, len(tf))
    tree, best = fptree.Tree(tf, m, list(range(len(tf))), w), fptree.Best(10)
    opened = tree.search(best)
    scores = fptree._scores(tf, m[:, None], w)
    order = np.lexsort((np.arange(len(tf)), -scores))[:10]
    assert best.rows == [(-int(scores[i]), False, int(i)) for i in order]
    assert opened < len(tf) / 4
    assert all(tree.bound(a, b) >= fptree._scores(tree.tf[a:b], tree.m[a:b, None], w).max() for a, b in ((0, 50), (7, 8), (100, 1000)))


def test_long_items_have_trees_of_fewer_rows(spark, make, monkeypatch):
    rng = random.Random(6)
    docs = list(enumerate(random_texts(rng, 120, 300, 60)))
    items = [(0, " ".join(f"w{i}" for i in range(300))), (1, "w0 w299")]
    monkeypatch.setattr(fptree, "CELLS", 2000)
    plan = fptree.Block([i for i, _ in docs], np.full(120, 50), np.array([len(set(t.split())) for _, t in docs]),
                        np.array([int(x[1:]) for _, t in docs for x in sorted(set(t.split()))]),
                        np.array([t.split().count(x) for _, t in docs for x in sorted(set(t.split()))]), 300)
    parts, w = np.arange(300), np.arange(1, 301)
    cut, whole = fptree.Best(10), fptree.Best(10)
    plan.search(parts, w, cut)
    monkeypatch.setattr(fptree, "CELLS", 1 << 22)
    plan.search(parts, w, whole)
    assert cut.rows == whole.rows and len(cut.rows) == 10
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(fptree.search(make(docs), frame)) == brute_search(docs, items)


def test_length_weight_needs_no_overflow(spark):
    row = spark.range(1).selectExpr("900000000000000 AS n").select(fptree.length_weight("n", 50_000_000_000, 10**15).alias("m")).first()
    assert row.m == 10 + 90 * 900000000000000 * 50_000_000_000 // 10**15


def test_search_odd_rows(spark, make):
    docs = [(1, None), (2, ""), (3, "..."), (4, "a b"), (4, "a b"), (None, "a b"), (5, "A " * 50_000 + "b")]
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "zzz"), (None, "b b B")], "item_id bigint, text string")
    assert found(fptree.search(make(docs), items)) == brute_search(docs, [(1, "a"), (1, "a"), (2, None), (3, "zzz"), (None, "b b B")])
    assert fptree.search(make([]), items).count() == 0 and fptree.search(make(docs), items.limit(0)).count() == 0


def test_op12_equals_brute_force(spark, docs_pdf):
    import pandas as pd

    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    rows = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in QUERIES["op12_ranked_search"](spark, SF).collect()), key=str)
    assert rows == brute_search(list(zip(docs_pdf.doc_id, docs_pdf.text)), list(zip(bench.item_id, bench.text)))


# --------------------------------------------------------- b-bit MinHash

def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_groups(docs):
    """(id, size, component, kept) by comparing all pairs."""
    sets = [brute_set(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    roots = union(len(docs), pairs)
    least = {}
    for r, (i, _) in zip(roots, docs):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(r), least.get(r) == i) for r, (i, _), s in zip(roots, docs, sets)), key=str)


def groups(df):
    return sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
    return w


def test_signature_parts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    low = np.stack([bbit.minima(np.unique(np.concatenate([a[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64)]))) for n in (400, 380, 200, 0)])
    packed = bbit.pack(low)
    for i in range(4):
        for j in range(4):
            plain = int(((low[i] & 3) == (low[j] & 3)).sum())
            assert bbit.equal_places(packed[i : i + 1], packed[j : j + 1])[0] == plain
    assert abs(bbit.estimate(int(bbit.equal_places(packed[:1], packed[1:2])[0])) - 380 / 420) < 0.12
    assert abs(bbit.estimate(int(bbit.equal_places(packed[:1], packed[3:])[0]))) < 0.2
    assert bbit.estimate(bbit.HASHES) == 1 and 0.4 < bbit.estimate(bbit.least_equal()) < 0.7
    keys = bbit.band_keys(low)
    assert (keys[0] == keys[1]).sum() > 5 and not (keys[0] == keys[3]).any() and len(np.unique(keys[0])) == bbit.BANDS


def test_shingles_equal_brute_force(docs_pdf):
    hashes = bbit.WordHashes()
    for text in [None, "", " ", "One", "a B", "a b C", "É à b c", *docs_pdf.text.head(80)]:
        assert len(bbit.shingle_set(text, hashes)) == len(brute_set(text))


@pytest.mark.parametrize("bucket, split", [(32, 100_000), (4, 100_000), (4, 10)])
def test_groups_equal_all_pairs(spark, make, monkeypatch, bucket, split):
    """Clusters with similarities around the threshold, chains, copies; small
    limits send everything through the ways of large buckets and hot keys."""
    monkeypatch.setattr(bbit, "BUCKET", bucket)
    monkeypatch.setattr(bbit, "SPLIT", split)
    rng = random.Random(9)
    docs = []
    for c in range(6):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(25):
            docs.append(" ".join(edited(rng, base, rng.randint(0, 1 + len(base) // 40))))
        chain = base
        for _ in range(8):
            chain = edited(rng, chain, 1)
            docs.append(" ".join(chain))
    docs += docs[:10] + ["", " ", "one", "ONE", "one two", "one two"]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    assert groups(bbit.near_groups(make(rows).repartition(4))) == brute_groups(rows)


def test_signatures_only_for_shared_keys(spark):
    """A key of one set alone sends no signature into the shuffle by key."""
    sets = spark.createDataFrame([(1, [10, 11], 5), (2, [10, 12], 5), (3, [13, 14], 5)], "node bigint, bands array<bigint>, n bigint")
    for s in bbit.WORDS64:
        sets = sets.withColumn(s, sets.node)
    rows = bbit._band_rows(sets).collect()
    assert sorted((r.key, r.part, r.node, r.n, r.s3) for r in rows) == [(10, 0, 1, 5, 1), (10, 0, 2, 5, 2)]


def test_bitmaps_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:k], rng.integers(0, 1 << 63, m, dtype=np.uint64)])) for k in (3, 250, 420, 450, 470, 490, 500) for m in (0, 20, 40)]
    schema = "node bigint, n bigint, x array<bigint>, " + ", ".join(f"{m} bigint" for m in bbit.MARKS)
    rows = [(i, len(x), x.view(np.int64).tolist(), *bbit.marks(x).tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, schema)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    share = {(a, b): both[a, b] / (len(sets[a]) + len(sets[b]) - both[a, b]) for a, b in pairs}
    found = spark.createDataFrame(pairs, "a bigint, b bigint")
    left = {(r.a, r.b) for r in bbit._possible(found, df, 85).collect()}
    similar = {p for p in pairs if share[p] >= 0.85}
    assert similar and similar <= left and not [p for p in left if share[p] < 0.6]
    assert {(r.a, r.b) for r in bbit._confirmed(found, df, 85).collect()} == similar


def test_isolated_pairs_behind_a_shared_template(spark, make, monkeypatch):
    """Pairs at the threshold in large buckets of texts that are too different."""
    monkeypatch.setattr(bbit, "BUCKET", 4)
    rng = random.Random(4)
    template = [f"t{i}" for i in range(120)]
    docs = []
    for _ in range(25):
        own = template + [f"o{rng.randrange(10**9)}" for _ in range(40)]
        docs += [" ".join(own), " ".join(own[:-rng.randint(4, 18)] + [f"x{rng.randrange(10**9)}"])]
    rows = list(enumerate(docs))
    assert groups(bbit.near_groups(make(rows))) == brute_groups(rows)


def test_near_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c d"), (4, "a b c d"), (None, "A B C D"), (None, "x y"), (5, "long text " * 30_000), (6, "LONG text " * 30_001)]
    assert groups(bbit.near_groups(make(rows))) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 1, None, True),
        (5, 2, 5, True), (6, 2, 5, False)], key=str)
    assert bbit.near_groups(make([])).count() == 0


def test_op13_equals_brute_force(spark, docs_pdf):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op13_minhash_neardup"](spark, SF).collect()), key=str)
    assert rows == brute_groups(list(zip(docs_pdf.doc_id.tolist(), docs_pdf.text)))
