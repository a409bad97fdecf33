"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fractions import Fraction

from orrery.llm import runs
from orrery.llm.queries import QUERIES, planted_words

SF = "/root/testdata/sf0.001"


def brute(w):
    """All runs, by comparing words q apart for every q."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            a, b = i, j + q
            if b - a >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(a, b - p)) for p in range(1, q)):
                out.add((a, b - a, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    """The row of the query, word by word from its rules."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (len(found), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 9])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 11)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        assert runs.runs_of([np.array(d, dtype=np.int64) for d in docs]) == [brute(d) for d in docs]


def test_fibonacci_words_and_nested_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    inner = [1, 2] * 4 + [3]
    for w in (b, inner * 5, [0] * 50 + [1] + [0] * 49, (inner * 4 + [9]) * 4):
        assert runs.runs_of([np.array(w)]) == [brute(w)]


def test_range_successor():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        v = rng.permutation(n)
        tree = runs.WaveletTree(v)
        low = rng.integers(0, n, 50)
        high = np.array([rng.integers(x + 1, n + 1) for x in low])
        x = v[np.array([rng.integers(a, b) for a, b in zip(low, high)])]
        left, right = tree.neighbours(low, high, x)
        for a, b, c, l, r in zip(low, high, x, left, right):
            assert l == max((y for y in v[a:b] if y < c), default=c) and r == min((y for y in v[a:b] if y > c), default=c)


def test_long_texts():
    n = 60_000
    rng = random.Random(1)
    assert runs.runs_of([np.zeros(n, dtype=np.int64)]) == [[(0, n, 1)]]
    assert runs.runs_of([np.arange(n) % 1000]) == [[(0, n, 1000)]]
    plain = [rng.randrange(10**6) for _ in range(n)]
    assert runs.runs_of([np.array(plain[:100] * 3), np.array(plain), np.array(plain[:100] * 4)])[1:] == [[], [(0, 400, 100)]]


def test_query(spark, docs_pdf):
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(rows) == len(docs_pdf)
    some = 0
    for doc_id, text in zip(docs_pdf.doc_id, docs_pdf.text):
        if len((text or "").split()) > 1500:
            continue
        r = rows[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == digest(doc_id, text)
        some += r.n_runs > 0
    assert some >= 10


def test_odd_rows(spark, make):
    """Null and empty texts, repeated rows, a null id, clashing columns, long texts."""
    docs = make([(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y " * 4), (5, "a\u00a0a " * 40_000), (6, "a a a a a")])
    rows = sorted(((r.id or 0, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in runs.find_runs(docs).collect()), key=str)
    assert rows == sorted([
        (1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""), (4, 6, [(0, 6, 1)], (0, 6, 1), "a"), (4, 6, [(0, 6, 1)], (0, 6, 1), "a"),
        (0, 8, [(0, 8, 2)], (0, 8, 2), "x y"), (5, 40_000, [(0, 40_000, 1)], (0, 40_000, 1), "a\u00a0a"), (6, 5, [], None, "a a a a a")], key=str)
    assert runs.find_runs(make([])).count() == 0
    assert planted_words(None, "a b c") == [b"a", b"b", b"c"]


@pytest.mark.parametrize("found, best", [([], None), ([(5, 8, 2), (0, 8, 2)], (0, 8, 2)), ([(0, 12, 3), (0, 8, 2)], (0, 8, 2)), ([(0, 8, 2), (9, 9, 2)], (9, 9, 2))])
def test_strongest(found, best):
    assert runs.strongest(found) == best
