"""Exact dedup, repeated passages and packing against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from orrery.llm import blocknames, packing, repeats
from orrery.llm.queries import QUERIES, tokenizer_files

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (None, "a"), (None, "a"), (5, "a"), (6, "b" * 5000), (7, "b" * 5000), (7, "b" * 5000), (8, "b" * 4999 + "c"),
       (9, "é" * 3000), (10, "c" * 2048), (11, "c" * 4096), (12, "c" * 4096)]


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, (doc, text, *_) in enumerate(rows):
        groups[text or ""].append((doc is not None, doc or 0, i))
    return groups


def test_exact_dedup_odd_rows(make):
    got = blocknames.exact_dedup(make(ODD)).collect()
    groups = brute_exact(ODD)
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(by) == len(groups)
    for text, members in groups.items():
        rows = by[hashlib.sha256(text.encode()).hexdigest()]
        ids = [m[1] for m in members if m[0]]
        assert len(rows) == len(members) == rows[0].group_size
        assert {r.keep_id for r in rows} == {max(ids) if ids else None}
        kept = [r for r in rows if r.kept]
        assert len(kept) == 1 and kept[0].id == kept[0].keep_id


def test_exact_dedup_small_blocks_and_hot_blocks(make):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 24)))) for i in range(400)] + [(1000 + i, "ab" * 11) for i in range(300)]
    got = blocknames.exact_dedup(make(rows), block_bytes=2).collect()
    want = {t: (max(m)[1], len(m)) for t, m in brute_exact(rows).items()}
    text = dict(rows)
    assert all((r.keep_id, r.group_size) == want[text[r.id]] and r.kept == (r.id == r.keep_id) for r in got) and len(got) == len(rows)


def test_exact_dedup_empty_table(make):
    assert blocknames.exact_dedup(make([])).count() == 0


def test_exact_dedup_native(spark):
    plan = QUERIES["op9_exact_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ----------------------------------------------------------- repeated passages

def brute_repeats(rows, length, keep):
    """By (row): removed bytes mask."""
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen, count = {}, collections.Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for k, raw in enumerate(raws):
        mask = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if count[w] > 1 and (keep == "none" or seen.setdefault(w, (k, i)) != (k, i)):
                mask[i : i + length] = True
        out.append((raw, mask))
    return out


def expect(raw, mask):
    edge = np.diff(np.concatenate([[0], mask.astype(int), [0]]))
    return (len(raw), int(mask.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mask])).hexdigest())


def passages():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, half = text(260), text(150)
    rows = [(0, None), (1, ""), (2, "short"), (3, shared), (4, shared), (5, "x" + shared + text(90)), (6, text(300) + shared[:205]),
            (7, text(99) + half + text(100)), (8, half + text(100)), (9, "z" * 900), (10, "Nd, " * 200), (11, shared + text(50) + shared),
            (12, shared[:130] + "!" + shared[131:]), (None, shared), (7, text(250))]
    rows += [(20 + i, text(40) + shared[30:240] + text(i)) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("windows", [120_000, 40])
def test_repeats(make, keep, windows):
    rows = passages()
    got = repeats.remove_repeats(make(rows).coalesce(1), keep=keep, shard_windows=windows).collect()
    want = sorted((str(r[0]), *expect(*w)) for r, w in zip(rows, brute_repeats(rows, 200, keep)))
    assert sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == want


def test_repeats_over_partitions(make):
    rows = passages()
    got = repeats.remove_repeats(make(rows).repartition(5), keep="none").collect()
    want = sorted((str(r[0]), *expect(*w)) for r, w in zip(rows, brute_repeats(rows, 200, "none")))
    assert sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == want


def test_repeats_empty_table(make):
    assert repeats.remove_repeats(make([])).count() == 0


def test_previous_factors_are_longest_previous_factors():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 400).astype(np.uint8)
    n, length = 370, 30
    order, lcp = repeats.suffix_order(text, np.arange(n), length)
    got = repeats.previous_factors(order, lcp, np.arange(n))

    def common(i, j):
        k = 0
        while k < length and text[i + k] == text[j + k]:
            k += 1
        return k

    assert got.tolist() == [max([common(i, j) for j in range(i)], default=0) for i in range(n)]


def test_query_on_documents(spark, docs_pdf):
    rows = list(zip(docs_pdf.doc_id, docs_pdf.text))
    got = QUERIES["op3_repeated_passages"](spark, SF).collect()
    want = {r[0]: expect(*w) for r, w in zip(rows, brute_repeats(rows, 200, "none"))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


# ---------------------------------------------------------------------- packing

def check_pieces(pieces, texts, capacity=1024):
    """texts: doc -> ids; every id in one piece, sequences gapless and full or a power of two."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc, ids in texts.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_on_documents(spark, docs_pdf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_files()["tokenizer_path"])
    texts = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in zip(docs_pdf.doc_id, docs_pdf.text)}
    assert check_pieces(QUERIES["op4_packing"](spark, SF).collect(), texts) == 0


def test_packing_odd_rows(make):
    long = "word " * 70_000 + "é" * 9000 + " " * 9000 + "end"
    rows = [(1, None), (2, ""), (3, "a b"), (4, long), (5, "<|endoftext|> is text")]
    got = packing.pack_documents(make(rows), **tokenizer_files(), with_ids=True).withColumnRenamed("id", "doc_id").collect()
    encode = packing.encoder(tokenizer_files()["tokenizer_path"], None, None)  # the reference tokenizer on whole texts
    assert check_pieces(got, {d: [*encode(t or "").tolist(), 0] for d, t in rows}) == 0
    assert all(len(p.ids) == 4 * p.length for p in got)
    assert packing.pack_documents(make([]), **tokenizer_files()).count() == 0
    assert packing.pack_documents(make([(None, "a"), (None, "a")]), **tokenizer_files()).count() >= 2


def test_pack_rests_is_exact():
    rng = random.Random(2)
    for _ in range(30):
        rests = [rng.randrange(1, 64) for _ in range(rng.randrange(1, 200))]
        bins = packing.pack_rests(rests, 64, 5)
        covered = collections.defaultdict(list)
        for b in bins:
            assert len(b) <= 5 and sum(x[2] for x in b) <= 64
            for i, at, n in b:
                covered[i].append((at, n))
        for i, size in enumerate(rests):
            at = 0
            for a, n in sorted(covered[i]):
                assert a == at and n > 0
                at += n
            assert at == size


def test_vector_bins_hold_every_limit(make, spark):
    rng = random.Random(4)
    items = [(i, rng.randrange(0, 90), rng.randrange(0, 40)) for i in range(500)] + [(500, 130, 10), (501, None, None)]
    df = spark.createDataFrame(items, "conv bigint, tokens int, loss int").withColumnRenamed("tokens", "n").withColumnRenamed("loss", "l")
    got = packing.pack_vectors(df, ["conv"], "n", "l", 100, 6, 60).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    assert sorted(r.conv for r in got) == list(range(502))
    for b in bins.values():
        assert len(b) == 1 or (sum(r.tokens for r in b) <= 100 and len(b) <= 6 and sum(r.loss for r in b) <= 60)
    lower = max(sum(r.tokens for r in got) / 100, len(got) / 6, sum(r.loss for r in got) / 60)
    assert len(bins) <= 1.25 * lower + 2
    assert packing.pack_vectors(df.limit(0), ["conv"], "n", "l", 100, 6, 60).count() == 0
