"""SimHash near-dedup and fuzzy line dedup against brute force."""

import collections
import random
from itertools import combinations

import numpy as np
import pytest

from orrery.llm import linededup, simhash
from orrery.llm.components import components
from orrery.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def brute_fp(text, k=4):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs_pdf):
    texts = [None, "", " \n", "one", "A b C", "É à b c d", "x " * 40_000, *docs_pdf.text.head(60)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]


def test_golay_keys_meet_within_two_bits():
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    mine = simhash.codewords(x)
    for n in range(3):
        for places in combinations(range(23), n):
            other = simhash.codewords(x ^ sum(1 << p for p in places))
            assert (mine[:, :, None] == other[:, None, :]).any((1, 2)).all()


def test_first_kind_is_shared():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    diff = np.array([sum(1 << int(p) for p in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in a], dtype=np.uint64)

    def keys(f):
        out = [set() for _ in f]
        for r, k in zip(*simhash.bucket_keys(f)):
            out[r].add(int(k))
        return out

    for kind, x, y in zip(simhash.first_kind(diff), keys(a), keys(a ^ diff)):
        assert int(kind) in {k >> 58 for k in x & y}


@pytest.mark.parametrize("bucket", [512, 2])
def test_links_find_all_components(spark, bucket):
    """Random fingerprints with dense groups and chains; bucket 2 goes by centres."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:20]:
        x = b
        for _ in range(12):  # chains, and stars about their start
            x ^= sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 6)))
            fps |= {x, b ^ (1 << rng.randrange(64))}
    fps = sorted(fps)
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.links(df, bucket=bucket)).collect()}
    got = [roots.get(x, x) for x in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_near_groups_odd_rows(make):
    rows = [(3, None), (4, ""), (4, ""), (None, "a b c"), (None, "A  b\tc"), (9, "q r s t"), (9, "q r s t"), (8, "w " * 60_000)]
    got = simhash.near_groups(make(rows)).collect()
    assert collections.Counter((r.id, r.component_id) for r in got) == collections.Counter(
        [(3, 3), (4, 3), (4, 3), (None, None), (None, None), (9, 9), (9, 9), (8, 8)])
    df = make(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(3, ""), (0, "a b c"), (9, "q r s t"), (8, "w " * 60_000)])
    assert simhash.near_groups(make([])).count() == 0 and simhash.keep_one(make([])).count() == 0


def test_query_on_documents(spark, docs_pdf):
    fps = [brute_fp(t) for t in docs_pdf.text]
    root = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    ids = docs_pdf.doc_id.tolist()
    first = {}
    for i, r in enumerate(root):
        first[r] = min(first.get(r, ids[i]), ids[i])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_neardup"](spark, SF).collect()}
    assert got == {d: (f"{f:016x}", first[r]) for d, f, r in zip(ids, fps, root)}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(90)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a bigint, b bigint")
    want = union(600, pairs)
    got = {r.node: r.root for r in components(df).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in linked}
    assert components(df.limit(0)).count() == 0


# ------------------------------------------------------------------------ lines

def brute_lines(rows):
    """(row, line) -> first (row, line) of its component; rows in order of (id, row)."""
    lines = [(k, p, x.strip(" \t\r").lower()) for k, (_, t, *_) in enumerate(rows) for p, x in enumerate((t or "").split("\n"))]
    texts = sorted({x for *_, x in lines if x})
    sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    root = dict(zip(texts, union(len(texts), pairs)))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    rank = {k: n for n, k in enumerate(order)}
    first = {}
    for k, p, x in sorted(lines, key=lambda y: (rank[y[0]], y[1])):
        first.setdefault(root.get(x), (k, p))
    return {(k, p): first[root[x]] if x else (k, p) for k, p, x in lines}


def line_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    long = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "tiny"), (5, "tiny\nTINY \n\tother"), (5, "x" * 40_000)]
    for i in range(70):
        part = [rng.choice(long) for _ in range(3)] + [" ".join(word() for _ in range(rng.randrange(1, 12)))]
        for j in range(3):
            w = part[j].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = word()
            part[j] = " ".join(w)
        rows.append((100 - i, "\n".join(part)))
    return rows


def test_line_groups(make):
    rows = line_rows()
    got = linededup.line_groups(make(rows).coalesce(1)).collect()
    rid = sorted({r.rid for r in got})
    at = {x: k for k, x in enumerate(rid)}
    assert {(at[r.rid], r.pos): (at[r.keep_rid], r.keep_pos) for r in got} == brute_lines(rows)
    assert all(r.kept == ((r.rid, r.pos) == (r.keep_rid, r.keep_pos)) for r in got)


def test_dense_buckets(make, monkeypatch):
    """One large group of near copies: the same groups when buckets are split."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghijk ") for _ in range(300)) for _ in range(2)]
    rows = [(i, base[i % 2][:k] + "#" + base[i % 2][k + 1 :]) for i, k in enumerate(rng.sample(range(300), 120))]
    want = brute_lines(rows)
    monkeypatch.setattr(linededup, "BUCKET", 8)
    got = linededup.line_groups(make(rows).coalesce(1)).collect()
    at = {x: k for k, x in enumerate(sorted({r.rid for r in got}))}
    assert {(at[r.rid], r.pos): (at[r.keep_rid], r.keep_pos) for r in got} == want


def test_isolated_pairs_in_large_buckets(make):
    """Lines with a frequent template: pairs just above 0.8 that no other line ties."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for share in (150, 160):  # of 200 characters
        base = word(share)
        rows += [(0, base + word(200 - share)) for _ in range(400)]
        for _ in range(60):
            end = word(200 - share)
            rows += [(0, base + end), (0, base + end[: rng.choice([-14, -17, -20])] + word(20))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = linededup.line_groups(make(rows).coalesce(1)).collect()
    at = {x: k for k, x in enumerate(sorted({r.rid for r in got}))}
    found = {at[r.rid]: at[r.keep_rid] for r in got}
    want = {k: a for (k, _), (a, _) in brute_lines(rows).items()}
    lost = [k for k in want if found[k] != want[k]]
    assert sum(want[k] != k for k in want) > 100 and not lost, len(lost)


def test_crowd_around_the_limit(make, monkeypatch):
    """Near copies of one line, most pairs of them around 0.8: the same groups, and
    lines of different components meet in a number that does not grow with the crowd's square."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    base, rows = [word() for _ in range(85)], []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(85), rng.randrange(3, 9)):
            w[k] = word()
        rows.append((i, " ".join(w)))
    met, across = [], linededup._across
    monkeypatch.setattr(linededup, "_across", lambda *a: (met.append(linededup.store(across(*a), "met")), met[-1])[1])
    got = linededup.line_groups(make(rows).coalesce(1)).collect()
    at = {x: k for k, x in enumerate(sorted({r.rid for r in got}))}
    assert {(at[r.rid], r.pos): (at[r.keep_rid], r.keep_pos) for r in got} == brute_lines(rows)
    n = met[0].count()
    assert n < 5 * len(rows), n


def test_bitmaps_differ_no_more_than_shingles(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([3, 40, 700]))) for _ in range(40)] + ["a" * 900, "ab" * 700]
    texts += [t[:-1] + "#" for t in texts]
    rows = linededup._marks(spark.createDataFrame(list(enumerate(texts)), "h bigint, line string")).collect()
    sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in texts]
    assert len(rows) == len(texts)
    for a in rows:
        for b in rows:
            differ = sum(((a[m] ^ b[m]) & (1 << 64) - 1).bit_count() for m in linededup.MARKS)
            assert differ <= len(sets[a.h] ^ sets[b.h]) and (differ - len(sets[a.h] ^ sets[b.h])) % 2 == 0


def test_only_possible_pairs_reach_the_exact_comparison(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh ") for _ in range(380))
    texts = [base, "", "ab", "aab" * 200]
    for edits in [*range(1, 16), 60]:
        t = list(base)
        for k in rng.sample(range(380), edits):
            t[k] = "#"
        texts.append("".join(t))
    lines = spark.createDataFrame(list(enumerate(texts)), "h bigint, line string")
    pairs = list(combinations(range(len(texts)), 2))
    sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in texts]
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    df, marks = spark.createDataFrame(pairs, "a bigint, b bigint"), linededup._marks(lines)
    left = {(r.a, r.b): (r.n_a, r.n_b) for r in linededup._possible(df, marks).collect()}
    assert all(left[a, b] == (len(sets[a]), len(sets[b])) for (a, b), j in near.items() if j >= 0.8)
    assert not [p for p in left if near[p] < 0.6]
    assert {(r.a, r.b) for r in linededup._similar(df, lines, marks).collect()} == {p for p, j in near.items() if j >= 0.8}


def test_candidates_come_from_one_shuffle_of_the_lines(spark, make):
    """Signatures and texts read the same shuffle files."""
    df = linededup._lines(make(line_rows()), "doc_id", "text").where("h IS NOT NULL").select("h", "line")
    found = linededup._candidates(df)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert rows and "Reused" in plan


def test_four_bins_share_a_row(spark):
    """Groups are what the aggregation of shingles takes time for: ten a line at most, with all 40 minima."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(4000)), "ab", "a" * 500]
    rows = linededup._minima(spark.createDataFrame(list(enumerate(texts)), "h bigint, line string")).collect()
    assert collections.Counter(r.h for r in rows) == {0: 10, 1: 1, 2: 1}
    assert {r.h: sum(r[f"y{i}"] != 0 for r in rows if r.h == h for i in range(4)) for h in range(3) for r in rows if r.h == h} == {0: 40, 1: 1, 2: 1}


def test_texts_are_cut_for_signatures_and_places_only(spark, make):
    """What follows reads the stored places, no text; settings are as before."""
    key = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    before = spark.conf.get(key, "true")
    files = linededup.line_groups(make(line_rows())).inputFiles()
    assert {f.split("/")[-2].split("-", 1)[1] for f in files} == {"line-places", "line-named"}
    assert spark.conf.get(key, "true") == before


def test_lines_are_lowered_and_trimmed_each(spark, make):
    lines = ["", " ", "ΑΣ", "ΣΑ \r", "\t \tA B\t", "\u00a0X\u00a0", "İI\r", "\x0bA ", "ΟΔΟΣ", "\r\r"]
    got = linededup._lines(make([(1, "\n".join(lines)), (2, None)]), "doc_id", "text").collect()
    each = spark.createDataFrame(list(enumerate(lines)), "pos int, raw string").selectExpr("pos", "lower(trim(BOTH ' \t\r' FROM raw)) AS line")
    assert {r.pos: r.line for r in got if r.id == 1} == {r.pos: r.line for r in each.collect()}
    assert [(r.pos, r.line, r.h) for r in got if r.id == 2] == [(0, "", None)]


def test_drop_lines(make):
    rows = line_rows()
    keep, df = brute_lines(rows), make(rows).coalesce(1)
    got = linededup.drop_lines(df, length_col="n_chars")
    assert got.columns == df.columns
    want = []
    for k, (doc, text) in enumerate(rows):
        parts = (text or "").split("\n")
        rest = [x for p, x in enumerate(parts) if keep[k, p] == (k, p)]
        new = text if len(rest) == len(parts) else "\n".join(rest)
        want.append((str(doc), str(new), len(new or "")))
    assert sorted((str(r.doc_id), str(r.text), r.n_chars) for r in got.collect()) == sorted(want)
    assert linededup.drop_lines(make([])).count() == 0 and linededup.line_groups(make([])).count() == 0


def test_line_query_native_and_whole(spark, docs_pdf):
    df = QUERIES["op6_line_dedup"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = list(zip(docs_pdf.doc_id.tolist(), docs_pdf.text))
    want = {(rows[k][0], p): (rows[a][0], b) for (k, p), (a, b) in brute_lines(rows).items()}
    assert {(r.doc_id, r.line): (r.keep_doc_id, r.keep_line) for r in df.collect()} == want
