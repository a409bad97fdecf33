"""Fuzzy line dedup by MinHash, with DataFrame operations only.

A line is compared in lower case without surrounding white space, as the set of
its character shingles (``SHINGLE`` characters; a shorter line is one shingle).
Lines link at a Jaccard similarity of 0.8 or more.

* Signature: one 64-bit hash per shingle, and the smallest of each of 40 bins
  of the hash space (one-permutation MinHash).  Four bins are a band.  Ten bands
  find a pair at 0.8 with probability 0.995 and a closer one more surely.  Short
  lines, told by how many bins they fill, have four bands of ten bins or eight
  of five: similar ones differ in fewer shingles than there are bands, so a band
  is equal.  A line just above a class limit has the bands of the class below
  too.
* Candidates: different lines that share a band.  A bucket of at most
  ``BUCKET`` lines is compared in pairs.  In a larger one the lines are first
  compared with the bucket's first line, with their neighbour and with the
  ``HUBS`` most central ones, which ties dense groups together.
* The rest of the large buckets, exactly: lines of different components so far
  are compared if they share one of their rarest shingles (a prefix filter with
  the lengths and places that a similarity of 0.8 needs) and if bitmaps of their
  shingles allow the similarity.  No pair of 0.8 is left out, whatever the size
  of a bucket.
* Verification: the exact Jaccard similarity of both shingle sets, for the pairs
  that the bitmaps of their shingles do not rule out.
* Distributed union-find over the links; equal lines are one node from the
  start.  Of each component the first line stays: the smallest (id, row, line
  number), null ids last.

Scale: equal lines are grouped by their hash with map-side combine.  The texts
are shuffled once, for the signatures and to fetch the candidates, band
keys (16 bytes each) once.  No bucket gives more rows than BUCKET times its
members; lines of large buckets are shuffled once more, with a fifth of their
shingles.  Large groups of lines just below 0.8 may give many candidates: they
are all compared, if the bitmaps cannot tell them from similar ones.  A line is one row until its shingles are rows.

Defined results: a null text is one empty line; blank lines always stay and
have no component; equal lines are recognised by a 64-bit hash; repeated rows
are rows of their own; an empty table gives an empty table; other columns are
ignored (``drop_lines`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.llm.common import RID, keyed, release, stable, store
from orrery.llm.components import components

SHINGLE, SIMILARITY, BINS, BUCKET = 9, 0.8, 40, 32
HUBS = 4  # lines of a large bucket that all its others are compared with
SLOTS = 1 << 18  # counters for how common shingles are
MARKS = [f"m{i}" for i in range(16)]  # 64-bit words of a line's bitmap
#: (most bins with a shingle, bins of a band) of each class of lines.
CLASSES = ((10, 10), (18, 5), (None, 4))


@contextmanager
def _many_groups(spark: SparkSession) -> Iterator[None]:
    """Aggregations here have a group for every few rows: Spark's small first
    map is full at once, and asking it for every row is in vain."""
    key = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, id, pos, line, h)``; h is null for blank lines."""
    # Lower case first: no letter's case depends on another line, and one text is faster than its parts.
    texts = keyed(df, id_col, text_col).select("rid", "id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    cut = texts.select("rid", "id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    # Most lines have nothing to trim, which is told by their ends.
    spaced = reduce(or_, [f("raw", F.lit(c)) for f in (F.startswith, F.endswith) for c in " \t\r"])
    line = cut.select("rid", "id", "pos", F.when(spaced, F.trim("raw", F.lit(" \t\r"))).otherwise(F.col("raw")).alias("line"))
    return line.withColumn("h", F.when(F.col("line") != "", F.xxhash64("line")))


def _wide(line: str) -> Column:
    """Two bytes a character, so that a shingle is a slice at a known place."""
    return F.encode(line, "UTF-16BE")


def _shingles(wide: str) -> Column:
    """The hashed shingles of a ``_wide`` column, repeats included."""
    width = 2 * SHINGLE
    # The outer array makes the text a variable of the function: a column of bytes
    # that it names itself would be copied whole for every shingle.
    return F.transform(F.array(wide), lambda text: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1)), F.lit(2)),
        lambda at: F.xxhash64(F.substring(text, at, F.lit(width)))))[0]


def _distinct(lines: DataFrame) -> DataFrame:
    """``(h, line)``: each of the lines (h, line) once."""
    return lines.groupBy("h").agg(F.min("line").alias("line"))


def _minima(lines: DataFrame) -> DataFrame:
    """``(h, part, y0..y3)``: for each line (h, line) and each four bins in a row
    the smallest shingle hash of each bin, hashed together with the bin; 0 for
    an empty one.

    Shingles are rows, aggregated in place: lines are dealt by h once, and the
    aggregation, like the ones that follow, keeps to that.  New groups are what
    it takes most time for, so that four bins share a row.
    """
    width = 2 * SHINGLE
    texts = _distinct(lines).select("h", _wide("line").alias("wide"))
    at = F.explode_outer(F.sequence(F.lit(1), F.greatest(F.length("wide") - width + 1, F.lit(1)), F.lit(2))).alias("at")
    hashed = texts.select("h", "wide", at).select("h", F.xxhash64(F.substring("wide", F.col("at"), F.lit(width))).alias("x"))
    # The bin of a hash: its upper half, scaled to BINS.
    placed = hashed.select("h", "x", F.shiftrightunsigned(F.shiftrightunsigned("x", 32) * BINS, 32).cast("int").alias("bin"))
    least = [F.min(F.when(F.col("bin").bitwiseAND(3) == i, F.col("x"))).alias(f"x{i}") for i in range(4)]
    parts = placed.groupBy("h", F.shiftright("bin", 2).alias("part")).agg(*least)
    y = [F.when(F.col(f"x{i}").isNull(), 0).otherwise(F.xxhash64((F.col("part") * 4 + i).cast("long"), f"x{i}")).alias(f"y{i}") for i in range(4)]
    return parts.select("h", "part", *y)


def _bands(lines: DataFrame) -> DataFrame:
    """``(h, key)`` of all bands of all lines (h, line)."""
    one = _minima(lines)
    # A band is the combination of its bins' minima; 0 where all bins are empty.
    cols, bands = [], []
    for k, (_, bins) in enumerate(CLASSES):
        for j in range(BINS // bins):
            inside: dict[tuple[int, ...], list[int]] = {}
            for part in range(j * bins // 4, -(-(j + 1) * bins // 4)):
                inside.setdefault(tuple(i for i in range(4) if j * bins <= part * 4 + i < (j + 1) * bins), []).append(part)
            each = F.lit(0).cast("long")
            for places, parts in inside.items():
                both = reduce(Column.bitwiseXOR, [F.col(f"y{i}") for i in places])
                each = F.when(F.col("part").isin(parts), both).otherwise(each)
            cols.append(F.bit_xor(each).alias(f"b{k}_{j}"))
            key = F.when(F.col(f"b{k}_{j}") != 0, F.xxhash64(F.lit(k * 64 + j), f"b{k}_{j}"))
            low = CLASSES[k - 1][0] if k else 0
            most = CLASSES[k][0]
            # Just above a limit: the class below too, so that similar lines always have one in common.
            mine = F.col("n") > low if most is None else (F.col("n") > low) & (F.col("n") <= int(most / SIMILARITY) + 1)
            bands.append(F.when(mine, key))
    filled = sum((F.col(f"y{i}") != 0).cast("int") for i in range(4))
    signed = one.groupBy("h").agg(F.sum(filled).alias("n"), *cols)
    # The outer form: the optimizer adds no filter that would compute the keys again.
    return signed.select("h", F.explode_outer(F.array(*bands)).alias("key")).where("key IS NOT NULL")


def _in_buckets(rows: DataFrame) -> DataFrame:
    """``(key, h)`` distinct, of keys with two different h at least.

    One sort by key; each row looks at its neighbours only, so a hot key is
    streamed through and never held.
    """
    w = Window.partitionBy("key").orderBy("h")
    return (rows.select("key", "h", F.lag("h").over(w).alias("a"), F.lead("h").over(w).alias("b"))
            .where("a != h OR b != h").select("key", "h").distinct())


def _candidates(lines: DataFrame) -> DataFrame:
    """``(h, line, keys)``: the lines (h, line) that share a bucket with others, and
    the keys of those buckets.

    Signatures and texts come from one shuffle of the lines, which Spark reads twice.
    """
    keys = _in_buckets(_bands(lines)).groupBy("h").agg(F.collect_list("key").alias("keys"))
    return _distinct(lines).join(keys, "h")


def _pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs in the small buckets of ``rows`` (key, h); the rows of the large ones."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    small = rows.join(sizes.where(F.col("n") <= BUCKET), "key").select("key", "h")
    pairs = small.select("key", F.col("h").alias("a")).join(small.select("key", F.col("h").alias("b")), "key").where("a < b")
    return pairs.select("a", "b"), rows.join(sizes.where(F.col("n") > BUCKET), "key").select("key", "h")


def _dense(rows: DataFrame) -> DataFrame:
    """Each row of a large bucket with the bucket's first row and with the row before it."""
    # The order differs from bucket to bucket, so that each has another first row.
    w = Window.partitionBy("key").orderBy(F.xxhash64("key", "h"), "h")
    near = rows.select("h", F.array_distinct(F.array(F.first("h").over(w), F.lag("h").over(w))).alias("near"))
    near = near.select("h", F.explode("near").alias("x")).union(_hubs(rows))
    return near.where("x != h").select(F.least("h", "x").alias("a"), F.greatest("h", "x").alias("b"))


def _hubs(rows: DataFrame) -> DataFrame:
    """``(h, x)``: each row (key, h) of a large bucket with the ``HUBS`` lines of the
    bucket that share their buckets with most rows: near copies are closer to
    the line that they were made from than to each other."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    central = rows.join(sizes, "key").groupBy("h").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "h")
    hubs = rows.join(central, "h").withColumn("place", F.row_number().over(w)).where(F.col("place") <= HUBS)
    return rows.join(hubs.select("key", F.col("h").alias("x")), "key").select("h", "x")


def _possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b)``: the ``pairs`` (a, b) whose numbers of shingles and
    bitmaps (rows of ``_marks``) allow the similarity; exact, no similar pair goes."""
    one, two = (marks.select(F.col("h").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *MARKS)]) for x in "ab")
    enough = F.least("n_a", "n_b") >= _least(SIMILARITY, F.greatest("n_a", "n_b"))
    return pairs.join(one, "a").join(two, "b").where(enough & _fits()).select("a", "b", "n_a", "n_b")


def _fits() -> Column:
    """Whether the bitmaps of a pair (n_a, m0_a.., n_b, m0_b..) allow the similarity."""
    differ = sum(F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS)
    both = F.col("n_a") + F.col("n_b")
    return both - differ >= 2 * _least(SIMILARITY / (1 + SIMILARITY), both)


def _similar(pairs: DataFrame, texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of lines (h, line; marks: their ``_marks``) that are
    similar by their shingle sets."""
    one = texts.select(F.col("h").alias("a"), _wide("line").alias("wide_a"))
    two = texts.select(F.col("h").alias("b"), _wide("line").alias("wide_b"))
    # By b first: the pairs lie by b already.
    sets = _possible(pairs, marks).join(two, "b").join(one, "a")
    # The set operation drops repeats itself.
    common = F.size(F.array_intersect(_shingles("wide_a"), _shingles("wide_b"))).alias("common")
    sets = sets.select("a", "b", "n_a", "n_b", common)
    return sets.where(F.col("common") >= F.lit(SIMILARITY) * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _least(share: float, n: Column) -> Column:
    """The smallest whole number of at least ``share`` times n; rounding may only make it smaller."""
    return F.ceil(F.lit(share) * n - F.lit(1e-6)).cast("int")


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """``(h, x)``: the distinct shingles of each line (h, line)."""
    wide = texts.groupBy("h").agg(_wide(F.min("line")).alias("wide"))
    return wide.select("h", F.explode(F.array_distinct(_shingles("wide"))).alias("x"))


def _marks(texts: DataFrame) -> DataFrame:
    """``(h, n, m0..m15)``: the number of shingles and a bitmap of each line (h, line);
    a bit tells whether an odd number of its shingles falls there.  Two lines have at
    least as many different shingles as different bits."""
    # By four words first: four bitmap words per row, not all of them for each shingle.
    word = F.expr(f"CAST(shiftrightunsigned(x, 6) & {len(MARKS) - 1} AS INT)").alias("word")
    rows = _shingle_rows(texts).select("h", word, F.expr("shiftleft(1L, CAST(x & 63 AS INT))").alias("bit"))
    none = F.lit(0).cast("long")
    bits = [F.bit_xor(F.when(F.col("word").bitwiseAND(3) == i, F.col("bit")).otherwise(none)).alias(f"bits{i}") for i in range(4)]
    words = rows.groupBy("h", F.shiftright("word", 2).alias("part")).agg(F.count("*").alias("n"), *bits)
    marks = [F.bit_xor(F.when(F.col("part") == i // 4, F.col(f"bits{i % 4}")).otherwise(none)).alias(m) for i, m in enumerate(MARKS)]
    return words.groupBy("h").agg(F.sum("n").cast("int").alias("n"), *marks)


def _prefixes(texts: DataFrame) -> DataFrame:
    """``(h, n, at, x, short)``: of each line (h, line) with n shingles, the rarest
    that a similar line must share, with their places in the order of all.

    Of two similar lines the shorter one has a common shingle among its first
    n - 2t/(1+t) n + 1 (``short``), the longer one among its first n - t n + 1.
    """
    rows = _shingle_rows(texts)
    # How common a shingle is, by SLOTS counters; any order that is the same for
    # all lines gives whole results, a better one fewer candidates.
    slot = F.pmod("x", F.lit(SLOTS)).cast("int").alias("slot")
    counts = rows.groupBy(slot).agg(F.count("*").cast("int").alias("n")).where(F.col("n") > 1)
    # One row, an array of SLOTS numbers: a place to look up, not a join with a row per shingle.
    every = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(counts, "slot", "left")
    listed = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("n", F.lit(1)).alias("n"))))
    dense = store(every.agg(listed.alias("all")).select(F.transform("all", lambda s: s["n"]).alias("n")), "line-slots")
    ranked = rows.select("h", "x", slot).withColumn("n", F.element_at(dense.scalar(), F.col("slot") + 1))
    ordered = ranked.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("all"))
    ordered = ordered.select("h", F.size("all").alias("n"), "all")
    long = F.col("n") - _least(SIMILARITY, F.col("n")) + 1
    short = F.col("n") - _least(2 * SIMILARITY / (1 + SIMILARITY), F.col("n")) + 1
    first = ordered.select("h", "n", F.posexplode(F.slice("all", F.lit(1), long)).alias("at", "one"))
    return first.select("h", "n", "at", "one.x", (F.col("at") < short).alias("short"))


def _across(texts: DataFrame, marks: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines (h, line; marks: their ``_marks``) that can be similar by
    number, order and bitmap of their shingles and that have different roots (node,
    root); without a cap.

    A shingle whose lines all have one root gives no pair.  Of another one, lines
    of the most frequent root meet only those of other roots.
    """
    named = _prefixes(texts).join(roots, F.col("h") == F.col("node"), "left")
    rows = store(named.select("h", "n", "at", "x", "short", F.coalesce("root", "h").alias("root")), "line-prefixes")
    release(texts.sparkSession)
    most = rows.groupBy("x", "root").agg(F.count("*").alias("m"), F.min(F.when(F.col("short"), F.col("n"))).alias("low"))
    # Of each shingle the shortest line of ``short`` rows, and that of the other roots.
    w = Window.partitionBy("x").orderBy(F.asc_nulls_last("low"), "root")
    most = most.withColumn("next", F.lead("low").over(w))
    low = F.min(F.when(F.col("low").isNotNull(), F.struct("low", "root", "next"))).alias("low")
    most = most.groupBy("x").agg(F.max(F.struct("m", "root"))["root"].alias("most"), F.count("*").alias("roots"), low)
    most = most.where("roots > 1 AND low IS NOT NULL").select(F.col("x").alias("of"), "most", "low")
    # A row that is not short only meets shorter lines, and late ones only much shorter ones.
    least = F.when(F.col("low.root") == F.col("root"), F.col("low.next")).otherwise(F.col("low.low"))
    meets = F.col("short") | ((least <= F.col("n")) & (F.col("n") - F.col("at") >= _least(SIMILARITY / (1 + SIMILARITY), least + F.col("n"))))
    rows = rows.join(most, (F.col("x") == F.col("of")) & meets).withColumn("common", F.col("root") == F.col("most")).drop("of", "low")
    rows = rows.join(marks.drop("n"), "h")
    cols = ("h", "n", "at", "root", *MARKS)
    meets = F.when(F.col("common"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    one = rows.where("short").select("x", F.explode(meets).alias("common"), *[F.col(c).alias(f"{c}_a") for c in cols])
    two = rows.select("x", "common", *[F.col(c).alias(f"{c}_b") for c in cols])
    # What both share at most, if this shingle is the first that they share.
    shared = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    need = _least(SIMILARITY / (1 + SIMILARITY), F.col("n_a") + F.col("n_b"))
    fits = ((F.col("root_a") != F.col("root_b")) & (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= _least(SIMILARITY, F.col("n_b")))
            & (shared >= need) & _fits())
    found = one.join(two, ["x", "common"]).where(fits)
    return found.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct()


def links(lines: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of different lines (rows h, line; any number of rows
    each) with a verified similarity of ``SIMILARITY`` or more; of lines that
    others tie together not every pair."""
    found = store(_candidates(lines), "line-texts")
    release(lines.sparkSession)
    texts = found.select("h", "line")
    pairs, large = _pairs(found.select(F.explode("keys").alias("key"), "h"))
    large = store(large, "line-large")
    hot = not large.isEmpty()
    if hot:
        pairs = pairs.union(_dense(large))
    pairs = store(pairs.distinct(), "line-pairs")
    marks = store(_marks(texts), "line-marks")
    release(lines.sparkSession)
    found = store(_similar(pairs, texts, marks), "line-links")
    release(lines.sparkSession)
    if not hot:
        return found
    # Whole large buckets, but for the lines that are in one component already.
    rest = _across(texts.join(large.select("h").distinct(), "h"), marks, components(found))
    return found.union(store(_similar(rest, texts, marks), "line-links-across"))


def line_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(rid, id, pos, root, keep_rid, keep_id, keep_pos, group_size, kept)``
    per line of the input; root names the component."""
    lines = _lines(stable(df), id_col, text_col)
    with _many_groups(df.sparkSession):
        roots = components(links(lines.where("h IS NOT NULL").select("h", "line")))
    release(df.sparkSession)
    # The texts are cut once more for the places; what follows reads these.
    places = store(lines.select("rid", "id", "pos", "h"), "line-places")
    many = places.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # Only lines that have company need to be told.
    linked = roots.withColumnRenamed("node", "h")
    nodes = store(many.join(linked, "h", "full").select("h", F.coalesce("root", "h").alias("root")), "line-nodes")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "pos")).alias("first")
    groups = places.join(nodes, "h").groupBy("root").agg(first, F.count("*").alias("group_size"))
    named = store(nodes.join(groups, "root"), "line-named")
    rows = places.join(named, "h", "left")
    kept = F.col("first").isNull() | ((F.col("first.rid") == F.col("rid")) & (F.col("first.pos") == F.col("pos")))
    return rows.select("rid", "id", "pos", F.coalesce("root", "h").alias("root"),
                       F.coalesce("first.rid", "rid").alias("keep_rid"), F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
                       F.coalesce("first.pos", "pos").alias("keep_pos"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"))


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df``, all rows and columns, with only the kept lines in each text; a
    text that loses no line stays as it is (null too).  ``length_col``, if
    given, gets the new number of characters."""
    names, df = df.columns, stable(df)
    groups = line_groups(df, id_col, text_col)
    flags = groups.groupBy(F.col("rid").alias(RID)).agg(
        F.min("kept").alias("all_kept"), F.sort_array(F.collect_list(F.struct("pos", "kept"))).alias("flags"))
    kept = F.transform("flags", lambda x: x["kept"]).alias("__orrery_kept")
    flags = store(flags.where(~F.col("all_kept")).select(RID, kept), "line-flags")
    release(df.sparkSession)
    # The flags grow with the corpus, so the join is the same at every size.
    text = F.col(f"`{text_col}`")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: F.col("__orrery_kept")[i]), "\n")
    new = {text_col: F.when(F.col("__orrery_kept").isNull(), text).otherwise(rest)}
    out = df.join(flags.hint("merge"), RID, "left").select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in names])
    if length_col:
        out = out.withColumn(length_col, F.coalesce(F.length(F.col(f"`{text_col}`")).cast("long"), F.col(f"`{length_col}`")))
    return out
