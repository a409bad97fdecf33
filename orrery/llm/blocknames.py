"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg).

Every text is cut into blocks of ``block_bytes`` bytes.  Equal blocks get one
integer name: the blocks are grouped by content and each content is named
after its smallest block number.  Then adjacent names are paired and the pairs
named the same way, level by level, until every document has one name.  Names
are compared by content, never by hash alone, so two documents have one name
if and only if their bytes are equal.

Scale: each level shuffles half the rows of the one before; only the first
moves text.  A block that makes up much of the data (a header, one document
copied a million times) is a hot key.  The ``MAX_HOT`` most frequent contents,
found by a count over 64-bit hashes, are salted, so no other key holds more
than 1 / MAX_HOT of the rows; the names of the salted parts meet in a table of
at most ``MAX_HOT`` blocks, small enough to broadcast.  DataFrame operations
only.

Defined results: null counts as the empty text; empty texts are equal to each
other; of equal texts one row stays, the one with the largest id (null ids
come last; among repeated rows exactly one); an empty table gives an empty
table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import keyed, stable, store

BLOCK_BYTES = 2048
MAX_HOT = 256
SALTS = 64


def _name(rows: DataFrame, key: str) -> DataFrame:
    """Replaces column ``key`` of ``rows`` (with a unique ``num``) by ``name``,
    equal for equal keys only."""
    counts = rows.groupBy(F.xxhash64(key).alias("x")).agg(F.count("*").alias("n")).where("n >= 100")
    hot = [r.x for r in counts.orderBy(F.desc("n"), "x").limit(MAX_HOT).collect()]
    is_hot = F.xxhash64(key).isin(hot) if hot else F.lit(False)
    rows = rows.withColumn("salt", F.when(is_hot, F.pmod("num", F.lit(SALTS))).otherwise(F.lit(-1)).cast("int"))
    names = rows.groupBy(key, "salt").agg(F.min("num").alias("name"))
    out = rows.join(names, [key, "salt"])
    if hot:
        whole = rows.where("salt >= 0").groupBy(key).agg(F.min("num").alias("all_name"))  # at most MAX_HOT contents
        out = out.join(F.broadcast(whole), key, "left").withColumn("name", F.coalesce("all_name", "name")).drop("all_name")
    return out.drop(key, "salt")


def block_names(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(rid, id, text_sha256, n_blocks, name)`` per input row; equal texts, and
    only they, have equal ``(n_blocks, name)``."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = keyed(stable(df), id_col, text_col).select("rid", "id", raw.alias("raw"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("raw") / F.lit(block_bytes))).cast("int")
    blocks = docs.select("rid", n_blocks.alias("n"), F.posexplode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("raw")), F.lit(block_bytes)),
        lambda i: F.substring("raw", i, F.lit(block_bytes)))).alias("pos", "block"))
    named = store(_name(blocks.withColumn("num", F.monotonically_increasing_id()), "block"), "names0")
    done, level = [named.where("n = 1")], 0
    longest = named.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        half = named.where("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.ceil(F.first("n") / 2).cast("int").alias("n"), F.min("num").alias("num"),
            F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r"))
        # A last name without a neighbour pairs with -1, which is no name.
        pair = F.struct("l", F.coalesce("r", F.lit(-1)).alias("r")).alias("pair")
        named = store(_name(store(half.select("rid", "n", "pos", "num", pair), f"pairs{level}"), "pair"), f"names{level}")
        done.append(named.where("n = 1"))
    names = done[0]
    for x in done[1:]:
        names = names.unionByName(x)
    meta = docs.select("rid", "id", F.sha2("raw", 256).alias("text_sha256"), n_blocks.alias("n_blocks"))
    return meta.join(names.select("rid", "name"), "rid")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` per input row."""
    rows = store(block_names(df, id_col, text_col, block_bytes), "identity")
    groups = store(rows.groupBy("n_blocks", "name").agg(
        F.max(F.struct("id", "rid")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["n_blocks", "name"]).select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")
