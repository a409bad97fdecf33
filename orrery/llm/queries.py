"""The registered queries of this package: each applies one operator, with
production parameters, to its whole table and returns the full result."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import bbit, blocknames, decontam, fptree, langid, linededup, packing, repeats, runs, secrets, simhash, tokencount, toxicity
from orrery.llm.common import documents, training_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers as P

    return {"tokenizer_path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def held_out():
    return (~training_row(F.col("doc_id"))).alias("held_out")


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(), "lang_pred", "score")


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return tokencount.count_tokens(documents(spark, sf_dir), P.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


@register("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_groups(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("line"), F.col("keep_id").alias("keep_doc_id"),
                        F.col("keep_pos").cast("long").alias("keep_line"), "group_size", "kept")


@register("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.drop("rid").withColumnRenamed("id", "doc_id")


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op2_simhash_neardup")
def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op3_repeated_passages")
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir), keep="none")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), **tokenizer_files()).withColumnRenamed("id", "doc_id")


@register("op9_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.exact_dedup(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@register("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def planted_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; where crc32 of the id is a multiple of ten, the words
    from one place on repeat with one period.  A null id changes nothing."""
    words = runs.words_of(doc_id, text)
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(documents(spark, sf_dir), split=planted_words)
    line = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000L div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@register("op12_ranked_search", """
WITH
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
total AS (SELECT count_if(len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs),
asked AS (
  SELECT DISTINCT i, item_id, unnest(terms) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM benchmark)),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
m AS (SELECT r, doc_id, 10 + (90 * len(terms) * n_docs) // n_terms AS m FROM docs, total),
scored AS (
  SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@register("op13_minhash_neardup", """
WITH RECURSIVE
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT r, unnest(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+2], ' '))) AS g
  FROM docs WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
near AS (
  SELECT a.r AS r, b.r AS s FROM grams a JOIN grams b USING (g)
  GROUP BY a.r, b.r
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes WHERE sizes.r = a.r) + (SELECT n FROM sizes WHERE sizes.r = b.r) - count(*))),
reach(r, s) AS (SELECT r, s FROM near UNION SELECT reach.r, near.s FROM reach JOIN near ON reach.s = near.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, doc_id) AS component_id, coalesce(least_id, doc_id) = doc_id AS kept
FROM docs LEFT JOIN sizes USING (r)
LEFT JOIN (SELECT reach.r, min(o.doc_id) AS least_id FROM reach JOIN docs o ON o.r = reach.s GROUP BY reach.r) USING (r)
""")
def op13_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bbit.near_groups(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@register("pack_conversations")
def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under three limits at once: tokens, segments, and
    tokens of the assistant's turns."""
    sizes = packing.conversation_sizes(documents(spark, sf_dir, "conversations"), **tokenizer_files())
    return packing.pack_vectors(sizes, ["conv_id"], "tokens", "loss", capacity=2048, max_segments=8, max_loss=1024)
