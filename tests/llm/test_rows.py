"""Row numbers are the same in every evaluation, however a scan is split."""

import pytest

from orrery.llm import blocknames, linededup, repeats
from orrery.llm.common import RID, keyed, stable

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def table(spark, tmpdir_path):
    """Three files of several row groups, each text with a passage of its own and one that it shares."""
    rows = [(i, f"{i:05d} own " * 20 + f"\n{i // 2:05d} shared " * 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(3, "doc_id")
    df.write.option("parquet.block.size", 8192).option("parquet.page.size", 1024).option("compression", "none").parquet(f"{tmpdir_path}/docs")
    yield spark.read.parquet(f"{tmpdir_path}/docs")
    spark.conf.unset(SPLIT)


def split_smaller(spark):
    """As when executors are lost or join between two evaluations."""
    spark.conf.set(SPLIT, "16k")


def numbers(df):
    return {r.rid: r.id for r in keyed(df, "doc_id", "text").collect()}


def test_numbers_survive_another_split(spark, table):
    df = stable(table)
    parts, before = table.rdd.getNumPartitions(), numbers(df)
    split_smaller(spark)
    assert spark.read.parquet(*table.inputFiles()).rdd.getNumPartitions() > parts
    assert numbers(df) == before and len(before) == 3000


def test_numbers_of_other_inputs(spark, table):
    twice = spark.read.parquet(*table.inputFiles(), *table.inputFiles())
    for df in (table.where("doc_id % 2 = 0"), table.limit(50), table.union(table), twice, spark.createDataFrame([], table.schema)):
        n, numbered = df.count(), stable(df)
        spark.conf.unset(SPLIT)
        before = numbers(numbered)
        split_smaller(spark)
        assert numbers(numbered) == before and len(before) == n
        assert stable(numbered) is numbered


def test_repeats_cut_from_their_own_rows(spark, table, monkeypatch):
    want = {r.id: (r.spans, r.kept_sha256) for r in repeats.remove_repeats(table).collect()}
    found = repeats.repeated_spans
    monkeypatch.setattr(repeats, "repeated_spans", lambda *a, **k: (found(*a, **k), split_smaller(spark))[0])
    assert {r.id: (r.spans, r.kept_sha256) for r in repeats.remove_repeats(table).collect()} == want


def test_lines_dropped_from_their_own_rows(spark, table, monkeypatch):
    want = {r.doc_id: r.text for r in linededup.drop_lines(table).collect()}
    groups = linededup.line_groups
    monkeypatch.setattr(linededup, "line_groups", lambda *a, **k: (groups(*a, **k), split_smaller(spark))[0])
    got = linededup.drop_lines(table)
    assert RID not in got.columns and {r.doc_id: r.text for r in got.collect()} == want


def test_names_join_their_own_rows(spark, table, monkeypatch):
    name = blocknames._name
    monkeypatch.setattr(blocknames, "_name", lambda *a, **k: (name(*a, **k), split_smaller(spark))[0])
    assert all(r.kept and r.id == r.keep_id for r in blocknames.exact_dedup(table).collect())
