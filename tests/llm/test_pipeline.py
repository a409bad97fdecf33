"""The corpus pipeline: each stage against a brute-force version of its decision."""

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm.common import documents
from tests.llm.test_exact import check_pieces
from tests.llm.test_models import brute_leaks
from tests.llm.test_near import brute_fp, brute_lines, union

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = documents(spark, SF)
    junk = spark.createDataFrame([(10**6, "123 456", "en", "s", 7), (10**6 + 1, None, "en", "s", None)], docs.schema)
    start = docs.union(junk)
    one = stages["language_id"](spark, start, SF).toPandas()
    assert sorted(one.doc_id) == sorted(docs.toPandas().doc_id)

    docs = spark.createDataFrame(one, docs.schema).coalesce(1)
    two = stages["line_dedup"](spark, docs, SF).toPandas()
    rows = list(zip(one.doc_id, one.text))
    keep = brute_lines(rows)
    want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if keep[k, p] == (k, p)) for k, (d, t) in enumerate(rows)}
    assert dict(zip(two.doc_id, two.text)) == want and (two.n_chars == two.text.str.len()).all()

    docs = spark.createDataFrame(two, docs.schema)
    three = stages["near_dedup"](spark, docs, SF).toPandas()
    two = two.sort_values("doc_id").reset_index(drop=True)
    fps = [brute_fp(t) for t in two.text]
    root = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert sorted(three.doc_id) == sorted(two.doc_id[i] for i, r in enumerate(root) if i == r)

    docs = spark.createDataFrame(three, docs.schema)
    four = stages["decontamination"](spark, docs, SF).toPandas()
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    leaks = {d for d, _ in brute_leaks(zip(three.doc_id, three.text), list(zip(items.item_id, items.text)))}
    assert leaks and sorted(four.doc_id) == sorted(set(three.doc_id) - leaks)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(corpus_pipeline.tokenizer_files()["tokenizer_path"])
    docs = spark.createDataFrame(four, docs.schema)
    pieces = stages["packing"](spark, docs, SF).collect()
    assert check_pieces(pieces, {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in zip(four.doc_id, four.text)}) == 0


def test_run_and_empty_table(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 0 < got.agg(F.countDistinct("doc_id")).first()[0] <= documents(spark, SF).count()
    empty = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == empty.columns and stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
