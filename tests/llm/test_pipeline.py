"""The pipeline, stage by stage against brute force."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_texts import encoding  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_in_turn(spark):
    from vocaframe.llm.io import read_documents, table

    docs = read_documents(spark, SF)
    at = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert list(at) == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    columns = docs.columns

    good = table(at["quality"](spark, docs, SF), "t")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(good)
    assert good.columns == columns
    marked = [(labels[i], i in kept) for i in rows(docs) if i in labels]
    assert sum(q == k for q, k in marked) / len(marked) > 0.9

    lines = table(at["line_dedup"](spark, good, SF), "t")
    want = {i: t for i, (n, gone, t) in brute.kept_lines([(i, r.text) for i, r in kept.items()]).items() if not gone or t.strip()}
    assert lines.columns == columns
    assert {i: r.text for i, r in rows(lines).items()} == want

    unique = table(at["near_duplicates"](spark, lines, SF), "t")
    classes = brute.classes(list(want.items()))
    assert set(rows(unique)) == {i for i, (_, c) in classes.items() if c == i}

    clean = table(at["decontamination"](spark, unique, SF), "t")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == columns
    assert not [r for r in rows(clean).values() if any(i in r.text for i in items)]
    assert len(rows(unique)) - len(rows(clean)) <= 0.1 * len(rows(unique))

    tokens = rows(at["tokens"](spark, clean, SF))
    encode = encoding().encode_ordinary
    assert set(tokens) == set(rows(clean))
    for i, r in rows(clean).items():
        assert list(tokens[i].tokens) == encode(r.text) and tokens[i].round_trip

    assert set(rows(corpus_pipeline.run(spark, SF))) == set(tokens)


def test_empty_documents(spark):
    from vocaframe.llm.io import read_documents

    docs = read_documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_null_texts_pass(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text of a few words", "en", "s", 24)], schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 3 and docs.where("round_trip").count() == 3
    assert docs.where(F.col("doc_id").isNull()).count() == 1
