"""The registered queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tests.compare import duck
from tests.llm.test_texts import BYTE_FILE, _check_packed
from tracelantern.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - {"op11_collocations", "op13_prefix_trie"}))
def test_one_row_per_document(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op2") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in QUERIES[name](spark, FOLDER).select(key).collect()]
    assert set(got) == ids
    if not name.startswith("op10"):
        assert len(got) == len(ids)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
    assert duck(FOLDER).execute("SELECT count(*) FROM documents").fetchall()[0][0] > 0


def test_pipeline(spark):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs.cache()
        assert 0 < docs.count() <= before
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect(), rows, Tokenizer.from_file(BYTE_FILE))
