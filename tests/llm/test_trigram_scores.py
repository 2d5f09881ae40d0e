"""The order of the registered scores."""

import numpy as np

from tests.llm import plain
from tracelantern.functions.stages import new_path
from tracelantern.llm import lm_scoring


def test_registered_scores_are_of_trigrams(spark):
    folder = new_path(spark)
    plain.odd_documents(spark).write.parquet(f"{folder}/documents.parquet")
    rows = lambda found: sorted(map(str, found.collect()))
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = rows(lm_scoring.op4_stupid_backoff(spark, folder))
    assert got == rows(lm_scoring.score(documents, order=3)) != rows(lm_scoring.score(documents, order=2))


def test_both_steps_read_one_shuffle_of_the_texts(spark):
    documents = spark.createDataFrame([(k, f"some words of row {k} " * 5) for k in range(200)] + [(None, None)], "doc_id long, text string")
    found = lm_scoring.score(documents, block_bytes=1000)
    assert len(found.collect()) == 201
    # the plan that ran, whose blocks are dealt once
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_ngrams_and_counts_travel_in_few_bytes():
    draw = np.random.default_rng(1)
    grams = np.unique(draw.integers(0, 1 << 64, 50_000, np.uint64) >> np.uint64(6))  # as dense as in a block
    for some in (grams, grams[:1], grams[:0], np.array([5, 1 << 63, (1 << 64) - 1], np.uint64)):
        assert lm_scoring._from_six(lm_scoring._six(some)).tolist() == some.tolist()
    assert len(lm_scoring._six(grams)) < 5.7 * len(grams)
    counts = np.where(draw.random(50_000) < 0.9, 1, draw.integers(1, 1000, 50_000))
    for some in (counts, counts[:0], np.array([254, 255, 256, 1 << 40])):
        assert lm_scoring._from_small(lm_scoring._small(some)).tolist() == some.tolist()
    assert len(lm_scoring._small(counts)) < len(counts)
