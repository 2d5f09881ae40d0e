"""Exact and near duplicates, and repeated byte strings, against plain versions."""

import hashlib
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tracelantern.functions.stages import new_path
from tracelantern.llm import exact_dedup, simhash, suffix_dedup
from tracelantern.llm.components import components
from tracelantern.llm.suffix_array import suffix_array


def test_exact_on_odd_rows(spark):
    rows = plain.odd_rows()
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain.lower(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i))
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = True
        for i in ids:
            stays = i == top and left
            left = left and not stays
            want[(i, top, len(ids), stays, sha)] += 1
    documents = plain.odd_documents(spark)
    got = Counter(map(tuple, exact_dedup.deduplicate(documents, exact_dedup.fresh_index(spark), "a").collect()))
    assert got == want
    kept = exact_dedup.distinct_documents(documents, exact_dedup.fresh_index(spark), "a")
    assert kept.columns == documents.columns
    assert Counter((r.doc_id, plain.lower(r.text)) for r in kept.collect()) == Counter(
        (max(ids, key=lambda i: (i is not None, i)), text) for text, ids in groups.items()
    )


def test_exact_over_batches(spark):
    path = new_path(spark)
    first = spark.createDataFrame([(5, "a"), (6, "B")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "b"), (2, "c"), (9, "C"), (3, "A")], "doc_id long, text string")
    exact_dedup.deduplicate(first, exact_dedup.DigestIndex(spark, path, 4), "one").collect()
    index = exact_dedup.DigestIndex(spark, path, 4)  # opened again
    for _ in range(2):  # a batch that runs again changes nothing
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(second, index, "two").collect()}
        assert got == {1: (6, False), 2: (9, False), 9: (9, True), 3: (5, False)}
        assert index.entries().count() == 3


def test_exact_of_hot_text(spark):
    documents = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.deduplicate(documents, exact_dedup.fresh_index(spark), "a")
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 AND keep_id = 2997").count() == 1000


def test_components(spark):
    rnd = random.Random(2)
    nodes = list(range(-50, 250))
    linked = [(n, n + 1) for n in range(-50, 40)] + [(200, k) for k in range(100, 199)] + [tuple(rnd.sample(nodes, 2)) for _ in range(60)]
    want = {n: r for n, r in plain.components(nodes, linked).items() if any(n in link for link in linked)}
    got = components(spark.createDataFrame(linked, "a long, b long").repartition(3))
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint():
    for _, text in plain.odd_rows():
        assert simhash.fingerprint((text or "").encode()) == plain.simhash(text)


@pytest.mark.parametrize("large_group", [20_000, 5])
def test_links_reach_all_within_two_bits(spark, large_group):
    rnd = random.Random(4)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        value = rnd.getrandbits(64)
        values.add(value)
        for _ in range(rnd.choice([0, 3, 25])):  # walks of one to three bits
            for _ in range(rnd.randint(1, 3)):
                value ^= 1 << rnd.randrange(64)
            values.add(value)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    want = plain.components(values, [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 2])
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(4)
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(nodes, large_group).collect()]
    assert all((a ^ b).bit_count() for a, b in links)
    assert plain.components(values, links) == want


def test_gray_index_finds_each_pair():
    rnd = random.Random(5)
    values = sorted({rnd.getrandbits(64) & ~0xFFF | rnd.getrandbits(6) for _ in range(3)} | {k for k in range(200)}, key=lambda v: _rank(v))
    fp = np.array(values, np.uint64)
    starts = np.zeros(len(fp), bool)
    starts[0] = True
    got = {(int(i), int(j)) for a, b in simhash.GrayIndex(fp, starts).pairs() for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2}


def _rank(value):
    for shift in (1, 2, 4, 8, 16, 32):
        value ^= value >> shift
    return value


def test_near_duplicates_on_odd_rows(spark):
    rows = plain.odd_rows()
    prints = [(i, plain.simhash(t)) for i, t in rows]
    values = {fp for _, fp in prints}
    root = plain.components(values, [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for i, fp in prints:
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    documents = plain.odd_documents(spark)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect())
    assert got == Counter((i, f"{fp:016x}", least.get(root[fp])) for i, fp in prints)
    stays = simhash.one_of_each(documents)
    assert stays.columns == documents.columns
    assert Counter(r.doc_id for r in stays.collect()) == Counter(
        i for i, _ in rows if i is None or i in least.values()
    )


def test_suffix_array():
    rnd = random.Random(6)
    for _ in range(500):
        text = [rnd.randint(1, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(0, 60))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def test_suffixes_are_sorted_side_by_side():
    rnd = random.Random(7)
    words = [[rnd.randint(2, 90) for _ in range(40)] for _ in range(50)]
    text = [s for _ in range(5000) for s in rnd.choice(words)] + [0]
    began = time.process_time()
    order = suffix_array(text)
    # 0.2 seconds; one suffix after the other took over 1
    assert time.process_time() - began < 0.7
    assert sorted(order) == list(range(len(text)))
    assert all(text[a:a + 400] <= text[b:b + 400] for a, b in zip(order[::97], order[1::97], strict=False))
    assert suffix_array([1] * 3000 + [0]) == list(range(3000, -1, -1))


def test_repeats_on_odd_rows(spark):
    rows = plain.odd_rows()
    got = suffix_dedup.remaining(plain.odd_documents(spark)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_octets", 256))
    assert Counter(map(tuple, got.collect())) == Counter(plain.without_repeats(rows))


@pytest.mark.parametrize("common", [32, 3])
def test_repeats_of_short_pieces(spark, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON_LEAST", common)
    rnd = random.Random(8)
    bases = ["".join(rnd.choice("abcdefgh éñ") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rnd.randint(0, 6)):
            start, size = rnd.randint(0, 260), rnd.choice([20, 30, 49, 50, 51, 60, 80, 120])
            text += rnd.choice(bases)[start:start + size] + "".join(rnd.choice("xyz") for _ in range(rnd.choice([0, 0, 1, 25])))
        rows.append((rnd.choice([i, i, i // 2]), text))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remaining(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_octets", 256))
    assert Counter(map(tuple, got.collect())) == Counter(plain.without_repeats(rows))
