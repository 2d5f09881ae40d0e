"""The pipeline's near-copies against the similarity of all pairs."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from tests.llm import plain
from tracelantern.llm import near_copies


def _shingles(text):
    words = plain.WORD.findall(plain.lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def _similarity(one, other):
    return len(one & other) / len(one | other)


def _edited(rnd, words, edits):
    words = list(words)
    for at in rnd.sample(range(len(words)), edits):
        words[at] = f"new{rnd.randrange(10**9)}"
    return words


def test_stage_finds_pairs_from_similarity_0_8(spark):
    rnd = random.Random(12)
    rows, pairs = [], []
    for k in range(300):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(100, 400))]
        other = _edited(rnd, words, rnd.randint(1, len(words) // 35))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs.append(_similarity(_shingles(rows[-2][1]), _shingles(rows[-1][1])))
    assert sum(0.8 <= s < 0.85 for s in pairs) > 20 and sum(0.9 <= s < 0.95 for s in pairs) > 20 and sum(s < 0.8 for s in pairs) > 20
    left = {r.doc_id for r in corpus_pipeline.near(spark, plain.odd_documents(spark, rows), "").collect()}
    for k, s in enumerate(pairs):
        assert 2 * k in left
        assert (2 * k + 1 in left) == (s < 0.8), s


def test_fingerprints_find_pairs_that_share_no_band(spark, monkeypatch):
    def own(grams):
        return near_copies._mixed(grams.sum() + np.arange(near_copies.BANDS, dtype=np.uint64)).view(np.int64)

    monkeypatch.setattr(near_copies, "band_keys", own)
    rnd = random.Random(14)
    rows = []
    for k in range(8):
        words = [f"w{rnd.randrange(90000)}" for _ in range(3000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(plain.odd_documents(spark, rows)).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(8)) >= 6
    assert all(found[2 * k] == 2 * k for k in range(8))


def test_components_of_chains_and_large_groups(spark):
    rnd = random.Random(13)
    rows = [(None, "no id"), (900, ""), (901, None), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "b a")]
    words = [f"w{k}" for k in range(200)]
    for k in range(40):  # each step is near the one before, the ends are not alike
        rows.append((k, " ".join(words)))
        words = _edited(rnd, words, 3)
    base = [f"v{k}" for k in range(300)]
    rows += [(100 + k, " ".join(_edited(rnd, base, rnd.randint(0, 12)))) for k in range(80)]
    sets = {i: _shingles(t) for i, t in rows if i is not None}
    want = plain.components(sets, [p for p in combinations(sets, 2) if _similarity(sets[p[0]], sets[p[1]]) >= 0.8])
    documents = plain.odd_documents(spark, rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(documents.where("doc_id IS NOT NULL")).collect()}
    assert got == want
    stays = near_copies.one_of_each(documents)
    assert stays.columns == documents.columns
    assert {r.doc_id for r in stays.collect()} == {None, *want.values()}


def test_many_texts_just_below_the_similarity_are_not_all_compared(spark, monkeypatch):
    rnd, met = random.Random(15), []
    base = [f"v{k}" for k in range(120)]
    rows = [(k, " ".join(_edited(rnd, base, 3))) for k in range(600)]
    rows += [(1000 + k, rows[50 * k][1] + " end") for k in range(10)]  # alike to one text each, and to few others
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: met.append(pairs.distinct().count()) or verified(pairs, *rest))
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: _shingles(t) for i, t in rows}
    assert found == plain.components(sets, [p for p in combinations(sets, 2) if _similarity(sets[p[0]], sets[p[1]]) >= 0.8])
    assert sum(met) <= 2 * near_copies.BANDS * len(rows)  # a pair for each member of a band, twice


def test_first_shingles_find_all_alike_sets(spark):
    rnd, sets = random.Random(17), {}
    for k in range(40):
        base = rnd.sample(range(500), rnd.randint(1, 120))
        for j in range(6):
            some = set(rnd.sample(base, rnd.randint(-(-9 * len(base) // 10), len(base)))) | {10**6 + rnd.randrange(10**6) for _ in range(rnd.randint(0, len(base) // 12))}
            sets[10 * k + j - 200] = some
    rows = [(k, len(v), k, bytearray(np.array(sorted(v), "<u4").tobytes())) for k, v in sets.items()]
    found = near_copies._by_prefix(spark.createDataFrame(rows, "node long, size int, root long, grams binary"), 0.8)
    found = {(r.a, r.b) for r in found.distinct().collect()}
    alike = {(a, b) for a, b in combinations(sorted(sets), 2) if _similarity(sets[a], sets[b]) >= 0.8 and sets[a] != sets[b]}
    assert len(alike) > 200 and alike <= found
    assert len(found) < 3 * len(alike)


def test_workers_get_texts_in_small_batches(spark, monkeypatch):
    shingled = near_copies._shingled

    def watched(words_in_shingle):
        run = shingled(words_in_shingle)

        def few(batches):
            for batch in batches:
                assert batch.nbytes < 40_000
                yield batch

        return lambda batches: run(few(batches))

    monkeypatch.setattr(near_copies, "_shingled", watched)
    monkeypatch.setattr(near_copies, "_BATCH_BYTES", 10_000, raising=False)
    rows = [(k, " ".join(f"w{k // 2}x{j}" for j in range(200))) for k in range(100)]
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {tuple(r) for r in found.collect()} == {(k, k - k % 2) for k in range(100)}
