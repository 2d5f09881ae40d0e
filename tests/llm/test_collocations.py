"""Collocations against counting loops."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import duck
from tracelantern.llm import collocations
from tracelantern.llm.queries import SQL

SCHEMA = "doc_id long, text string, lang string, phrase string, k int"
ROWS = [
    (1, "New York, new york! a b c a b c a b c", "en", "x", 1),
    (1, "New York, new york! a b c a b c a b c", "en", "x", 1),
    (2, None, "en", None, None),
    (3, "", None, None, None),
    (None, "new york\tNEW  YORK\nnew york.new york a b c", None, None, None),
    (4, "ünder der Ünder der, der ünder\x0bder " * 4, "und", None, None),
    (5, "z " * 40 + "z. " + "q;" * 30, "de", None, None),
]


def plain(rows, most, least, top):
    """The contract by loops."""
    counts, words = {}, Counter()
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(found)
            own = counts.setdefault(lang or "und", Counter())
            for k in range(1, most + 1):
                own.update(tuple(found[i:i + k]) for i in range(len(found) - k + 1))
    result = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(100 * f >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, f in candidates.items() if len(q) > len(p)):
                continue
            score, _, left, right = min(
                (1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(result)


@pytest.mark.parametrize("most, least, top", [(3, 2, 2000), (3, 10, 3), (2, 2, 5), (4, 2, 2000), (5, 3, 2000)])
def test_against_loops(spark, most, least, top):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = collocations.collocations(frame, most, least, top=top).collect()
    assert sorted(map(tuple, got)) == plain(ROWS, most, least, top)


def test_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HOT_SHARE", 8)
    rows = ROWS + [(k, f"the of {k % 7} w{k} the of the of. the of", "en", None, None) for k in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collocations.hot_words(frame.selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")) == {("en", b"the"), ("en", b"of")}
    for most in (2, 3, 4):
        assert sorted(map(tuple, collocations.collocations(frame, most, 3).collect())) == plain(rows, most, 3, 2000)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_stay_exact(spark):
    rows = spark.range(1).selectExpr("'en' AS lang", "CAST(3037000507 AS long) AS a", "CAST(3037000507 AS long) AS l", "CAST(3037000509 AS long) AS r")
    wide = "cast(cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) AS decimal(32,0)) * cast(1000000 AS decimal(7,0))"
    got = rows.selectExpr(f"cast(({wide}) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0))) AS bigint) AS s").first().s
    assert got == 1_000_000 * 3037000507**2 // (3037000507 * 3037000509)


def _counted(texts, m, size):
    """Counts of full grams and of piece ends, from the paths of all blocks."""
    found = Counter()
    for names, ids in collocations.blocks(iter(texts), m, size):
        for flat, offsets, weight in collocations.paths(ids, m):
            for start, stop, w in zip(offsets, offsets[1:], weight):
                words = [names[i] for i in flat[start:stop]]
                for i in range(max(1, len(words) - m + 1)):
                    found[tuple(words[i:i + m])] += int(w)
    return found


@pytest.mark.parametrize("m", [2, 3, 4])
@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_blocks_cut_anywhere(m, size):
    rng = np.random.default_rng(3)
    vocabulary = ["a", "b", "cc", "é", "dd", ",", ".", "a,"]
    texts = [" ".join(rng.choice(vocabulary, n)).encode() for n in (0, 1, 2, 5, 60, 400)]
    texts += [b"a b " * 50, b"a " * 99, b"\t , \n", b"x" * 90, b"the end "]
    want = Counter()
    for text in texts:
        for piece in re.split(rb"[.,;:!?\n-\r]", text):
            words = piece.split()
            want.update(tuple(words[i:i + m]) for i in range(len(words)))
    assert _counted(texts, m, size) == want


def test_unary_paths_are_one_row():
    names, ids = next(collocations.blocks(iter([b"a b c d e f g. x c d y"]), 3))
    rows = [[names[i] for i in flat[s:e]] for flat, offsets, *_ in collocations.paths(ids, 3) for s, e in zip(offsets, offsets[1:])]
    assert [b"a", b"b", b"c", b"d"] in rows and [b"c", b"d", b"e", b"f", b"g"] in rows


def test_sql_states_the_contract(spark):
    """The SQL against the loops, so that both sides of the comparison are known good."""
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = duck(folder).execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({SQL['op11_collocations']})").fetchall()
    assert sorted(got) == plain(rows, 3, 10, 2000)
