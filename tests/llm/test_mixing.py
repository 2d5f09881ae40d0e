"""The mix of sources: targets by a plain loop, thresholds, odd rows."""

import re
from collections import defaultdict

from tracelantern.llm.mixing import Mix

SCHEMA = "doc_id long, text string, source string, size string, `hash` int, target double, `row` long"


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """source -> target, by handing on the excess until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, found, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return found | {s: level * weight[s] for s in free}
        found |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return found


def check(frame, rows):
    mix = Mix(frame)
    got = mix.plan().collect()
    again = Mix(frame.repartition(5)).plan().collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    plain = lambda rs: sorted((str(r.doc_id), r["size"], str(r.source), r.target, r.taken) for r in rs)
    assert plain(got) == plain(again)
    sizes, taken, largest, wanted = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        wanted[r.source] = r.target
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
    for source, target in targets(sizes).items():
        assert abs(wanted[source] - target) < 1e-6 * max(1, target)
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6
        assert all(r.source_size == sizes[source] for r in got if r.source == source)
    mix.close()


def test_odd_rows(spark):
    rows = [(k, "w " * (1 + k * 7 % 50), f"s{k % 5}", "x", 1, 0.5, k) for k in range(400)]
    rows += [(k, "w v", "s1", None, None, None, None) for k in range(60)]  # ids again
    rows += [(None, None, None, None, None, None, None), (7, "", "", None, None, None, None), (8, " \t\n", None, None, None, None, None)]
    rows += [(9, "a é b " * 5, None, None, None, None, None), (10, "long " * 60_000, "", None, None, None, None)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(7), rows)


def test_equal_rows_are_split(spark):
    """A third of all rows are one row; some of them go in."""
    rows = [(1, "a b c", "hot", None, None, None, None)] * 500 + [(k, "a b c d", f"s{k % 4}", None, None, None, None) for k in range(1000)]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_sources_without_words(spark):
    rows = [(k, "", f"s{k}", None, None, None, None) for k in range(5)]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_empty_table(spark):
    assert Mix(spark.createDataFrame([], SCHEMA)).plan().count() == 0


def test_larger_budgets_nest(spark):
    rows = [(k, "w " * (1 + k % 9), "one", None, None, None, None) for k in range(300)]
    rows += [(k, "w", "two", None, None, None, None) for k in range(300, 2000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    taken = [{r.doc_id for r in Mix(frame, weights=(1, w), share=0.5).plan().collect() if r.source == "one" and r.copies} for w in (9, 4, 1)]
    assert taken[0] < taken[1] < taken[2]
