"""One pass over the text for any number of rules."""

import random
import re

import pyarrow as pa
import pytest

from tracelantern.functions import prefilter
from tracelantern.operators import detect
from tracelantern.sources.phrases import PHRASES
from tracelantern.tables.ruleset import Rule, RuleSet


def keyword_rule(name, words):
    return Rule(name, "LOW", 5, "Sigma Rule", "", name, tuple(re.escape(w) for w in words))


def many_rules(n):
    rng = random.Random(5)
    made = []
    for k in range(n):
        words = [f"tool{k}", f"Agent-{k % 50}.exe"] + (["shared word"] if k % 1000 == 0 else [])
        if k == 17:
            words = [f"listed{j}x" for j in range(900)]
        made.append(keyword_rule(f"sigma_{k}", rng.sample(words, len(words))))
    return made


def lines_for(rng):
    texts = ["", "nothing", "TOOL12 runs", "xtool123", "agent-7.EXE", "a Shared word", "listed899X", "tool9 tool99 tool999", "ſhared word"]
    return texts + [" ".join(rng.choice(PHRASES).split() + [f"tool{rng.randrange(12000)}"]) for _ in range(200)]


def test_ten_thousand_keyword_rules(spark):
    made = many_rules(10_000)
    rules = RuleSet.builtin().plus(made)
    texts = lines_for(random.Random(1))
    frame = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file_id string, line_no long, line string")
    got = {(r.line_no, r.rule_id) for r in detect.hits(frame, rules).collect()}
    compiled = [(r.rule_id, re.compile("|".join(f"(?:{p})" for p in r.patterns), re.I)) for r in rules]
    assert got == {(k, name) for k, text in enumerate(texts) for name, pattern in compiled if pattern.search(text)}


@pytest.mark.skipif(prefilter.ahocorasick is None, reason="needs the automaton's library")
def test_passes_do_not_grow_with_the_rules():
    few, many = (prefilter.RuleScan([r.patterns for r in [*RuleSet.builtin(), *many_rules(n)]]) for n in (3, 3000))
    assert few._words and many._words
    assert len(few._groups) == len(many._groups)


def test_without_the_library(monkeypatch):
    """The same places either way."""
    rules = [r.patterns for r in [*RuleSet.builtin(), *many_rules(40)]]
    texts = pa.array([t.lower().replace("ſ", "s") for t in lines_for(random.Random(2))])
    with_it = prefilter.RuleScan(rules)
    monkeypatch.setattr(prefilter, "ahocorasick", None)
    without = prefilter.RuleScan(rules)
    assert without._words is None
    found = [
        prefilter._scan_texts(texts, scan._words, scan._groups, ("tool",)).to_pylist() for scan in (with_it, without)
    ]
    assert found[0] == found[1]


def test_empty_batch():
    scan = prefilter.RuleScan([("abc",)])
    assert prefilter._scan_texts(pa.array([], pa.string()), scan._words, scan._groups, ()).to_pylist() == []
