"""Which rules match a line, by Arrow's linear-time regex engine, batch by batch.

Most lines match few rules.  Every match of a rule must contain certain literal
words, so one pass with an automaton over the words of all rules comes first, however many
rules there are; a rule's own regexes follow only on the lines that have a word of it.  Rules in a syntax that this engine
lacks (look-around and back references in user rules) are left to an exact search in
the JVM, on the lines that have their words.

The scan is an Arrow UDF because its automata read each byte once and never backtrack.
Where the automaton's library is not installed, the words of a dozen rules at a time are
looked for in a pass of their own.  The same scan in JVM regexes or substring tests took several
times as long, and a long line that nearly matches ``a.*b.*c`` could hold up a
backtracking search for hours.
"""

import itertools
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelantern.functions.dialect import to_re2

try:  # all words of all rules in one pass
    import ahocorasick
except ImportError:
    ahocorasick = None

try:  # the parse tree of the standard library; without it every rule is searched
    from re import _parser
except ImportError:
    _parser = None

# Non-ASCII letters that equal an ASCII letter when case is ignored.
_CASE_TWINS = (("ſ", "s"), ("ı", "i"), ("İ", "i"), ("K", "k"))

# Single characters rare enough in log text to be worth a look-up.
_RARE_MARKS = set(";|`<>$@%*")

# Rules in one scan for words, and patterns in one regex.
_GROUP, _PIECE = 12, 500

# Bytes of text scanned at once: words found in marked-up text take many times the text.
_SCAN_BYTES = 1 << 20


def folded(line: Column) -> Column:
    """Lower-cased line in which ASCII text compares as the regexes compare it."""
    for twin, plain in _CASE_TWINS:
        line = F.replace(line, F.lit(twin), F.lit(plain))
    return F.lower(line)


# Added to the place of a rule that still needs an exact search on the line.
OPEN = 1_000_000


class RuleScan:
    """Rules found in a line, for rules given as tuples of patterns."""

    def __init__(self, rules: list[tuple[str, ...]]):
        self._uses = Counter()
        choices = [[self._choices(p) for p in patterns] for patterns in rules]
        tests = []
        for place, (patterns, per_pattern) in enumerate(zip(rules, choices), 1):
            picked = [self._pick(c) for c in per_pattern]
            words = None if None in picked else frozenset().union(*picked)
            if words is not None and len(words) > _PIECE and ahocorasick is None:
                words = None  # as many tests as the rule has itself
            tests.append(_RuleTest(place, words, _pieces(patterns)))
        self.open_places = [t.place for t in tests if t.regexes is None]
        guarded = [t for t in tests if t.words]
        self._words = _WordScan(guarded) if guarded and ahocorasick is not None else None
        if self._words:
            guarded = []
        self._groups = [
            (_alternation(set().union(*(t.words for t in guarded[start:start + _GROUP]))), guarded[start:start + _GROUP])
            for start in range(0, len(guarded), _GROUP)
        ]
        self._groups += [(None, [t]) for t in tests if not t.words]

    def found(self, text: Column, probes: tuple[str, ...] = ()) -> Column:
        """Array of the 1-based places of the rules found in a folded line.

        Where the scan alone cannot tell, which happens only to ``open_places``, the
        place is raised by ``OPEN``.  ``probes``
        are further regexes over the same text: -1 stands for the first, and so on.
        """
        words, groups = self._words, self._groups
        if not words and not groups and not probes:
            return F.array().cast("array<int>")

        @F.arrow_udf("array<int>")
        def scan(texts: pa.Array) -> pa.Array:
            step = max(1, len(texts) * _SCAN_BYTES // max(1, texts.nbytes))
            parts = [_scan_texts(texts.slice(at, step), words, groups, probes) for at in range(0, len(texts), step)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

        return scan(text)

    def _choices(self, pattern: str):
        """Words of the pattern's matches as nested (all, any) choices."""
        if _parser is None:
            return None
        choices = _all_of(_parser.parse(pattern, re.IGNORECASE))
        self._uses.update(set(_leaves(choices)))
        return choices

    def _pick(self, choices) -> set[str] | None:
        """One set of words, at least one of which is in every match; rare words first."""
        if choices is None or isinstance(choices, str):
            return choices and {choices}
        kind, parts = choices
        picked = [self._pick(part) for part in parts]
        if kind == "any":
            return set().union(*picked)
        return min(picked, key=lambda ws: sum(self._cost(w) for w in ws))

    def _cost(self, word: str) -> float:
        """Rough guess of how often a word turns up: short and much used words do."""
        rarity = sum(1 if c.isalnum() else 2 for c in word)
        return self._uses[word] + 1000 * 8.0 ** -rarity


def _leaves(choices) -> list[str]:
    if choices is None or isinstance(choices, str):
        return [choices] if choices else []
    return [word for part in choices[1] for word in _leaves(part)]


def _any_of(branches):
    parts = [_all_of(branch) for branch in branches]
    return None if None in parts else ("any", parts)


def _all_of(tree):
    parts, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is _parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if len(run) > 1 or run in _RARE_MARKS:
            parts.append(run)
        run = ""
        if op is _parser.SUBPATTERN:
            parts.append(_all_of(arg[-1]))
        elif op is _parser.BRANCH:
            parts.append(_any_of(arg[1]))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
            parts.append(_all_of(arg[2]))
    parts = [part for part in parts if part is not None]
    return ("all", parts) if parts else None


def _alternation(words: set[str]) -> str:
    return "|".join(re.escape(word) for word in sorted(words))


def _pieces(patterns: tuple[str, ...]) -> tuple[str, ...] | None:
    """Linear-time regexes for any of the patterns, a bounded number in each, or None."""
    translated = [to_re2(p) for p in patterns]
    if None in translated:
        return None
    return tuple(
        "(?i)" + "|".join(f"(?:{p})" for p in translated[start:start + _PIECE])
        for start in range(0, len(translated), _PIECE)
    )


class _RuleTest(NamedTuple):
    place: int
    words: frozenset[str] | None  # of which every match has one
    regexes: tuple[str, ...] | None  # found in just the texts that the rule matches


class _WordScan:
    """Which rules have a word in a text, for all rules in one pass."""

    def __init__(self, tests: list[_RuleTest]):
        self.tests = tests
        by_word: dict[str, list[int]] = {}
        for n, test in enumerate(tests):
            for word in test.words:
                by_word.setdefault(word, []).append(n)
        self._automaton = ahocorasick.Automaton()
        for k, word in enumerate(by_word):
            self._automaton.add_word(word, k)
        self._automaton.make_automaton()
        # the tests of each word, one after the other
        self._owners = np.array([n for owners in by_word.values() for n in owners], np.int64)
        self._ends = np.cumsum([len(owners) for owners in by_word.values()])
        # between texts; words are lower case, so none has it
        self._between = "A"

    def near(self, texts: pa.Array) -> list[tuple[_RuleTest, np.ndarray]]:
        """Rules and the rows in which they have a word, in order of the rules."""
        each = texts.to_pylist()
        starts = np.cumsum([0, *(len(text) + 1 for text in each)])
        hits = itertools.chain.from_iterable(self._automaton.iter(self._between.join(each)))
        found = np.fromiter(hits, np.int64).reshape(-1, 2)
        row = np.searchsorted(starts, found[:, 0], "right") - 1
        pair = np.unique(found[:, 1] * len(each) + row)
        word, row = pair // max(1, len(each)), pair % max(1, len(each))
        count = np.diff(self._ends, prepend=0)[word]
        # every word stands for its tests
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        test = self._owners[np.repeat(self._ends[word], count) - np.repeat(count, count) + at]
        pair = np.unique(test * len(each) + np.repeat(row, count))
        test, row = pair // max(1, len(each)), pair % max(1, len(each))
        edges = np.flatnonzero(np.diff(test, prepend=-1))
        return [(self.tests[test[e]], row[e:stop]) for e, stop in zip(edges, [*edges[1:], len(row)])]


def _scan_texts(text: pa.Array, words: _WordScan | None, groups, probes) -> pa.Array:
    """Per text, the rules found: words first, then the regexes of the rules that have one."""
    rows, places = [], []

    def note(hit: np.ndarray, place: int) -> None:
        rows.append(hit)
        places.append(np.full(len(hit), place, dtype=np.int32))

    def matching(indices: pa.Array, regex: str | None) -> np.ndarray:
        if regex is None or len(indices) == 0:
            return indices.to_numpy()
        hit = pc.match_substring_regex(text.take(indices), regex)
        return indices.take(pc.indices_nonzero(hit)).to_numpy()

    def decide(test: _RuleTest, near: pa.Array) -> None:
        if test.regexes is None:
            note(near.to_numpy(), test.place + OPEN)
            return
        rest = near
        for regex in test.regexes:
            hit = matching(rest, regex)
            note(hit, test.place)
            if len(test.regexes) > 1:
                rest = pa.array(np.setdiff1d(rest.to_numpy(), hit, assume_unique=True))

    everything = pa.array(np.arange(len(text)))
    for n, probe in enumerate(probes, 1):
        note(matching(everything, probe), -n)
    for test, near in words.near(text) if words and len(text) else ():
        decide(test, pa.array(near))
    for regex, tests in groups:
        near = everything if regex is None else pc.indices_nonzero(pc.match_substring_regex(text, regex))
        for test in tests:
            decide(test, near)
    if not rows:
        return pa.array([[]] * len(text), pa.list_(pa.int32()))
    row, place = np.concatenate(rows).astype(np.int64), np.concatenate(places)
    order = np.lexsort((place, row))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order]))
