"""The rules a job runs with: built-in rows plus user rows."""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelantern.tables.frames import frame
from tracelantern.tables.lookups import KEYWORD_CATEGORY
from tracelantern.tables.rules import DETECTION_RULES


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    weight: int
    category: str
    technique_id: str
    description: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class RuleSet:
    """Rules in evaluation order.  A rule table is configuration: its size follows
    the number of rules, never the amount of log data."""

    rules: tuple[Rule, ...]

    @classmethod
    def builtin(cls) -> "RuleSet":
        return cls(tuple(Rule(*row) for row in DETECTION_RULES))

    def plus(self, more: Iterable[Rule]) -> "RuleSet":
        """With user rules added; a known id keeps its place and takes the new row."""
        by_id = {rule.rule_id: rule for rule in self.rules}
        by_id.update((rule.rule_id, rule) for rule in more)
        return RuleSet(tuple(by_id.values()))

    def plus_frame(self, rules: DataFrame) -> "RuleSet":
        """With the rules of a DataFrame that has the columns of :class:`Rule`."""
        names = list(Rule.__dataclass_fields__)
        rows = rules.select(*names).orderBy("rule_id").collect()
        return self.plus(Rule(**{**row.asDict(), "patterns": tuple(row.patterns)}) for row in rows)

    def of_category(self, category: str) -> "RuleSet":
        return RuleSet(tuple(r for r in self.rules if r.category == category))

    def categories(self) -> list[str]:
        return list(dict.fromkeys(r.category for r in self.rules))

    def keyword_rules(self) -> int:
        return sum(r.category == KEYWORD_CATEGORY for r in self.rules)

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Rule attributes as a DataFrame, for joins with hits."""
        text, whole = pa.string(), pa.int32()
        return frame(
            spark,
            [(n, r.rule_id, r.severity, r.weight, r.category, r.technique_id, r.description, list(r.patterns))
             for n, r in enumerate(self.rules, 1)],
            rule_ord=whole, rule_id=text, severity=text, weight=whole, category=text,
            technique_id=text, description=text, patterns=pa.list_(text),
        )
