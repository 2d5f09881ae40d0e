"""Rule hits: every line against every rule, one row per (line, rule) that matches.

All rules sit in one projection, so a line is read once, stays in its partition
and nothing is shuffled.  The scan of ``functions.prefilter`` decides nearly all
pairs of line and rule; the rest are decided here by an exact search in the JVM.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelantern.functions.dialect import to_java
from tracelantern.functions.prefilter import OPEN, RuleScan, folded
from tracelantern.tables.ruleset import Rule, RuleSet


def matches(rule: Rule, line: Column) -> Column:
    """Condition: any pattern of the rule is found in the line, whatever the case."""
    one = "|".join(f"(?:{p})" for p in rule.patterns)
    return line.rlike(to_java(one, ignore_case=True))


def rule_places(rules: RuleSet, scan: RuleScan, found: Column) -> Column:
    """1-based places of the rules that match the line, from the result of the scan."""
    certain = F.filter(found, lambda place: (place > 0) & (place < OPEN))
    if not scan.open_places:
        return certain

    # one flat list, however many rules are open
    checked = F.array(*[
        F.when(F.array_contains(found, OPEN + n) & matches(rules.rules[n - 1], F.col("line")), n) for n in scan.open_places
    ])
    both = F.concat(certain, F.array_compact(checked))
    return F.when(F.exists(found, lambda place: place > OPEN), both).otherwise(certain)


def rule_id_at(rules: RuleSet, place: Column) -> Column:
    ids = F.lit([r.rule_id for r in rules]).cast("array<string>")
    return F.get(ids, place - 1)


def scan_for(rules: RuleSet) -> RuleScan:
    return RuleScan([rule.patterns for rule in rules])


def hits(lines: DataFrame, rules: RuleSet) -> DataFrame:
    """Lines with rule_ord and rule_id, once per rule that matches the line."""
    scan = scan_for(rules)
    return (
        lines.withColumn("found", scan.found(folded(F.coalesce("line", F.lit("")))))
        .select(*lines.columns, F.explode(rule_places(rules, scan, F.col("found"))).alias("rule_ord"))
        .withColumn("rule_id", rule_id_at(rules, F.col("rule_ord")))
    )
