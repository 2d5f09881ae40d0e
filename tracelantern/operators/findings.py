"""What the hits of a file say: findings, techniques, categories, timeline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelantern.functions.text import seen_line, snippet, strip
from tracelantern.operators.extract import event_time
from tracelantern.operators.ranking import first_rows


def with_rule(hit_counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Hit counts with the attributes of their rules."""
    return hit_counts.join(rules.drop("patterns"), "rule_id")


def first_findings(hits: DataFrame, n: int) -> DataFrame:
    """(file_id, rule_id, line_no, content, rank): the first n hits of every rule."""
    found = hits.select("file_id", "rule_id", "line_no", strip(F.col("line")).alias("content"))
    return first_rows(found, ["file_id", "rule_id"], [F.col("line_no")], n)


def more_than(counts: DataFrame, n: int) -> DataFrame:
    """Counts with ``more``: how many rows the first n leave out."""
    return counts.withColumn("more", F.greatest(F.col("cnt") - n, F.lit(0)))


def findings_summary(hit_counts: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, rule_id, cnt, severity, category, description, technique_id, first_seen)."""
    return with_rule(hit_counts, rules).select(
        "file_id", "rule_id", "cnt", "severity", "category", "description", "technique_id", "first_seen"
    )


def findings_by_category(hit_counts: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, category, rules, hits): rules in first-hit order, at most one entry per rule."""
    return with_rule(hit_counts, rules).groupBy("file_id", "category").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_seen", "rule_id", "cnt"))),
            lambda r: F.struct(r.rule_id.alias("rule_id"), r.cnt.alias("cnt")),
        ).alias("rules"),
        F.sum("cnt").alias("hits"),
    )


def technique_hits(hit_counts: DataFrame, rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(file_id, technique_id, technique_name, hits, first_seen); rules without a technique add nothing."""
    per_technique = (
        with_rule(hit_counts, rules)
        .where(F.col("technique_id") != "")
        .groupBy("file_id", "technique_id")
        .agg(F.sum("cnt").alias("hits"), F.min("first_seen").alias("first_seen"))
    )
    return per_technique.join(techniques, "technique_id", "left").select(
        "file_id", "technique_id", "technique_name", "hits", "first_seen"
    )


def named(techniques: DataFrame, missing: str) -> DataFrame:
    """Techniques with the given text where no name is known."""
    return techniques.withColumn("technique_name", F.coalesce("technique_name", F.lit(missing)))


def timeline(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, time, rule, severity, category, line, content, rule_ord), one row per hit."""
    attributes = rules.select("rule_id", "severity", "category")
    return hits.select(
        "file_id",
        event_time(F.col("line_no")).alias("time"),
        "rule_id",
        F.col("line_no").alias("line"),
        snippet(strip(F.col("line")), 120).alias("content"),
        "rule_ord",
    ).join(attributes, "rule_id").select(
        "file_id", "time", F.col("rule_id").alias("rule"), "severity", "category", "line", "content", "rule_ord"
    )


def first_events(events: DataFrame, n: int = 500) -> DataFrame:
    """First n timeline events of every file; times compare as text."""
    order = [F.col("time"), F.col("line"), F.col("rule_ord")]
    return first_rows(events, ["file_id"], order, n)


def first_hit_line(counts: DataFrame) -> DataFrame:
    """Counts with the line of the first hit in place of the ordering value."""
    return counts.withColumn("first_line", seen_line(F.col("first_seen"))).drop("first_seen")
