"""Scores: per rule, per file, and the level of a file."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelantern.tables.lookups import LOWEST_LEVEL, THREAT_LEVELS


def rule_points(n: Column, weight: Column) -> Column:
    """The first hit counts the weight, hits two to five 0.3 of it, later hits 0.1."""
    return (
        F.when(n == 1, weight)
        .when(n <= 5, weight + (n - 1) * (weight * 0.3))
        .otherwise(weight + 4 * (weight * 0.3) + (n - 5) * (weight * 0.1))
    )


def rule_scores(hit_counts: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, rule_id, cnt, weight, rule_score, first_seen)."""
    score = rule_points(F.col("cnt"), F.col("weight").cast("double"))
    weights = rules.select("rule_id", "weight")
    return hit_counts.join(weights, "rule_id").select(
        "file_id", "rule_id", "cnt", "weight", score.alias("rule_score"), "first_seen"
    )


def _sum_in_order(parts: Column, start: Column) -> Column:
    """Sum of the last field of sorted structs; the order decides how doubles round."""
    return F.aggregate(parts, start, lambda total, part: total + part.points)


def threat_scores(files: DataFrame, rule_scores: DataFrame, matches: DataFrame) -> DataFrame:
    """(file_id, threat_score, threat_level) of every file, with or without hits.

    Lists hold one number per rule or correlation of a file, never per hit.
    """
    from_rules = rule_scores.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct("first_seen", F.col("rule_score").alias("points")))).alias("rule_points")
    )
    from_chains = matches.groupBy("file_id").agg(
        F.sort_array(
            F.collect_list(F.struct("corr_ord", F.col("score_boost").cast("double").alias("points")))
        ).alias("chain_points")
    )
    total = _sum_in_order(F.col("rule_points"), F.lit(0.0))
    total = F.coalesce(_sum_in_order(F.col("chain_points"), total), total, F.lit(0.0))
    score = F.least(F.floor(total), F.lit(100)).cast("int")
    return (
        files.select("file_id")
        .join(from_rules, "file_id", "left")
        .join(from_chains, "file_id", "left")
        .select("file_id", score.alias("threat_score"))
        .withColumn("threat_level", threat_level(F.col("threat_score")))
    )


def threat_level(score: Column) -> Column:
    level = F.lit(LOWEST_LEVEL)
    for floor, name in reversed(THREAT_LEVELS):
        level = F.when(score >= floor, name).otherwise(level)
    return level


def score_bar(score: Column) -> Column:
    """Filled steps of a 20-step bar."""
    return F.floor(score / 5).cast("int")
