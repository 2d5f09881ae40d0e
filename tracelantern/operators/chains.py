"""Conclusions from the set of rules that fired in a file.

All inputs are per (file, rule), already reduced; the dimension tables are small
local relations.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelantern.tables.lookups import DEFAULT_RECOMMENDATION, TACTIC_WORDS, TACTICS


def correlation_matches(hit_counts: DataFrame, correlations: DataFrame) -> DataFrame:
    """(file_id, corr_ord, name, severity, score_boost, requires, description) where all
    required rules fired in the file, in whatever order."""
    wanted = correlations.select("corr_ord", F.explode(F.array_distinct("requires")).alias("rule_id"))
    met = (
        hit_counts.select("file_id", "rule_id")
        .join(wanted, "rule_id")
        .groupBy("file_id", "corr_ord")
        .agg(F.count("*").alias("met"))
    )
    return (
        met.join(correlations, "corr_ord")
        .where(F.col("met") == F.size(F.array_distinct("requires")))
        .select("file_id", "corr_ord", "name", "severity", "score_boost", "requires", "description")
    )


def recommendations(
    files: DataFrame, hit_counts: DataFrame, matches: DataFrame, advice: DataFrame
) -> DataFrame:
    """(file_id, rec_ord, recommendation) in declared order; a default where nothing applies."""
    by_rule = hit_counts.select("file_id", "rule_id").join(
        advice.select("rec_ord", F.explode("any_rule").alias("rule_id")), "rule_id"
    )
    by_chain = matches.select("file_id", "name").join(
        advice.select("rec_ord", F.explode("any_corr").alias("name")), "name"
    )
    given = by_rule.select("file_id", "rec_ord").unionByName(by_chain.select("file_id", "rec_ord")).distinct()
    given = given.join(advice.select("rec_ord", "recommendation"), "rec_ord")
    default = files.select("file_id").join(given, "file_id", "left_anti").select(
        "file_id", F.lit(1).alias("rec_ord"), F.lit(DEFAULT_RECOMMENDATION).alias("recommendation")
    )
    return given.select("file_id", "rec_ord", "recommendation").unionByName(default)


def tactic_coverage(technique_hits: DataFrame) -> DataFrame:
    """(file_id, tactic_ord, tactic, detected): all tactics for every file with a technique."""
    name = F.coalesce("technique_name", F.lit(""))
    tactic = F.lit(None).cast("string")
    for label, words in reversed(TACTIC_WORDS):
        said = reduce(lambda a, b: a | b, [name.contains(w) for w in words])
        tactic = F.when(said, label).otherwise(tactic)
    seen = technique_hits.groupBy("file_id").agg(F.collect_set(tactic).alias("seen"))
    return seen.select(
        "file_id", "seen", F.posexplode(F.array(*[F.lit(t) for t in TACTICS])).alias("pos", "tactic")
    ).select(
        "file_id",
        (F.col("pos") + 1).alias("tactic_ord"),
        "tactic",
        F.array_contains("seen", F.col("tactic")).alias("detected"),
    )
