"""All results about a table of lines.

Counts, sets, the period, scores and conclusions come from one roll-up, computed in one
scan of the lines and kept.  A second scan happens only for outputs that quote lines.
"""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelantern.functions.stages import drop, kept, new_path, spread_rows
from tracelantern.operators import chains, detect, extract, findings, rollup, score, tops
from tracelantern.tables import frames
from tracelantern.tables.correlations import CORRELATIONS
from tracelantern.tables.ruleset import RuleSet

# Rows of the roll-up that a task takes on average: a row is some 20 bytes in the table and 200 where it is grouped or sorted.
ROWS_AT_ONCE = 500_000


class Analysis:
    """DataFrames about ``lines``, one row set per file.

    The roll-up is computed and written when something first needs it; all else is lazy.
    ``kinds`` may narrow the roll-up to what is asked for later.  ``close`` deletes what
    was written; nothing of the analysis can be read after that.
    """

    def __init__(
        self,
        lines: DataFrame,
        rules: RuleSet | None = None,
        correlations=CORRELATIONS,
        kinds: tuple[str, ...] = rollup.DETAILED,
    ):
        self.lines = lines
        self.rules = RuleSet.builtin() if rules is None else rules
        self._spark = lines.sparkSession
        self.correlation_rows = correlations
        self._kinds = kinds
        self._kept: list[str] = []

    def close(self) -> None:
        for path in self._kept:
            drop(self._spark, path)
        self._kept.clear()

    def __enter__(self) -> "Analysis":
        return self

    def __exit__(self, *problem) -> None:
        self.close()

    @cached_property
    def rule_frame(self) -> DataFrame:
        return self.rules.frame(self._spark)

    @cached_property
    def correlations(self) -> DataFrame:
        return frames.correlations(self._spark, self.correlation_rows)

    @cached_property
    def rollup(self) -> DataFrame:
        self._kept.append(new_path(self._spark))
        found = rollup.rollup(self.lines, self.rules, self._kinds)
        rows = kept(found, "kind", "file_id", path=self._kept[-1], codec="zstd")
        key = [name for name in ("file_id", "kind", "value", "block") if name in rows.columns]
        return spread_rows(rows, ROWS_AT_ONCE, key=tuple(key), together="file_id")

    def keep(self, found: DataFrame) -> DataFrame:
        """A table written beside the roll-up."""
        self._kept.append(new_path(self._spark))
        return kept(found, path=self._kept[-1], codec="zstd")

    def _counted(self, kind: str) -> DataFrame:
        return self.rollup.where(F.col("kind") == kind).select("file_id", "value", "cnt", "first_seen")

    @cached_property
    def files(self) -> DataFrame:
        """(file_id, total_lines) of every file that has a line."""
        return self._counted(rollup.LINE).select("file_id", F.col("cnt").alias("total_lines"))

    @cached_property
    def ip_counts(self) -> DataFrame:
        return self._counted(rollup.IP)

    @cached_property
    def user_counts(self) -> DataFrame:
        return self._counted(rollup.USER)

    @cached_property
    def event_id_counts(self) -> DataFrame:
        return self._counted(rollup.EVENT_ID)

    @cached_property
    def iocs(self) -> DataFrame:
        found = self.rollup.where(F.col("kind").isin(*extract.IOC_TYPES))
        return found.select("file_id", F.col("kind").alias("ioc_type"), "value", "first_seen")

    @cached_property
    def hit_counts(self) -> DataFrame:
        return self._counted(rollup.RULE).withColumnRenamed("value", "rule_id")

    @cached_property
    def techniques(self) -> DataFrame:
        return findings.technique_hits(self.hit_counts, self.rule_frame, frames.techniques(self._spark))

    @cached_property
    def matches(self) -> DataFrame:
        return chains.correlation_matches(self.hit_counts, self.correlations)

    @cached_property
    def scores(self) -> DataFrame:
        return score.threat_scores(self.files, score.rule_scores(self.hit_counts, self.rule_frame), self.matches)

    @cached_property
    def recommendations(self) -> DataFrame:
        return chains.recommendations(
            self.files, self.hit_counts, self.matches, frames.recommendations(self._spark)
        )

    @cached_property
    def tactics(self) -> DataFrame:
        return chains.tactic_coverage(self.techniques)

    @cached_property
    def period(self) -> DataFrame:
        if rollup.STAMP not in self._kinds:
            return rollup.log_period(self.lines)
        line = self.rollup.where((F.col("kind") == rollup.LINE) & F.col(rollup.STAMPS[0]).isNotNull())
        return line.select("file_id", *rollup.period_of([F.col(name) for name in rollup.STAMPS]))

    @cached_property
    def hits(self) -> DataFrame:
        return detect.hits(self.lines, self.rules)

    @cached_property
    def counters(self) -> DataFrame:
        """Distinct counts per file, from one grouping of the roll-up."""
        counted = {
            "unique_ips": F.col("kind") == rollup.IP,
            "unique_users": F.col("kind") == rollup.USER,
            "unique_event_ids": F.col("kind") == rollup.EVENT_ID,
            "rules_triggered": F.col("kind") == rollup.RULE,
            "total_iocs": F.col("kind").isin(*extract.IOC_TYPES),
        }
        return self.rollup.groupBy("file_id").agg(
            F.sum(F.when(F.col("kind") == rollup.LINE, F.col("cnt"))).alias("total_lines"),
            *[F.count(F.when(test, 1)).alias(name) for name, test in counted.items()],
        )

    @cached_property
    def headline(self) -> DataFrame:
        """One row of counters, score and level per file."""
        return (
            self.counters.join(rollup.distinct_per_file(self.techniques, "techniques"), "file_id", "left")
            .join(rollup.distinct_per_file(self.matches, "correlations"), "file_id", "left")
            .join(self.scores, "file_id", "left")
            .na.fill(0, ["techniques", "correlations"])
        )

    def top_tokens(self, n: int) -> DataFrame:
        """The n most frequent tokens of each kind (ip, user, event_id) of a file."""
        counts = self.rollup.where(F.col("kind").isin(rollup.IP, rollup.USER, rollup.EVENT_ID)).select(
            "file_id", "kind", "value", "cnt", "first_seen"
        )
        return tops.top_tokens(counts, n, ["file_id", "kind"])

    def top_ips(self, n: int = 10) -> DataFrame:
        return tops.top_tokens(self.ip_counts, n)

    def top_users(self, n: int = 10) -> DataFrame:
        return tops.top_tokens(self.user_counts, n)

    def top_event_ids(self, n: int = 20, short: bool = False) -> DataFrame:
        return tops.with_event_names(
            tops.top_tokens(self.event_id_counts, n), frames.event_id_names(self._spark, short)
        )
