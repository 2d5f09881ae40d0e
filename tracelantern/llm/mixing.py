"""Mixing sources to target weights without a sort: hash-threshold histograms.

A row has a hash of its id and size.  A source that may take R words more than whole
rounds of its documents takes those with the smallest hashes, so a larger budget takes a
superset.  The threshold is found digit by digit: words are summed by source and hash
digit, the digit in which the running sum passes R is the boundary, and only its rows are
looked at again by their next digit.  One filter by threshold then makes the mix.
Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions.stages import drop, kept, new_path
from tracelantern.llm.shared import hot_join

# Weights of the sources in their order, repeating; share of all words to take; most uses of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2

# A hash has five digits of 12 bits, and rows that tie in it five more from their row number.
_DIGIT_BITS, _DIGITS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def _digit(level: int) -> Column:
    held = F.col("hash") if level < _DIGITS else F.shiftright(F.xxhash64("row"), 64 - _DIGIT_BITS * _DIGITS)
    shift = _DIGIT_BITS * (_DIGITS - 1 - level % _DIGITS)
    return F.shiftright(held, shift).bitwiseAND((1 << _DIGIT_BITS) - 1)


class Mix:
    """Which documents a mix takes, and how often.

    ``documents`` has ``doc_id``, ``text`` and the column named by ``source``; other
    columns pass through ``repeated``.  Null text has size 0 and is never taken; a null
    source is a source of its own, the last.  Rows that are equal in id and size tie:
    which of them is taken does not show.  An empty table gives an empty mix.
    ``close`` deletes the tables written.
    """

    def __init__(self, documents: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS,
                 share: float = SHARE, most: int = MOST):
        self._spark = documents.sparkSession
        self._kept: list[str] = []
        self._weights, self._share, self._most = tuple(weights), float(share), most
        size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
        # code point order with null last; a bare prefix keeps null apart from any text
        name = F.col(source).cast("string")
        sized = documents.withColumns({
            "_size": size, "_source": F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name)),
        }).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"))
        tag = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
        hashed = sized.withColumns({
            "hash": F.conv(F.substring(tag, 1, 15), 16, 10).cast("long"), "row": F.monotonically_increasing_id(),
        })
        self._rows = self._keep(hashed)
        self._total = self._rows.count()
        self.targets = self._keep(self._with_targets(self._ranked()))

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(new_path(self._spark))
        return kept(df, path=self._kept[-1])

    def close(self) -> None:
        for path in self._kept:
            drop(self._spark, path)
        self._kept.clear()

    def _ranked(self) -> DataFrame:
        """(source, rows, source_size, weight); ranks without all sources in one task."""
        sources = self._rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
        parts = self._keep(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()))
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
        # a row per partition of the step before, however many sources there are
        before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        within = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
        cycle = F.lit(list(self._weights))
        place = ((F.col("before") + F.col("within")) % len(self._weights) + 1).cast("int")
        return self._keep(
            parts.withColumn("within", within).join(before, "part")
            .select("source", "rows", "source_size", F.element_at(cycle, place).cast("long").alias("weight"))
        )

    def _with_targets(self, ranked: DataFrame) -> DataFrame:
        """Adds ``target``: one level of words per unit of weight, capped at each source's limit.

        A source whose limit lies below the level leaves its excess to the others, which
        raises the level; a few sums over the sources lead to the level that stays.
        """
        limit = float(self._most) * F.col("source_size")
        words = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
        level, before = 0.0, None
        while level != before:
            full = F.lit(level) * F.col("weight") > limit
            held, free = ranked.agg(
                F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
                F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            ).first()
            before = level
            level = (self._share * words - float(self._most) * held) / free if free else float("inf")
        return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit))

    def _thresholds(self) -> DataFrame:
        """(source, hash, row, whole): the boundary document of each source that has one."""
        target, size = F.col("target"), F.col("source_size")
        rounds = F.least(F.floor(target / size), F.lit(self._most)).cast("long")
        budgets = self.targets.where(size > 0).select("source", rounds.alias("rounds"), (target - rounds * size).alias("budget"))
        # words left to give out and words below the boundary so far; whole numbers stay exact
        open_ = self._keep(budgets.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("below")))
        inside = self._rows.where("size > 0")
        found = None
        for level in range(2 * _DIGITS):
            sums = inside.groupBy("source", _digit(level).alias("digit")).agg(
                F.sum("size").alias("words"), F.count("*").alias("n"), F.max("hash").alias("hash"), F.max("row").alias("row")
            )
            # at most 4,096 rows a source
            upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
            passed = sums.withColumn("upto", upto).join(open_, "source").where(
                (F.col("below") + F.col("upto") > F.col("budget")) & (F.col("below") + F.col("upto") - F.col("words") <= F.col("budget"))
            )
            edge = self._keep(passed.withColumn("below", F.col("below") + F.col("upto") - F.col("words")))
            last = level == 2 * _DIGITS - 1
            settled = edge if last else edge.where("n = 1")
            # the boundary document goes in if that comes nearer to the budget
            nearer = F.col("below") + F.col("words") - F.col("budget") < F.col("budget") - F.col("below")
            settled = settled.select("source", "hash", F.xxhash64("row").alias("mark"), nearer.alias("whole"))
            found = settled if found is None else found.unionByName(settled)
            again = edge.where("n > 1").select("source", "digit", "budget", "below")
            if last or again.isEmpty():
                break
            open_ = again.drop("digit")
            held = inside.withColumn("digit", _digit(level)).join(again.select("source", "digit"), ["source", "digit"], "left_semi")
            inside = self._keep(held.drop("digit"))
        return budgets.join(found, "source", "left")

    def plan(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, copies, taken``, a row per document."""
        cuts = self.targets.join(self._thresholds(), "source", "left").drop("weight")
        cuts = self._keep(cuts)
        joined = hot_join(self._rows, cuts.withColumnRenamed("hash", "edge"), "source", "rows", self._total)
        mark = F.xxhash64("row")
        # marks compare as the digits do, by their unsigned bits
        high = lambda c: F.shiftrightunsigned(c, 64 - _DIGIT_BITS * _DIGITS)
        below = (F.col("hash") < F.col("edge")) | (
            (F.col("hash") == F.col("edge"))
            & ((high(mark) < high(F.col("mark"))) | ((high(mark) == high(F.col("mark"))) & F.col("whole")))
        )
        more = F.coalesce(below, F.lit(False)) & (F.col("size") > 0)
        copies = (F.coalesce("rounds", F.lit(0)) + more.cast("long")).alias("copies")
        name = F.when(F.col("source") != "1", F.substring("source", 2, 1 << 30)).alias("source")
        return joined.select("doc_id", name, "size", "source_size", "target", copies, "row").withColumn(
            "taken", F.col("size") * F.col("copies")
        )


def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all ``documents`` takes of each."""
    mix = Mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return mix.plan().select("doc_id", "size", "source_size", "target", "taken", "copies")


OP12_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, 'null') AS source, source IS NULL AS last,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
  FROM documents
),
sources AS (
  SELECT source, last, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(([5, 2, 1])[1 + (row_number() OVER (ORDER BY last, source) - 1) % 3] AS BIGINT) AS weight
  FROM sized GROUP BY source, last
),
levels AS (
  SELECT 0 AS step, 0.0::DOUBLE AS level, -1.0::DOUBLE AS before
  UNION ALL
  SELECT step + 1,
         (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (l.level * weight > 2.0::DOUBLE * source_size), 0)::DOUBLE)
                 / sum(weight) FILTER (l.level * weight <= 2.0::DOUBLE * source_size)::DOUBLE FROM sources),
         l.level
  FROM levels l WHERE l.level <> l.before
),
targets AS (
  SELECT *, least((SELECT max_by(level, step) FROM levels) * weight, 2.0::DOUBLE * source_size) AS target FROM sources
),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS rounds FROM targets
),
ordered AS (
  SELECT doc_id, size, source_size, target, CAST(rounds AS BIGINT) AS rounds, target - rounds * source_size AS budget,
         sum(size) OVER (PARTITION BY source, last ORDER BY substr(md5(doc_id || ':' || size), 1, 15)
                         ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized JOIN budgets USING (source, last)
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT *, rounds + CASE WHEN size > 0 AND (upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size))) THEN 1 ELSE 0 END AS copies
  FROM ordered)
"""
