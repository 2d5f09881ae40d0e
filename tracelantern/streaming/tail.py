"""Structured Streaming over a folder into which log files are dropped.

Detection and extraction are projections and run on a stream as they are.  A stream
has no line numbers, so the running results are counts, keyed by file.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracelantern.operators import detect, score
from tracelantern.tables.ruleset import RuleSet


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(file_id, line, arrived) of the text files that arrive under a path.

    ``arrived`` is the time of the batch, and a file is read in one batch, so no line is late.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.make_valid_utf8("value").alias("line"),
        F.current_timestamp().alias("arrived"),
    )


def stream_hit_counts(lines: DataFrame, rules: RuleSet, keep: str = "1 hour") -> DataFrame:
    """(file_id, rule_id, cnt) as it grows.

    The state is one number per file and rule; it goes when the file arrived longer ago
    than ``keep``.
    """
    hits = detect.hits(lines.withWatermark("arrived", keep), rules)
    return hits.groupBy("file_id", "arrived", "rule_id").agg(F.count("*").alias("cnt")).drop("arrived")


def write_rule_scores(counts: DataFrame, rules: RuleSet, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of the changed rows of every batch, with the score of each (file, rule).

    A batch that is run again after a failure overwrites its own folder, so nothing
    is counted twice; readers take the row with the highest batch per file and rule.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        weighted = score.rule_scores(
            batch.withColumn("first_seen", F.lit(None).cast("long")), rules.frame(batch.sparkSession)
        )
        weighted.drop("first_seen").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
    )
