"""Text logs: every line of every file under a path, with its number in its file.

Files are read in splits, so a giant file is many tasks.  A first pass counts the
lines of each split; a running sum over splits, a few rows per file, turns
positions in a split into line numbers.  Lines themselves are not shuffled.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept
from tracelantern.sources.log_ranges import LogFolder
from tracelantern.sources.store import Store

_SPLIT = ["file_id", "split_start"]

# A split is four LONGs, so this many are some 250 MB; with splits of 128 MB they are a petabyte.
_MOST_SPLITS = 8_000_000


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``lines`` of text files; ``\\n``, ``\\r\\n`` and ``\\r`` end a line, bad bytes become U+FFFD."""
    return _numbered(_scan(spark, path))


def read_event_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``lines`` of rendered event XML: one whole ``<Event>`` element per row, in file order."""
    end = "</Event>"
    pieces = _numbered(_scan(spark, path, end)).where(F.col("line").rlike(r"<Event[\s>]"))
    event = F.regexp_extract("line", r"(?s)<Event[\s>].*", 0)
    return pieces.withColumn("line", F.concat(event, F.lit(end)))


def read_logs(spark: SparkSession, path: str | list[str], store: Store | None = None) -> DataFrame:
    """``lines`` of a folder of mixed logs, read by suffix: event files, event XML, and text for all others."""
    return LogFolder(spark, path, store).lines()


def _scan(spark: SparkSession, path, line_end: str | None = None) -> DataFrame:
    # both passes must see the same splits, also when executors come or go between them
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("at"),
        F.make_valid_utf8("value").alias("line"),
    )


def _numbered(scan: DataFrame) -> DataFrame:
    splits = scan.groupBy(*_SPLIT).agg(F.min("at").alias("first_at"), F.count("*").alias("cnt"))
    earlier = Window.partitionBy("file_id").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = kept(splits.withColumn("before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0))))
    if splits.count() > _MOST_SPLITS:
        raise ValueError("too many splits; raise spark.sql.files.maxPartitionBytes")
    # all splits go to all executors, so no line is shuffled
    starts = splits.select(F.xxhash64(*_SPLIT).alias("split"), "first_at", "cnt", "before")
    if starts.select("split").distinct().count() < starts.count():
        raise ValueError("two splits have the same hash; change spark.sql.files.maxPartitionBytes")
    at = F.col("at") - F.col("first_at")
    number = F.when(
        (at >= 0) & (at < F.col("cnt")), F.col("before") + at + 1
    ).otherwise(F.raise_error(F.lit("the files or their splits changed while they were read")).cast("long"))
    found = scan.withColumn("split", F.xxhash64(*_SPLIT)).join(F.broadcast(starts), "split", "left")
    return found.select("file_id", number.alias("line_no"), "line")
