"""Top and first rows shown per file."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelantern.operators.ranking import first_rows


def top_tokens(counts: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Most frequent tokens of a file (or of the given keys); equals rank by first appearance."""
    order = [F.desc("cnt"), F.col("first_seen"), F.col("value")]
    return first_rows(counts, keys or ["file_id"], order, n)


def with_bars(top: DataFrame) -> DataFrame:
    """Top tokens with bar lengths: relative to the most frequent one, and capped at 30."""
    most = F.max("cnt").over(Window.partitionBy("file_id"))  # over n rows a file
    return top.withColumn("relative_bar", F.floor(F.col("cnt") / most * 30).cast("int")).withColumn(
        "capped_bar", F.least(F.col("cnt"), F.lit(30)).cast("int")
    )


def with_event_names(top: DataFrame, names: DataFrame) -> DataFrame:
    """Top event ids with their names, empty where unknown."""
    named = top.join(names.withColumnRenamed("event_id", "value"), "value", "left")
    return named.withColumn("event_name", F.coalesce("event_name", F.lit("")))


def top_techniques(techniques: DataFrame, n: int | None = None) -> DataFrame:
    """Techniques by hits, then by first hit, ranked per file; the first n if given."""
    order = [F.desc("hits"), F.col("first_seen"), F.col("technique_id")]
    if n is None:
        # one row per technique and file, so a group is never larger than the technique table
        return techniques.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)))
    return first_rows(techniques, ["file_id"], order, n, large_groups=False)


def first_iocs(iocs: DataFrame, n: int) -> DataFrame:
    """First n indicators of each type of a file, in value order."""
    return first_rows(iocs, ["file_id", "ioc_type"], [F.col("value")], n)


def ioc_totals(iocs: DataFrame) -> DataFrame:
    """(file_id, ioc_type, total): per type, and overall under the type ``all``."""
    per_type = iocs.groupBy("file_id", "ioc_type").agg(F.count("*").alias("total"))
    overall = per_type.groupBy("file_id").agg(F.sum("total").alias("total"))
    return per_type.unionByName(overall.select("file_id", F.lit("all").alias("ioc_type"), "total"))


def raw_head(lines: DataFrame, n: int = 2000) -> DataFrame:
    """The first n lines of every file."""
    return lines.where(F.col("line_no") <= n)
