"""Tables of lines, ``lines(file_id STRING, line_no LONG, line STRING)``, from Parquet tables.

Every view is a projection of its table: one pass over whole texts.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.functions.stages import spread_rows
from tracelantern.sources.phrases import PHRASES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Inputs with this many splits or more are never shuffled to spread them.
_FEW_SPLITS = 64
# Rows of ``events`` that a task takes at most on average.  Its row of some 20 bytes becomes a line
# and a dozen facts, so a split by bytes would be far more than a task should hold.
EVENTS_AT_ONCE = 50_000


def spread(lines: DataFrame) -> DataFrame:
    """Lines over all cores when a small input has fewer splits than there are cores.

    ``lines`` is a projection of a scan.  At most 64 splits are shuffled, some
    gigabytes; anything larger is left as it is.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() >= min(cores, _FEW_SPLITS):
        return lines
    return lines.repartition(cores, "file_id", "line_no")


def text_lines(table: DataFrame, file_id: Column, text: Column) -> DataFrame:
    """Lines of whole texts; any of the three line ends counts, a final one opens no line."""
    body = F.when(text.endswith("\n") | text.endswith("\r"), F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""))
    body = F.coalesce(body, text)
    pieces = F.when(text.contains("\r"), F.split(body, r"\r\n|\r|\n")).otherwise(F.split(body, "\n"))
    lines = table.where(text != "").select(
        file_id.cast("string").alias("file_id"), F.posexplode(pieces).alias("pos", "line")
    )
    return spread(lines.select("file_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line"))


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ``documents``; a document is a file."""
    return text_lines(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the HTML of ``pages``; a page is a file."""
    return text_lines(table(spark, folder, "pages"), F.col("page_id"), F.col("html"))


def url_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of ``pages`` as one-line files."""
    return spread(table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("file_id"), F.lit(1).cast("long").alias("line_no"), F.col("url").alias("line")
    ))


def whole_page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the HTML of ``pages``, with the address as line 0."""
    address = url_lines(spark, folder).withColumn("line_no", F.lit(0).cast("long"))
    return page_lines(spark, folder).unionByName(address)


def chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of ``conversations`` as records; a record keeps its line breaks."""
    return spread(table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("file_id"),
        (F.col("turn") + 1).alias("line_no"),
        F.col("text").alias("line"),
    ))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` rendered as log lines; a file is one user on one day and the
    line number is the place of the event in the event stream."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    cores = min(spark.sparkContext.defaultParallelism, _FEW_SPLITS)
    return rendered(spread_rows(events, EVENTS_AT_ONCE, cores)).select("file_id", "line_no", "line")


def rendered_events(spark: SparkSession, folder: str) -> DataFrame:
    """``event_log`` with the event type and day."""
    return rendered(table(spark, folder, "events"))


def rendered(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    ident = F.col("event_id")
    event_id = (
        F.when(kind == "error", "EventID=4625")
        .when(kind == "signup", "EventID: 4720")
        .when(kind == "purchase", "EventID 4663")
        .when(kind == "click", "EventID=4624")
        .otherwise("audit")
    )
    source = F.concat(
        F.lit("198.51."), (F.col("user_id") % 200).cast("string"), F.lit("."), (ident % 97).cast("string")
    )
    text = ident.cast("string")
    detail = (
        F.when(kind == "error", F.concat(F.lit("sha256="), F.sha2(text, 256), F.lit(" ref CVE-2024-"),
                                         (F.lit(10000) + ident % 5000).cast("string")))
        .when(kind == "signup", F.concat(F.lit("sha1="), F.sha1(text), F.lit(" mail u"),
                                         F.col("user_id").cast("string"), F.lit("@corp"),
                                         (ident % 7).cast("string"), F.lit(".org")))
        .when(kind == "purchase", F.concat(F.lit("md5="), F.md5(text)))
        .when(kind == "view", F.concat(F.lit("page http://h"), F.col("user_id").cast("string"),
                                       F.lit(".example.com/p/"), text))
        .otherwise("-")
    )
    phrase = F.element_at(F.lit(list(PHRASES)), (ident % len(PHRASES) + 1).cast("int"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stamp = F.when(kind == "click", F.replace(stamp, F.lit(" "), F.lit("T"))).when(
        kind == "purchase", F.lit("-")).otherwise(stamp)
    return events.select(
        "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.concat(F.col("user_id").cast("string"), F.date_format("ts", "'-'yyyy-MM-dd")).alias("file_id"),
        (ident + 1).alias("line_no"),
        F.concat_ws(" ", stamp, event_id, F.concat(F.lit("user=u"), F.col("user_id").cast("string")),
                    F.concat(F.lit("src="), source), detail, phrase).alias("line"),
    )
