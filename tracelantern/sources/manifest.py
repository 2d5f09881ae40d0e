"""File facts: name, type, size, hashes, number of lines."""

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.sources.store import Store

_MIB = 1024 * 1024


def file_type(name: Column) -> Column:
    """Kind of log by suffix."""
    is_event_log = F.lower(name).endswith(".evtx")
    return F.when(is_event_log, "EVTX (Windows Event Log)").otherwise("Text Log")


def size_label(size: Column) -> Column:
    """Bytes, or MB with one decimal from 1 MiB."""
    large = F.format_string("%.1f MB", size / _MIB)
    return F.when(size >= _MIB, large).otherwise(F.format_string("%,d bytes", size))


def text_manifest(table: DataFrame, name: Column, text: Column, lines: DataFrame) -> DataFrame:
    """(file_id, name, type, size_bytes, size_label, md5, sha256, total_lines) of texts in a table."""
    size = F.octet_length(text).cast("long")
    facts = table.select(
        name.cast("string").alias("file_id"),
        name.cast("string").alias("name"),
        file_type(name.cast("string")).alias("type"),
        size.alias("size_bytes"),
        size_label(size).alias("size_label"),
        F.md5(text).alias("md5"),
        F.sha2(text, 256).alias("sha256"),
    )
    counts = lines.groupBy("file_id").agg(F.count("*").alias("total_lines"))
    return facts.join(counts, "file_id", "left").na.fill(0, ["total_lines"])


_FACTS = pa.schema([
    ("file_id", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("md5", pa.string()), ("sha256", pa.string()),
])


def file_manifest(spark: SparkSession, path: str | list[str], lines: DataFrame, store: Store | None = None) -> DataFrame:
    """(file_id, name, type, size_bytes, size_label, md5, sha256, total_lines) of files.

    A file of any size is hashed in one pass over its pieces, since a digest runs from
    the first byte to the last; its name may start with any character.
    """
    store = store or Store()
    files = store.files(spark, path)
    number, total = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(number, max(spark.sparkContext.defaultParallelism, total // (256 * _MIB))))
    hashed = files.repartition(tasks).mapInArrow(
        _hasher(store), "file_id string, name string, size long, md5 string, sha256 string"
    )
    facts = hashed.select(
        "file_id",
        "name",
        file_type(F.col("name")).alias("type"),
        F.col("size").alias("size_bytes"),
        size_label(F.col("size")).alias("size_label"),
        "md5",
        "sha256",
    )
    counts = lines.groupBy("file_id").agg(F.count("*").alias("total_lines"))
    return facts.join(counts, "file_id", "left").na.fill(0, ["total_lines"])


def _hasher(store: Store) -> Callable:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                md5, sha256 = hashlib.md5(), hashlib.sha256()
                with store.open(row["file_id"]) as file:
                    while piece := file.read(8 * _MIB):
                        md5.update(piece)
                        sha256.update(piece)
                rows.append(row | {"md5": md5.hexdigest(), "sha256": sha256.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, _FACTS)

    return hashed
