"""Binary event files: the text of every record, in chunk and record order."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.sources.log_ranges import LogFolder, records
from tracelantern.sources.store import Store


def read_event_records(spark: SparkSession, path: str | list[str], store: Store | None = None) -> DataFrame:
    """``lines`` of the ``.evtx`` files below a path: ``RecordID:<id> <text>``; ``line_no`` is the record's place.

    Files of any size are read by ranges of chunks.
    """
    return LogFolder(spark, path, store, only=F.lower("name").endswith(".evtx")).lines()


def numbered_records(bodies: DataFrame) -> DataFrame:
    """``lines`` of the records in ``bodies(file_id, chunk_no, body)``, each decoded once."""
    chunks = bodies.mapInPandas(_read_chunks, "file_id string, chunk_no int, records array<string>")
    earlier = Window.partitionBy("file_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    # at most 65,536 chunks a file
    before = F.coalesce(F.sum(F.size("records")).over(earlier), F.lit(0))
    return (
        chunks.withColumn("before", before)
        .select("file_id", "before", F.posexplode("records").alias("pos", "line"))
        .select("file_id", (F.col("before") + F.col("pos") + 1).cast("long").alias("line_no"), "line")
    )


def _read_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [records(bytes(body)) for body in batch["body"]]
        yield pd.DataFrame({"file_id": batch["file_id"], "chunk_no": batch["chunk_no"], "records": found})
