"""Logs as a source of ``spark.read.format``: planned by byte range, filters reach the plan.

With the index of a ``LogFolder`` a file is read by as many tasks as it has ranges, and a
filter on ``file_id`` or ``line_no`` drops ranges before any task starts.  Without one a
file is read by one task, piece by piece, since nobody has counted its lines.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    StringStartsWith,
)

from tracelantern.sources.log_ranges import EVENTS, HEADER, RANGE_BYTES, TEXT, XML, LogFolder, numbered_lines
from tracelantern.sources.store import Store

FORMAT = "tracelantern_logs"
_INDEX = ("file_id", "kind", "start", "stop", "n", "before")
_ALL = (1 << 63) - 1


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, and the lines of them that are wanted."""

    ranges: list[dict]
    first: int
    last: int


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def read_indexed(spark: SparkSession, folder: LogFolder) -> DataFrame:
    """``lines(file_id, line_no, line)`` of an indexed folder; file systems of its store are not carried over."""
    register(spark)
    return spark.read.format(FORMAT).option("index", folder.index_path).load()


class LogSource(DataSource):
    """``spark.read.format(FORMAT).load(path)``: text, event XML and binary event files by suffix.

    Options: ``index``, the table of a ``LogFolder``, in place of a path; ``rangeBytes``, how
    much one task reads.  A path without files, or files without lines, give no rows; names
    may begin with ``_`` or ``.``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_id string, line_no long, line string"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(dict(self.options))


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {name.lower(): value for name, value in options.items()}
        self._index, self._path = options.get("index"), options.get("path")
        if not (self._index or self._path):
            raise ValueError("name a path, or the index of a folder")
        self._size = int(options.get("rangebytes", RANGE_BYTES))
        self._files: set[str] | None = None
        self._starts: list[str] = []
        self._first, self._last = 1, _ALL

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what narrows files and lines; all other filters are Spark's."""
        for each in filters:
            if not self._takes(each):
                yield each

    def _takes(self, each: Filter) -> bool:
        column, value = getattr(each, "attribute", None), getattr(each, "value", None)
        if column == ("file_id",) and isinstance(each, EqualTo | In):
            named = set(value if isinstance(each, In) else [value])
            self._files = named if self._files is None else self._files & named
        elif column == ("file_id",) and isinstance(each, StringStartsWith):
            self._starts.append(value)
        elif column == ("line_no",) and isinstance(each, EqualTo):
            self._first, self._last = max(self._first, value), min(self._last, value)
        elif column == ("line_no",) and isinstance(each, GreaterThan | GreaterThanOrEqual):
            self._first = max(self._first, value + isinstance(each, GreaterThan))
        elif column == ("line_no",) and isinstance(each, LessThan | LessThanOrEqual):
            self._last = min(self._last, value - isinstance(each, LessThan))
        else:
            return False
        return True

    def _named(self, file_id: str) -> bool:
        return (self._files is None or file_id in self._files) and all(map(file_id.startswith, self._starts))

    def partitions(self) -> list[Ranges]:
        """Ranges dealt into tasks of about ``rangeBytes``; plans hold four numbers a range, as Spark's own do."""
        found, held, size = [], [], 0
        for row in self._indexed() if self._index else self._listed():
            held.append(row)
            size += row["stop"] - row["start"]
            if size >= self._size:
                found.append(Ranges(held, self._first, self._last))
                held, size = [], 0
        # a source must have a task, though it may have nothing to read
        return found + [Ranges(held, self._first, self._last)] if held or not found else found

    def _indexed(self) -> Iterator[dict]:
        store = Store()
        for _, address, name, _ in store._entries(self._index, True):
            if not name.endswith(".parquet"):
                continue
            with store.open(address) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=list(_INDEX)):
                    for row in batch.to_pylist():
                        if self._named(row["file_id"]) and row["before"] + row["n"] >= self._first and row["before"] < self._last:
                            yield row

    def _listed(self) -> Iterator[dict]:
        for is_folder, address, name, size in Store()._entries(self._path, True):
            low = name.lower()
            kind = EVENTS if low.endswith(".evtx") else XML if low.endswith(".xml") else TEXT
            start = HEADER if kind == EVENTS else 0
            if not is_folder and size > start and self._named(address):
                yield {"file_id": address, "kind": kind, "start": start, "stop": size, "n": None, "before": 0}

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, first, last = Store(), partition.first, partition.last
        for row in partition.ranges:
            # past the last wanted line the rest of a file is not read
            wanted = itertools.takewhile(lambda batch: batch.column(1)[0].as_py() <= last, numbered_lines(store, row))
            for batch in wanted:
                begin = batch.column(1)[0].as_py()
                low, high = max(0, first - begin), min(batch.num_rows, last - begin + 1)
                if low < high:
                    yield batch.slice(low, high - low)
