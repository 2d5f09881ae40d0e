"""Mixed folders of logs by byte range: text, event XML and binary event files alike.

A file is cut into ranges, rows of four numbers, and tasks read ranges of files that any
task can open.  A first pass counts the lines, elements or records of each range; a running
sum over the ranges of a file then says with which number a range begins, so the second
pass numbers its rows by itself: nothing is joined, shuffled or broadcast, and ranges
outside a wanted span of files or lines are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions.stages import drop, kept, new_path
from tracelantern.sources.store import Store

TEXT, XML, EVENTS = "text", "xml", "events"
RANGE_BYTES = 64 << 20
_PIECE = 4 << 20

# Layout of a binary event file, and the end of an element.
HEADER, CHUNK = 4096, 65536
CHUNK_MAGIC = b"ElfChnk\x00"
RECORD_MAGIC = b"\x2a\x2a\x00\x00"
ELEMENT_END = b"</Event>"

_COUNTS_DDL = "file_id string, kind string, start long, stop long, n long, ended boolean"
_COUNTS = pa.schema([
    ("file_id", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("n", pa.int64()), ("ended", pa.bool_()),
])
_LINES_DDL = "file_id string, line_no long, line string"
_LINES = pa.schema([("file_id", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])


def kind_of(name: Column) -> Column:
    """How a file is read, by its suffix."""
    low = F.lower(name)
    return F.when(low.endswith(".evtx"), EVENTS).when(low.endswith(".xml"), XML).otherwise(TEXT)


def byte_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(file_id, kind, start, stop) of files (file_id, name, size).

    Ranges of event files are whole chunks, counted from the end of the header; a chunk
    needs its magic and one more byte.
    """
    kind, whole = kind_of(F.col("name")), F.col("size")
    chunks = max(1, size // CHUNK) * CHUNK
    text = F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - 1, F.lit(size).cast("long")))
    events = F.when(whole > HEADER + 8, F.sequence(F.lit(HEADER).cast("long"), whole - 9, F.lit(chunks).cast("long")))
    step = F.when(F.col("kind") == EVENTS, chunks).otherwise(size)
    starts = files.select("file_id", kind.alias("kind"), "size", F.explode(F.when(kind == EVENTS, events).otherwise(text)).alias("start"))
    return starts.select("file_id", "kind", "start", F.least(F.col("start") + step, F.col("size")).alias("stop"))


def _dealt(ranges: DataFrame, size: int) -> DataFrame:
    """Ranges over tasks of about ``size`` bytes, however large or small the files are."""
    number, total = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(number, max(cores, -(-total // size)))))


class LogFolder:
    """All logs below ``path``: an index of ranges, and ``lines`` of all or some of them.

    Names may start with ``_`` or ``.``.  Text lines end in ``\\n``, ``\\r\\n`` or ``\\r``; bad bytes
    become U+FFFD, a byte-order mark at the start goes.  XML rows are whole ``<Event>``
    elements, event-file rows ``RecordID:<id> <text>`` up to the first chunk without its
    magic.  Empty files have no rows; a folder without files gives none.  ``close`` deletes
    the index.  ``only`` is a condition on ``name`` and ``size``.
    """

    def __init__(
        self, spark: SparkSession, path: str | list[str], store: Store | None = None, size: int = RANGE_BYTES, only: Column | None = None
    ):
        self.store = store or Store()
        self._spark, self._size = spark, size
        self._path = new_path(spark)
        files = self.store.files(spark, path)
        self.files = files if only is None else files.where(only)
        counted = _dealt(byte_ranges(self.files, size), size).mapInArrow(_counter(self.store), _COUNTS_DDL)
        earlier = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        # a file is read up to its first foreign chunk
        read = ~F.coalesce(F.bool_or("ended").over(earlier), F.lit(False))
        numbered = counted.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), read.alias("read"))
        self.index = kept(numbered.where("read AND n > 0").drop("read", "ended"), path=self._path)

    @property
    def index_path(self) -> str:
        """Where the table of ranges lies."""
        return self._path

    def close(self) -> None:
        drop(self._spark, self._path)

    def lines(self, files: Column | None = None, first: int = 1, last: int | None = None) -> DataFrame:
        """``lines(file_id, line_no, line)``.

        ``files`` is a condition on ``file_id``; only ranges that have a line from ``first``
        to ``last`` of such a file are opened.
        """
        wanted = self.index if files is None else self.index.where(files)
        wanted = wanted.where(F.col("before") + F.col("n") >= first)
        found = F.col("line_no") >= first
        if last is not None:
            wanted, found = wanted.where(F.col("before") < last), found & (F.col("line_no") <= last)
        rows = _dealt(wanted, self._size).mapInArrow(_reader(self.store), _LINES_DDL)
        return rows if first <= 1 and last is None else rows.where(found)


def _counter(store: Store) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with store.open(row["file_id"]) as file:
                    n, ended = _COUNT[row["kind"]](file, row["start"], row["stop"])
                rows.append(row | {"n": n, "ended": ended})
            yield pa.RecordBatch.from_pylist(rows, _COUNTS)

    return count


def _reader(store: Store) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from numbered_lines(store, row)

    return read


def numbered_lines(store: Store, row: dict) -> Iterator[pa.RecordBatch]:
    """The lines of a range (file_id, kind, start, stop, before, n), as they come; n may be None."""
    number = row["before"]
    with store.open(row["file_id"]) as file:
        for lines in filter(None, _READ[row["kind"]](file, row["start"], row["stop"])):
            places = pa.array(range(number + 1, number + len(lines) + 1), pa.int64())
            number += len(lines)
            names = pa.array([row["file_id"]] * len(lines), pa.string())
            yield pa.RecordBatch.from_arrays([names, places, pa.array(lines, pa.string())], schema=_LINES)
    if row["n"] is not None and number - row["before"] != row["n"]:
        raise ValueError(f"{row['file_id']} changed while it was read")


class _Ends(NamedTuple):
    """How lines or elements end."""

    pattern: re.Pattern
    reach: int  # bytes of an end that lie before the place where it was cut
    last: Callable[[bytes], int]  # just after the last sure end in some bytes, or 0


# a return at the very end may have its line feed in the next bytes
_LINE = _Ends(re.compile(rb"\r\n|\r|\n"), 1, lambda held: max(held.rfind(b"\n"), held.rfind(b"\r", 0, len(held) - 1)) + 1)
_ELEMENT = _Ends(
    re.compile(re.escape(ELEMENT_END)), len(ELEMENT_END),
    lambda held: (held.rfind(ELEMENT_END) + len(ELEMENT_END)) * (ELEMENT_END in held),
)


def _boundary(file, at: int, ends: _Ends) -> int:
    """The first place from ``at`` on where a line or element begins, or the size of the file."""
    if at == 0:
        return 0
    place, over, size = max(0, at - ends.reach), b"", 64 << 10
    while piece := file.read_at(size, place):
        held, base = over + piece, place - len(over)
        for found in ends.pattern.finditer(held):
            end = base + found.end()
            if end < at:
                continue
            if found[0] == b"\r" and found.end() == len(held) and file.read_at(1, end) == b"\n":
                end += 1
            return end
        place, over, size = place + len(piece), held[len(held) - ends.reach + 1:], _PIECE
    return place


def _pieces(file, start: int, stop: int, ends: _Ends) -> Iterator[bytes]:
    """The bytes of the lines or elements that begin in a range, cut only after whole ones."""
    at, stop = _boundary(file, start, ends), _boundary(file, stop, ends)
    held: list[bytes] = []
    while at < stop:
        piece = file.read_at(min(_PIECE, stop - at), at)
        at += len(piece) or stop
        cut = len(piece) if at >= stop else ends.last(piece)
        if cut:
            yield b"".join([*held, piece[:cut]])
            held, piece = [], piece[cut:]
        held.append(piece)


def _text(file, start: int, stop: int) -> Iterator[list[str]]:
    for piece in _pieces(file, start, stop, _LINE):
        text = piece.decode("utf-8", "replace")
        if start == 0:
            text, start = text.removeprefix("\ufeff"), -1
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        yield text.removesuffix("\n").split("\n")


def _count_text(file, start: int, stop: int) -> tuple[int, bool]:
    return sum(
        piece.count(b"\n") + (piece.count(b"\r") - piece.count(b"\r\n") if b"\r" in piece else 0) + (piece[-1:] not in (b"\n", b"\r"))
        for piece in _pieces(file, start, stop, _LINE)
    ), False


_OPENED = re.compile(rb"<Event[\s>]")


def _elements(file, start: int, stop: int) -> Iterator[bytes]:
    for piece in _pieces(file, start, stop, _ELEMENT):
        for element in piece.split(ELEMENT_END)[:-1]:
            opened = _OPENED.search(element)
            if opened:
                yield element[opened.start():] + ELEMENT_END


def _xml(file, start: int, stop: int) -> Iterator[list[str]]:
    for element in _elements(file, start, stop):
        yield [element.decode("utf-8", "replace")]


def _count_xml(file, start: int, stop: int) -> tuple[int, bool]:
    return sum(1 for _ in _elements(file, start, stop)), False


def _chunks(file, start: int, stop: int) -> Iterator[bytes]:
    for at in range(start, stop, CHUNK):
        chunk = file.read_at(CHUNK, at)
        if not chunk.startswith(CHUNK_MAGIC) or len(chunk) <= len(CHUNK_MAGIC):
            return
        yield chunk


def record_places(chunk: bytes) -> Iterator[tuple[int, int, int]]:
    """(place, size, id) of the records of a chunk; a record of size 0 is passed over."""
    at = chunk.find(RECORD_MAGIC)
    while 0 <= at <= len(chunk) - 16:
        size, record_id = struct.unpack_from("<IQ", chunk, at + 4)
        if size:
            yield at, size, record_id
        at = chunk.find(RECORD_MAGIC, at + max(size, 1))


def records(chunk: bytes) -> list[str]:
    """The text of each record of a chunk, behind its id."""
    return [f"RecordID:{record_id} {chunk[at:at + size].decode('utf-16le', errors='ignore')}" for at, size, record_id in record_places(chunk)]


def _events(file, start: int, stop: int) -> Iterator[list[str]]:
    for chunk in _chunks(file, start, stop):
        yield records(chunk)


def _count_events(file, start: int, stop: int) -> tuple[int, bool]:
    number = chunks = 0
    for chunk in _chunks(file, start, stop):
        number, chunks = number + sum(1 for _ in record_places(chunk)), chunks + 1
    return number, chunks * CHUNK < stop - start


_READ = {TEXT: _text, XML: _xml, EVENTS: _events}
_COUNT = {TEXT: _count_text, XML: _count_xml, EVENTS: _count_events}
