"""Files by name, size and byte range, for readers that need more than Spark's own offer.

Spark's file sources skip names that start with ``_`` or ``.`` and give a binary file only
whole.  A ``Store`` lists every file and opens it for reads from any byte, on the driver
and in tasks.  Which file system serves a scheme is the caller's to say; local paths and
whatever Arrow knows by its own name work unsaid.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.functions.stages import arrow_bytes, kept, shuffles_deleted, spread_rows

# What Spark's and Hadoop's writers, and ``Store.replace``, put beside the data.
_BOOKKEEPING = re.compile(r"_SUCCESS|_temporary|_committed_.*|_started_.*|\..*\.crc|\.[0-9a-f-]{36}\.unready")

# What a task reads or answers at once.
_NAMES_AT_ONCE, _BYTES_AT_ONCE = 5000, 4 << 20

_FOUND = pa.schema([("file_id", pa.string()), ("name", pa.string()), ("size", pa.int64())])
_FOUND_DDL = "file_id string, name string, size long"


class Store:
    """File systems by scheme: ``Store({"s3a": lambda host: S3FileSystem(...)})``.

    A factory gets the part between ``//`` and the path and returns an Arrow file system;
    it is called in every process that opens a file and must be picklable.
    """

    def __init__(self, factories: dict[str, Callable[[str], object]] | None = None):
        self._factories = dict(factories or {})

    def _place(self, path: str) -> tuple[str, str, str]:
        """Scheme, host and path of a plain path or an address."""
        found = re.fullmatch(r"(?s)([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path)
        if not found:
            return "file", "", os.path.abspath(path)
        return found[1].lower(), found[2] or "", unquote(found[3])

    def _system(self, scheme: str, host: str):
        from pyarrow import fs

        if scheme in self._factories:
            return self._factories[scheme](host)
        return fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]

    def open(self, file_id: str):
        """The file for reading at any byte."""
        scheme, host, path = self._place(file_id)
        return self._system(scheme, host).open_input_file(self._inner(scheme, host, path))

    def replace(self, file_id: str, pieces: Iterator[bytes]) -> int:
        """Writes a file and then puts it in the place of an earlier one; number of bytes."""
        scheme, host, path = self._place(file_id)
        system, inner = self._system(scheme, host), self._inner(scheme, host, path)
        folder, _, name = inner.rpartition("/")
        system.create_dir(folder, recursive=True)
        unready = f"{folder}/.{uuid.uuid4()}.unready"
        size = 0
        with system.open_output_stream(unready) as out:
            for piece in pieces:
                size += len(piece)
                out.write(piece)
        system.move(unready, inner)
        return size

    def write(self, rows: DataFrame, folder: str, whole: bool = False) -> tuple[int, int]:
        """One file per ``name`` of rows (name, part, body), parts in order; number of files and of bytes.

        A file appears whole and takes the place of one that was there, so a job that
        runs again, or a task that is tried again, changes nothing.  A file passes
        through one task piece by piece.  ``whole`` says that every row is a file of its
        own; rows are then written where they are.
        """
        columns = rows.select("name", F.col("part").cast("long"), F.col("body").cast("binary"))
        dealt = columns if whole else columns.repartition("name").sortWithinPartitions("name", "part")
        done = dealt.mapInArrow(self._writer(folder.rstrip("/")), "name string, size long")
        # long bodies would fill a batch of 64 MB in every worker
        with arrow_bytes(rows.sparkSession, _BYTES_AT_ONCE), shuffles_deleted(rows.sparkSession):
            return tuple(done.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())

    def _writer(self, folder: str) -> Callable:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # bodies one by one, for a batch of them may be large
            rows = ((name.as_py(), body.as_py() or b"") for batch in batches for name, body in zip(batch.column(0), batch.column(2)))
            done = ((name, self.replace(f"{folder}/{name}", (body for _, body in parts))) for name, parts in itertools.groupby(rows, lambda row: row[0]))
            for some in itertools.batched(done, _NAMES_AT_ONCE):
                names, sizes = zip(*some)
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "size": pa.array(sizes, pa.int64())})

        return write

    def read(self, spark: SparkSession, path: str | list[str]) -> DataFrame:
        """(name, body) of every file below the paths, each whole; tasks list the folders in them and read."""
        # kept, so that a second reader does not list again
        found = kept(self.files(spark, path))
        dealt = spread_rows(found, _NAMES_AT_ONCE, spark.sparkContext.defaultParallelism, ("file_id",))
        return dealt.select("file_id", "name").mapInArrow(self._bodies, "name string, body binary")

    def _bodies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bodies, held = [], [], 0
        for batch in batches:
            for file_id, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with self.open(file_id) as file:
                    bodies.append(file.read())
                names.append(name)
                held += len(bodies[-1])
                if held >= _BYTES_AT_ONCE or len(names) >= _NAMES_AT_ONCE:
                    yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "body": pa.array(bodies, pa.binary())})
                    names, bodies, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "body": pa.array(bodies, pa.binary())})

    @staticmethod
    def _inner(scheme: str, host: str, path: str) -> str:
        # object stores take the bucket as the first part of a name
        return f"{host}{path}" if scheme in ("s3", "s3a", "gs", "gcs") else path

    def _entries(self, folder: str, recursive: bool) -> Iterator[tuple[bool, str, str, int]]:
        """(is a folder, address, name, size) of what is in a folder, or of a single file."""
        from pyarrow import fs

        scheme, host, path = self._place(folder)
        system, inner = self._system(scheme, host), self._inner(scheme, host, path).rstrip("/") or "/"
        own = system.get_file_info(inner)
        if own.type == fs.FileType.NotFound:
            raise FileNotFoundError(folder)
        single = own.type == fs.FileType.File
        for info in [own] if single else system.get_file_info(fs.FileSelector(inner, recursive=recursive)):
            # some file systems name what they find without the first slash
            below = info.path.strip("/")[len(inner.strip("/")):].split("/") if not single else [info.base_name]
            if any(_BOOKKEEPING.fullmatch(part) for part in below):
                continue
            outer = info.path[len(host):] if self._inner(scheme, host, "") else "/" + info.path.lstrip("/")
            yield info.type == fs.FileType.Directory, _address(scheme, host, outer), info.base_name, info.size or 0

    def exists(self, path: str) -> bool:
        from pyarrow import fs

        scheme, host, inner = self._place(path)
        found = self._system(scheme, host).get_file_info(self._inner(scheme, host, inner).rstrip("/") or "/")
        return found.type != fs.FileType.NotFound

    def files(self, spark: SparkSession, path: str | list[str], deep: bool = True) -> DataFrame:
        """(file_id, name, size) of every file below the paths; folders in them are listed by tasks, or not at all."""
        top = [entry for each in ([path] if isinstance(path, str) else path) for entry in self._entries(each, False)]
        plain = [entry[1:] for entry in top if not entry[0]]
        columns = list(zip(*plain)) if plain else [(), (), ()]
        found = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND))
        folders = [entry[1] for entry in top if entry[0]]
        if not folders or not deep:
            return found
        below = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())}))
        below = below.repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism))
        return found.unionByName(below.mapInArrow(self._list, _FOUND_DDL))

    def _list(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [entry[1:] for entry in self._entries(folder, True) if not entry[0]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND)], schema=_FOUND)


# What an address has as it is; characters beyond ASCII stay, too.
_ENCODED = re.compile(r"[^A-Za-z0-9/_\-!.~'()*,;:$&+=@\u0080-\U0010ffff]")


def _address(scheme: str, host: str, path: str) -> str:
    """As Spark's ``_metadata.file_path`` has it."""
    return f"{scheme}:{'//' * bool(host)}{host}{_ENCODED.sub(lambda c: f'%{ord(c[0]):02X}', path)}"
