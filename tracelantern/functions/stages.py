"""Intermediate results that several branches of a job read."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame, *cluster_by: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """The DataFrame, computed once and written to the cluster's shared checkpoint folder.

    It is a Parquet table, so each branch reads only the columns and, thanks to the
    order within the files, mostly only the rows it needs; its true size is known to
    the planner, and a lost executor costs nothing but a second read.  What the job shuffled
    is deleted with its end; ``codec`` compresses the table, the session's if not given.
    """
    path = path or new_path(df.sparkSession)
    ordered = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    with shuffles_deleted(df.sparkSession):
        (ordered.write.option("compression", codec) if codec else ordered.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_rows(rows: DataFrame, at_once: int, least: int = 1, key: tuple[str, ...] = (), together: str | None = None) -> DataFrame:
    """Short rows of a table in partitions of about ``at_once``, so that a task's work has an end.

    A split has as many rows as fit its bytes, and what a task sorts or groups of them takes many
    times that.  Rows that lie in ``least`` splits, and in enough for their number, stay where
    they are; ``key``, all columns if not given, must tell rows apart.  Rows of one value of
    ``together`` come to one task, so that groups of it need no further shuffle, unless that
    gives a task more than ``_CROWD`` times its rows.
    """
    splits, wanted = rows.rdd.getNumPartitions(), max(least, -(-rows.count() // at_once))
    if splits >= wanted:
        return rows
    if together is not None:
        # the same hash as that of a shuffle
        sizes = rows.groupBy(F.pmod(F.hash(together), F.lit(wanted)).alias("part")).count()
        if sizes.agg(F.max("count")).first()[0] <= _CROWD * at_once:
            return rows.repartition(wanted, together)
    return rows.repartition(wanted, *(key or rows.columns))


# How many times the rows of a task may come together.
_CROWD = 4


@contextmanager
def arrow_bytes(session: SparkSession, most: int) -> Iterator[None]:
    """Within the block, jobs hand at most about ``most`` bytes, or a longer row, to a Python worker at once."""
    with _set(session, "spark.sql.execution.arrow.maxBytesPerBatch", str(most)):
        yield


def shuffles_deleted(session: SparkSession):
    """Within the block, a job deletes what it shuffled when it ends; else that waits for the driver's garbage collector."""
    return _set(session, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def _set(session: SparkSession, name: str, value: str) -> Iterator[None]:
    before = session.conf.get(name, None)
    session.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            session.conf.unset(name)
        else:
            session.conf.set(name, before)


def drop(session: SparkSession, path: str) -> None:
    """Deletes a table that ``kept`` wrote."""
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)


def new_path(session: SparkSession) -> str:
    """A path not yet used in the shared folder."""
    return f"{_folder(session)}/tracelantern-{uuid.uuid4()}"


def _folder(session: SparkSession) -> str:
    folder = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()
    if folder is None:
        # one process on one machine; a local cluster has executors of its own
        if not re.fullmatch(r"local(\[.*\])?", session.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tracelantern-")
        session.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
