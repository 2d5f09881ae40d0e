"""Steps that several operators of this subpackage share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys with more than 1 / HOT_SHARE of all rows count as hot, so there are fewer than HOT_SHARE.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key.

    ``groups[size]`` is the number of rows of the key and ``total`` the number of
    all rows.  Groups above ``total / HOT_SHARE`` rows are fewer than HOT_SHARE,
    so they are broadcast and their rows stay where they are; all other rows are
    shuffled by the key.  ``rows`` is read twice and should be a written table.
    """
    cut = total // HOT_SHARE + 1
    hot = F.broadcast(groups.where(F.col(size) > cut))
    in_place = rows.join(hot, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return in_place.unionByName(rest.join(groups.where(F.col(size) <= cut), key))


def in_worker(name: tuple, make: Callable[[], Any]) -> Any:
    """The object of that name, made once per process.

    Functions travel to workers by value, and their globals are new in every task, so the
    object stays in a module of its own.
    """
    held = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def free_worker() -> None:
    """Lets go of what ``in_worker`` made; a worker that Spark hands to another step would keep it."""
    if sys.modules.pop("_kept_in_worker", None):
        gc.collect()


def whole_bytes(column: pa.Array) -> list[bytes]:
    """The values of a text column in UTF-8; null counts as empty."""
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most_bytes``, or a single longer row."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, rows * most_bytes // max(1, batch.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
