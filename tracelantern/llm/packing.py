"""Best-fit packing of documents into sequences under several capacities at once.

A piece of n tokens asks for n tokens, one document and n * n units of attention of its
sequence, so its length says all.  The plan is therefore made from the number of pieces
of each length, at most ``capacity`` numbers however large the corpus is: whole stacks
of equal pieces go into stacks of equally filled sequences.  Each piece then finds its
place by its rank among the pieces of its length, and ranks come from counts by hash
bucket, so a length with a third of all pieces is still dealt over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions.stages import arrow_bytes, kept
from tracelantern.llm.shared import slices
from tracelantern.llm.tokens import encoder

TOKENS = 1024
END_ID = 2
# Pieces that one rank bucket of one length holds at most, about.
_BUCKET_ROWS = 100_000
# What a worker gets at once.
_BATCH_BYTES = 4 << 20


_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())
])


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and attention (sum of squared lengths)."""

    tokens: int = TOKENS
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        """A piece has a token at least, and squares sum to the square of the sum at most,
        so the default limits are those that the tokens imply."""
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


def plan(counts: dict[int, int], capacity: Capacity, rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> list[tuple]:
    """Where the pieces of each length go: rows ``length, first, last, sequence, times, offset``.

    The pieces of ``length`` with rank ``first <= r < last`` go to sequence
    ``sequence + (r - first) // times``, at ``offset + (r - first) % times * length``.
    Longer pieces come first.  Of the stacks of equally filled sequences that can take
    a piece under every constraint, it takes the one with the smallest weighted norm of
    what would remain (rule "norm") or the largest weighted product of demand and
    remaining capacity (rule "dot"), and opens a sequence where there is none.
    """
    full = capacity.vector()
    scale = np.array(weights) / full.astype(float) ** 2
    room = np.empty((0, 3), np.int64)  # of each open stack
    stacks: list[tuple[int, tuple]] = []  # number of sequences, their contents as (length, times)
    done: list[tuple[int, tuple]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        demand = np.array([length, 1, length * length], dtype=np.int64)
        while left:
            fits = np.flatnonzero((room >= demand).all(axis=1))
            if len(fits):
                rest = room[fits]
                score = ((rest - demand) ** 2 * scale).sum(axis=1) if rule == "norm" else -(rest * demand * scale).sum(axis=1)
                at = int(fits[np.argmin(score)])
                have, space, contents = stacks[at][0], room[at], stacks[at][1]
            else:
                at, have, space, contents = -1, left, full, ()
                if (demand > full).any():
                    raise ValueError(f"a piece of {length} tokens fits no sequence")
            times = int((space // demand).min())
            filled = min(have, left // times)
            parts = [(filled, times)] if filled else []
            if filled < have and left > filled * times:
                parts.append((1, left - filled * times))
            if at >= 0:
                used = sum(n for n, _ in parts)
                if used < have:
                    stacks[at] = (have - used, contents)
                else:
                    stacks.pop(at)
                    room = np.delete(room, at, axis=0)
            for n, k in parts:
                left -= n * k
                remains = space - k * demand
                if (remains < 1).any():
                    done.append((n, (*contents, (length, k))))
                else:
                    stacks.append((n, (*contents, (length, k))))
                    room = np.vstack([room, remains])
    rows, sequence, rank = [], 0, dict.fromkeys(counts, 0)
    for n, contents in done + stacks:
        offset = 0
        for length, k in contents:
            rows.append((length, rank[length], rank[length] + n * k, sequence, k, offset))
            rank[length] += n * k
            offset += length * k
        sequence += n
    return rows


def pieces(documents: DataFrame, tokenizer: str, capacity: int = TOKENS, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut into
    pieces of ``capacity`` tokens of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            out = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.all(texts), strict=True):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                out += [
                    (doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
                ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _PIECE.types, strict=True)], schema=_PIECE
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(
    documents: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), rule: str = "norm", end_id: int = END_ID
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.

    A null text counts as empty and is one piece, the end id.  Documents longer than a
    sequence are cut, no others.  Repeated rows are packed each.  Sequences have no
    gaps.  Columns other than doc_id and text are not read.
    """
    spark = documents.sparkSession
    with arrow_bytes(spark, _BATCH_BYTES):
        rows = kept(pieces(documents, tokenizer, capacity.tokens, end_id))
    # at most ``capacity`` rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(256, sum(counts.values()) // _BUCKET_ROWS)
    ranked = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = ranked.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("rank", F.row_number().over(within)).join(sizes, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("rank") - 1
    )
    places = spark.createDataFrame(
        plan(counts, capacity, rule), "length long, first long, last long, sequence long, times long, at long"
    )
    # the plan grows with the number of lengths, not with the corpus
    return ranked.join(F.broadcast(places), "length").where("rank >= first AND rank < last").selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32",
        "sequence + (rank - first) div times AS sequence_id",
        "at + (rank - first) % times * length AS offset",
    )


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return pack(documents, public_tokenizers.path("byte_bpe_50k.json"))
