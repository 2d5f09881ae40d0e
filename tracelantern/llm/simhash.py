"""SimHash fingerprints and their near-duplicates by a Gray-order hierarchical index.

Two fingerprints that differ in at most two of 64 bits agree on at least one of any
three blocks of bits.  So each distinct fingerprint goes to three groups, named by
block and block value, and every link is found within a group.  A group with very
many fingerprints is divided again by three blocks of its remaining bits; after
three divisions at most 19 bits are free, so no group can hold more than 2**19
fingerprints, whatever the data.

Within its groups a task sorts the fingerprints by Gray rank, which puts those that
share bit patterns side by side, and factors shared leading patterns into the upper
nodes of a tree, one level a byte.  A fingerprint walks the trees from the root and adds
up the differences from each node's pattern; a node beyond two differences is dropped
with everything below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept
from tracelantern.llm.components import components
from tracelantern.llm.shared import hot_join, slices, whole_bytes

DISTANCE = 2
# Widths of the three blocks of each division; what a block leaves free is divided next.
DIVISIONS = ((22, 21, 21), (15, 14, 14), (10, 10, 10))
# Groups above this many fingerprints are divided again.
LARGE_GROUP = 20_000
_ROWS_AT_ONCE = 100_000
_PAIRS_AT_ONCE = 2_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """SimHash of one text in UTF-8: the majority of the shingles' XXH64 in each bit."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words_in_shingle, len(words))
    view = memoryview(joined)
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(view[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1:].tolist(), strict=False)], dtype=np.uint64
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes: a bit is set where it is in over half of them."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    ones = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` for each row; fp is the fingerprint as a signed LONG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, words_in_shingle) for t in whole_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[list[int]]:
    """Masks of the groups of each division: the bits on which a group agrees."""
    levels, open_ = [], [(0, list(range(63, -1, -1)))]
    for widths in DIVISIONS:
        below = []
        for mask, free in open_:
            start = 0
            for width in widths:
                block = free[start:start + width]
                start += width
                below.append((mask | sum(1 << bit for bit in block), [bit for bit in free if bit not in block]))
        levels.append([mask for mask, _ in below])
        open_ = below
    return levels


MASKS = _masks()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _divided(nodes: DataFrame, level: int, parent: bool) -> DataFrame:
    """``mask, key, fp``: each fingerprint in the three groups of the next division."""
    masks = [_signed(m) for m in MASKS[level]]
    if parent:
        all_ = F.array(*[F.lit(m) for m in masks])
        options = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(
            (F.col("mask") * 3 + k).cast("int").alias("mask"),
            F.element_at(all_, (F.col("mask") * 3 + k + 1).cast("int")).alias("bits")))
    else:
        options = F.array(*[F.struct(F.lit(k).alias("mask"), F.lit(m).alias("bits")) for k, m in enumerate(masks)])
    return nodes.select("fp", F.explode(options).alias("o")).select(
        F.col("o.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("o.bits")).alias("key"), "fp"
    )


def links(nodes: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """Links between the distinct fingerprints ``nodes(fp)``: ``a, b``, enough of them to
    reach from every fingerprint every other that is within DISTANCE, step by step."""
    found, open_, last = [], _divided(nodes, 0, False), len(DIVISIONS) - 1
    for level in range(len(DIVISIONS)):
        sizes = open_.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        if level == last:
            found.append(_searched(open_))
            break
        sizes = kept(sizes)
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # fewer than a thousand groups exceed the limit, so they are broadcast
        limit = max(large_group, total // 1000 + 1)
        large = F.broadcast(sizes.where(F.col("n") > limit).select("mask", "key"))
        found.append(_searched(open_.join(large, ["mask", "key"], "left_anti")))
        if sizes.where(F.col("n") > limit).isEmpty():
            break
        open_ = kept(_divided(open_.join(large, ["mask", "key"]).select("mask", "fp"), level + 1, True))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _searched(members: DataFrame) -> DataFrame:
    """Links within groups; a group lies in one task, in Gray order."""
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    # flipping the sign bit makes the signed order the unsigned one
    return (
        members.select("mask", "key", "fp", rank.bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
        .repartition("mask", "key").sortWithinPartitions("mask", "key", "rank")
        .mapInArrow(_search, "a long, b long")
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(np.column_stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)]))
        rows += batch.num_rows
        if rows >= _ROWS_AT_ONCE:
            block = np.concatenate(held)
            new = np.flatnonzero((block[1:, :2] != block[:-1, :2]).any(axis=1)) + 1
            cut = int(new[-1]) if len(new) else 0  # the last group may go on
            yield from _stars(block[:cut])
            held, rows = [block[cut:]], len(block) - cut
    if held:
        yield from _stars(np.concatenate(held))


def _stars(block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of whole groups, as stars around one fingerprint of each local component."""
    if len(block) < 2:
        return
    starts = np.concatenate(([True], (block[1:, :2] != block[:-1, :2]).any(axis=1)))
    sizes = np.diff(np.append(np.flatnonzero(starts), len(block)))
    useful = np.repeat(sizes > 1, sizes)
    fp, starts = block[useful, 2].view(np.uint64), starts[useful]
    if not len(fp):
        return
    label = np.arange(len(fp))
    for i, j in GrayIndex(fp, starts).pairs():
        while True:  # every pair under the smaller label, until nothing moves
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = label[label]
            if np.array_equal(before, label):
                break
    while not np.array_equal(label, label[label]):
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["a", "b"]
    )


class GrayIndex:
    """Trees over fingerprints in Gray order; one tree per group, one level per byte.

    A node of level k stands for neighbouring fingerprints that share their first k
    bytes; its pattern is byte k, compared only where the walk reaches it.
    """

    def __init__(self, fp: np.ndarray, starts: np.ndarray):
        self.octets = fp.astype(">u8").view(np.uint8).reshape(-1, 8)
        flags, self.first, self.node = starts.copy(), [], []
        for level in range(9):
            if level:
                octet = self.octets[:, level - 1]
                flags[1:] |= octet[1:] != octet[:-1]
            self.first.append(np.flatnonzero(flags))
            self.node.append(np.cumsum(flags) - 1)
        self.size = len(fp)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of fingerprints of one group within DISTANCE."""
        todo = [(0, np.arange(self.size), self.node[0].copy(), np.zeros(self.size, np.int64))]
        while todo:
            level, query, node, differences = todo.pop()
            if level == 8:
                yield query, self.first[8][node]
                continue
            if len(query) > 1 and self._children(level, node).sum() > _PAIRS_AT_ONCE:
                half = len(query) // 2
                todo += [(level, query[s], node[s], differences[s]) for s in (slice(half, None), slice(half))]
                continue
            todo.append((level + 1, *self._below(level, query, node, differences)))

    def _children(self, level: int, node: np.ndarray) -> np.ndarray:
        end = np.append(self.first[level], self.size)[node + 1]
        return self.node[level + 1][end - 1] - self.node[level + 1][self.first[level][node]] + 1

    def _below(self, level, query, node, differences):
        count = self._children(level, node)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        child = np.repeat(self.node[level + 1][self.first[level][node]], count) + offset
        query, differences = np.repeat(query, count), np.repeat(differences, count)
        pattern = self.octets[self.first[level + 1][child], level]
        differences = differences + np.bitwise_count(pattern ^ self.octets[query, level])
        end = np.append(self.first[level + 1], self.size)[child + 1]
        keep = (differences <= DISTANCE) & (end - 1 > query)
        return query[keep], child[keep], differences[keep]


def near_duplicates(documents: DataFrame, words_in_shingle: int = 3, large_group: int = LARGE_GROUP) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``documents``.

    The text is cut into words at ASCII white space after lower-casing A-Z, and
    hashed by shingles of ``words_in_shingle`` words, repeats included; a shorter
    text is one shingle, and a text without words or null has fingerprint zero,
    which links like any other.  Documents link at two or fewer differing bits;
    component_id is the smallest doc_id reached (null ids count as absent; a
    component of null ids alone has a null component).  Repeated rows give repeated
    results.  Columns other than doc_id and text are not read.
    """
    rows = kept(fingerprints(documents, words_in_shingle))
    nodes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    member = kept(components(kept(links(nodes.select("fp"), large_group))))
    linked = nodes.join(member, nodes["fp"] == member["node"], "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root")
    )
    # a component's size is not bounded, so its least id is joined like any hot key
    linked = kept(linked)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    of_node = hot_join(linked, kept(least), "root", "m", total)
    return hot_join(rows, kept(of_node.select("fp", "n", "component_id")), "fp", "n", total).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` without near-copies: of each component the row with the smallest
    doc_id stays, with all its columns.  Rows without doc_id stay."""
    stays = near_duplicates(documents.where("doc_id IS NOT NULL")).where("doc_id = component_id")
    ids = stays.select(F.col("doc_id").alias("stays")).distinct()
    # the columns travel as one, so that none of their names can clash
    rows = documents.select(F.col("doc_id").alias("own_id"), F.struct("*").alias("whole"))
    return rows.join(ids, F.col("own_id") == F.col("stays"), "left").where("stays IS NOT NULL OR own_id IS NULL").select("whole.*")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints and components of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
