"""Removal of byte strings that repeat across documents, with suffix arrays.

A repeated string of WIDTH bytes holds the same anchor in both documents: the gram with
the smallest hash among all grams in it.  So each document gives its anchors, with a
hash of the bytes that any string of WIDTH bytes around the anchor can reach (its
context).  Anchors meet by the hash of their gram, packed by block and part:

* equal contexts are settled there: all but those in the smallest document are repeats;
* contexts that differ around one gram may still share strings if SIDE bytes more agree
  before or behind the gram.  The bytes of such contexts are fetched from the documents, a suffix array built by grouping puts equal strings side
  by side, and each string counts as removed in all documents but the smallest.

Before anything is shuffled a block settles its own repeats, so a passage with a third of
all copies is one row per block.  Grams that very many documents share, as parts of
shorter common phrases, are dealt out by context, and what is left of them by the bytes that a
few neighbouring strings have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept
from tracelantern.llm.shared import slices, whole_bytes
from tracelantern.llm.suffix_array import suffix_order

WIDTH = 50
GRAM = 20
REACH = WIDTH - GRAM
# A string of WIDTH bytes around a gram has this many bytes before it or behind it.
SIDE = REACH // 2
# Bytes of text in a block, and of contexts that one suffix array sorts.
BLOCK_BYTES = 1 << 19
SORTED_BYTES = 1 << 16
# Bytes of text for each part of the anchors.
PART_BYTES = 2 << 20
# A gram is common when it has contexts that differ in this share of the documents, so common
# grams are fewer than the anchors of two hundred documents.
COMMON_SHARE = 0.005
COMMON_LEAST = 32
_COUNTED_AT_ONCE = 1 << 20
# Neighbouring strings of a common gram that travel as one, and rows in a batch of contexts.
TOGETHER = 4
_SENT_AT_ONCE = 1 << 16

_M1, _M2, _M3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
# Stands for a null doc_id.
_LAST = (1 << 63) - 1
_SPANS = "row long, doc long, start int, stop int, gram long, common boolean"


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * _M3
    value = (value ^ (value >> np.uint64(29))) * _M1
    return value ^ (value >> np.uint64(32))


def _gram_hashes(e: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the grams at the first places, from the eight bytes at each place."""
    return _mix(e[:size] * _M1 + e[8:size + 8] * _M2 + (e[12:size + 12] ^ _M3) * _M3)


class Texts:
    """Texts of a block, one after the other, with space after each that no string reaches."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + WIDTH)[:-1]]).astype(np.int64)
        self.octets = (b"\0" * WIDTH).join([*texts, b"\0" * WIDTH])
        # the eight bytes that start at each place
        self.eights = np.ndarray(max(0, len(self.octets) - 7), "<u8", self.octets, strides=(1,)) if len(self.octets) > 7 else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, place in the block, and gram hash of each anchor."""
        none = np.zeros(0, np.int64)
        long = np.flatnonzero(self.lengths >= WIDTH)
        if not len(long):
            return none, none, none.view(np.uint64)
        e = self.eights
        size = len(e) - 12
        grams = _gram_hashes(e, size)
        # the smallest hash of a run of grams; the first of equal ones
        place_bits = np.uint64(len(self.octets).bit_length())
        key = (grams >> place_bits << place_bits) | np.arange(size, dtype=np.uint64)
        least, width = key, 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH + 1:
            rest = REACH + 1 - width
            least = np.minimum(least[:-rest], least[rest:])
        least = (least & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
        windows = self.lengths[long] - WIDTH + 1
        found = np.concatenate([least[a:a + n] for a, n in zip(self.starts[long].tolist(), windows.tolist(), strict=True)])
        # the places never go back, so equal ones are neighbours
        found = found[np.append(True, found[1:] != found[:-1])]
        return np.searchsorted(self.starts, found, side="right") - 1, found, grams[found]

    def strings(self, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """Hashes of the strings of ``width`` bytes at given places."""
        value = np.full(len(starts), width, np.uint64)
        for step in (*range(0, width - 8, 8), width - 8):
            value = _mix(value * _M2 + self.eights[starts + step])
        return value

    def sides(self, place: np.ndarray) -> np.ndarray:
        """16 bits each of the hashes of a gram with SIDE bytes before it and behind it.

        Where a text has fewer bytes, no string needs that side and any value will do.
        """
        before, behind = (self.strings(place - k, GRAM + SIDE) >> np.uint64(48) for k in (SIDE, 0))
        return (before << np.uint64(16) | behind).astype(np.uint32)

    def contexts(self, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the context of each anchor starts and stops, and the hash of its bytes."""
        first, end = self.starts[number], self.starts[number] + self.lengths[number]
        start, stop = np.maximum(first, place - REACH), np.minimum(end, place + GRAM + REACH)
        value = np.full(len(place), 7, np.uint64)
        whole = np.flatnonzero(stop - start == GRAM + 2 * REACH)
        for step in range(0, GRAM + 2 * REACH, 8):
            value[whole] = _mix(value[whole] * _M2 + self.eights[start[whole] + step])
        view = memoryview(self.octets)
        cut = np.flatnonzero(stop - start < GRAM + 2 * REACH)
        value[cut] = [
            # the same bytes further left or right of the gram are another context
            xxhash.xxh3_64_intdigest(view[a:b], p - a + 1) for a, b, p in zip(start[cut].tolist(), stop[cut].tolist(), place[cut].tolist(), strict=True)
        ]
        return start, stop, value


def _first_of(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest doc among the entries with the same key."""
    order = np.lexsort((docs, keys))
    new = np.append(True, keys[order][1:] != keys[order][:-1]) if len(order) else np.zeros(0, bool)
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(docs[order][new], np.diff(np.append(np.flatnonzero(new), len(order))))
    return least


def _ends_of(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest doc among the entries with the same key."""
    if not len(keys):
        return docs, docs
    order = np.lexsort((docs, keys))
    new = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    after = np.append(new[1:], len(order))
    least, most = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    least[order], most[order] = (np.repeat(docs[order][at], after - new) for at in (new, after - 1))
    return least, most


def _joined(number: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each number, those that overlap or touch as one; stops rise with starts."""
    if not len(number):
        return number, start, stop
    order = np.lexsort((start, number))
    number, start, stop = number[order], start[order], stop[order]
    new = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (start[1:] > stop[:-1])))
    return number[new], start[new], stop[np.append(new[1:], len(number)) - 1]


def _spans(rows, docs, starts, stops, grams=None, common=False) -> pa.RecordBatch:
    none = pa.nulls(len(rows), pa.int64()) if grams is None else pa.array(grams.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(docs), pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32)), none, pa.array(np.full(len(rows), common))],
        names=["row", "doc", "start", "stop", "gram", "common"],
    )


def _texts(documents: DataFrame) -> DataFrame:
    """``row, doc, text``: rows with the same doc_id and text share a row; null ids come last, as one id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    # a LONG that names document and text
    row = doc.bitwiseXOR(F.shiftleft(F.hash(text).cast("long"), 32))
    return documents.select(row.alias("row"), doc.alias("doc"), text.alias("text"))


def _common_grams(texts: DataFrame, rows: int) -> np.ndarray:
    """Hashes of the grams that many documents have in contexts that differ.

    Equal contexts meet in the first step, however many there are.
    """

    def often(held: list[tuple[np.ndarray, np.ndarray]], documents: int) -> pa.RecordBatch:
        grams, contexts = (np.concatenate(c) for c in zip(*held, strict=True))
        found, times = np.unique(grams[np.unique(_mix(grams) ^ contexts, return_index=True)[1]], return_counts=True)
        # a gram with the share in all documents has about that share in some of these runs
        common = times >= max(4, COMMON_SHARE * documents)
        return pa.RecordBatch.from_arrays([pa.array(found[common].view(np.int64)), pa.array(times[common])], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, documents = [], 0, 0
        for batch in slices(batches, BLOCK_BYTES):
            block = Texts(whole_bytes(batch.column(0)))
            number, place, grams = block.anchors()
            held.append((grams, block.contexts(number, place)[2]))
            size, documents = size + len(grams), documents + batch.num_rows
            if size > _COUNTED_AT_ONCE:
                yield often(held, documents)
                held, size, documents = [], 0, 0
        if held:
            yield often(held, documents)

    counts = texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(COMMON_LEAST, int(COMMON_SHARE * rows))
    # bounded: a document has few anchors, and each common gram is in a thousandth of them
    return np.array([r["gram"] for r in counts.where(F.col("n") >= least).select("gram").collect()], np.int64).view(np.uint64)


def _settled(rows, docs, starts, stops, grams, contexts, sides) -> tuple[np.ndarray, np.ndarray]:
    """Which entries repeat the context of a smaller document, and which need a closer look."""
    first = _first_of(contexts ^ _mix(grams), docs)
    again = docs > first
    # contexts whose first documents differ are different, and may share strings
    lowest, highest = _ends_of(grams, first)
    open_ = np.flatnonzero((lowest < highest) & ~again)
    near = np.zeros(len(grams), bool)
    for side in (sides >> 16, sides & 0xFFFF | 1 << 16):
        lowest, highest = _ends_of(_mix(grams[open_] ^ _mix(side[open_].astype(np.uint64))), first[open_])
        near[open_] |= lowest < highest
    return again, near


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, doc, text`` of the documents, and the ``row, start, stop`` of repeated strings, overlapping."""
    texts = _texts(documents)
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    common = _common_grams(texts, rows)
    parts = max(1, round(size / PART_BYTES))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_BYTES):
            block = Texts(whole_bytes(batch.column(2)))
            number, place, grams = block.anchors()
            start, stop, contexts = block.contexts(number, place)
            sides = block.sides(place)
            rows, docs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            start, stop = start - block.starts[number], stop - block.starts[number]
            own = _first_of(contexts ^ _mix(grams), docs[number]) < docs[number]
            yield from _packed(rows, docs, *_joined(number[own], start[own], stop[own]), None, None, None, parts)
            for is_common in (False, True):
                rest = ~own & (np.isin(grams, common) == is_common)
                yield from _packed(rows, docs, number[rest], start[rest], stop[rest], grams[rest], contexts[rest], sides[rest], parts, is_common)

    def settle(table: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*(_unpacked(r) for r in table.to_pylist()), strict=True)]
        part = table.column("part")[0].as_py()
        if part < 0:
            return pa.Table.from_batches([_spans(*columns[:4])])
        again, open_ = _settled(*columns)
        rows, docs, starts, stops, grams, *_ = columns
        is_common = part >= parts
        if is_common:  # the contexts of a common gram are in all parts
            open_ = ~again
        return pa.Table.from_batches([
            _spans(rows[again], docs[again], starts[again], stops[again]),
            _spans(rows[open_], docs[open_], starts[open_], stops[open_], grams[open_], is_common),
        ])

    packed = texts.mapInArrow(anchored, "part long, data binary")
    spans = kept(packed.groupBy("part").applyInArrow(settle, _SPANS))
    asked = spans.where("gram IS NOT NULL").groupBy("row").agg(
        F.first("doc").alias("doc"), F.collect_list(F.struct("start", "stop", "gram", "common")).alias("asked")
    )
    contexts = _zipped(texts).drop("doc").join(asked, "row").select("row", "doc", "zipped", "asked").mapInArrow(
        _fetched, "gram long, row long, doc long, start int, octets binary"
    )
    sorted_ = contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compared, "row long, start int, stop int")
    found = spans.where("gram IS NULL").select("row", "start", "stop").unionByName(sorted_)
    return texts, found


def _packed(rows, docs, number, start, stop, grams, contexts, sides, parts, common=False) -> Iterator[pa.RecordBatch]:
    """A row for each part: the documents it names, then the entries column by column.

    Entries that are settled already go to the parts below zero, any of them.  Hashes
    travel as seven bytes; high and low bytes of small numbers stand apart, so that they
    compress.
    """
    if not len(number):
        return
    if grams is None:
        part = np.full(len(number), -1 - int(docs[0]) % parts)
    else:
        # the contexts of a common gram are dealt out by their own hash
        # an anchor is the gram with the smallest hash around, so its hash is mixed once more
        dealt = contexts if common else _mix(grams)
        part = ((dealt >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) + parts * common
    order = np.lexsort((start, number, part))
    edges = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
    tags = (rows ^ docs) >> 32
    data = []
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        at = order[a:b]
        named, local = np.unique(number[at], return_inverse=True)
        columns = [
            np.array([len(named), len(at)], "<u4"), np.diff(docs[named], prepend=0), tags[named].astype("<i4"), np.diff(local, prepend=0).astype("u1"),
            (start[at] & 0xFFFF).astype("<u2"), (start[at] >> 16).astype("<u2"), (stop - start)[at].astype("<i4" if grams is None else "u1"),
        ]
        if grams is not None:
            columns += [_seven(grams[at]), _seven(contexts[at]), sides[at].astype("<u4")]
        data.append(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))
    yield pa.RecordBatch.from_arrays([pa.array(part[order][edges]), pa.array(data, pa.binary())], names=["part", "data"])


def _seven(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    data, at = row["data"], 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    def hashes(n: int) -> np.ndarray:
        high = np.zeros((n, 8), np.uint8)
        if row["part"] >= 0:
            high[:, 1:] = take("u1", 7 * n).reshape(-1, 7)
        return high.view("<u8").ravel()

    named, size = take("<u4", 2).tolist()
    docs = np.cumsum(take("<i8", named))
    rows = docs ^ take("<i4", named).astype(np.int64) << 32
    number = np.cumsum(take("u1", size), dtype=np.int64)
    start = take("<u2", size).astype(np.int32)
    start |= take("<u2", size).astype(np.int32) << 16
    stop = start + take("u1" if row["part"] >= 0 else "<i4", size)
    grams, contexts = hashes(size), hashes(size)
    return rows[number], docs[number], start, stop, grams, contexts, take("<u4", size if row["part"] >= 0 else 0)


def _zipped(texts: DataFrame) -> DataFrame:
    """``row, doc, zipped``: texts are compressed one by one before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            zipped = pa.array([press(octets) for octets in whole_bytes(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), zipped], names=["row", "doc", "zipped"])

    return texts.mapInArrow(run, "row long, doc long, zipped binary")


def _unzipped(column: pa.Array) -> list[bytes]:
    return [zstandard.decompress(octets) for octets in column.to_pylist()]


def _gram_places(text: bytes, gram: int) -> list[int]:
    """Where a text has a gram, by the seven bytes of its hash that travel."""
    e = Texts([text]).eights
    size = len(text) - GRAM + 1
    grams = _gram_hashes(e, size)
    return np.flatnonzero(grams >> np.uint64(8) == np.uint64(gram & (1 << 64) - 1) >> np.uint64(8)).tolist()


def _neighbours(number, start, stop, grams, texts: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of TOGETHER strings around common grams: text, first string, last string, and the bytes all hold.

    Runs are counted from the gram, so a string is in the same run wherever it occurs.
    """
    # a context that ends before its text tells its gram's place, one that begins after the text's start, too
    place = np.where(stop < lengths[number], stop - WIDTH, start + REACH)
    unsure = np.flatnonzero((start == 0) & (stop == lengths[number]))
    more = [(k, p) for k in unsure.tolist() for p in _gram_places(texts[number[k]], int(grams[k]))]
    sure = np.setdiff1d(np.arange(len(number)), unsure, assume_unique=True)
    entry = np.concatenate([sure, np.array([k for k, _ in more], np.int64)])
    place = np.concatenate([place[sure], np.array([p for _, p in more], np.int64)])
    runs = -(-(REACH + 1) // TOGETHER)
    entry, place = np.repeat(entry, runs), np.repeat(place, runs)
    begin = place - REACH + TOGETHER * np.tile(np.arange(runs), len(place) // runs)
    first = np.maximum(start[entry], begin)
    last = np.minimum(np.minimum(stop[entry] - WIDTH, begin + TOGETHER - 1), place)
    some = np.flatnonzero(first <= last)
    return number[entry[some]], first[some], last[some], begin[some] + TOGETHER - 1


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are asked for; of common grams by runs of strings."""
    for batch in slices(batches):
        texts = _unzipped(batch.column(2))
        block = Texts(texts)
        octets = np.frombuffer(block.octets, np.uint8)
        names = [batch.column(3).type.value_type.field(k).name for k in range(4)]
        asked = dict(zip(names, (c.to_numpy(zero_copy_only=False) for c in batch.column(3).flatten().flatten()), strict=True))
        all_numbers = np.repeat(np.arange(len(texts)), batch.column(3).value_lengths().to_numpy())
        for at in range(0, len(all_numbers), _SENT_AT_ONCE):
            number, (start, stop, grams) = all_numbers[at:at + _SENT_AT_ONCE], (
                asked[name][at:at + _SENT_AT_ONCE].astype(np.int64) for name in ("start", "stop", "gram")
            )
            common = asked["common"][at:at + _SENT_AT_ONCE].astype(bool)
            plain = ~common
            near, first, last, held = _neighbours(number[common], start[common], stop[common], grams[common], texts, block.lengths)
            keys = block.strings(block.starts[near] + held, WIDTH - TOGETHER + 1).view(np.int64)
            number = np.concatenate([number[plain], near])
            start, stop = np.concatenate([start[plain], first]), np.concatenate([stop[plain], last + WIDTH])
            sizes = stop - start
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            bytes_at = np.repeat(block.starts[number] + start - offsets[:-1], sizes) + np.arange(offsets[-1])
            data = pa.Array.from_buffers(
                pa.binary(), len(number), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(octets[bytes_at])]
            )
            rows, docs = (np.asarray(batch.column(k))[number] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([grams[plain], keys])), pa.array(rows), pa.array(docs), pa.array(start.astype(np.int32)), data],
                names=["gram", "row", "doc", "start", "octets"],
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that contexts around the same gram share, for whole groups in the order they come."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > 4 * BLOCK_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            grams = table.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))  # the last group may go on
            yield from _shared(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield from _shared(pa.Table.from_batches(held))


def _shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    contexts = table.column("octets").to_pylist()
    if not contexts:
        return
    rows, docs = table.column("row").to_numpy(), table.column("doc").to_numpy()
    starts = table.column("start").to_numpy().astype(np.int64)
    block = Texts(contexts)
    # strings whose hash another document has too; all others repeat nothing
    windows = np.maximum(block.lengths - WIDTH + 1, 0)
    number = np.repeat(np.arange(len(contexts)), windows)
    place = np.repeat(block.starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    # the low bits make way for the string's number: strings with equal hashes are sorted side by side
    bits = np.uint64(len(place).bit_length())
    ranked = np.sort(block.strings(place) >> bits << bits | np.arange(len(place), dtype=np.uint64))
    order = (ranked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    h, d = ranked >> bits, docs[number][order]
    shared = np.zeros(len(h), bool)
    if len(h):
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)
        shared[order] = np.repeat(several, np.diff(np.append(edge, len(h))))
    number, place = number[shared], place[shared]
    # the stretch of each context that its shared strings cover
    wanted, at = np.unique(number, return_index=True)
    last = np.append(at[1:], len(number)) - 1 if len(at) else at
    group = table.column("gram").to_numpy()
    pieces: dict[bytes, list[tuple[int, int]]] = {}  # equal stretches once, with the contexts they are in
    size, batch, found = 0, None, []
    for c, a, b in zip(wanted.tolist(), place[at].tolist(), (place[last] + WIDTH).tolist(), strict=True):
        if size > SORTED_BYTES and group[c] != batch:
            found += _repeated(pieces, docs)
            pieces, size = {}, 0
        octets = block.octets[a:b]
        if octets not in pieces:
            size += len(octets)
        pieces.setdefault(octets, []).append((c, int(starts[c] + a - block.starts[c])))
        batch = group[c]
    found += _repeated(pieces, docs)
    if found:
        number, start, stop = _joined(*map(np.array, zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[number]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["row", "start", "stop"]
        )


def _repeated(pieces: dict[bytes, list[tuple[int, int]]], docs: np.ndarray) -> list[tuple[int, int, int]]:
    """Context, start and stop of strings that occur in a smaller document.

    A suffix array of the stretches puts equal strings side by side.
    """
    if not pieces:
        return []
    sizes = np.array([len(members) for members in pieces.values()])
    holders = np.array([c for members in pieces.values() for c, _ in members])
    first = np.minimum.reduceat(docs[holders], np.cumsum(sizes) - sizes)
    lengths = np.array([len(p) for p in pieces])
    # 0 ends the text, 1 ends a stretch, bytes follow
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(lengths + 1) - 1
    joined[ends] = 1
    order = suffix_order(np.append(joined, 0))[1:]
    number = np.repeat(np.arange(len(pieces)), lengths + 1)
    order = order[ends[number[order]] - order >= WIDTH]
    # neighbours in the order that share a string, and the smallest document of each
    string = np.lib.stride_tricks.sliding_window_view(joined, WIDTH)[order]
    edge = np.flatnonzero(np.append(True, (string[1:] != string[:-1]).any(axis=1)))
    least = np.full(len(joined), _LAST)
    least[order] = np.repeat(np.minimum.reduceat(first[number[order]], edge), np.diff(np.append(edge, len(order))))
    out = []
    begins = ends - lengths
    # the strings of a stretch lie from its start to WIDTH - 1 before its end
    borders = np.column_stack([begins, ends - WIDTH + 1]).ravel()
    lows, highs = (ends_of.reduceat(least, borders)[::2].tolist() for ends_of in (np.minimum, np.maximum))
    for members, begin, end, low, high in zip(pieces.values(), begins.tolist(), ends.tolist(), lows, highs, strict=True):
        own = least[begin:end - WIDTH + 1]
        for c, at in members:
            doc = docs[c]
            if high < doc:
                out.append((c, at, at + end - begin))
            elif low < doc:
                out += [(c, at + k, at + k + WIDTH) for k in np.flatnonzero(own < doc).tolist()]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remaining(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_octets`` for each row of ``documents``.

    Texts are taken as UTF-8 bytes; null counts as empty.  Each byte goes that a string
    of WIDTH bytes covers which also starts in a row with a smaller doc_id.  A null
    doc_id is larger than any other; rows with the same doc_id are no repeats of each
    other.  What remains may not be valid UTF-8.  Other columns are not read.
    """
    texts, found = repeats(documents)
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = _zipped(texts).join(spans, "row", "left").select(F.nullif("doc", F.lit(_LAST)).alias("doc_id"), "zipped", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for octets, spans in zip(_unzipped(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                cut = merged([(s["start"], s["stop"]) for s in spans or []])
                edges = [0, *(e for span in cut for e in span), len(octets)]
                left = b"".join(octets[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(octets), len(octets) - len(left), len(cut), left))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_octets"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_octets binary")


def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What repeats across all ``documents``, and digests of what remains."""
    rows = remaining(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_octets", 256).alias("kept_sha256"))
