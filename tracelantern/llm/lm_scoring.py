"""Stupid-backoff scores of documents against the n-grams of all other documents.

Documents are dealt into blocks by a hash of their id; they travel compressed, and once, for the
two steps that read a block share the shuffle.  A block explodes its texts into
n-grams of all orders and sends each distinct one, with its count, to the part of the
count table that its hash names; n-grams of a part that come from one block travel in
one row of sorted arrays.  A part adds up the counts of its n-grams and joins the totals to
what each block asked for, and the block sums the scores of each document.  A frequent
n-gram is one entry per block, never one per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.llm.shared import whole_bytes

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20
# Parts of the count table per block; a part's arrays fit a task many times over.
PARTS_PER_BLOCK = 2

_ASKED = "part long, block long, grams binary, counts binary"
_TOLD = "block long, part long, totals binary"


class Block:
    """N-grams of the documents of a block: distinct hashes in order, and where they occur."""

    def __init__(self, texts: list[bytes], order: int):
        ids: dict[bytes, int] = {}
        words = [np.fromiter((ids.setdefault(w, len(ids)) for w in t.lower().split()), np.int64) for t in texts]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
        self.ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.starts = self.ends - np.array([len(w) for w in words], dtype=np.int64)
        word = hashes[np.concatenate([*words, np.zeros(0, np.int64)])] if len(ids) else np.zeros(0, np.uint64)
        self.order, self.size = order, len(word)
        # position of each token in its document, so that n-grams stay within documents
        self.place = np.arange(self.size) - np.repeat(self.starts, self.ends - self.starts)
        gram, self.found = word, []
        for n in range(1, order + 1):
            if n > 1:  # the n-gram that ends at each token, from the one before it and the token
                gram = np.concatenate([np.zeros(1, np.uint64), gram[:-1]]) if self.size else gram
                gram = _mixed(gram * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n))
            self.found.append(gram[self.place >= n - 1])

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams in order, and how often each occurs."""
        grams = np.concatenate(self.found)
        grams.sort()
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]]))
        return grams[first], np.diff(first, append=len(grams))

    def where(self) -> list[np.ndarray]:
        """For each order, the number of the n-gram that ends at each token, or -1."""
        inverse = np.unique(np.concatenate(self.found), return_inverse=True)[1].astype(np.int32)
        edge, out = 0, []
        for n, grams in enumerate(self.found, 1):
            at = np.full(self.size, -1, np.int32)
            at[self.place >= n - 1] = inverse[edge:edge + len(grams)]
            edge += len(grams)
            out.append(at)
        return out

    def scores(self, totals: np.ndarray, tokens: int, backoff: float) -> list[tuple[int, float]]:
        """Number of words and sum of log scores of each document, without its own counts."""
        out, where = [], self.where()
        for a, b in zip(self.starts, self.ends, strict=True):
            others, there = [], []
            for at in where:
                own = at[a:b]
                inside = own[own >= 0]
                _, inverse, times = np.unique(inside, return_inverse=True, return_counts=True)
                rest = np.zeros(b - a, np.int64)
                rest[own >= 0] = totals[inside] - times[inverse]
                others.append(rest)
                there.append(own >= 0)
            log = np.log(np.maximum(others[0], 0.5) / max(1, tokens - (b - a)))
            for n in range(2, self.order + 1):
                seen, shorter = others[n - 1] > 0, log + np.where(there[n - 1], np.log(backoff), 0)
                # the count of the context: the n-gram before the last word
                context = np.concatenate([[0], others[n - 2][:-1]])
                log = np.where(seen, np.log(np.maximum(others[n - 1], 1) / np.maximum(context, 1)), shorter)
            out.append((int(b - a), float(log.sum())))
        return out


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _parts(grams: np.ndarray, number: int) -> np.ndarray:
    """Where the n-grams of each part begin and end; parts are ranges of hashes."""
    edges = (np.arange(1, number, dtype=np.float64) * (2.0**64 / number)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def _tight(octets: np.ndarray) -> bytes:
    """Compressed octets behind their number and their compressed size."""
    body = pa.Codec("zstd").compress(octets.tobytes(), asbytes=True) if len(octets) else b""
    return len(octets).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body


def _from_tight(octets: bytes) -> tuple[np.ndarray, bytes]:
    """The octets, and the bytes behind them."""
    n, end = int.from_bytes(octets[:8], "little"), 16 + int.from_bytes(octets[8:16], "little")
    body = pa.Codec("zstd").decompress(octets[16:end], n, asbytes=True) if n else b""
    return np.frombuffer(body, np.uint8), octets[end:]


def _six(values: np.ndarray) -> bytes:
    """Sorted hashes as gaps of six bytes each after the first, the sixth ones compressed; wider gaps are spelled out."""
    gaps = np.diff(values, prepend=np.uint64(0))
    wide = np.flatnonzero(gaps >> np.uint64(48))
    octets = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    spelled = len(wide).to_bytes(8, "little") + wide.astype("<u8").tobytes() + (gaps[wide] >> np.uint64(48)).astype("<u8").tobytes()
    return _tight(octets[:, 5]) + spelled + octets[:, :5].tobytes()


def _from_six(octets: bytes) -> np.ndarray:
    sixth, octets = _from_tight(octets)
    n = int.from_bytes(octets[:8], "little")
    wide, high = np.frombuffer(octets, "<u8", 2 * n, 8).reshape(2, n)
    low = np.frombuffer(octets, np.uint8, -1, 8 + 16 * n).reshape(-1, 5)
    gaps = np.column_stack([low, sixth, np.zeros((len(low), 2), np.uint8)]).copy().view("<u8").ravel()
    gaps[wide.astype(np.int64)] |= high << np.uint64(48)
    return np.cumsum(gaps, dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in a byte each, compressed; those from 255 on are spelled out behind."""
    large = counts[counts >= 255].astype("<i8")
    return _tight(np.minimum(counts, 255).astype(np.uint8)) + large.tobytes()


def _from_small(octets: bytes) -> np.ndarray:
    low, large = _from_tight(octets)
    counts = low.astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, "<i8")
    return counts


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (block, doc_id, text), those of a block and batch in one compressed table."""
    compressed = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy(), kind="stable")
        rows = batch.take(pa.array(order))
        numbers, starts = np.unique(rows.column(0).to_numpy(), return_index=True)
        packed = []
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            sink = pa.BufferOutputStream()
            some = pa.Table.from_batches([rows.slice(start, end - start)]).select([1, 2]).combine_chunks()
            with pa.ipc.new_stream(sink, some.schema, options=compressed) as out:
                out.write_table(some)
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], names=["block", "docs"])


def _unpacked(docs: pa.ChunkedArray) -> pa.Table:
    """``doc_id, text`` of the compressed tables."""
    return pa.concat_tables([pa.ipc.open_stream(each.as_buffer()).read_all() for each in docs])


def score(documents: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` for each row of ``documents``.

    Words are runs of other than ASCII white space, with A-Z in lower case.  Counts are
    over all rows but the scored one.  S(w | context) is the share of the context's
    occurrences that w follows; where it is zero, ``backoff`` times the score with a
    shorter context; a word that no other row has counts as half an occurrence.  A
    null or empty text has no words, log_score 0 and a null mean.  Repeated rows count
    as documents each.  Other columns are not read.
    """
    size, rows = documents.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)), F.count("*")).first()
    blocks = max(1, round(size / block_bytes))
    parts = blocks * PARTS_PER_BLOCK
    texts = documents.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    ).mapInArrow(_packed, "block long, docs binary")

    def ask(table: pa.Table) -> pa.Table:
        block = Block(whole_bytes(_unpacked(table.column("docs")).column("text")), order)
        grams, times = block.counted()
        edges = _parts(grams, parts)
        full = [k for k in range(parts) if edges[k] < edges[k + 1]]
        numbers = table.column("block")[0].as_py()
        return pa.table({
            "part": pa.array([*full, -1], pa.int64()), "block": pa.array([numbers] * (len(full) + 1), pa.int64()),
            "grams": pa.array([*(_six(grams[edges[k]:edges[k + 1]]) for k in full), b""], pa.binary()),
            # part -1 carries the number of tokens
            "counts": pa.array([*(_small(times[edges[k]:edges[k + 1]]) for k in full), _small(np.array([block.size]))], pa.binary()),
        })

    def tell(table: pa.Table) -> pa.Table:
        number = table.column("part")[0].as_py()
        blocks_, counts = table.column("block").to_pylist(), [_from_small(c) for c in table.column("counts").to_pylist()]
        if number < 0:
            asked = [np.zeros(1, np.uint64) for _ in counts]
        else:
            asked = [_from_six(g) for g in table.column("grams").to_pylist()]
        grams, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.zeros(len(grams), np.int64)
        np.add.at(totals, inverse, np.concatenate(counts))
        ends = np.cumsum([len(a) for a in asked])
        answers = [_small(totals[inverse[e - len(a):e]]) for a, e in zip(asked, ends, strict=True)]
        return pa.table({"block": pa.array(blocks_, pa.int64()), "part": pa.array([number] * len(blocks_), pa.int64()), "totals": pa.array(answers, pa.binary())})

    def add_up(table: pa.Table, told: pa.Table) -> pa.Table:
        table = _unpacked(table.column("docs"))
        block = Block(whole_bytes(table.column("text")), order)
        told = told.sort_by("part")
        answers = [_from_small(t) for t in told.column("totals").to_pylist()]
        tokens, totals = int(answers[0][0]), np.concatenate([*answers[1:], np.zeros(0, np.int64)])
        del answers
        found = block.scores(totals, tokens, backoff)
        words = np.array([n for n, _ in found])
        sums = np.round([s for _, s in found], 6)
        means = [round(s / n, 6) if n else None for s, n in zip(sums.tolist(), words.tolist(), strict=True)]
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(words, pa.int64()), "log_score": pa.array(sums, pa.float64()),
            "mean_log_score": pa.array(means, pa.float64()),
        })

    # one plan, so that both readers of the blocks use one shuffle of them
    told = texts.groupBy("block").applyInArrow(ask, _ASKED).groupBy("part").applyInArrow(tell, _TOLD)
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        add_up, "doc_id long, n_words long, log_score double, mean_log_score double"
    )


def op4_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all ``documents`` against all others."""
    return score(spark.read.parquet(f"{folder}/documents.parquet"))
