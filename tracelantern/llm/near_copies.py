"""Near-copies by the exact similarity of their word shingles.

A document is the set of its shingles of five words, and two documents are near-copies
when the sets share at least 0.8 of their union.  Candidates come from the SimHash of the
set, by the Gray-order index of ``simhash``: those whose fingerprints are equal or linked.
A pair at 0.8 differs in about ten of 64 bits, too many for blocks of bits, so for less
alike pairs there are min-hashes besides: 30 bands of six, in which a pair at 0.8 meets
with probability 0.9998 and a pair at 0.9 practically always.  Each candidate is decided
by its sets, never by an estimate.

Members of a band are first compared with the smallest of them, then, where several
components are left, with the one that meets most others: as many comparisons as a
group has members.  What bands still hold in several components is settled by an exact
filter.  With shingles in one order, rare ones first, two sets that share enough share
one among the first few of each, about a ninth for sets of equal size.  So members meet
again by these few shingles, which alike pairs of one passage with words of their own
do not share, and only where such a group holds several components, those outside its
largest are compared.  No pair that meets in a band and is alike is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelantern.functions.membership import maybe_in
from tracelantern.functions.stages import arrow_bytes, kept
from tracelantern.llm.components import components
from tracelantern.llm.shared import free_worker, hot_join, slices, whole_bytes
from tracelantern.llm.simhash import links as fingerprint_links
from tracelantern.llm.simhash import majority

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AT_ONCE = 4096
# What a worker gets at once; an executor holds a batch in its JVM and in Python for each core.
_BATCH_BYTES = 4 << 20
# Sizes of one class differ by 4 % at most; a set looks for smaller ones class by class.
_CLASS = math.log(1.04)
_SHINGLED = "doc_id long, node long, size int, fp long, keys array<long>, grams binary"


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def shingles(text: bytes, words_in_shingle: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles in order; a shorter text is one shingle."""
    words = text.lower().split()
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))[at]
    width = max(1, min(words_in_shingle, len(words)))
    gram = np.full(max(1, len(words) - width + 1), width if words else 0, np.uint64)
    for k in range(width if words else 0):
        gram = _mixed(gram * np.uint64(0x9E3779B97F4A7C15) + word[k:k + len(gram)])
    return np.unique(gram)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One hash per band of the smallest values of the set under its six permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), _AT_ONCE):
        least = np.minimum(least, (_FACTORS[:, None] * grams[None, start:start + _AT_ONCE]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _shingled(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in slices(batches):
            sets = [shingles(text, words_in_shingle) for text in whole_bytes(batch.column(1))]
            keys = [band_keys(grams) for grams in sets]
            # 32 bits of each hash are enough to compare two sets that met by their whole hashes
            short = [np.unique((grams >> np.uint64(32)).astype("<u4")) for grams in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) for grams in sets], pa.int64()),
                pa.array(map(len, short), pa.int32()),
                pa.array(np.array([majority(grams) for grams in sets], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS), pa.int32()), pa.array(np.concatenate(keys))),
                pa.array([s.tobytes() for s in short], pa.binary()),
            ], names=["doc_id", "node", "size", "fp", "keys", "grams"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (one, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of ``node, size, root, grams``."""
    for batch in slices(batches):
        sets = [np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(3)]
        of = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        token = pa.array(np.concatenate([*sets, np.zeros(0, "<u4")]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(3)), token], names=["node", "size", "root", "token"])


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the set of one side; a node in very many pairs is joined in place."""
    times = pairs.groupBy(side).agg(F.count("*").alias("times"))
    groups = kept(times.join(sets, times[side] == sets["node"]).select(side, "times", F.col("grams").alias(f"{side}_grams")))
    total = groups.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    return hot_join(pairs, groups, side, "times", total).drop("times")


def _sets(named: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct nodes ``named`` with their ``grams``; other sets are not moved."""
    asked = kept(named.join(nodes.select("node", "row"), "node"))
    return kept(maybe_in(rows.select("row", "grams"), asked, "row").join(asked, "row").drop("row"))


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b, a_size, b_size)`` whose sets are alike: ``a, b``.

    Only the sets of nodes that are in a pair are moved.
    """
    close = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size")
    pairs = kept(pairs.where(close).select("a", "b").distinct())
    if pairs.isEmpty():
        return pairs
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(named, rows, nodes)
    first = kept(_with_sets(pairs, sets, "a"))
    both = _with_sets(first, sets, "b")
    return kept(both.select("a", "b", "a_grams", "b_grams").mapInArrow(_alike(similarity), "a long, b long"))


def near_copies(documents: DataFrame, words_in_shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` for each row of ``documents``.

    Words are cut and lower-cased as in ``simhash``.  Documents link when their sets of
    shingles share at least ``similarity`` of their union; a text without words or null
    is one shingle of its own kind.  component_id is the smallest doc_id reached; null
    ids count as absent.  Columns other than doc_id and text are not read.
    """
    # every step in Python is kept before the end of this
    with arrow_bytes(documents.sparkSession, _BATCH_BYTES):
        return _components_of(documents, words_in_shingle, similarity)


def _components_of(documents: DataFrame, words_in_shingle: int, similarity: float) -> DataFrame:
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = kept(texts.mapInArrow(_shingled(words_in_shingle), _SHINGLED).withColumn("row", F.monotonically_increasing_id()))
    nodes = kept(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("n"),
        F.min("size").alias("size"), F.min("fp").alias("fp")))
    banded = rows.select("node", "size", F.explode("keys").alias("key"))
    groups = banded.groupBy("key").agg(
        F.min(F.struct("node", "size")).alias("first"), F.max("node").alias("last"), F.count("*").alias("m")
    )
    groups = kept(groups.where("first.node <> last").select("key", "first", "m"))
    total = groups.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    members = kept(hot_join(banded, groups, "key", "m", total))
    stars = members.where("node <> first.node").select(
        F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.size").alias("a_size"), F.col("size").alias("b_size")
    )
    links = _verified(stars.unionByName(_by_fingerprint(nodes)), rows, nodes, similarity)
    links = links.unionByName(_verified(_by_centre(_open(members, nodes, links)), rows, nodes, similarity))
    open_ = _open(members, nodes, links).select("node", "size", "root").distinct()
    links = links.unionByName(_verified(_by_prefix(_sets(open_, rows, nodes), similarity), rows, nodes, similarity))
    of_node = nodes.join(kept(components(links)).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        "node", "least", "n", F.coalesce("root", "node").alias("root")
    )
    of_node = kept(of_node)
    least = kept(of_node.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    whole = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labelled = kept(hot_join(of_node, least, "root", "m", whole).select("node", "n", "component_id"))
    return hot_join(rows.select("doc_id", "node"), labelled, "node", "n", whole).select("doc_id", "component_id")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs whose fingerprints are equal or linked: each with the smallest node of its own or of the linked fingerprint."""
    groups = kept(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first"), F.count("*").alias("m")))
    total = groups.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    equal = hot_join(nodes.select("fp", "node", "size"), groups, "fp", "m", total).where("node <> first.node")
    first = groups.select("fp", "first")
    linked = kept(fingerprint_links(groups.select("fp")))
    linked = linked.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    pairs = equal.select(F.col("first").alias("x"), F.struct("node", "size").alias("y")).unionByName(linked.select("x", "y"))
    return _ordered(pairs)


def _ordered(pairs: DataFrame) -> DataFrame:
    """``a, b, a_size, b_size`` of pairs of ``x(node, size)`` and ``y(node, size)``."""
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return pairs.select(low.node.alias("a"), high.node.alias("b"), low.size.alias("a_size"), high.size.alias("b_size"))


def _open(members: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Members of bands that hold several components of ``links``; weight is how many others a node meets."""
    root = kept(components(links)).select(F.col("node").alias("of"), "root")
    roots = kept(nodes.join(root, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("root")))
    times = members.groupBy("node").agg(F.count("*").alias("times"), F.sum("m").alias("weight"))
    of_node = kept(times.join(roots, "node"))
    return _mixed_groups(kept(hot_join(members.select("key", "node", "size"), of_node, "node", "times", members.count()).drop("times")))


def _mixed_groups(rows: DataFrame) -> DataFrame:
    """The ``rows(key, root, ...)`` of groups with several roots, with the most frequent root ``top`` and the number of rows ``m``."""
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("p"))
    largest = parts.groupBy("key").agg(F.max(F.struct("p", "root")).alias("top"), F.count("*").alias("roots"), F.sum("p").alias("m"))
    mixed = kept(largest.where("roots > 1").select("key", F.col("top.root").alias("top"), "m"))
    return kept(hot_join(rows, mixed, "key", "m", rows.count()))


def _by_centre(members: DataFrame) -> DataFrame:
    """Pairs of each member and the one of its band that meets most others."""
    centres = kept(members.groupBy("key").agg(F.max(F.struct("weight", "node", "size", "root")).alias("c"), F.max("m").alias("m")))
    met = hot_join(members.select("key", "node", "size", "root"), centres, "key", "m", members.count()).where("root <> c.root")
    return _ordered(met.select(F.struct("node", "size").alias("x"), F.struct("c.node", "c.size").alias("y")))


def _by_prefix(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``sets(node, size, root, grams)`` of two roots that may be alike: sets of sizes n
    and m must share ``least(n, m)`` shingles, so the first they share, rare ones first, has
    that many behind it in both."""
    share = similarity / (1 + similarity)

    def least(both: Column) -> Column:
        return F.ceil(both * share - 1e-6)

    def class_of(size: Column) -> Column:
        return F.floor(F.log(F.greatest(size, F.lit(1.0))) / _CLASS)

    tokens = kept(sets.select("node", "size", "root", "grams").mapInArrow(_spelled, "node long, size int, root long, token long"))
    often = kept(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
    shared = kept(hot_join(tokens, often, "token", "often", tokens.count()))
    own = Window.partitionBy("node")
    # shingles of no other set come first
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "token")) - 1
    behind = F.col("size") - F.col("at")
    placed = kept(shared.withColumn("at", at).select("node", "size", "root", "token", behind.alias("behind")).where(F.col("behind") >= similarity * F.col("size") - 1e-6))
    small = placed.where(F.col("behind") >= least(2 * F.col("size"))).select("*", F.lit(True).alias("small"), class_of(F.col("size")).alias("class"))
    low = similarity * F.col("size") - 1e-6
    large = placed.select("*", F.lit(False).alias("small"), F.explode(F.sequence(class_of(low), class_of(F.col("size")))).alias("class"))
    large = large.where(F.col("behind") >= least(F.col("size") + F.greatest(low, F.exp(F.col("class") * _CLASS))))
    rows = kept(small.unionByName(large).select(F.xxhash64("token", "class").alias("key"), "node", "size", "root", "behind", "small"))
    mixed = _mixed_groups(rows)
    # a set that looks for smaller ones meets only those, so the key of the one side names the role of the other
    strays = mixed.where("root <> top").groupBy(F.xxhash64("key", ~F.col("small")).alias("key")).agg(
        F.collect_set(F.struct("node", "size", "root", "behind")).alias("strays"), F.max("m").alias("m")
    )
    roles = mixed.select(F.xxhash64("key", "small").alias("key"), "node", "size", "root", "behind")
    met = hot_join(roles, kept(strays), "key", "m", mixed.count())
    met = met.select("node", "size", "root", "behind", F.explode("strays").alias("s")).where("s.root <> root")
    needed = least(F.col("size") + F.col("s.size"))
    met = met.where((F.col("behind") >= needed) & (F.col("s.behind") >= needed))
    return _ordered(met.select(F.struct("node", "size").alias("x"), F.struct("s.node", "s.size").alias("y")))


def one_of_each(documents: DataFrame, words_in_shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` without near-copies: of each component the row with the smallest
    doc_id stays, with all its columns.  Rows without doc_id stay."""
    found = near_copies(documents.where("doc_id IS NOT NULL"), words_in_shingle, similarity)
    ids = found.where("doc_id = component_id").select(F.col("doc_id").alias("stays")).distinct()
    # the columns travel as one, so that none of their names can clash
    rows = documents.select(F.col("doc_id").alias("own_id"), F.struct("*").alias("whole"))
    return rows.join(ids, F.col("own_id") == F.col("stays"), "left").where("stays IS NOT NULL OR own_id IS NULL").select("whole.*")
