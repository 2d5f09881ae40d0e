"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt into shards of neighbouring ids.  A shard indexes each
(position, turn) by a bitset of its conversations; depth-first, the bitset of a node and
the postings of the next position give its children, their popcounts and the list of
conversations that end there.  Shards give one row per node of theirs, so a prefix that
very many conversations share is small before anything is shuffled; rows of the same node
are then added up.  Texts are read once and stay where they are: a turn travels as a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions.stages import drop, kept, new_path
from tracelantern.llm.shared import hot_join

WORD = r"[^\x20\x09-\x0D]+"
# A shard closes after this many conversations or turns, at the end of a conversation.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 18
ROOT = bytes(16)

_NODES = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()),
    ("n", pa.int64()), ("first", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
])
_NODES_DDL = "key binary, parent binary, depth long, words long, n long, first long, members array<long>, ends array<long>"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, words``: the turns of each conversation in order, as digests.

    Rows without a conv_id are left out.  Turns go by ``turn``, null first; ties by role
    and then by digest.  Null role and text count as empty; repeated rows are turns each.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    # the length of the role keeps the two texts apart
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), role.alias("role"),
        F.unhex(F.md5(whole)).alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "turn")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn", "words")


def plain_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, turn, words, last`` of conversations as they are, with a turnless first row each."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    lasts = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", F.col("pos").alias("depth"), "turn", "words",
                        (F.col("pos") == F.max("pos").over(lasts)).alias("last"))
    return _with_roots(rows, sizes.withColumn("length", F.col("n")))


def _with_roots(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("turn"), zero.alias("words"),
                         (F.col("length") == 0).alias("last"))
    return rows.unionByName(roots)


def branched_paths(turns: DataFrame, total: int, group: int = 20, most: int = 4) -> DataFrame:
    """Paths in which each conversation starts with the first turns of its group's first one.

    The first h turns of conversation c give way to those of ``c - c % group``, or to as
    many as it has, with ``h = crc32(c) % most``.  ``turns`` should be a written table of
    ``total`` rows.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn", "words"))).alias("head")  # fewer than ``most``
    )
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({
        "base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most,
    })
    sizes = sizes.join(heads, "base", "left")
    head = F.when(F.col("h") > 0, F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)).cast("int")))
    sizes = sizes.withColumn("head", F.coalesce(head, F.slice("head", 1, 0), F.array().cast("array<struct<pos:long,turn:binary,words:long>>")))
    taken = F.size("head").cast("long")
    sizes = sizes.withColumn("length", taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("base")
    first = sizes.select("conv_id", "length", F.inline("head")).select(
        "conv_id", F.col("pos").alias("depth"), "turn", "words", (F.col("pos") == F.col("length")).alias("last")
    )
    slim = sizes.select("conv_id", "n", "h", "length", taken.alias("taken"))
    depth = F.col("taken") + F.col("pos") - F.col("h")
    rest = hot_join(turns, slim, "conv_id", "n", total).where("pos > h").select(
        "conv_id", depth.alias("depth"), "turn", "words", (depth == F.col("length")).alias("last")
    )
    return _with_roots(first.unionByName(rest), sizes)


class _Shard:
    """Bitmaps of some whole conversations."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.postings: dict[tuple[int, bytes], int] = {}
        self.words: dict[tuple[int, bytes], int] = {}
        self.ends: dict[int, int] = {}
        self.paths: list[list[bytes]] = []
        self.turns = 0

    def add(self, conv_id: int, depth: int, turn: bytes, words: int, last: bool) -> None:
        if not depth:
            self.ids.append(conv_id)
            self.paths.append([])
        bit = 1 << (len(self.ids) - 1)
        if depth:
            self.paths[-1].append(turn)
            posting = depth, turn
            self.postings[posting] = self.postings.get(posting, 0) | bit
            self.words[posting] = words
        if last:
            self.ends[depth] = self.ends.get(depth, 0) | bit
        self.turns += 1

    def listed(self, bits: int) -> list[int]:
        """The ids whose bits are set, ascending."""
        found = []
        while bits:
            low = bits & -bits
            found.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return found

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_NODES``, depth first."""
        if not self.ids:
            return
        stack = [(ROOT, None, 0, 0, (1 << len(self.ids)) - 1)]
        while stack:
            key, parent, depth, words, members = stack.pop()
            ended = members & self.ends.get(depth, 0)
            ids = self.listed(members)
            yield key, parent, depth, words, len(ids), ids[0], ids, self.listed(ended)
            rest, depth = members & ~ended, depth + 1
            while rest:
                # the first conversation not yet placed names the next child
                turn = self.paths[(rest & -rest).bit_length() - 1][depth - 1]
                child = rest & self.postings[depth, turn]
                rest ^= child
                stack.append((hashlib.md5(key + turn).digest(), key, depth, self.words[depth, turn], child))


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the shards in rows sorted by conversation and depth."""
    shard = _Shard()
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if not row[1] and (len(shard.ids) >= SHARD_CONVERSATIONS or shard.turns >= SHARD_TURNS):
                yield from _batches(shard.nodes())
                shard = _Shard()
            shard.add(*row)
    yield from _batches(shard.nodes())


def _batches(rows: Iterator[tuple], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Arrow batches of node rows, cut by the number of ids that they hold."""
    held, ids = [], 0
    for row in rows:
        held.append(row)
        ids += row[4] + 1
        if ids >= most:
            yield _batch(held)
            held, ids = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per key of its ids, from rows sorted by key and first id; one list is held at a time."""
    key, digest = None, None
    out = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = ",".join(map(str, ids)).encode()
            if at == key:
                digest.update(b"," + text)
                continue
            if key is not None:
                done.append((key, digest.hexdigest()))
            key, digest = at, hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([v for _, v in done], pa.string())], schema=out)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], schema=out)


class PrefixTrie:
    """The trie of ``paths(conv_id, depth, turn, words, last)``, a row per conversation and depth from 0.

    An empty table has no node.  A conversation's rows stay together, 50 bytes a turn in
    the task that has its shard.  ``close`` deletes the tables written.
    """

    def __init__(self, paths: DataFrame):
        self._spark = paths.sparkSession
        self._kept: list[str] = []
        columns = paths.select("conv_id", "depth", "turn", "words", "last")
        dealt = columns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "depth")
        self.shards = self.keep(dealt.mapInArrow(_shard_nodes, _NODES_DDL))

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(new_path(self._spark))
        return kept(df, path=self._kept[-1])

    def close(self) -> None:
        for path in self._kept:
            drop(self._spark, path)
        self._kept.clear()

    def nodes(self) -> DataFrame:
        """``key, parent, depth, conv_id, n_convs, parent_conv_id, n_children, n_leaves, saved_tokens``."""
        merged = self.shards.groupBy("key").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"),
            F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"),
        )
        merged = self.keep(merged)
        children = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
        tree = self.keep(merged.join(children, "key", "left").na.fill(0, ["n_children"]))
        parents = tree.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of_parent"))
        below = hot_join(tree.where(F.col("parent").isNotNull()), parents, "parent", "of_parent", tree.count()).drop("of_parent")
        roots = tree.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
        return below.unionByName(roots).join(self._subtrees(tree), "key")

    def _subtrees(self, tree: DataFrame) -> DataFrame:
        """``key, n_leaves, saved_tokens``: sums over subtrees without a walk.

        Each node's own values lie with its smallest member.  Every node above is a
        prefix of that conversation, so sums from each depth of a conversation to its
        end, added up over the members of a node, are the sums over its subtree.
        """
        own = tree.select(
            "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        )
        rows = self.shards.select("key", "depth", F.explode("members").alias("conv_id"))
        rows = rows.join(own, ["conv_id", "depth"], "left").na.fill(0, ["leaf", "saved"])
        tail = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        tails = rows.select("key", F.sum("leaf").over(tail).alias("leaf"), F.sum("saved").over(tail).alias("saved"))
        return tails.groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    def ends(self) -> DataFrame:
        """``key, ends``: conversations that end at a node, as lists per shard."""
        return self.shards.where(F.size("ends") > 0).select("key", "ends")

    def end_hashes(self) -> DataFrame:
        """``key, ends_sha256`` for nodes at which a conversation ends; lists follow each other by shard."""
        dealt = self.ends().repartition("key").sortWithinPartitions("key", F.col("ends")[0])
        return dealt.mapInArrow(_hashed_ends, "key binary, ends_sha256 string")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of all ``conversations``, branched in groups of 20."""
    path = new_path(spark)
    turns = kept(turn_digests(spark.read.parquet(f"{folder}/conversations.parquet")), path=path)
    trie = PrefixTrie(branched_paths(turns, turns.count()))
    drop(spark, path)
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return trie.nodes().join(trie.end_hashes(), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
