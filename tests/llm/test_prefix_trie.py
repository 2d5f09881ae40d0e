"""The prefix trie against a plain walk."""

from collections import Counter

import pytest

from tests.llm import plain_trie
from tracelantern.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, members string"


def _got(spark, rows, tmp_path):
    frame = spark.createDataFrame([(*r, "k", 1, None) for r in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("shard", [1, 7, 4096])
def test_odd_rows(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", shard)
    rows = []
    for c in [*range(0, 130), 205, 1_000_000_007]:
        if c == 60:
            continue  # a group without its first conversation
        for t in range(c * 7 % 6 + (c == 41) * 300):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"w{t} " * (t + 1) if c % 3 else f"hello {c % 4} {t}"))
    rows += [(3, None, None, None), (3, None, "a", ""), (5, 0, "user", "again"), (5, 0, "user", "again"), (7, 2, None, "x y z")]
    rows += [(None, 1, "user", "nobody"), (80, 0, "ab", "c"), (81, 0, "a", "bc"), (9, 1, "user", "long " * 50_000)]
    rows += [(c, 0, "user", "the same") for c in range(300, 420)]
    assert _got(spark, rows, tmp_path) == Counter(plain_trie.nodes(rows))


def test_real_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Counter(tuple(r) for r in prefix_trie.op13_prefix_trie(spark, folder).collect())
    assert got == Counter(plain_trie.nodes(rows))


def test_empty_table(spark, tmp_path):
    assert not _got(spark, [], tmp_path)


def test_plain_paths(spark):
    rows = [(1, 0, "u", "a b", None, None, None), (1, 1, "u", "c", None, None, None), (2, 0, "u", "a b", None, None, None)]
    trie = prefix_trie.PrefixTrie(prefix_trie.plain_paths(prefix_trie.turn_digests(spark.createDataFrame(rows, SCHEMA))))
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in trie.nodes().collect()}
    assert got == {(1, 0): (2, 1, 1, 2), (1, 1): (2, 1, 1, 2), (1, 2): (1, 0, 1, 0)}
    assert sorted(sum((r.ends for r in trie.ends().collect()), [])) == [1, 2]
    trie.close()
