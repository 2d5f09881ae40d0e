"""Operators on workers that cannot import this package."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

from tracelantern.llm import pii, shared, tokens

ROOT = str(Path(__file__).resolve().parent.parent.parent)

CODE = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
os.environ.pop("PYTHONPATH", None)
import tempfile
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-")).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
from pyspark.sql import functions as F

@F.udf("boolean")
def blind(_):
    import importlib.util
    return importlib.util.find_spec("tracelantern") is None

assert spark.range(1).select(blind("id")).first()[0]
docs = spark.createDataFrame([(1, "a b c. a b c", "en", "s"), (2, "é ö 12 Straße", "de", None), (3, None, None, "s")], "doc_id long, text string, lang string, source string")
talks = spark.createDataFrame([(0, 0, "u", "a"), (1, 0, "u", "a")], "conv_id long, turn long, role string, text string")
import public_tokenizers
from tracelantern.llm import bpe, collocations, mixing, packing, prefix_trie
print(bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json")).count())
print(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count())
print(collocations.collocations(docs, least=2).count())
print(mixing.Mix(docs).plan().count())
print(prefix_trie.PrefixTrie(prefix_trie.plain_paths(prefix_trie.turn_digests(talks))).nodes().count())
"""


def test_blind_workers(tmp_path):
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert ran.stdout.split() == ["3", "3", "1", "3", "2"]


def test_pii_hands_over_little_at_once(spark, monkeypatch):
    def small(batches):
        for batch in batches:
            assert batch.nbytes < 8 << 20
            yield batch

    monkeypatch.setattr(pii, "slices", small)
    documents = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    kept = pii.redact(documents, pii.fit_judge(documents))
    assert kept.agg(F.count("*"), F.sum(F.length("text"))).first() == (6000, 6000 * 5000)


def test_a_worker_lets_go():
    first = shared.in_worker(("made",), object)
    assert shared.in_worker(("made",), object) is first
    shared.free_worker()
    assert shared.in_worker(("made",), object) is not first
    shared.free_worker()


def test_the_tokenizer_gets_few_pieces_at_once():
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"w{k:x}q" for k in range(10_000))
    whole, most = encoder.tokenizer, []

    class Watched:
        def encode_batch(self, pieces, **options):
            most.append(len(pieces))
            return whole.encode_batch(pieces, **options)

    encoder.tokenizer = Watched()
    assert encoder(text) == tokens._packed(whole.encode(text, add_special_tokens=False).ids)
    assert max(most) <= 5000
