"""Exact de-duplication against a digest index that persists between batches.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the normalised
text.  A new batch is first reduced to one row per digest (partial aggregation,
so a text with a third of all copies is one row per task before the shuffle),
then anti-joined with the index by merging the sorted buckets, and what is new is
appended.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept, new_path
from tracelantern.llm.shared import hot_join


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


class DigestIndex:
    """Digests of all texts seen so far: ``digest BINARY, keep_id LONG, batch STRING``.

    ``path`` lies in storage that all executors share.  A new index has as many buckets as
    shuffles have partitions, so that a task writes one bucket; the count is stored beside
    the index, and one written earlier is opened with it.  Another count is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        stored = _stored_buckets(spark, path)
        if stored and buckets and stored != buckets:
            raise ValueError(f"the index at {path} has {stored} buckets, not {buckets}")
        buckets = stored or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not stored:
            spark.range(1, numPartitions=1).select(F.lit(buckets).alias("buckets")).write.parquet(_beside(path))
        self.spark, self.buckets = spark, buckets
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}-buckets"


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count of the index at ``path``; none if it is new."""
    configuration = spark._jsc.hadoopConfiguration()

    def exists(name: str) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        return place.getFileSystem(configuration).exists(place)

    if exists(_beside(path)):
        return spark.read.parquet(_beside(path)).first()[0]
    if exists(path):
        raise ValueError(f"the index at {path} has no bucket count beside it")
    return None


def deduplicate(documents: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts in the batch the row with the largest doc_id stays; of several
    rows with that doc_id one stays.  A text of an earlier batch has no row that
    stays, and its keep_id is the one in the index.  A null doc_id is smaller than
    any other.  ``batch`` names the batch; running the same batch again changes
    nothing.  Columns other than doc_id and text are not read.
    """
    rows = kept(documents.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")))
    groups = kept(rows.groupBy("digest").agg(F.max("doc_id").alias("largest"), F.count("*").alias("group_size")))
    fresh = groups.join(index.entries().hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("largest").alias("keep_id"), F.lit(batch).alias("batch")))
    known = groups.join(index.entries().hint("merge"), "digest").select(
        "digest", "keep_id", "group_size", (F.col("batch") == batch).alias("fresh")
    )
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    decided = hot_join(rows, kept(known), "digest", "group_size", total).withColumn(
        "top", F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )
    names = ["doc_id", "keep_id", "group_size", "digest"]
    # repeated rows of the id that stays: the first of them stays
    top = decided.where("top").groupBy(*names).agg(F.count("*").cast("int").alias("times"))
    top = top.select(*names, F.explode(F.sequence(F.lit(1), "times")).alias("nth"))
    return (
        decided.where("NOT top").select(*names, F.lit(False).alias("kept"))
        .unionByName(top.select(*names, (F.col("nth") == 1).alias("kept")))
        .select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    )


def distinct_documents(documents: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns."""
    wanted = deduplicate(documents, index, batch).where("kept").select(
        F.xxhash64("doc_id", "text_sha256").alias("key"), "doc_id", "text_sha256"
    )
    sha = F.sha2(normalised(F.col("text")), 256)
    # the columns travel as one, so that none of their names can clash
    rows = documents.select(
        F.xxhash64(F.col("doc_id"), sha).alias("own_key"), F.col("doc_id").alias("own_id"), sha.alias("own_sha"), F.struct("*").alias("whole")
    )
    found = rows.join(
        wanted, (F.col("own_key") == F.col("key")) & (F.col("own_sha") == F.col("text_sha256")) & F.col("own_id").eqNullSafe(F.col("doc_id"))
    )
    # of repeated rows of the id that stays, the first stays
    first = F.row_number().over(Window.partitionBy("own_key", "own_sha").orderBy("own_sha"))
    return found.withColumn("nth", first).where("nth = 1").select("whole.*")


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, new_path(spark))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions for all ``documents`` as the first batch of a new index."""
    return deduplicate(spark.read.parquet(f"{folder}/documents.parquet"), fresh_index(spark), "first")


OP6_SQL = """
WITH digests AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AND row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept,
       text_sha256
FROM digests
WINDOW w AS (PARTITION BY text_sha256)
"""
