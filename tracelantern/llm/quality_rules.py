"""Quality rules: counts within a document, and lines that many documents of a host share.

The text is read once.  Each document gives its counts and, for each distinct
normalised line, a hash and the number of words that the line holds in it.  Lines are
counted by host with partial aggregation; a line in too many documents of its host is
boilerplate and is removed everywhere but in the first of them, and a document of
which little remains is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept
from tracelantern.llm.shared import hot_join, slices, whole_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
# A line is boilerplate above this many distinct documents of its host, however large the host is.
LINE_DOCUMENTS = 20
# A document is depleted when less than this share of its words, or fewer than MIN_WORDS, remain.
LEAST_LEFT = 0.3

_COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "lines array<struct<line:long,words:long>>"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more, the first included."""
    places = {word: k for k, word in enumerate(dict.fromkeys(words))}
    if len(words) <= width or len(places) == len(words):
        return 0
    ids = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    windows = len(words) - width + 1
    code, distinct = ids[:windows], len(places)
    for k in range(1, width):
        if distinct * len(places) >= 1 << 62:  # number the codes anew before they overflow
            code = np.unique(code, return_inverse=True)[1]
            distinct = int(code.max()) + 1
        code = code * len(places) + ids[k:k + windows]
        distinct *= len(places)
    _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(times[inverse] > 1)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def document_counts(text: bytes) -> tuple[list[int], dict[int, int]]:
    """Counts of one text, and the words held by each distinct normalised line."""
    words = text.split()
    seen: set[bytes] = set()
    again, lines = 0, {}
    for line in text.split(b"\n"):
        parts = line.lower().split()
        if parts:
            again += line in seen
            seen.add(line)
            key = xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63)
            lines[key] = lines.get(key, 0) + len(parts)
    counts = [
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        again,
        repeated_words(words),
    ]
    return counts, lines


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
    for batch in slices(batches):
        found = [document_counts(text) for text in whole_bytes(batch.column(2))]
        columns = [pa.array([counts[k] for counts, _ in found], pa.int64()) for k in range(5)]
        lines = pa.array([[{"line": k, "words": v} for k, v in each.items()] for _, each in found], kind)
        names = [part.split()[0] for part in _COUNTS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, lines], names=[*names, "lines"])


def apply_rules(
    documents: DataFrame,
    host: str = "source",
    line_documents: int = LINE_DOCUMENTS,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """Counts and verdict for each row of ``documents``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_words_left``.  A null text has no words and fails.  A null
    host is a host of its own.  A line is removed when it is in more than
    ``line_documents`` distinct documents of its host; in the document with the smallest
    doc_id (and in rows without one) it stays.  Rows with the same doc_id are one
    document, and so are rows without.
    """
    columns = [F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string")]
    counted = documents.select(*columns).mapInArrow(_counted, f"{_COUNTS}, {_LINES}")
    rows = kept(counted.withColumn("row", F.monotonically_increasing_id()))
    line_rows = rows.select("row", "doc_id", "host", F.explode("lines").alias("l")).select(
        "row", "doc_id", F.xxhash64(F.col("host").isNull(), "host", "l.line").alias("line"), F.col("l.words").alias("words")
    )
    # rows are counted first, in place, so only lines of many rows are told apart by document
    rough = line_rows.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    rough = kept(rough.where(F.col("n") > line_documents))
    total = rough.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # structs are counted even where they hold a null
    distinct = hot_join(line_rows, rough, "line", "n", total).groupBy("line").agg(F.count_distinct(F.struct("doc_id")).alias("documents"))
    often = kept(rough.join(distinct.where(F.col("documents") > line_documents), "line").select("line", "n", "first_id"))
    lost = hot_join(line_rows, often, "line", "n", total).where("doc_id <> first_id")
    lost = lost.groupBy("row").agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.drop("lines").join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= F.greatest(F.lit(float(MIN_WORDS)), least_left * F.col("n_words")))).alias("kept"),
        left.alias("n_words_left"),
    )


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdicts for all ``documents``; the host is their source."""
    return apply_rules(spark.read.parquet(f"{folder}/documents.parquet"))


OP7_SQL = rf"""
WITH docs AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
tokens AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM docs
),
word_at AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM tokens
),
windows AS (
  SELECT doc_id, i, CASE WHEN i + 4 <= len(words) THEN array_to_string(words[i:i + 4], ' ') END AS five FROM word_at
),
again AS (
  SELECT doc_id, i, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS twice FROM windows
),
covered AS (
  SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside
  FROM again
),
repeats AS (SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM docs),
worded AS (
  SELECT *, regexp_extract_all(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS parts
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
normal AS (
  SELECT doc_id, host, array_to_string(parts, ' ') AS line, sum(len(parts)) AS words FROM worded GROUP BY ALL
),
often AS (
  SELECT host, line, min(doc_id) AS first_id FROM normal GROUP BY host, line HAVING count(DISTINCT doc_id) > {LINE_DOCUMENTS}
),
lost AS (
  SELECT doc_id, sum(words) AS lost FROM normal JOIN often ON normal.line = often.line AND normal.host IS NOT DISTINCT FROM often.host
  WHERE doc_id <> first_id GROUP BY doc_id
),
counts AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(words) - coalesce(lost, 0) AS BIGINT) AS n_words_left
  FROM tokens LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words)
         AND n_words_left >= greatest({MIN_WORDS}, {LEAST_LEFT} * n_words) AS kept,
       n_words_left
FROM counts
"""
