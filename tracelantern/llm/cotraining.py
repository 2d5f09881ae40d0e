"""Document quality by co-training a text view and a metadata view.

One classifier sees the text's content (hashed byte trigrams), the other what is known
about the document: language, source, length and layout.  Both start from a bounded
sample of labelled documents.  In each round either view labels the unlabelled
documents it is surest of for the other one, from a bounded pool.  Held-out labels
calibrate both views and their sum, and set the score below which documents go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept
from tracelantern.llm.boosting import threshold_for
from tracelantern.llm.shared import free_worker, slices, whole_bytes

# Bounds of what the classifiers are fitted on: labelled rows of each label, unlabelled rows.
LABELLED = 2000
POOL = 4000
ROUNDS = 5
PER_ROUND = 100
# Of the held-out documents that the threshold rejects, this share is labelled bad.
PRECISION = 0.99

TEXT_WIDTH = 1024
_HASHED = 32
_COLUMNS = ("text", "lang", "source")


def text_view(text: bytes) -> np.ndarray:
    """Root shares of hashed byte trigrams; the case and the digits are folded, so no number stands out."""
    octets = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(octets) < 3:
        return np.zeros(TEXT_WIDTH, np.float32)
    digit = (octets >= 48) & (octets <= 57)
    octets[digit] = 48
    code = (octets[:-2] << 16 | octets[1:-1] << 8 | octets[2:]) * np.uint32(2654435761) >> 22
    return np.sqrt(np.bincount(code, minlength=TEXT_WIDTH) / len(code)).astype(np.float32)


def metadata_view(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed language and source, length, and the layout of the text."""
    words = text.split()
    lines = text.split(b"\n")
    n, size = max(1, len(words)), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    own = np.array([
        np.log1p(len(text)) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 5, len(text) / max(1, len(lines)) / 1000,
        len(set(words)) / n, np.log1p(max(map(len, words), default=0)) / 5, sum(map(len, words)) / n / 10,
        counts[65:91].sum() / size, counts[48:58].sum() / size, (counts[33:48].sum() + counts[58:65].sum()) / size,
        (counts[91:97].sum() + counts[123:127].sum()) / size, counts[128:].sum() / size, counts[32] / size,
        1 - len(set(lines)) / max(1, len(lines)),
    ], np.float32)
    hashed = np.zeros(2 * _HASHED, np.float32)
    for k, value in enumerate((lang, source)):
        hashed[k * _HASHED + xxhash.xxh32_intdigest((value or "").encode()) % _HASHED] = 0.3
    return np.concatenate([own, own * own, np.sqrt(np.abs(own)), hashed])


class Linear:
    """Ridge logistic regression by Newton steps; classes weigh alike."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 8):
        x = np.column_stack([rows, np.ones(len(rows))]).astype(np.float64)
        share = np.where(labels > 0, (labels > 0).mean(), (labels <= 0).mean())
        weight = 0.5 / share
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (labels - chance)) - ridge * w
            curve = (x * (weight * chance * (1 - chance))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            w += np.linalg.solve(curve, gradient)
        self.weights, self.bias = w[:-1], float(w[-1])

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights + self.bias


@dataclass
class Quality:
    """Two fitted views, the calibration of each and of both, and the least score kept."""

    views: tuple[Linear, Linear]
    scales: tuple[tuple[float, float], tuple[float, float]]
    joint: tuple[float, float, float]
    least: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of the text view, the metadata view and both together."""
        each = [a * view(rows) + b for view, rows, (a, b) in zip(self.views, (text, meta), self.scales, strict=True)]
        return np.column_stack([*each, self.joint[0] * each[0] + self.joint[1] * each[1] + self.joint[2]])


def co_train(
    text: np.ndarray, meta: np.ndarray, labels: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray,
    rounds: int = ROUNDS, per_round: int = PER_ROUND, precision: float = PRECISION,
) -> Quality | None:
    """The classifier, or None where the labels name only one class or too few rows."""
    held = np.arange(len(labels)) % 4 == 3
    if min((labels[~held] > 0).sum(), (labels[~held] <= 0).sum(), (labels[held] > 0).sum(), (labels[held] <= 0).sum()) < 5:
        return None
    known, pool = (text, meta), (pool_text, pool_meta)
    taught = [[], []]  # of each view: (pool row, label)
    free = np.ones(len(pool_text), bool)

    def fitted(k: int) -> Linear:
        at = [i for i, _ in taught[k]]
        rows = np.concatenate([known[k][~held], pool[k][at]])
        return Linear(rows, np.concatenate([labels[~held], [y for _, y in taught[k]]]))

    views = [fitted(0), fitted(1)]
    good = (labels[~held] > 0).mean()
    for _ in range(rounds):
        for k in (0, 1):
            scores = np.where(free, views[k](pool[k]), np.nan)
            order = np.argsort(scores)[:free.sum()]
            bad_n, good_n = max(1, int(per_round * (1 - good))), max(1, int(per_round * good))
            sure = [(i, 0.0) for i in order[:bad_n] if scores[i] < -2] + [(i, 1.0) for i in order[::-1][:good_n] if scores[i] > 2]
            taught[1 - k] += sure
            free[[i for i, _ in sure]] = False
        views = [fitted(0), fitted(1)]
    scales, each = [], []
    for k in (0, 1):
        raw = views[k](known[k][held])
        line = Linear(raw[:, None], labels[held], ridge=0.1)
        scales.append((float(line.weights[0]), line.bias))
        each.append(scales[k][0] * raw + scales[k][1])
    both = Linear(np.column_stack(each), labels[held], ridge=0.1)
    quality = Quality(tuple(views), tuple(scales), (*map(float, both.weights), both.bias), -np.inf)
    joint = quality.scores(text[held], meta[held])[:, 2]
    quality.least = min(0.0, -threshold_for(-joint, 1 - labels[held], precision))
    return quality


def fit_quality(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Quality | None:
    """Fits on about ``labelled`` documents of each label and ``pool`` others at most.

    Every doc_id draws a number by its hash, and those below the share that the sample is
    of all documents of its kind are fitted on.  Labels other than 0 and 1 and null ids
    are not used; of several labels of a document the smallest counts.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("mark"))
    ids = documents.where("doc_id IS NOT NULL").select("doc_id").distinct()
    marked = kept(ids.join(marks, "doc_id", "left").select("doc_id", F.coalesce("mark", F.lit(-1)).cast("int").alias("mark")))
    counts = {r["mark"]: r["count"] for r in marked.groupBy("mark").count().collect()}
    share = F.lit(pool / max(1, counts.get(-1, 0)))
    for mark in (0, 1):
        share = F.when(F.col("mark") == mark, labelled / max(1, counts.get(mark, 0))).otherwise(share)
    # bounded by the parameters, whatever the number of documents
    sample = F.broadcast(marked.where(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, meta = _views(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(4), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())],
                names=["doc_id", "mark", "text", "meta"],
            )

    rows = _viewed(documents, F.col("doc_id")).join(sample, "doc_id").select(*_COLUMNS, "doc_id", "mark").mapInArrow(
        run, "doc_id long, mark int, text binary, meta binary"
    ).collect()
    # one row of each document, in an order that does not depend on the tasks
    rows = sorted({r["doc_id"]: r for r in sorted(rows)}.values(), key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"]).encode()), r["doc_id"]))
    if not rows:
        return None
    text = np.stack([np.frombuffer(r["text"], np.float32) for r in rows])
    meta = np.stack([np.frombuffer(r["meta"], np.float32) for r in rows])
    mark = np.array([r["mark"] for r in rows], float)
    return co_train(text[mark >= 0], meta[mark >= 0], mark[mark >= 0], text[mark < 0], meta[mark < 0])


def _viewed(documents: DataFrame, *more) -> DataFrame:
    """The columns that the views read; a missing lang or source counts as null."""
    own = [F.col(c).cast("string").alias(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in _COLUMNS]
    return documents.select(*own, *more)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    texts = whole_bytes(batch.column(at("text")))
    langs, sources = batch.column(at("lang")).to_pylist(), batch.column(at("source")).to_pylist()
    if not texts:
        return np.zeros((0, TEXT_WIDTH)), np.zeros((0, 1))
    return np.stack([text_view(t) for t in texts]), np.stack([metadata_view(*v) for v in zip(texts, langs, sources, strict=True)])


def score(documents: DataFrame, quality: Quality | None) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` for each row.

    Scores are calibrated log-odds of being good, rounded to 6 digits.  Without a
    classifier they are null and all rows are kept.  A null text counts as empty.
    Repeated rows give repeated results.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.round(quality.scores(*_views(batch)), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), *(pa.array(found[:, k]) for k in range(3)), pa.array(found[:, 2] >= quality.least)],
                names=["doc_id", "text_score", "meta_score", "score", "kept"],
            )

    names = ["text_score", "meta_score", "score"]
    if quality is None:
        return documents.select(F.col("doc_id").cast("long"), *(F.lit(None).cast("double").alias(c) for c in names), F.lit(True).alias("kept"))
    return _viewed(documents, F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, text_score double, meta_score double, score double, kept boolean"
    )


def good_documents(documents: DataFrame, quality: Quality | None) -> DataFrame:
    """The rows that the classifier keeps, with all their columns."""
    if quality is None:
        return documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in slices(batches):
            views = batch
            for name in ("lang", "source"):
                if name not in batch.schema.names:
                    views = views.append_column(name, pa.nulls(batch.num_rows, pa.string()))
            yield batch.filter(pa.array(np.round(quality.scores(*_views(views))[:, 2], 6) >= quality.least))

    return documents.mapInArrow(run, documents.schema)


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and verdicts for all ``documents``, learned from ``labels``."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return score(documents, fit_quality(documents, spark.read.parquet(f"{folder}/labels.parquet")))
