"""Personal data: base rules, wide candidates, and boosted trees that judge them.

Base rules find addresses, network addresses, card and phone numbers that pass their
checks; these always stay.  Wider generators propose overlapping spans of the same
kinds.  Trees are boosted on all candidates whose label is certain (a base span, or one
that fails a hard check), on features of format and context; of these a third is held
out and sets for each kind the threshold that keeps the wanted precision.
Candidates of uncertain form above their kind's threshold are redacted too.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions.stages import arrow_bytes, drop, kept, new_path
from tracelantern.llm.boosting import Boosted, Tree, sums, threshold_for
from tracelantern.llm.shared import free_worker, slices, whole_bytes

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995
# Kinds of labelled candidates (equal features and label) that are fitted in the driver; more stay in tasks.
IN_MEMORY = 100_000
# What a worker gets at once; an executor holds a batch in its JVM and in Python for each core.
_BATCH_BYTES = 4 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a run of digits that cannot start a match at its first digit cannot at a later one
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider forms: written-out addresses, and numbers with other separators.
_WIDE_EMAIL = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64}\s?[(\[]\s?at\s?[)\]]\s?[\w-]{1,63}(?:\s?(?:\.|[(\[]\s?dot\s?[)\]])\s?[\w-]{1,63}){1,8}", re.IGNORECASE
)
_WIDE_PHONE = re.compile(r"(?<![\w.+])[(+]{0,2}[0-9]{1,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w])")
_WIDE_CARD = re.compile(r"(?<![\w.])(?:[0-9]{14,19}|[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})(?![\w])")
_WIDE_QUAD = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\x20?[.\[(]{1,2}\x20?[0-9]{1,3}[\])]?){3}(?![\w])")
_DIGITS = b"0123456789"
# Words before a value that speak for its kind (fixed values).
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "from", "client"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "tarjeta", "karte", "carte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "telefono"},
}
AGAINST = {"version", "v", "release", "section", "isbn", "no", "nr", "order", "id", "token"}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2]) % 10 == -sum(sum(divmod(2 * v, 10)) for v in values[1::2]) % 10


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Leftmost matches of the base patterns of each kind, and whether they pass their checks."""
    edge = 0
    for m in _DOMAIN.finditer(text):
        # the local part reaches back to the last other character, or the last address
        start = m.start()
        while start > edge and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            edge = m.end()
            yield Span("email", start, edge), True
    for m in _IP.finditer(text):
        yield Span("ip", *m.span()), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        yield Span("card", *m.span()), 14 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield Span("phone", *m.span()), 10 <= len(_digits(m[0])) <= 15


def by_place(spans) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def candidates(text: str) -> tuple[list[Span], list[Span], list[Span]]:
    """Base spans, spans that fail a hard check, and spans of uncertain form."""
    base, failed = [], []
    for span, passes in matches(text):
        (base if passes else failed).append(span)
    known = {(s.start, s.end) for s in base} | {(s.start, s.end) for s in failed}
    wide = [Span("email", *m.span()) for m in _WIDE_EMAIL.finditer(text)]
    wide += [Span("phone", *m.span()) for m in _WIDE_PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    wide += [Span("card", *m.span()) for m in _WIDE_CARD.finditer(text)]
    wide += [Span("ip", *m.span()) for m in _WIDE_QUAD.finditer(text)]
    return base, failed, [s for s in wide if (s.start, s.end) not in known]


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    value = text[span.start:span.end]
    before, after = text[max(0, span.start - 24):span.start], text[span.end:span.end + 24]
    digits = _digits(value)
    groups = re.findall("[0-9]+", value)
    words = re.findall(r"[^\W\d_][\w-]*", before.lower())
    near = set(words[-3:])
    around = before + after
    return [
        float(KINDS.index(span.kind)), len(value), len(digits), sum(c.isalpha() for c in value), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), max((int(g) for g in groups if len(g) < 6), default=0),
        value.count("."), value.count(" "), value.count("-"), value.count("("), value.startswith("+"), value.count("@"),
        len(set(digits)), bool(digits) and luhn(digits), digits.startswith("0"), int(digits[:1] or 0),
        bool(near & CUES[span.kind]), bool(near & AGAINST),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ("", " ", "\n"), before[-1:] in ("#", "$", "=", "\"", "/"),
        sum(c.isdigit() for c in around) / (len(around) + 1), sum(not c.isalnum() and not c.isspace() for c in around) / (len(around) + 1),
    ]


_FEATURES = len(features("", Span(KINDS[0], 0, 0)))
# Features become whole numbers below _CODES, those below _EXACT and shares of 48 characters one by one.
_EXACT, _CODES, _SHARES = 2048, 4096, 2


def coded(rows: np.ndarray) -> np.ndarray:
    """The features as whole numbers in the same order; large ones share a number if they differ by half a percent."""
    large = _EXACT + np.floor(128 * np.log2(np.maximum(rows, _EXACT) / _EXACT))
    codes = np.where(rows < _EXACT, np.floor(rows), np.minimum(large, _CODES - 1))
    codes[:, -_SHARES:] = np.floor(rows[:, -_SHARES:] * _CODES)
    return codes.astype(np.int64)


def may_hold(octets: bytes) -> bool:
    """Whether a text has a digit or a sign that any generator needs."""
    return b"@" in octets or len(octets.translate(None, _DIGITS)) < len(octets) or bool(re.search(rb"[(\[]\s?[aA][tT]\s?[)\]]", octets))


class Judge:
    """The fitted trees and the threshold of each kind."""

    def __init__(self, trees: Boosted | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    @staticmethod
    def fit(rows: list[list[float]], labels: list[int], precision: float = PRECISION) -> Judge:
        """Two thirds of the rows grow the trees, the rest sets the thresholds."""
        if not len(labels):
            return Judge(None, {})
        held = np.arange(len(labels)) % 3 == 2
        return Judge.of_counts(coded(np.array(rows, float)), np.array(labels, float), np.ones(len(labels)), held, precision)

    @staticmethod
    def of_counts(codes: np.ndarray, labels: np.ndarray, counts: np.ndarray, held: np.ndarray, precision: float) -> Judge:
        """Rows of coded features, each of which occurs ``counts`` times; those held out set the thresholds."""
        if len(set(labels[~held])) < 2 or counts.sum() < 30:
            return Judge(None, {})
        trees = Boosted().fit(codes[~held], labels[~held], counts[~held])
        scores = trees.log_odds(codes[held])
        thresholds = {}
        for k, kind in enumerate(KINDS):
            own = codes[held][:, 0] == k
            thresholds[kind] = max(0.0, threshold_for(scores[own], labels[held][own], precision, counts[held][own]))
        return Judge(trees, thresholds)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans; added spans overlap no other of their kind."""
        base, _, wide = candidates(text)
        base = by_place(base)
        if not wide or self.trees is None:
            return base, base
        scores = self.trees.log_odds(coded(np.array([features(text, s) for s in wide], float)))
        chosen = list(base)
        for k in np.argsort(-scores, kind="stable"):
            span = wide[k]
            if scores[k] >= self.thresholds[span.kind] and not any(
                s.kind == span.kind and s.start < span.end and span.start < s.end for s in chosen
            ):
                chosen.append(span)
        return base, by_place(chosen)


def _counted(documents: DataFrame) -> DataFrame:
    """(held, label, codes, n): the labelled candidates of all texts, equal ones as one row.

    Whether a candidate is held out follows from its document and place, so it is the same
    however the rows are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in slices(batches):
            rows, marks = [], []
            for doc_id, octets in zip(batch.column(0).to_pylist(), whole_bytes(batch.column(1)), strict=True):
                if may_hold(octets):
                    text = octets.decode("utf-8", "replace")
                    base, failed, _ = candidates(text)
                    for label, spans in ((1, base), (0, failed)):
                        for span in spans:
                            rows.append(features(text, span))
                            marks.append((xxhash.xxh64_intdigest(f"{doc_id}:{span.kind}:{span.start}".encode()) % 3 == 2, label))
            if rows:
                codes = coded(np.array(rows, float)).astype("<u2")
                found = Counter((*mark, row.tobytes()) for mark, row in zip(marks, codes, strict=True))
                columns = [*zip(*found, strict=True), list(found.values())]
                types = (pa.bool_(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["held", "label", "codes", "n"])

    texts = documents.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    found = texts.mapInArrow(run, "held boolean, label int, codes binary, n long")
    return found.groupBy("held", "label", "codes").agg(F.sum("n").alias("n"))


def _arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and counts of rows of ``_counted``."""
    codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), "<u2").reshape(batch.num_rows, -1)
    return codes.astype(np.int64), batch["label"].to_numpy().astype(float), batch["n"].to_numpy().astype(float)


def _grown(rows: DataFrame, share: float) -> Boosted:
    """Trees from rows of ``_counted`` that stay in tasks: only sums by node, feature and number leave them."""
    trees = Boosted()

    def of_level(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    codes, labels, counts = _arrays(batch)
                    own = np.stack(sums(codes, labels, counts, trees.log_odds(codes), tree.node(codes, level), level, _CODES))
                    total = own if total is None else total + own
            if total is not None:
                cells = np.flatnonzero(total[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(total[0].ravel()[cells]), pa.array(total[1].ravel()[cells])], names=["cell", "gradient", "weight"]
                )

        found = rows.mapInArrow(run, "cell long, gradient long, weight long").groupBy("cell").agg(F.sum("gradient"), F.sum("weight"))
        cell, *values = (column.to_numpy() for column in found.toArrow().columns)
        shape = (2**level, _FEATURES, _CODES)
        filled = np.zeros((2, int(np.prod(shape))), np.int64)
        filled[:, cell] = values
        return tuple(part.reshape(shape) for part in filled)

    return trees.grow(share, of_level)


def _thresholds(rows: DataFrame, trees: Boosted, precision: float) -> dict[str, float]:
    """``threshold_for`` of each kind over rows of ``_counted`` that stay in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, _, _ = _arrays(batch)
                columns = [pa.array(codes[:, 0]), pa.array(trees.log_odds(codes)), batch["label"], batch["n"]]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "score", "label", "n"])

    scored = rows.mapInArrow(run, "kind long, score double, label int, n long")
    scored = scored.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    share = F.sum("right").over(above) / F.sum("n").over(above)
    ranked = scored.select("kind", "score", share.alias("share"), F.lead("score").over(above).alias("below"))
    last = ranked.where(F.col("share") >= precision).groupBy("kind").agg(F.min(F.struct("score", "below")).alias("last")).collect()
    found = {KINDS[r.kind]: (r.last.score + (r.last.score if r.last.below is None else r.last.below)) / 2 for r in last}
    return {kind: max(0.0, found.get(kind, float("inf"))) for kind in KINDS}


def fit_judge(documents: DataFrame, precision: float = PRECISION, in_memory: int = IN_MEMORY) -> Judge:
    """The judge for a corpus, from all its labelled candidates.

    Equal candidates are counted.  Up to ``in_memory`` of what is left is fitted in the
    driver; more stays where it is, and only sums of a fixed number of cells are collected.
    Both give the same trees.
    """
    session = documents.sparkSession
    path = new_path(session)
    try:
        with arrow_bytes(session, _BATCH_BYTES):
            rows = kept(_counted(documents), path=path)
        counts = {(r.held, r.label): (r["n"], r["rows"]) for r in rows.groupBy("held", "label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
        if sum(n for _, n in counts.values()) <= in_memory:
            table = rows.toArrow()
            if not table.num_rows:
                return Judge(None, {})
            return Judge.of_counts(*_arrays(table), table["held"].to_numpy(), precision)
        good, bad = (counts.get((False, label), (0, 0))[0] for label in (1, 0))
        if not good or not bad or sum(n for n, _ in counts.values()) < 30:
            return Judge(None, {})
        trees = _grown(rows.where("NOT held"), good / (good + bad))
        return Judge(trees, _thresholds(rows.where("held"), trees, precision))
    finally:
        drop(session, path)


def find(documents: DataFrame, judge: Judge) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row.

    The counts and the digest are of the base spans; ``spans`` lists all.  A null text
    counts as empty.  Repeated rows give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for octets in whole_bytes(batch.column(1)):
                base, all_ = judge.spans(octets.decode("utf-8", "replace")) if may_hold(octets) else ([], [])
                counts = [sum(s.kind == kind for s in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(all_)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted_text(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    for span in spans:
        if span.start >= at:
            parts += [text[at:span.start], f"[{span.kind.upper()}]"]
        at = max(at, span.end)
    return "".join(parts) + text[at:]


def redact(documents: DataFrame, judge: Judge) -> DataFrame:
    """``documents`` with all spans of ``text`` replaced; other columns and rows stay as they are.

    A null text stays null.  ``n_chars`` is counted again where there is such a column.
    The rows are written once, for what a worker gets at once is settled when a job starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = []
            for octets in batch.column(at).cast(pa.binary()).to_pylist():
                if octets is not None and may_hold(octets):
                    text = octets.decode("utf-8", "replace")
                    octets = redacted_text(text, judge.spans(text)[1]).encode()
                texts.append(octets)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))

    with arrow_bytes(documents.sparkSession, _BATCH_BYTES):
        out = kept(documents.mapInArrow(run, documents.schema))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all ``documents``."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return find(documents, fit_judge(documents))
