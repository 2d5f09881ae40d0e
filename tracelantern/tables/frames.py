"""The fixed rows as DataFrames.

They are built from Arrow tables, which Spark plans as local relations of known
size: joins with them are broadcast by Spark's own size threshold, unhinted.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelantern.tables import lookups
from tracelantern.tables.correlations import CORRELATIONS
from tracelantern.tables.techniques import TECHNIQUES

_TEXT = pa.string()
_TEXTS = pa.list_(pa.string())
_INT = pa.int32()


def frame(spark: SparkSession, rows, **columns: pa.DataType) -> DataFrame:
    """DataFrame of a few Python rows with the given columns."""
    rows = list(rows)
    arrays = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def techniques(spark: SparkSession) -> DataFrame:
    return frame(spark, TECHNIQUES, technique_id=_TEXT, technique_name=_TEXT)


def correlations(spark: SparkSession, rows=CORRELATIONS) -> DataFrame:
    return frame(
        spark,
        [(n, name, severity, boost, list(requires), text)
         for n, (name, severity, boost, requires, text) in enumerate(rows, 1)],
        corr_ord=_INT, name=_TEXT, severity=_TEXT, score_boost=_INT, requires=_TEXTS, description=_TEXT,
    )


def event_id_names(spark: SparkSession, short: bool = False) -> DataFrame:
    rows = [(i, brief if short else name) for i, name, brief in lookups.EVENT_ID_NAMES]
    return frame(spark, [r for r in rows if r[1] is not None], event_id=_TEXT, event_name=_TEXT)


def recommendations(spark: SparkSession) -> DataFrame:
    return frame(
        spark,
        [(n, list(rules), [corr] if corr else [], text)
         for n, (rules, corr, text) in enumerate(lookups.RECOMMENDATIONS, 1)],
        rec_ord=_INT, any_rule=_TEXTS, any_corr=_TEXTS, recommendation=_TEXT,
    )


def tactics(spark: SparkSession) -> DataFrame:
    return frame(spark, enumerate(lookups.TACTICS, 1), tactic_ord=_INT, tactic=_TEXT)


def ioc_labels(spark: SparkSession) -> DataFrame:
    return frame(
        spark, [(n, kind, label) for n, (kind, label) in enumerate(lookups.IOC_LABELS, 1)],
        ioc_ord=_INT, ioc_type=_TEXT, ioc_label=_TEXT,
    )
