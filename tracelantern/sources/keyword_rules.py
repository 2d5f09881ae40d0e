"""User rules from YAML files: a list of keywords, any of which is a hit."""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.sources.store import Store
from tracelantern.tables.lookups import KEYWORD_CATEGORY, KEYWORD_DEFAULT, KEYWORD_WEIGHTS

_SCHEMA = (
    "stem string, rejected string, rule_id string, severity string, weight int, category string, "
    "technique_id string, description string, patterns array<string>"
)


def read_rule_files(spark: SparkSession, folder: str, store: Store | None = None) -> DataFrame:
    """(stem, body) of the ``*.yml`` files in a folder, whatever their names start with; null for a body that is not UTF-8."""
    store = store or Store()
    files = store.files(spark, folder, deep=False).where(F.col("name").endswith(".yml"))
    bodies = files.select("file_id", F.regexp_replace("name", r"\.yml$", "").alias("stem")).mapInArrow(
        _body_reader(store), "stem string, body string"
    )
    return bodies


def _body_reader(store: Store) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with store.open(row["file_id"]) as file:
                    try:
                        rows.append({"stem": row["stem"], "body": file.read().decode()})
                    except UnicodeDecodeError:
                        rows.append({"stem": row["stem"], "body": None})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("stem", pa.string()), ("body", pa.string())]))

    return read


def parse_rules(bodies: DataFrame) -> DataFrame:
    """Every rule file as a rule row or, with ``rejected`` set, as the reason it is skipped."""
    return bodies.mapInArrow(_parse_batches, _SCHEMA)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("rejected").isNull()).drop("rejected", "stem")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("rejected").isNotNull()).select("stem", "rejected")


def rule_folder(log_folder: str, store: Store | None = None) -> str | None:
    """``sigma_rules`` beside the logs, else under the working folder, else none."""
    store = store or Store()
    folders = (f"{log_folder.rstrip('/')}/sigma_rules", "sigma_rules")
    return next((folder for folder in folders if store.exists(folder)), None)


def load_keyword_rules(spark: SparkSession, folder: str, store: Store | None = None) -> DataFrame:
    """Usable rules of a folder."""
    return accepted(parse_rules(read_rule_files(spark, folder, store)))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    schema = pa.schema(
        [("stem", text), ("rejected", text), ("rule_id", text), ("severity", text), ("weight", pa.int32()),
         ("category", text), ("technique_id", text), ("description", text), ("patterns", pa.list_(text))]
    )
    for batch in batches:
        rows = [_rule_row(row["stem"], row["body"]) for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema)


def _rule_row(stem: str, body: str) -> dict:
    import yaml

    try:
        rule = yaml.safe_load(body)
        if not rule or "detection" not in rule:
            return {"stem": stem, "rejected": "no detection"}
        keywords = rule["detection"].get("keywords", [])
        if not isinstance(keywords, list) or not keywords:
            return {"stem": stem, "rejected": "no keyword list"}
        patterns = [_keyword_pattern(keyword) for keyword in keywords]
        for pattern in patterns:
            re.compile(pattern)
        level = rule.get("level", "medium").upper()
        severity, weight = next(((n, w) for n, w in KEYWORD_WEIGHTS if n == level), KEYWORD_DEFAULT)
        technique = next((tag for tag in rule.get("tags", []) if tag.startswith("attack.t")), "")
        return {
            "stem": stem,
            "rule_id": f"sigma_{stem}",
            "severity": severity,
            "weight": weight,
            "category": KEYWORD_CATEGORY,
            "technique_id": technique.replace("attack.", "").upper(),
            "description": str(rule.get("description", rule.get("title", stem))),
            "patterns": patterns,
        }
    except Exception as problem:  # a bad file is skipped, whatever is wrong with it
        return {"stem": stem, "rejected": f"{type(problem).__name__}: {problem}"}


def _keyword_pattern(keyword: str) -> str:
    # a leading * marks a wildcard keyword, whose other characters stay a regex
    return keyword.replace("*", ".*") if keyword.startswith("*") else re.escape(keyword)
