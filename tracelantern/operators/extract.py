"""Per-line extraction: address, user, event-id and time tokens; indicators.

Everything here is a narrow projection over ``lines``: no shuffle.
"""

from functools import lru_cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelantern.functions.dialect import to_java
from tracelantern.functions.prefilter import RuleScan, folded
from tracelantern.tables import lookups

def _line() -> Column:
    return F.col("line")


def _find_all(pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(_line(), F.lit(to_java(pattern, ignore_case)), F.lit(group))


def _when_present(present: Column, values: Column) -> Column:
    """Skip the search on lines that lack the text every match contains."""
    return F.when(present, values)


def ip_values() -> Column:
    return _when_present(_line().contains("."), _find_all(lookups.IP_TOKEN, 1))


def user_values(text: Column | None = None) -> Column:
    """``text`` may bring the folded line."""
    text = folded(_line()) if text is None else text
    return _when_present(
        text.contains("user") | text.contains("account"),
        _find_all(lookups.USER_TOKEN, 1, ignore_case=True),
    )


def event_id_values(text: Column | None = None) -> Column:
    """``text`` may bring the folded line."""
    text = folded(_line()) if text is None else text
    return _when_present(
        text.contains("eventid"), _find_all(lookups.EVENT_ID_TOKEN, 1, ignore_case=True)
    )


def timestamp_values() -> Column:
    return _when_present(
        _line().contains(":") & _line().contains("-"), _find_all(lookups.TIMESTAMP_TOKEN)
    )


def _tokens(lines: DataFrame, values: Column) -> DataFrame:
    return lines.where(_line().isNotNull()).select(
        "file_id", "line_no", F.posexplode(values).alias("place", "value")
    )


def ip_tokens(lines: DataFrame) -> DataFrame:
    """Every dotted quad; octets are not range-checked."""
    return _tokens(lines, ip_values())


def user_tokens(lines: DataFrame) -> DataFrame:
    """The word after user / username / account."""
    return _tokens(lines, user_values())


def event_id_tokens(lines: DataFrame) -> DataFrame:
    """The digits after EventID and at least one separator."""
    return _tokens(lines, event_id_values())


def timestamp_tokens(lines: DataFrame) -> DataFrame:
    """Every timestamp, as text."""
    return _tokens(lines, timestamp_values())


def event_time(line_no: Column) -> Column:
    """First timestamp of the line, else ``Line <n>``."""
    first = F.regexp_extract(_line(), to_java(lookups.TIMESTAMP_TOKEN), 0)
    return F.coalesce(F.nullif(first, F.lit("")), F.format_string("Line %d", line_no))


_IOC_TEXT = {"url": "://", "email": "@", "cve": "CVE-"}
IOC_TYPES = tuple(kind for kind, _ in lookups.IOC_PATTERNS)

# Looser forms of the costly patterns, for the scan that goes before a search
# (see ``functions.prefilter``): lower case, linear-time syntax.
PROBES = {
    "ip": r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}",
    "hash": r"[a-f0-9]{32}",
    "domain": r"[a-z0-9]\.(?:com|net|org|io|xyz|info|ru|cn|tk|top|cc|pw|biz|me|co|uk|de|fr)",
}


def hash_values() -> Column:
    """Whole words that are 32, 40 or 64 hex digits; the length tells the kind."""
    return _find_all(r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b")


_HASH_SIZES = {"md5": 32, "sha1": 40, "sha256": 64}


def _kept_hash(size: int, value: Column) -> Column:
    return (F.length(value) == size) & (F.size(F.array_distinct(F.split(value, ""))) > 4)


def _kept_address(value: Column) -> Column:
    return ~reduce(lambda a, b: a | b, [value.startswith(p) for p in ("0.", "127.", "255.")])


@lru_cache(maxsize=None)
def _domain_search():
    """All domains of a line, by Arrow's linear-time engine.

    It knows word edges for ASCII only.  A domain is ASCII, so other letters can become
    an underscore, which is no part of a domain but a word character like them, and
    other marks a space; the matches are then the same.
    """
    pattern = dict(lookups.IOC_PATTERNS)["domain"]

    @F.arrow_udf("array<string>")
    def search(lines: pa.Array) -> pa.Array:
        plain = pc.replace_substring_regex(lines, r"[\x01\x02]|[^\x00-\x7F\p{L}\p{N}]", " ")
        plain = pc.replace_substring_regex(plain, r"[^\x00-\x7F]", "_")
        marked = pc.replace_substring_regex(plain, f"({pattern})", "\x01\\1\x02")
        found = [line and [part.split("\x02", 1)[0] for part in line.split("\x01")[1:]] for line in marked.to_pylist()]
        return pa.array([f or None for f in found], pa.list_(pa.string()))

    return search


def domain_values(present: Column) -> Column:
    """Null where there is none; lines that are not ``present`` are not searched."""
    return _domain_search()(F.when(present, _line()))


def scanned(lines: DataFrame, scan: RuleScan) -> DataFrame:
    """Lines with their ``folded`` text, with ``found``, what one scan of it finds of
    rules and probes, and with the values of the costly patterns, searched only where
    their probe was found."""

    def probed(name: str) -> Column:
        return F.array_contains("found", -1 - list(PROBES).index(name))

    return (
        lines.withColumn("folded", folded(F.coalesce(_line(), F.lit(""))))
        .withColumn("found", scan.found(F.col("folded"), tuple(PROBES.values())))
        .withColumn("ips", F.when(probed("ip"), ip_values()))
        .withColumn("hashes", F.when(probed("hash"), hash_values()))
        .withColumn("domains", domain_values(probed("domain")))
    )


def ioc_values(kind: str) -> Column:
    """Array of the indicators of one type in a scanned line, noise removed."""
    if kind in _HASH_SIZES:
        return F.filter("hashes", lambda value: _kept_hash(_HASH_SIZES[kind], value))
    if kind == "ipv4":
        return F.filter("ips", _kept_address)
    if kind == "domain":
        return F.col("domains")
    return _when_present(_line().contains(_IOC_TEXT[kind]), _find_all(dict(lookups.IOC_PATTERNS)[kind]))


def _marked(kind: str) -> Column:
    """The indicators of one type as structs that name the type."""
    values = F.coalesce(ioc_values(kind), F.array().cast("array<string>"))
    place, name = F.lit(IOC_TYPES.index(kind)).alias("place"), F.lit(kind).alias("ioc_type")
    return F.transform(values, lambda value: F.struct(place, name, value.alias("value")))


def iocs(lines: DataFrame, kinds: tuple[str, ...] = IOC_TYPES) -> DataFrame:
    """(file_id, line_no, place, ioc_type, value); ``place`` is the order of the type."""
    found = [_marked(kind) for kind in kinds]
    return scanned(lines, RuleScan([])).select("file_id", "line_no", F.inline(F.concat(*found)))
