"""Counts per file.

All counts use map-side partial aggregation on fixed-width buffers (a count and a
minimum LONG), so a hot file or a hot token is reduced before it is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelantern.functions.stamps import packed, unpacked
from tracelantern.functions.text import seen_at
from tracelantern.operators import detect, extract
from tracelantern.tables.ruleset import RuleSet


def token_counts(tokens: DataFrame) -> DataFrame:
    """(file_id, value, cnt, first_seen) of tokens (file_id, line_no, place, value)."""
    return tokens.groupBy("file_id", "value").agg(
        F.count("*").alias("cnt"), F.min(seen_at(F.col("line_no"), F.col("place"))).alias("first_seen")
    )


def hit_counts(hits: DataFrame) -> DataFrame:
    """(file_id, rule_id, cnt, first_seen): matching lines per rule."""
    return hits.groupBy("file_id", "rule_id").agg(
        F.count("*").alias("cnt"), F.min(seen_at(F.col("line_no"), F.col("rule_ord"))).alias("first_seen")
    )


def ioc_set(iocs: DataFrame) -> DataFrame:
    """(file_id, ioc_type, value, first_seen): distinct indicators."""
    return iocs.groupBy("file_id", "ioc_type", "value").agg(
        F.min(seen_at(F.col("line_no"), F.col("place"))).alias("first_seen")
    )


def total_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_id").agg(F.count("*").alias("total_lines"))


# kinds of facts, besides one per indicator type
LINE, IP, USER, EVENT_ID, RULE, STAMP, HIT = "line", "ip", "user", "event_id", "rule", "stamp", "hit"
ALL = (LINE, STAMP, IP, USER, EVENT_ID, *extract.IOC_TYPES, RULE)
# with the numbers of all lines that a rule matches, 64 lines in a LONG
DETAILED = (*ALL, HIT)

# the period of a file: packed stamps of its first and of its last line with one
STAMPS = ("first_stamp", "first_script", "last_stamp", "last_script")


def _with_stamps(lines: DataFrame) -> DataFrame:
    found = lines.withColumn("stamps", extract.timestamp_values())
    first = packed(F.col("line_no"), F.get("stamps", F.lit(0)))
    last = packed(F.col("line_no"), F.try_element_at("stamps", F.lit(-1)))
    return found.withColumns(dict(zip(STAMPS, (*first, *last)))).drop("stamps")


def _stamp_sums(values: list[Column]) -> list[Column]:
    """Aggregates over ``STAMPS``: smallest of the first, largest of the last."""
    return [(F.min if name.startswith("first") else F.max)(value).alias(name) for name, value in zip(STAMPS, values)]


def period_of(stamps: list[Column]) -> tuple[Column, Column]:
    """``log_start`` and ``log_end`` of the packed stamps of a file."""
    return unpacked(*stamps[:2]).alias("log_start"), unpacked(*stamps[2:]).alias("log_end")


def facts(lines: DataFrame, rules: RuleSet, kinds: tuple[str, ...] = ALL) -> DataFrame:
    """(file_id, line_no, kind, value, place): what is counted about a line, in one pass.

    With stamps among the kinds, ``STAMPS`` of the line, too.
    """

    def tagged(kind: str, values: Column, place: int | None = None) -> Column:
        values = F.coalesce(values, F.array().cast("array<string>"))
        return F.transform(values, lambda value, at: _fact(kind, value, at if place is None else F.lit(place)))

    scan = detect.scan_for(rules)

    def per_rule(kind: str) -> Column:
        places = detect.rule_places(rules, scan, F.col("found"))
        return F.transform(places, lambda place: _fact(kind, detect.rule_id_at(rules, place), place))

    parts = {
        LINE: F.array(_fact(LINE, F.lit(""), F.lit(0))),
        IP: tagged(IP, F.col("ips")),
        USER: tagged(USER, extract.user_values(F.col("folded"))),
        EVENT_ID: tagged(EVENT_ID, extract.event_id_values(F.col("folded"))),
        **{kind: tagged(kind, extract.ioc_values(kind), n) for n, kind in enumerate(extract.IOC_TYPES)},
        RULE: per_rule(RULE),
        HIT: per_rule(HIT),
    }
    stamps = STAMPS if STAMP in kinds else ()
    scanned = extract.scanned(_with_stamps(lines) if stamps else lines, scan)
    return scanned.select("file_id", "line_no", *stamps, F.inline(F.concat(*[parts[kind] for kind in kinds if kind in parts])))


def _fact(kind: str, value: Column, place: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), place.cast("int").alias("place"))


def rollup(lines: DataFrame, rules: RuleSet, kinds: tuple[str, ...] = ALL) -> DataFrame:
    """(file_id, kind, value, cnt, first_seen): one scan and one shuffle for all counts.

    With hits among the kinds, a row also has ``block``, a number of 64 lines, and
    ``bits``, the lines of the block that the rule matches.  With stamps among them, the
    file's line row has its ``STAMPS``.
    """
    keys: list = ["file_id", "kind", "value"]
    sums = [F.count("*").alias("cnt"), F.min(seen_at(F.col("line_no"), F.col("place"))).alias("first_seen")]
    if HIT in kinds:
        hit = F.col("kind") == HIT
        keys.append(F.when(hit, F.shiftright("line_no", 6)).otherwise(0).alias("block"))
        one = F.expr("shiftleft(1L, cast(line_no & 63 AS int))")
        sums.append(F.bit_or(F.when(hit, one).otherwise(0)).alias("bits"))
    if STAMP in kinds:
        line = F.col("kind") == LINE
        sums += _stamp_sums([F.when(line, F.col(name)) for name in STAMPS])
    return facts(lines, rules, kinds).groupBy(*keys).agg(*sums)


def log_period(lines: DataFrame) -> DataFrame:
    """(file_id, log_start, log_end): the first and the last timestamp by position."""
    stamps = [F.col(name) for name in STAMPS]
    ends = _with_stamps(lines).groupBy("file_id").agg(*_stamp_sums(stamps))
    return ends.where(F.col(STAMPS[0]).isNotNull()).select("file_id", *period_of(stamps))


def distinct_per_file(counts: DataFrame, name: str) -> DataFrame:
    """Number of rows of a table of distinct things, per file."""
    return counts.groupBy("file_id").agg(F.count("*").alias(name))
