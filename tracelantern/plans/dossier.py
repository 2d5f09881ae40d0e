"""One row per file with all that its report says.

The roll-up is grouped once for counters and once for lists that are bounded by the rules
and by the report's limits; what follows from the rules that fired (score, techniques,
correlations) is worked out inside the row, so no part of a report is joined to another.
Texts come last: the roll-up holds the numbers of all lines that a rule matches, 64 to a
LONG, and only the lines that a report quotes are fetched.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelantern.functions.membership import maybe_in
from tracelantern.functions.text import strip
from tracelantern.operators import extract, rollup, score
from tracelantern.operators.ranking import NO_LIMIT, first_rows
from tracelantern.tables.techniques import TECHNIQUES


@dataclass(frozen=True)
class Limits:
    """How many entries a report keeps; None keeps all."""

    # Fixed values
    top_ips: int | None = 10
    top_users: int | None = 10
    top_event_ids: int | None = 20
    iocs_per_type: int | None = 100
    details_per_rule: int | None = 50


_TOKENS = (rollup.IP, rollup.USER, rollup.EVENT_ID)
_PLACE = (1 << 24) - 1


def _of_kind(limits: Limits) -> dict[str, int]:
    found = {
        rollup.IP: limits.top_ips, rollup.USER: limits.top_users, rollup.EVENT_ID: limits.top_event_ids,
        rollup.HIT: limits.details_per_rule, **dict.fromkeys(extract.IOC_TYPES, limits.iocs_per_type),
    }
    return {kind: NO_LIMIT if n is None else n for kind, n in found.items()}


def counters(rows: DataFrame) -> DataFrame:
    """One row of counts per file, with its period and where each type of indicator was first seen."""
    kind = F.col("kind")
    counted = {
        "unique_ips": kind == rollup.IP,
        "unique_users": kind == rollup.USER,
        "unique_event_ids": kind == rollup.EVENT_ID,
        "rules_triggered": kind == rollup.RULE,
        "total_iocs": kind.isin(*extract.IOC_TYPES),
    }
    first = [F.min(F.when(kind == t, F.col("first_seen"))).alias(f"seen_{t}") for t in extract.IOC_TYPES]
    stamps = [(F.min if n.startswith("first") else F.max)(n).alias(n) for n in rollup.STAMPS]
    # numbers of matching lines are no counters
    found = rows.where(kind != rollup.HIT).groupBy("file_id").agg(
        F.sum(F.when(kind == rollup.LINE, F.col("cnt"))).alias("total_lines"),
        *[F.count(F.when(test, 1)).alias(name) for name, test in counted.items()], *first, *stamps,
    )
    return found.withColumns({c: v for c, v in zip(("log_start", "log_end"), rollup.period_of([F.col(n) for n in rollup.STAMPS]))}).drop(*rollup.STAMPS)


def _part(part: Column, name: Column, text: Column, n: Column, at: Column) -> list[Column]:
    return [F.col("file_id"), part.alias("part"), name.alias("name"), text.alias("text"), n.cast("long").alias("n"), at.cast("long").alias("at")]


def _rule_part(rows: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return rows.where(F.col("kind") == rollup.RULE).select(*_part(F.lit("rule"), F.col("value"), nothing, F.col("cnt"), F.col("first_seen")))


def ranked(rows: DataFrame, limits: Limits) -> DataFrame:
    """First tokens, indicators and blocks of hits of each file, ranked as the report has them."""
    kind, of_kind = F.col("kind"), _of_kind(limits)
    token, hit = kind.isin(*_TOKENS), kind == rollup.HIT
    listed = rows.where(kind.isin(*of_kind)).select(
        "file_id", "kind", F.when(hit, F.col("value")).otherwise("").alias("grp"), "value", "cnt", "block", "bits",
        F.when(token, -F.col("cnt")).when(hit, F.col("block")).otherwise(0).alias("order_1"),
        F.when(token, F.col("first_seen")).otherwise(0).alias("order_2"),
    )
    order = [F.col("order_1"), F.col("order_2"), F.col("value")]
    first = first_rows(listed, ["file_id", "kind", "grp"], order, max(of_kind.values()))
    kept = reduce(lambda test, k: F.when(kind == k, F.col("rank") <= of_kind[k]).otherwise(test), of_kind, F.lit(False))
    earlier = Window.partitionBy("file_id", "kind", "grp").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.bit_count("bits")).over(earlier), F.lit(0))
    return first.where(kept).select("file_id", "kind", "value", "cnt", "block", "bits", "rank", before.alias("before"))


def quoted(first: DataFrame, limits: Limits) -> DataFrame:
    """(file_id, line_no, rule_id) of the lines that a report quotes."""
    most = _of_kind(limits)[rollup.HIT]
    lines = first.where((F.col("kind") == rollup.HIT) & (F.col("before") < most)).select(
        "file_id", F.col("value").alias("rule_id"), "block", "before",
        F.posexplode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L)")).alias("pos", "bit"),
    )
    return lines.where(F.col("before") + F.col("pos") < most).select(
        "file_id", (F.shiftleft("block", 6) + F.col("bit")).alias("line_no"), "rule_id"
    )


def fetched(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the texts of its lines.

    A filter of fixed size goes before the join, so of texts that are not wanted hardly
    any is moved.  ``wanted`` is read twice and should come from a written table.
    """
    near = maybe_in(lines.select("file_id", "line_no", "line"), wanted, "file_id", "line_no")
    return near.join(wanted, ["file_id", "line_no"])


def counted(rows: DataFrame) -> DataFrame:
    """``counters`` and ``rule``, the list (at, name, text, n) of the rules that fired, by order of first hit."""
    return counters(rows).join(_collected(_rule_part(rows), ("rule",)), "file_id", "left")


def lists(first: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, ip, user, event_id, ioc, detail): ordered lists of (at, name, text, n)."""
    kind = F.col("kind")
    shown = first.where(kind != rollup.HIT).select(
        *_part(F.when(kind.isin(*_TOKENS), kind).otherwise("ioc"), kind, F.col("value"), F.col("cnt"), F.col("rank"))
    )
    details = texts.select(*_part(F.lit("detail"), F.col("rule_id"), strip(F.col("line")), F.col("line_no"), F.col("line_no")))
    # entries take less room in a shuffle than lists of them
    return _collected(shown.unionByName(details).repartition("file_id"), (*_TOKENS, "ioc", "detail"))


def _collected(parts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    entry = F.struct("at", "name", "text", "n")
    return parts.groupBy("file_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("part") == name, entry))).alias(name) for name in names]
    )


class Conclusions:
    """What follows from ``rule``, the list of the rules that fired in a file, by order of first hit."""

    def __init__(self, rules, correlations, fired: Column):
        self._rules = tuple(rules)
        self._correlations = tuple(correlations)
        self.fired = F.coalesce(fired, F.array().cast("array<struct<at:long,name:string,text:string,n:long>>"))

    def of_rule(self, entry: Column, field: str) -> Column:
        """An attribute of the rule of an entry, whose place is the low part of ``at``."""
        values = [getattr(rule, field) for rule in self._rules] or [0 if field == "weight" else ""]
        return F.element_at(F.lit(values), entry.at.bitwiseAND(_PLACE).cast("int"))

    def matches(self) -> Column:
        """The correlations whose rules all fired, in declared order."""
        names = F.transform(self.fired, lambda r: r["name"])
        known = F.array(*[
            F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(float(boost)).alias("boost"),
                     F.lit(list(requires)).alias("requires"), F.lit(text).alias("description"))
            for name, severity, boost, requires, text in self._correlations
        ]).cast("array<struct<name:string,severity:string,boost:double,requires:array<string>,description:string>>")
        return F.filter(known, lambda c: F.forall(c.requires, lambda rule: F.array_contains(names, rule)))

    def threat_score(self, matches: Column) -> Column:
        points = F.aggregate(
            self.fired, F.lit(0.0), lambda total, r: total + score.rule_points(r.n, self.of_rule(r, "weight").cast("double"))
        )
        total = F.aggregate(matches, points, lambda total, c: total + c.boost)
        return F.least(F.floor(total), F.lit(100)).cast("int")

    def techniques(self) -> Column:
        """(id, name, hits) by hits and then by first hit."""
        with_id = F.transform(self.fired, lambda r: F.struct(self.of_rule(r, "technique_id").alias("id"), r.at.alias("at"), r.n.alias("n")))
        with_id = F.filter(with_id, lambda r: r.id != "")
        names = F.create_map(*[F.lit(text) for row in TECHNIQUES for text in row])

        def summed(ident: Column) -> Column:
            own = F.filter(with_id, lambda r: r.id == ident)
            hits = F.aggregate(own, F.lit(0).cast("long"), lambda total, r: total + r.n)
            first = F.array_min(F.transform(own, lambda r: r.at))
            return F.struct((-hits).alias("order"), first.alias("at"), ident.alias("id"), hits.alias("hits"))

        found = F.array_sort(F.transform(F.array_distinct(F.transform(with_id, lambda r: r.id)), summed))
        return F.transform(found, lambda t: F.struct(t.id.alias("id"), F.coalesce(F.try_element_at(names, t.id), F.lit("")).alias("name"), t.hits.alias("hits")))

    def summary(self) -> Column:
        """Rule id -> its count and attributes."""
        return F.map_from_entries(F.transform(self.fired, lambda r: F.struct(r["name"], F.struct(
            r.n.alias("count"), self.of_rule(r, "severity").alias("severity"), self.of_rule(r, "category").alias("category"),
            self.of_rule(r, "description").alias("description"), self.of_rule(r, "technique_id").alias("mitre"),
        ))))

    def details(self, quotes: Column) -> Column:
        """Rule id -> its quoted lines."""
        def own(r: Column) -> Column:
            return F.transform(F.filter(quotes, lambda q: q["name"] == r["name"]), lambda q: F.struct(q.n.alias("line"), q.text.alias("content")))

        return F.map_from_entries(F.transform(self.fired, lambda r: F.struct(r["name"], own(r))))


def ioc_map(values: Column) -> Column:
    """Type -> its first values, types by first appearance."""
    types = F.array_compact(F.array(*[
        F.when(F.col(f"seen_{t}").isNotNull(), F.struct(F.col(f"seen_{t}").alias("at"), F.lit(t).alias("type"))) for t in extract.IOC_TYPES
    ]))
    return F.map_from_entries(F.transform(F.sort_array(types), lambda t: F.struct(
        t.type, F.transform(F.filter(values, lambda v: v["name"] == t.type), lambda v: v.text)
    )))


def flat(rows: DataFrame, rules, correlations) -> DataFrame:
    """Counters, period, score, and numbers of techniques and correlations per file."""
    found = counted(rows)
    made = Conclusions(rules, correlations, F.col("rule"))
    found = found.withColumn("matches", made.matches())
    found = found.withColumn("threat_score", made.threat_score(F.col("matches")))
    return found.select(
        "file_id", "total_lines", "unique_ips", "unique_users", "unique_event_ids", "rules_triggered", "total_iocs",
        F.size(made.techniques()).cast("long").alias("techniques"), F.size("matches").cast("long").alias("correlations"),
        "threat_score", score.threat_level(F.col("threat_score")).alias("threat_level"), "log_start", "log_end",
    )


def left_out(rows: DataFrame, limits: Limits) -> DataFrame:
    """(file_id, part, shown, left_out): entries of a kind of list that a limit keeps out, if any; hits per rule."""
    of_kind = _of_kind(limits)
    kind = F.col("kind")
    part = F.when(kind == rollup.RULE, F.col("value")).otherwise(kind)
    many = rows.where(kind.isin(*of_kind) & (kind != rollup.HIT) | (kind == rollup.RULE)).groupBy(
        "file_id", part.alias("part"), F.when(kind == rollup.RULE, rollup.HIT).otherwise(kind).alias("kind")
    ).agg(F.sum(F.when(kind == rollup.RULE, F.col("cnt")).otherwise(1)).alias("total"))
    limit = reduce(lambda n, k: F.when(kind == k, of_kind[k]).otherwise(n), of_kind, F.lit(NO_LIMIT))
    return many.where(F.col("total") > limit).select(
        "file_id", "part", limit.cast("long").alias("shown"), (F.col("total") - limit).alias("left_out")
    )
