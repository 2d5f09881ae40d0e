"""Report per file: flat facts, nested document, JSON text and section tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelantern import __version__
from tracelantern.functions.text import shortened
from tracelantern.operators import findings, rollup, score, tops
from tracelantern.plans import dossier
from tracelantern.plans.analysis import Analysis
from tracelantern.plans.dossier import Limits
from tracelantern.sources.store import Store
from tracelantern.tables import frames

TOOL = "tracelantern"

DETAILS_PER_RULE = Limits.details_per_rule


def file_report(analysis: Analysis) -> DataFrame:
    """One flat row per file: period, counters, score, rule-set facts."""
    return dossier.flat(analysis.rollup, analysis.rules, analysis.correlation_rows).withColumns({
        "score_bar": score.score_bar(F.col("threat_score")),
        "detection_rules_total": F.lit(len(analysis.rules)),
        "keyword_rules_loaded": F.lit(analysis.rules.keyword_rules()),
        "rule_categories": F.lit(len(analysis.rules.categories())),
    })


def documents(analysis: Analysis, files: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """One nested document per file with the 25 report keys, as typed columns.

    ``files`` may bring the facts of ``sources.manifest``; without it the hashes and the
    size are null, as for lines that come from tables.  ``dossier.left_out`` counts what
    ``limits`` keep out.
    """
    # kept one after the other, so that the shuffles of one step are gone when the next begins
    rows = analysis.rollup
    first = analysis.keep(dossier.ranked(rows, limits))
    counted = analysis.keep(dossier.counted(rows))
    texts = analysis.keep(dossier.fetched(analysis.lines, dossier.quoted(first, limits)))
    whole = counted.join(dossier.lists(first, texts), "file_id", "left")
    made = dossier.Conclusions(analysis.rules, analysis.correlation_rows, F.col("rule"))
    whole = whole.withColumn("matches", made.matches())
    whole = whole.withColumn("threat_score", made.threat_score(F.col("matches")))
    if files is None:
        whole = whole.withColumns({
            "file": F.col("file_id"),
            "file_md5": F.lit(None).cast("string"),
            "file_sha256": F.lit(None).cast("string"),
            "file_size_bytes": F.lit(None).cast("long"),
        })
    else:
        facts = files.select(
            "file_id", F.col("name").alias("file"), F.col("md5").alias("file_md5"),
            F.col("sha256").alias("file_sha256"), F.col("size_bytes").alias("file_size_bytes"),
        )
        whole = whole.join(facts, "file_id", "left")

    def entries(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<struct<at:long,name:string,text:string,n:long>>"))

    def pairs(kind: str) -> Column:
        return F.transform(entries(kind), lambda t: F.struct(t.text.alias("value"), t.n.alias("cnt")))

    return whole.select(
        "file_id",
        F.lit(TOOL).alias("tool"),
        F.lit(__version__).alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generated"),
        "file", "file_md5", "file_sha256", "file_size_bytes",
        "total_lines", "log_start", "log_end", "unique_ips", "unique_users",
        "threat_score", score.threat_level(F.col("threat_score")).alias("threat_level"),
        pairs(rollup.IP).alias("top_ips"), pairs(rollup.USER).alias("top_users"), pairs(rollup.EVENT_ID).alias("event_id_summary"),
        F.lit(len(analysis.rules)).alias("detection_rules_total"),
        F.lit(analysis.rules.keyword_rules()).alias("sigma_rules_loaded"),
        F.col("rules_triggered").alias("detection_rules_triggered"),
        made.techniques().alias("mitre_techniques_detected"),
        F.transform("matches", lambda c: F.struct(c["name"].alias("name"), c.severity.alias("severity"), c.description.alias("description"))).alias("correlations"),
        dossier.ioc_map(entries("ioc")).alias("iocs"),
        made.summary().alias("findings_summary"),
        made.details(entries("detail")).alias("findings_detail"),
    )


def as_json(documents: DataFrame) -> DataFrame:
    """(file_id, report): the document of each file as JSON text."""

    def pairs(name: str) -> Column:
        # a token and its count share a two-element list
        return F.transform(
            name, lambda t: F.array(t.value.cast("variant"), t.cnt.cast("variant"))
        ).alias(name)

    keys = [c for c in documents.columns if c != "file_id"]
    paired = ("top_ips", "top_users", "event_id_summary")
    body = F.struct(*[pairs(k) if k in paired else F.col(k) for k in keys])
    return documents.select("file_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def write_json(
    documents: DataFrame, folder: str, store: Store | None = None, dealt: bool = False, whole: bool = False
) -> tuple[int, int]:
    """One JSON file per log file, in the place of an earlier one; number of files and of bytes."""
    return write_by_file(as_json(documents), "report", folder, ".json", store, dealt, whole)


# A file name has 255 bytes at most; a longer address keeps its end, which differs most.
_NAME_BYTES = 180


def write_by_file(
    texts: DataFrame, column: str, folder: str, suffix: str, store: Store | None = None, dealt: bool = False, whole: bool = False
) -> tuple[int, int]:
    """Writes ``column`` of (file_id, column) to a file of its own, under a name that follows from the file id.

    ``dealt`` files lie in 256 folders by a hash of the file id, so that tasks can make and list
    millions of them side by side; others lie flat.  ``whole`` says that no file id has two rows, so
    that texts need not be shuffled.
    """
    name = F.replace(F.url_encode("file_id"), F.lit("*"), F.lit("%2A"))
    long = F.concat(F.sha2("file_id", 256), F.lit("-"), F.right(name, F.lit(_NAME_BYTES - 65)))
    name = F.when(F.length(name) > _NAME_BYTES, long).otherwise(name)
    part = F.lower(F.lpad(F.hex(F.pmod(F.xxhash64("file_id"), F.lit(256))), 2, "0"))
    rows = texts.select(F.concat(*[part, F.lit("/")] * dealt, name, F.lit(suffix)).alias("name"), F.lit(0).alias("part"), F.col(column).alias("body"))
    return (store or Store()).write(rows, folder, whole)


# Section tables of the text report and of the result tabs.

def correlation_section(analysis: Analysis) -> DataFrame:
    return analysis.matches.select(
        "file_id", "corr_ord", "severity", "name", "description",
        F.array_join("requires", ", ").alias("signals"),
    )


def findings_section(analysis: Analysis, examples: int = 3) -> DataFrame:
    """Categories ascending, rules by first hit; the first examples of each, and how many more."""
    counts = findings.more_than(findings.findings_summary(analysis.hit_counts, analysis.rule_frame), examples)
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("category", "first_seen"))
    counts = counts.withColumn("place", place)  # at most one row per rule and file
    shown = findings.first_findings(analysis.hits, examples).select(
        "file_id", "rule_id", "line_no", "rank", shortened(F.col("content"), 80).alias("snippet")
    )
    return counts.join(shown, ["file_id", "rule_id"]).select(
        "file_id", "place", F.upper("category").alias("category"), "rule_id", "severity", "description",
        "technique_id", "cnt", "rank", "line_no", "snippet", "more",
    )


def ioc_section(analysis: Analysis, n: int = 10) -> DataFrame:
    """Types in display order with their labels, first values and how many more."""
    totals = tops.ioc_totals(analysis.iocs).withColumnRenamed("total", "cnt")
    shown = tops.first_iocs(analysis.iocs, n).select("file_id", "ioc_type", "value", "rank")
    labels = frames.ioc_labels(analysis.lines.sparkSession)
    return (
        shown.join(findings.more_than(totals, n), ["file_id", "ioc_type"])
        .join(labels, "ioc_type")
        .select("file_id", "ioc_ord", "ioc_type", "ioc_label", "rank", "value", "cnt", "more")
    )
