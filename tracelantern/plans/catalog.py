"""Named queries over a folder of Parquet tables, one per operator or result."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelantern.functions import stages
from tracelantern.functions.text import shortened, snippet, strip
from tracelantern.operators import chains, detect, extract, findings, rollup, score, tops
from tracelantern.plans import report, stix
from tracelantern.plans.analysis import Analysis
from tracelantern.sources import event_records, keyword_rules, log_format, manifest, text_files, views
from tracelantern.sources.log_ranges import LogFolder
from tracelantern.sources.store import Store
from tracelantern.tables import frames
from tracelantern.tables.correlations import CORRELATIONS
from tracelantern.tables.ruleset import RuleSet

Query = Callable[[SparkSession, str], DataFrame]

# A user rule file as it would lie in a rule folder.
KEYWORD_RULE = """
title: Console tools run by service users
level: high
description: Console tools in service sessions
tags:
  - attack.execution
  - attack.t1059.001
detection:
  keywords:
    - "whoami /all"
    - "net view"
    - "*powershell*hidden"
    - "systeminfo collected"
  condition: keywords
"""


def family_query(category: str) -> str:
    """Query name of a rule family."""
    return "hits_" + "".join(c if c.isalnum() else "_" for c in category.lower())


def _hits(spark: SparkSession, folder: str, rules: RuleSet | None = None) -> DataFrame:
    return detect.hits(views.event_log(spark, folder), rules or RuleSet.builtin())


def _hit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.hit_counts(_hits(spark, folder))


def _rules(spark: SparkSession) -> DataFrame:
    return RuleSet.builtin().frame(spark)


def _keys(hits: DataFrame) -> DataFrame:
    return hits.select("file_id", "line_no", "rule_id")


def _first_line(counts: DataFrame) -> DataFrame:
    return findings.first_hit_line(counts)


def _token_query(tokens: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: _first_line(rollup.token_counts(tokens(views.event_log(spark, folder))))


def _top_query(tokens: Callable[[DataFrame], DataFrame], n: int) -> Query:
    return lambda spark, folder: _first_line(
        tops.top_tokens(rollup.token_counts(tokens(views.event_log(spark, folder))), n)
    )


def _ioc_query(kind: str, lines: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, folder: rollup.ioc_set(extract.iocs(lines(spark, folder), (kind,))).select(
        "file_id", "value"
    )


def _iocs(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.ioc_set(extract.iocs(views.event_log(spark, folder)))


def timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return extract.timestamp_tokens(views.event_log(spark, folder))


def distinct_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counted = (rollup.LINE, rollup.IP, rollup.USER, rollup.EVENT_ID)
    counts = rollup.rollup(views.event_log(spark, folder), RuleSet(()), counted)
    kinds = {"unique_ips": rollup.IP, "unique_users": rollup.USER, "unique_event_ids": rollup.EVENT_ID}
    return counts.groupBy("file_id").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(name) for name, kind in kinds.items()]
    )


def top_event_ids_named(spark: SparkSession, folder: str) -> DataFrame:
    counts = rollup.token_counts(extract.event_id_tokens(views.event_log(spark, folder)))
    return _first_line(tops.with_event_names(tops.top_tokens(counts, 15), frames.event_id_names(spark)))


def top_event_ids_short(spark: SparkSession, folder: str) -> DataFrame:
    counts = rollup.token_counts(extract.event_id_tokens(views.event_log(spark, folder)))
    names = frames.event_id_names(spark, short=True)
    return _first_line(tops.with_event_names(tops.top_tokens(counts, 20), names))


def relative_bars(spark: SparkSession, folder: str) -> DataFrame:
    counts = rollup.token_counts(extract.ip_tokens(views.event_log(spark, folder)))
    return tops.with_bars(tops.top_tokens(counts, 50)).drop("first_seen")


def ioc_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tops.ioc_totals(_iocs(spark, folder))


def ioc_capped(spark: SparkSession, folder: str) -> DataFrame:
    return report.ioc_section(Analysis(views.event_log(spark, folder), kinds=extract.IOC_TYPES))


def hits_per_rule(spark: SparkSession, folder: str) -> DataFrame:
    return _first_line(_hit_counts(spark, folder))


def findings_first_n(spark: SparkSession, folder: str) -> DataFrame:
    return findings.first_findings(_hits(spark, folder), report.DETAILS_PER_RULE)


def findings_by_category(spark: SparkSession, folder: str) -> DataFrame:
    grouped = findings.findings_by_category(_hit_counts(spark, folder), _rules(spark))
    listed = F.transform("rules", lambda r: F.concat(r.rule_id, F.lit(":"), r.cnt.cast("string")))
    return grouped.withColumn("rules", F.array_join(listed, ", "))


def findings_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _first_line(findings.findings_summary(_hit_counts(spark, folder), _rules(spark)))


def findings_section(spark: SparkSession, folder: str) -> DataFrame:
    return report.findings_section(_rule_analysis(views.event_log(spark, folder))).drop("first_seen")


def technique_hits(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.technique_hits(_hit_counts(spark, folder), _rules(spark), frames.techniques(spark))
    return _first_line(findings.named(found, "Unknown Technique"))


def technique_top20(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.technique_hits(_hit_counts(spark, folder), _rules(spark), frames.techniques(spark))
    return _first_line(findings.named(tops.top_techniques(found, 20), "Unknown"))


def timeline_500(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hits(spark, folder)
    return findings.first_events(findings.timeline(hits, _rules(spark)), 500).drop("rule_ord")


def correlation_matches(spark: SparkSession, folder: str) -> DataFrame:
    found = chains.correlation_matches(_hit_counts(spark, folder), frames.correlations(spark))
    return found.withColumn("requires", F.array_join("requires", ", "))


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score.rule_scores(_hit_counts(spark, folder), _rules(spark)).drop("first_seen")


def _rule_analysis(lines: DataFrame) -> Analysis:
    """Analysis of rule hits alone."""
    return Analysis(lines, kinds=(rollup.LINE, rollup.RULE))


def threat_score(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in, one scored row per file out: the query that runs end to end."""
    analysis = _rule_analysis(views.event_log(spark, folder))
    return analysis.headline.select("file_id", "total_lines", "rules_triggered", "threat_score", "threat_level")


def threat_level(spark: SparkSession, folder: str) -> DataFrame:
    scores = _rule_analysis(views.event_log(spark, folder)).scores
    return scores.withColumn("score_bar", score.score_bar(F.col("threat_score")))


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_analysis(views.event_log(spark, folder)).recommendations


def tactic_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.technique_hits(_hit_counts(spark, folder), _rules(spark), frames.techniques(spark))
    return chains.tactic_coverage(found)


def raw_head(spark: SparkSession, folder: str) -> DataFrame:
    return tops.raw_head(views.doc_lines(spark, folder))


def file_report(spark: SparkSession, folder: str) -> DataFrame:
    return report.file_report(Analysis(views.event_log(spark, folder), kinds=rollup.ALL))


def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of web pages, most of which fire one rule."""
    return _rule_analysis(views.page_lines(spark, folder)).headline.select(
        "file_id", "total_lines", "rules_triggered", "techniques", "threat_score", "threat_level"
    )


def json_report(spark: SparkSession, folder: str) -> DataFrame:
    documents = report.documents(Analysis(views.event_log(spark, folder)))
    return report.as_json(documents.drop("tool", "version", "generated"))


def stix_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return stix.stix_indicators(_iocs(spark, folder))


def stix_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles with fixed text in place of random ids and of the time."""
    bundles = stix.stix_bundle(stix.stix_objects(stix.stix_indicators(_iocs(spark, folder))))
    fixed = F.regexp_replace("bundle", "--[0-9a-f-]{36}", "--ID")
    fixed = F.regexp_replace(fixed, '("(?:created|modified|valid_from)":)"[^"]*"', '$1"NOW"')
    return bundles.withColumn("bundle", fixed)


# When the exports of the next query are said to be made.
EXPORTED = "2024-05-06 07:08:09"


def stix_export(spark: SparkSession, folder: str) -> DataFrame:
    """Every indicator of every file, no limit, with its id and times, by way of bundles on disk.

    The export is written twice, a file per log file; the second takes the place of the first.
    """
    objects = stix.stix_objects(stix.stix_indicators(_iocs(spark, folder), per_type=None), F.lit(EXPORTED).cast("timestamp"))
    path = stages.new_path(spark)
    table = stages.new_path(spark)
    bundles = stages.kept(stix.stix_bundle(objects), path=table, codec="zstd")
    for _ in range(2):
        stix.write_bundles(bundles, path, dealt=True, whole=True)
    stages.drop(spark, table)
    body = F.from_json(F.col("body").cast("string"), "type string, id string, objects array<struct<id:string,created:string,modified:string,name:string,pattern:string>>")
    name = F.regexp_extract(F.url_decode("name"), r"^(.*)\.stix\.json$", 1)
    written = Store().read(spark, path).select(name.alias("file_id"), body.alias("bundle"))
    return written.select("file_id", F.inline("bundle.objects"))


def json_report_export(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of documents as files, written twice and read back: what is in each, and how large its lists are."""
    path = stages.new_path(spark)
    with Analysis(views.doc_lines(spark, folder)) as analysis:
        documents = analysis.keep(report.documents(analysis, limits=report.Limits(None, None, None, None, None)).drop("generated"))
        for _ in range(2):
            report.write_json(documents, path, dealt=True, whole=True)
    fields = "file string, total_lines long, threat_score int, threat_level string, findings_detail map<string,array<struct<line:long,content:string>>>"
    written = Store().read(spark, path).select(F.from_json(F.col("body").cast("string"), fields).alias("r")).select("r.*")
    return written.select(
        F.col("file").alias("file_id"), "total_lines", "threat_score", "threat_level",
        F.size("findings_detail").alias("rules"),
        F.aggregate(F.map_values("findings_detail"), F.lit(0), lambda n, lines: n + F.size(lines)).alias("quoted"),
    )


def null_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of event files in which every line of an ``audit`` event has lost its text."""
    lines = views.event_log(spark, folder).withColumn("line", F.when(~F.col("line").contains(" audit "), F.col("line")))
    return report.file_report(Analysis(lines, kinds=rollup.ALL)).select(
        "file_id", "total_lines", "unique_ips", "unique_users", "rules_triggered", "total_iocs", "threat_score"
    )


# A correlation of a user's own beside the built-in ones.
OWN_CORRELATION = ("Login then account", "HIGH", 7, ("account_creation", "failed_login"), "A failed login and a new account in one log")


def own_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and numbers of correlations when a user adds one."""
    analysis = Analysis(views.event_log(spark, folder), correlations=(*CORRELATIONS, OWN_CORRELATION), kinds=rollup.ALL)
    return report.file_report(analysis).select("file_id", "correlations", "threat_score", "threat_level")


# Rule files as a user may have them; the second folder has another rule under a name of the first.
RULE_FILES = (
    {
        "console_tools.yml": KEYWORD_RULE,
        "_odd name.yml": 'title: Odd name\nlevel: critical\ndetection: {keywords: ["net view"]}',
        "unread.yml": "title: 2024", "broken.yml": 'detection: {keywords: ["*foo("]}', "other.yaml": KEYWORD_RULE,
    },
    {"console_tools.yml": 'title: Only views\nlevel: low\ntags: [attack.t1135]\ndetection: {keywords: ["net view", "vssadmin"]}'},
)


def rule_file_report(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and counters with rules read from two folders of files, the later taking the place of equal ids."""
    rules = RuleSet.builtin()
    for files in RULE_FILES:
        path = stages.new_path(spark)
        rows = [(name, 0, body) for name, body in files.items()]
        Store().write(spark.createDataFrame(rows, "name string, part int, body string"), path)
        rules = rules.plus_frame(keyword_rules.load_keyword_rules(spark, path))
    found = report.file_report(Analysis(views.event_log(spark, folder), rules, kinds=rollup.ALL))
    return found.select(
        "file_id", "rules_triggered", "techniques", "threat_score", "threat_level", "detection_rules_total", "keyword_rules_loaded",
    )


def json_report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Report documents of log files on disk, with their hashes and sizes."""
    path = _event_files(spark, folder, F.col("line"))
    lines = text_files.read_logs(spark, path)
    documents = report.documents(Analysis(lines), manifest.file_manifest(spark, path, lines))
    return _short_id(report.as_json(documents.drop("tool", "version", "generated", "file")))


def _little(number: Column, size: int) -> Column:
    """Hex digits of a number, lowest byte first."""
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*[F.substring(digits, k, 2) for k in range(2 * size - 1, 0, -2)])


def _event_chunks(rows: DataFrame) -> DataFrame:
    """(file_id, chunk_no, chunk) of rows (file_id, id, line): hex of records, 50 in a chunk."""
    order = Window.partitionBy("file_id").orderBy("id")  # a file is a user's or a type's day
    place = F.row_number().over(order) - 1
    # three marks tell where the text starts, after the record's head of 16 bytes
    text = F.hex(F.encode(F.concat(F.lit("\x01\x02\x03"), "line"), "UTF-16LE"))
    head = F.concat(F.lit("2A2A0000"), _little(F.length(text) / 2 + 16, 4), _little(F.col("id"), 8))
    records = rows.select("file_id", F.floor(place / 50).cast("int").alias("chunk_no"), "id", F.concat(head, text).alias("record"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("id", "record"))), lambda r: r.record)
    return records.groupBy("file_id", "chunk_no").agg(F.concat(F.lit("456C6643686E6B00"), F.array_join(ordered, "")).alias("chunk"))


def _record_fields(lines: DataFrame) -> DataFrame:
    return lines.select(
        "file_id", "line_no",
        F.regexp_extract("line", r"^RecordID:(\d+) ", 1).cast("long").alias("record_id"),
        F.regexp_extract("line", r"(?s)\x01\x02\x03(.*)", 1).alias("line"),
    )


def event_record_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as binary records, 50 in a chunk, and read back."""
    rows = views.rendered_events(spark, folder).select("file_id", F.col("line_no").alias("id"), "line")
    bodies = _event_chunks(rows).select("file_id", "chunk_no", F.unhex("chunk").alias("body"))
    return _record_fields(event_records.numbered_records(bodies))


def _mixed_folder(spark: SparkSession, folder: str) -> str:
    """Rendered events as a folder of mixed files, a file per event type and day.

    Errors lie in binary event files, sign-ups in event XML, all others in text files;
    all names start with ``_``.
    """
    kind, day = F.col("event_type"), F.col("day")
    suffix = F.when(kind == "error", ".evtx").when(kind == "signup", ".xml").otherwise(".log")
    name = F.concat(F.lit("_"), kind, F.lit(" "), day, suffix)
    rows = views.rendered_events(spark, folder).select(name.alias("file_id"), "event_type", F.col("line_no").alias("id"), "line")
    element = F.concat(F.lit("<Event>\n"), F.regexp_replace("line", "[<>&]", "_"), F.lit("\n</Event>\n"))
    texts = rows.where(kind != "error").select(
        F.col("file_id").alias("name"), F.col("id").alias("part"),
        F.when(kind == "signup", element).otherwise(F.concat("line", F.lit("\n"))).cast("binary").alias("body"),
    )
    chunks = _event_chunks(rows.where(kind == "error"))
    pages = chunks.select(
        F.col("file_id").alias("name"), (F.col("chunk_no") + 1).cast("long").alias("part"), F.unhex(F.rpad("chunk", 131072, "0")).alias("body")
    )
    header = F.unhex(F.rpad(F.hex(F.lit("ElfFile")), 8192, "0"))
    heads = chunks.select(F.col("file_id").alias("name"), F.lit(0).cast("long").alias("part"), header.alias("body")).distinct()
    path = stages.new_path(spark)
    Store().write(texts.unionByName(pages).unionByName(heads), path)
    return path


def _mixed_lines(lines: DataFrame) -> DataFrame:
    short = F.regexp_extract(F.url_decode("file_id"), r"/_([^/]*)\.\w+$", 1)
    records = _record_fields(lines)
    binary = F.col("file_id").endswith(".evtx")
    return lines.where(~binary).select(short.alias("file_id"), "line_no", F.lit(None).cast("long").alias("record_id"), "line").unionByName(
        records.where(binary).withColumn("file_id", short)
    )


def mixed_log_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of mixed log files, read by suffix."""
    return _mixed_lines(text_files.read_logs(spark, _mixed_folder(spark, folder)))


def log_format_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same folder through ``spark.read.format``: from the second line on, with the filter in the plan."""
    index = LogFolder(spark, _mixed_folder(spark, folder))
    return _mixed_lines(log_format.read_indexed(spark, index).where("line_no >= 2"))


def ioc_tab(spark: SparkSession, folder: str) -> DataFrame:
    """The result tab of indicators: up to 100 values of a type."""
    return report.ioc_section(Analysis(views.event_log(spark, folder), kinds=extract.IOC_TYPES), 100)


def correlation_section(spark: SparkSession, folder: str) -> DataFrame:
    return report.correlation_section(_rule_analysis(views.event_log(spark, folder)))


def keyword_rule_report(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and counters when user rules run beside the built-in ones."""
    rules = RuleSet.builtin().plus_frame(_user_rules(spark))
    found = report.file_report(Analysis(views.event_log(spark, folder), rules, kinds=rollup.ALL))
    return found.select(
        "file_id", "total_lines", "rules_triggered", "techniques", "correlations", "threat_score", "threat_level",
        "detection_rules_total", "keyword_rules_loaded", "rule_categories",
    )


def _user_rules(spark: SparkSession) -> DataFrame:
    bodies = [("console_tools", KEYWORD_RULE), ("unread", "title: 2024"), ("broken", 'detection: {keywords: ["*foo("]}')]
    return keyword_rules.accepted(keyword_rules.parse_rules(spark.createDataFrame(bodies, "stem string, body string")))


def keyword_rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    rules = RuleSet.builtin().plus_frame(_user_rules(spark))
    found = _hits(spark, folder, RuleSet(tuple(r for r in rules if r.category == "Sigma Rule")))
    return findings.with_rule(rollup.hit_counts(found), rules.frame(spark)).select(
        "file_id", "rule_id", "cnt", "severity", "weight", "category", "technique_id", "description"
    )


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = views.table(spark, folder, "documents")
    return manifest.text_manifest(
        documents, F.col("doc_id"), F.col("text"), views.doc_lines(spark, folder)
    )


def _event_files(spark: SparkSession, folder: str, text: Column) -> str:
    """Path of text files written from the rendered events, one per event type and day."""
    path = stages.new_path(spark)
    rows = views.rendered_events(spark, folder).select("event_type", "day", "line_no", text.alias("value"))
    ordered = rows.repartition("event_type", "day").sortWithinPartitions("event_type", "day", "line_no")
    ordered.drop("line_no").write.partitionBy("event_type", "day").text(path)
    return path


def _short_id(rows: DataFrame) -> DataFrame:
    """Event type and day in place of a file's path."""
    short = F.regexp_extract("file_id", "event_type=(.*?/day=.*?)/", 1)
    return rows.withColumn("file_id", F.replace(short, F.lit("/day="), F.lit(" ")))


def text_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered events through text files and back: scan and line numbers."""
    return _short_id(text_files.read_log_lines(spark, _event_files(spark, folder, F.col("line"))))


def event_xml_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same as event XML, an element over three lines."""
    body = F.regexp_replace("line", "[<>&]", "_")
    xml = F.format_string("<Event xmlns='e'><System>\n<Data>%s</Data>\n</System></Event>", body)
    return _short_id(text_files.read_event_xml(spark, _event_files(spark, folder, xml)))


def file_manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Facts about the text files of the rendered events."""
    path = _event_files(spark, folder, F.col("line"))
    facts = manifest.file_manifest(spark, path, text_files.read_log_lines(spark, path))
    return _short_id(facts).drop("name")


def event_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Display forms of every document line: stripped, cut with and without dots."""
    lines = views.doc_lines(spark, folder).withColumn("content", strip(F.col("line")))
    return lines.select(
        "file_id", "line_no", "content",
        shortened(F.col("content"), 80).alias("snippet_80"),
        snippet(F.col("content"), 100).alias("snippet_100"),
        snippet(F.col("content"), 120).alias("snippet_120"),
        extract.event_time(F.col("line_no")).alias("time"),
    )


def queries() -> dict[str, Query]:
    """All named queries."""
    named: dict[str, Query] = {
        "lines_numbered": views.doc_lines,
        "page_lines_numbered": views.page_lines,
        "chat_records_numbered": views.chat_lines,
        "event_log_lines": views.event_log,
        "line_snippets": event_snippets,
        "text_scan": text_scan,
        "event_xml_scan": event_xml_scan,
        "file_manifest": file_manifest,
        "file_manifest_scan": file_manifest_scan,
        "timestamps": timestamps,
        "ip_counts": _token_query(extract.ip_tokens),
        "user_counts": _token_query(extract.user_tokens),
        "event_id_counts": _token_query(extract.event_id_tokens),
        "distinct_tokens": distinct_tokens,
        "log_period": lambda spark, folder: rollup.log_period(views.event_log(spark, folder)),
        "total_lines": lambda spark, folder: rollup.total_lines(views.doc_lines(spark, folder)),
        "top_ips": _top_query(extract.ip_tokens, 10),
        "top_users": _top_query(extract.user_tokens, 10),
        "top_users_30": _top_query(extract.user_tokens, 30),
        "top_event_ids_named": top_event_ids_named,
        "top_event_ids_short": top_event_ids_short,
        "relative_bars": relative_bars,
        "ioc_totals": ioc_totals,
        "ioc_capped": ioc_capped,
        "ioc_ipv4_docs": _ioc_query("ipv4", views.doc_lines),
        "ioc_domain_docs": _ioc_query("domain", views.doc_lines),
        "ioc_email_docs": _ioc_query("email", views.doc_lines),
        "ioc_url_pages": _ioc_query("url", views.whole_page_lines),
        "ioc_domain_pages": _ioc_query("domain", views.whole_page_lines),
        "hits_all": lambda spark, folder: _keys(_hits(spark, folder)),
        "hits_pages": lambda spark, folder: _keys(
            detect.hits(views.page_lines(spark, folder), RuleSet.builtin())),
        "hits_docs": lambda spark, folder: _keys(
            detect.hits(views.doc_lines(spark, folder), RuleSet.builtin())),
        "hits_chats": lambda spark, folder: _keys(
            detect.hits(views.chat_lines(spark, folder), RuleSet.builtin())),
        "hits_per_rule": hits_per_rule,
        "findings_first_n": findings_first_n,
        "findings_by_category": findings_by_category,
        "findings_summary": findings_summary,
        "findings_section": findings_section,
        "technique_hits": technique_hits,
        "technique_top20": technique_top20,
        "timeline_500": timeline_500,
        "correlation_matches": correlation_matches,
        "rule_scores": rule_scores,
        "threat_score": threat_score,
        "threat_level": threat_level,
        "recommendations": recommendations,
        "tactic_coverage": tactic_coverage,
        "raw_head": raw_head,
        "file_report": file_report,
        "page_report": page_report,
        "json_report": json_report,
        "stix_indicators": stix_indicators,
        "stix_bundle": stix_bundle,
        "keyword_rule_hits": keyword_rule_hits,
        "keyword_rule_report": keyword_rule_report,
        "event_record_decode": event_record_decode,
        "mixed_log_scan": mixed_log_scan,
        "log_format_scan": log_format_scan,
        "ioc_tab": ioc_tab,
        "correlation_section": correlation_section,
        "json_report_files": json_report_files,
        "json_report_export": json_report_export,
        "stix_export": stix_export,
        "null_lines": null_lines,
        "own_correlation": own_correlation,
        "rule_file_report": rule_file_report,
    }
    for kind in extract.IOC_TYPES:
        named[f"ioc_{kind}"] = _ioc_query(kind, views.event_log)
    for category in RuleSet.builtin().categories():
        rules = RuleSet.builtin().of_category(category)
        named[family_query(category)] = lambda spark, folder, rules=rules: _keys(_hits(spark, folder, rules))
    return named
