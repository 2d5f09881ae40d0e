"""Exports that can run again, their limits, and reports of hot and odd files."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from tests import plain
from tracelantern.operators import extract, rollup
from tracelantern.plans import dossier, report, stix
from tracelantern.plans.analysis import Analysis
from tracelantern.plans.report import Limits
from tracelantern.sources.store import Store
from tracelantern.tables.correlations import CORRELATIONS
from tracelantern.tables.ruleset import Rule, RuleSet

ROWS = [
    ("a/b c*.log", k, f"198.51.100.{k % 30} user=u{k % 25} whoami /all mail{k % 210}@ex{k % 210}.org") for k in range(700)
] + [("x", 0, None), ("x", 1, "2024-01-01 00:00:00 Failed password"), ("x", 200, "failed PASSWORD"), ("y" * 300, 5, "")]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(ROWS, "file_id string, line_no long, line string").repartition(5)


def test_files_are_replaced_and_ids_stay(spark, lines, tmp_path):
    analysis = Analysis(lines)
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")

    def export():
        objects = stix.stix_objects(stix.stix_indicators(analysis.iocs), at)
        assert report.write_json(report.documents(analysis).drop("generated"), str(tmp_path / "r"))[0] == 3
        stix.write_bundles(stix.stix_bundle(objects), str(tmp_path / "s"))
        return {p.relative_to(tmp_path): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}

    first = export()
    assert first == export() and len(first) == 4
    bundle = json.loads(next(body for path, body in first.items() if path.parts[0] == "s"))
    for made in bundle["objects"]:
        assert made["id"] == f"indicator--{uuid.uuid5(stix.NAMESPACE, made['pattern'])}"
        assert made["created"] == made["valid_from"] == "2024-05-06T07:08:09.000Z"
    assert uuid.UUID(bundle["id"].removeprefix("bundle--")).version == 5
    analysis.close()


def test_time_of_export_is_now_in_utc(spark, lines):
    import datetime

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        made = stix.stix_objects(stix.stix_indicators(Analysis(lines).iocs)).first().object.created
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    assert abs((datetime.datetime.fromisoformat(made.removesuffix("Z")) - now).total_seconds()) < 300


def test_limits_and_what_they_leave_out(spark, lines):
    analysis = Analysis(lines)
    key = "a/b c*.log"
    some, everything = (
        {r.file_id: json.loads(r.report) for r in report.as_json(report.documents(analysis, limits=limits)).collect()}[key]
        for limits in (Limits(), Limits(None, None, None, None, None))
    )
    hits = [n for f, n, r in plain.rule_hits(ROWS) if f == key and r == list(everything["findings_detail"])[0]]
    detail = everything["findings_detail"][list(everything["findings_detail"])[0]]
    assert [d["line"] for d in detail] == hits
    assert (len(some["top_ips"]), len(everything["top_ips"])) == (10, 30)
    assert (len(some["top_users"]), len(everything["top_users"])) == (10, 25)
    assert (len(some["iocs"]["email"]), len(everything["iocs"]["email"])) == (100, 210)
    out = {(r.file_id, r.part): r.left_out for r in dossier.left_out(analysis.rollup, Limits()).collect()}
    for rule, entries in some["findings_detail"].items():
        count = some["findings_summary"][rule]["count"]
        assert len(entries) == min(50, count) and out.get((key, rule), 0) == max(0, count - 50)
    assert (out[key, rollup.IP], out[key, rollup.USER], out[key, "email"]) == (20, 15, 110)
    indicators = {r.ioc_type: r.left_out for r in stix.left_out(analysis.iocs).collect()}
    assert indicators == {"email": 10, "domain": 10}
    assert stix.stix_indicators(analysis.iocs, None).count() == stix.stix_indicators(analysis.iocs).count() + 20


def test_one_row_per_file_and_rules_run_once(spark, lines):
    analysis = Analysis(lines)
    documents = report.documents(analysis)
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # no scan for rules beside that of the roll-up
    assert plan.count("Exchange hashpartitioning") <= 6
    flat = {r.file_id: r for r in report.file_report(analysis).collect()}
    assert {f: r.threat_score for f, r in flat.items()} == plain.scores(ROWS)
    assert (flat["x"].total_lines, flat["x"].log_start, flat["x"].log_end) == (3, "2024-01-01 00:00:00", "2024-01-01 00:00:00")
    assert "SortAggregate" not in report.file_report(analysis)._jdf.queryExecution().executedPlan().toString()


def test_added_correlation_and_overridden_rule(spark, lines):
    own = ("Own", "LOW", 9, ("failed_login", "failed_login"), "Own text")
    known = RuleSet.builtin()
    changed = known.plus([Rule("failed_login", "LOW", 1, "Authentication", "", "Changed", ("whoami",))])
    base, more, less = (
        {r.file_id: r for r in report.file_report(Analysis(lines, rules, correlations=rows, kinds=rollup.ALL)).collect()}
        for rules, rows in ((known, CORRELATIONS), (known, (*CORRELATIONS, own)), (changed, CORRELATIONS))
    )
    assert more["x"].threat_score == base["x"].threat_score + 9 and more["x"].correlations == base["x"].correlations + 1
    assert [r.rule_id for r in known] == [r.rule_id for r in changed]
    assert less["x"].rules_triggered == base["x"].rules_triggered - 1


def test_no_lines(spark):
    nothing = spark.createDataFrame([], "file_id string, line_no long, line string")
    analysis = Analysis(nothing)
    assert report.documents(analysis).count() == report.file_report(analysis).count() == 0
    assert Analysis(nothing, RuleSet(()), correlations=()).headline.count() == 0


def test_without_rules(spark, lines):
    found = report.file_report(Analysis(lines, RuleSet(()), correlations=(), kinds=rollup.ALL)).collect()
    assert {r.threat_score for r in found} == {0} and len(found) == 3


def test_many_files_lie_in_folders_and_tasks_read_them_back(spark, tmp_path):
    texts = spark.range(3000).select(F.format_string("f %d/é", "id").alias("file_id"), F.format_string("body %d", "id").alias("text"))
    assert report.write_by_file(texts, "text", str(tmp_path / "out"), ".txt", dealt=True)[0] == 3000
    folders = list((tmp_path / "out").iterdir())
    assert 100 < len(folders) <= 256 and all(f.is_dir() and len(f.name) == 2 for f in folders)
    # a name has the same place in every run
    assert report.write_by_file(texts.where("file_id LIKE 'f 7%'"), "text", str(tmp_path / "out"), ".txt", dealt=True)[0] == 111
    found = Store().read(spark, str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
    got = {r.name: bytes(r.body).decode() for r in found.collect()}
    assert got == {f"f+{k}%2F%C3%A9.txt": f"body {k}" for k in range(3000)}


def test_ranks_without_a_limit_take_one_window(spark, lines):
    indicators = stix.stix_indicators(Analysis(lines).iocs, None)
    assert indicators._jdf.queryExecution().executedPlan().toString().count("RunningWindowFunction") <= 1
    assert indicators._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_bundles_without_a_limit_are_shuffled_by_file_once(spark, lines, tmp_path):
    iocs = rollup.ioc_set(extract.iocs(lines))
    bundles = stix.stix_bundle(stix.stix_objects(stix.stix_indicators(iocs, None), F.lit("2024-05-06 07:08:09").cast("timestamp")))
    plan = bundles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of the set of indicators, and by file
    done = {}
    for whole in (False, True):
        done[whole] = stix.write_bundles(bundles, str(tmp_path / str(whole)), dealt=True, whole=whole)
    found = {whole: {p.name: p.read_bytes() for p in (tmp_path / str(whole)).rglob("*.json")} for whole in done}
    assert done[False] == done[True] and found[False] == found[True] and len(found[True]) == done[True][0] > 0


def test_steps_of_a_report_are_kept(spark, lines):
    analysis = Analysis(lines)
    plan = report.documents(analysis)._jdf.queryExecution().executedPlan().toString()
    # counters and rules, quoted lines and ranked rows are tables by then
    assert plan.count("Exchange hashpartitioning") <= 3 and "Window [" not in plan
    analysis.close()
