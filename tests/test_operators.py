"""Operators against plain loops on hand-written lines."""

import random
import re
from functools import reduce
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import plain
from tracelantern.functions.prefilter import _CASE_TWINS
from tracelantern.functions.dialect import to_java, to_re2
from tracelantern.functions.text import strip
from tracelantern.operators import chains, detect, extract, findings, rollup, score, tops
from tracelantern.plans import report, stix
from tracelantern.plans.analysis import Analysis
from tracelantern.sources.phrases import PHRASES
from tracelantern.tables import frames, lookups
from tracelantern.tables.correlations import CORRELATIONS
from tracelantern.tables.ruleset import Rule, RuleSet

SCHEMA = "file_id string, line_no long, line string"

EDGES = [
    "999.999.999.999 1.2.3.4.5 10.0.0.1 127.0.0.1 0.1.2.3 255.1.1.1",
    "user=a.b-c UserName: x account = y, USER root",
    "EventID 4625 EventID4625 eventid=46250 EventID: 4624",
    "aaaabbbbccccddddaaaabbbbccccdddd aaaabbbbccccddddaaaabbbbccccddde",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709 x" + "0123456789abcdef" * 4,
    "2024-01-02T03:04:05 then 2023-01-02 03:04:05",
    "see HTTP://x.com https://a.example.co.uk/p?q=1 'http://b.de/x'",
    "mail a.b+c@d-e.org A@B.COM cve-2024-1111 CVE-2024-12345678",
    "énmap nmap\u00e9 \u0131d \u212aerberoast p\u017fexec \u0130D nmap",
    "\u00a0\t padded \x1c\u2003",
    "carriage\rreturn .*\u0085next: user=\u0661 EventID=\u0661\u0662",
    "ignore all previous\rinstruct here; TXT a\u0085base64",
    "renamed x.locked", "x.locked now",
    "multi\nline reg save\nSAM and reg save x SAM",
    "", None,
    r"..\..\x \\host\C$ \x90\x90 \\x9000 \Startup\ ",
    "MULTIPLE words with RECORD then A rotation; alert ( 1 )",
]


@pytest.fixture(scope="module")
def rows():
    mixed = [(f"f{i % 7}", i + 1, line) for i, line in enumerate(list(PHRASES) + EDGES)]
    return mixed + [("long", 1, " ".join(random.Random(1).choices(["txt", "a", "record", "base6", "id"], k=20000)))]


@pytest.fixture(scope="module")
def lines(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def pairs(frame):
    return {tuple(r) for r in frame.collect()}


def test_every_rule_as_python_searches(lines, rows):
    found = [tuple(r) for r in detect.hits(lines, RuleSet.builtin()).select("file_id", "line_no", "rule_id").collect()]
    assert Counter(found) == Counter(plain.rule_hits(rows))
    fired = {rule_id for _, _, rule_id in found}
    assert fired == {r.rule_id for r in RuleSet.builtin()}


def test_rule_without_literal_words_and_user_rule_order(spark, lines):
    digits = Rule("digits", "LOW", 5, "Own", "", "d", (r"\d\d:\d\d",))
    changed = Rule("xss", "LOW", 1, "Own", "", "d", ("padded",))
    rules = RuleSet.builtin().plus([digits, changed])
    assert len(rules) == 144
    assert [r.rule_id for r in rules][73] == "xss"
    found = pairs(detect.hits(lines, RuleSet((digits, changed))).select("line", "rule_id"))
    assert found == {
        (line, rule.rule_id)
        for line in EDGES + list(PHRASES) if line
        for rule in (digits, changed) if re.search(rule.patterns[0], line, re.I)
    }


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(PHRASES), st.sampled_from(PHRASES), st.integers(0, 60),
                          st.sampled_from(["", "é", "\u017f", "_", "\n", " ", "K"])), min_size=1, max_size=20))
def test_spliced_lines(spark, parts):
    rows = [("f", n, a[:cut] + glue + b[cut // 2:].swapcase()) for n, (a, b, cut, glue) in enumerate(parts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in detect.hits(frame, RuleSet.builtin()).select("file_id", "line_no", "rule_id").collect()]
    assert Counter(found) == Counter(plain.rule_hits(rows))


@pytest.mark.parametrize("pattern", [
    r"\bab\b", r"\Bb", r"[\w-]+", r"[^\s\d]+", r"\W\S\D", r"a{2}", r"a{,2}b", r"a{x", r"[[a]b", r"[]a]c", r"[^]]d",
    r"[a&&b]", r"\w+$", r"é\b", r".+", r"\bx?y", r"\b[a-c]+\b", r"\b(?:a|ab|\d)+\b", r"\b[a-c.]+\b", r"\b(?:x|)y\b",
])
def test_dialect(spark, pattern):
    texts = ["ab", "éab", "ab_", "a-b c", "aab", "b", "a{x", "[b", "ab]c", "xd]d", "a&b", "x\n", "x\r", "né e\u0301",
             "\u0661²", "a\x1cb", "y", "xy", " y", "ay", "\u0085", "a\u0085b"]
    frame = spark.createDataFrame([(t,) for t in texts], "line string")
    for ignore_case in (False, True):
        flags = re.I if ignore_case else 0
        java = to_java(pattern, ignore_case)
        found = [r[0] for r in frame.select(F.regexp_extract_all("line", F.lit(java), F.lit(0))).collect()]
        assert found == [[m.group() for m in re.finditer(pattern, t, flags)] for t in texts]


def test_linear_time_form_of_every_rule():
    """Every built-in pattern has one, and it agrees with Python on any text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [t for t in [*PHRASES, *EDGES, "x.locked\n", "a\x1cb; id"] if t]
    texts += [t.replace(" ", "é") for t in texts] + [t.replace(" ", " é ") for t in texts] + ["é" + t + "é" for t in texts]
    texts += ["wmic/node", "wmicé/node", "wmic é /node", "wmicx /node", "éid", "id", "idé", "id é", "; idé", "; id\n"]
    folded = [reduce(lambda text, twin: text.replace(*twin), _CASE_TWINS, t).lower() for t in texts]
    for rule in RuleSet.builtin():
        for pattern in rule.patterns:
            found = pc.match_substring_regex(pa.array(folded), "(?i)" + to_re2(pattern)).to_pylist()
            assert found == [bool(re.search(pattern, t, re.I)) for t in texts], pattern
    for pattern in (r"(?=a)b", r"(a)\1", r"[\S]a", r"ß", r"(?i)a", r"a++", r"a\bb", r"\d\Bz"):
        assert to_re2(pattern) is None


@pytest.mark.parametrize("line", [
    "é id_ " + "enum " * 200_000, "é psexecx wmicx " * 60_000, "é cobaltx meterpreterx sliverx havocx " * 30_000,
    "é nmapx zmapx " * 80_000, "é verx winverx " * 70_000, "é mimikatzx lsadumpx " * 50_000, "; é lsx catx idx " * 60_000, "é minerdx " * 100_000,
])
def test_long_accented_near_misses(spark, line):
    """Lines of a megabyte that nearly match take seconds, not the square of their length."""
    frame = spark.createDataFrame([("f", 1, line)], SCHEMA)
    assert detect.hits(frame, RuleSet.builtin()).where("rule_id IN ('user_enumeration', 'lateral_movement', 'command_and_control', "
                                                        "'network_scan', 'credential_dumping', 'command_injection')").count() == 0


def test_domains_of_any_line(spark):
    import time

    from tracelantern.tables.lookups import IOC_PATTERNS

    pattern = dict(IOC_PATTERNS)["domain"]
    texts = ["éa.com", "a.comé b.org", "é.a.net é", "x_a.com a.com_ -a.com a-.com a--b.co.uk", "a.b.c.d.com.e.com.x", "\x01a.com\x02b.ru", "…a.io…b.cc"]
    texts += ["a." * 300 + "com", "q" * 70 + ".com " + "q" * 63 + ".com", None]
    frame = spark.createDataFrame([("f", n, t) for n, t in enumerate(texts)], SCHEMA)
    found = Counter((r.line_no, r.value) for r in extract.iocs(frame, ("domain",)).collect())
    assert found == Counter((n, v) for n, t in enumerate(texts) if t for v in re.findall(pattern, t))
    long_ = spark.createDataFrame([("f", 1, "a." * 500_000 + " x.com " + "b.com " * 100_000)], SCHEMA)
    start = time.time()
    assert extract.iocs(long_, ("domain",)).count() == 100_001
    assert time.time() - start < 60


def test_many_and_large_user_rules(spark):
    own = [Rule(f"r{n}", "LOW", 1, "Own", "", "d", (f"größe{n}x", f"été {n}")) for n in range(1000)]
    large = Rule("large", "LOW", 1, "Own", "", "d", tuple(f"keyword {n} end" for n in range(50_000)))
    looking = [Rule(f"l{n}", "LOW", 1, "Own", "", "d", (f"look(?!no){n}z",)) for n in range(300)]
    rows = [("f", 1, "GRÖSSE GRÖßE7X and Été 12"), ("f", 2, "a KEYWORD 49999 end"), ("f", 3, "look7z"), ("f", 4, "keyword 50000 end")]
    found = detect.hits(spark.createDataFrame(rows, SCHEMA), RuleSet((*own, large, *looking)))
    assert pairs(found.select("line_no", "rule_id")) == {(1, "r7"), (1, "r1"), (1, "r12"), (2, "large"), (3, "l7")}


def test_rules_that_need_the_exact_search(spark):
    patterns = (r"(a)\1", r"x(?!y)", r"\bkö", r"é+$", r"(?s)p.q", r"\d\Bz")
    rules = RuleSet(tuple(Rule(f"r{n}", "LOW", 1, "Own", "", "d", (p,)) for n, p in enumerate(patterns)))
    rows = [("f", n, t) for n, t in enumerate(["AA", "xz xy", "xy", "KÖ", "akö", "É", "é\n", "p\nq", "1z", "\u0661z é"])]
    found = pairs(detect.hits(spark.createDataFrame(rows, SCHEMA), rules).select("line_no", "rule_id"))
    assert found == {(n, r.rule_id) for _, n, t in rows for r in rules if re.search(r.patterns[0], t, re.I)}


def test_strip(spark):
    texts = ["\u00a0\t x y \x1c\u2003", "\x1f\x85", "", "no"]
    frame = spark.createDataFrame([(t,) for t in texts], "line string")
    assert [r[0] for r in frame.select(strip(F.col("line"))).collect()] == [t.strip() for t in texts]


def test_tokens(lines, rows):
    for operator, pattern, flags in (
        (extract.ip_tokens, lookups.IP_TOKEN, 0),
        (extract.user_tokens, lookups.USER_TOKEN, re.I),
        (extract.event_id_tokens, lookups.EVENT_ID_TOKEN, re.I),
    ):
        counts = rollup.token_counts(operator(lines))
        found = {(r.file_id, r.value): r.cnt for r in counts.collect()}
        assert found == plain.tokens(rows, pattern, flags)


def test_very_long_lines(spark):
    """Lines that exhaust a recursive or a backtracking search."""
    rows = [
        ("f", 1, "a." * 20000 + "com x.org"),
        ("f", 2, "rotation multiple " + "a record " * 20000),
        ("f", 3, "é rotation multiple a record"),
        ("f", 4, "1." * 5000),
    ]
    lines = spark.createDataFrame(rows, SCHEMA)
    assert pairs(detect.hits(lines, RuleSet.builtin()).select("line_no", "rule_id")) == set()
    assert pairs(extract.iocs(lines, ("domain",)).select("line_no", "value")) == {
        (1, "a." * 20000 + "com"), (1, "x.org")}
    assert {(r.line_no, r.value) for r in extract.iocs(lines, ("ipv4",)).collect()} == {(4, "1.1.1.1")}


def test_iocs_and_period(lines, rows):
    assert pairs(rollup.ioc_set(extract.iocs(lines)).drop("first_seen")) == plain.indicators(rows)
    found = {r.file_id: (r.log_start, r.log_end) for r in rollup.log_period(lines).collect()}
    assert found == plain.first_and_last_stamp(rows)


def test_one_pass_roll_up_equals_the_single_operators(lines, rows):
    analysis = Analysis(lines)
    rules = RuleSet.builtin()
    assert pairs(analysis.ip_counts) == pairs(rollup.token_counts(extract.ip_tokens(lines)))
    assert pairs(analysis.user_counts) == pairs(rollup.token_counts(extract.user_tokens(lines)))
    assert pairs(analysis.event_id_counts) == pairs(rollup.token_counts(extract.event_id_tokens(lines)))
    assert pairs(analysis.iocs) == pairs(rollup.ioc_set(extract.iocs(lines)))
    assert pairs(analysis.hit_counts) == pairs(rollup.hit_counts(detect.hits(lines, rules)))
    assert pairs(analysis.files) == set(Counter(r[0] for r in rows).items())


def test_scores(lines, rows):
    found = {r.file_id: r.threat_score for r in Analysis(lines).scores.collect()}
    assert found == plain.scores(rows)


@pytest.mark.parametrize("n, weight, wanted", [
    (1, 20, 20.0), (2, 20, 26.0), (5, 20, 44.0), (6, 20, 46.0), (100, 20, 234.0), (1, 1, 1.0), (4, 1, 1.9),
])
def test_rule_score(spark, n, weight, wanted):
    counts = spark.createDataFrame([("f", "r", n, 1)], "file_id string, rule_id string, cnt long, first_seen long")
    rules = RuleSet((Rule("r", "LOW", weight, "c", "", "d", ("x",)),)).frame(spark)
    assert score.rule_scores(counts, rules).first().rule_score == pytest.approx(wanted)


def test_sample_score_of_two_rules(spark):
    rows = [("f", 1, "logon"), ("f", 2, "ANONYMOUS LOGON by NTLM V1"), ("f", 3, "ANONYMOUS LOGON off")]
    two = RuleSet(tuple(r for r in RuleSet.builtin() if r.rule_id in ("anonymous_logon", "ntlm_downgrade")))
    row = Analysis(spark.createDataFrame(rows, SCHEMA), two).scores.first()
    assert (row.threat_score, row.threat_level) == (46, "MEDIUM")


def test_levels(spark):
    frame = spark.createDataFrame([(n,) for n in (0, 19, 20, 39, 40, 59, 60, 79, 80, 100)], "s int")
    levels = [r[0] for r in frame.select(score.threat_level(F.col("s"))).collect()]
    assert levels == ["MINIMAL"] * 2 + ["LOW"] * 2 + ["MEDIUM"] * 2 + ["HIGH"] * 2 + ["CRITICAL"] * 2


def test_correlations_need_all_rules_in_one_file(spark):
    rows = []
    for name, _, _, needed, _ in CORRELATIONS:
        rows += [(f"all {name}", r) for r in needed]
        rows += [(f"less {name}", r) for r in needed[1:]]
        rows += [(f"split {name} {i}", r) for i, r in enumerate(needed)]
    counts = spark.createDataFrame(rows, "file_id string, rule_id string")
    found = pairs(chains.correlation_matches(counts, frames.correlations(spark)).select("file_id", "name"))
    assert found == {(f"all {c[0]}", c[0]) for c in CORRELATIONS}


def test_recommendations_and_default(spark):
    counts = spark.createDataFrame(
        [("a", "ransomware"), ("a", "uac_bypass"), ("a", "privilege_escalation"), ("c", "xss")],
        "file_id string, rule_id string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_id string")
    matches = spark.createDataFrame([("b", "Full Kill Chain Detected")], "file_id string, name string")
    found = pairs(chains.recommendations(files, counts, matches, frames.recommendations(spark)).select("file_id", "rec_ord", F.substring("recommendation", 1, 8)))
    assert found == {("a", 3, "CRITICAL"), ("a", 7, "Audit pr"), ("b", 13, "CRITICAL"), ("c", 1, "Continue")}


def test_tactics(spark):
    techniques = spark.createDataFrame(
        [("a", "Valid Accounts"), ("a", "Exfil Over Alt Protocol - DNS"), ("b", None)],
        "file_id string, technique_name string")
    found = chains.tactic_coverage(techniques)
    assert found.count() == 22
    assert pairs(found.where("detected").select("file_id", "tactic")) == {("a", "Initial Access / Auth"), ("a", "C2")}


def test_top_ties_go_to_the_first_seen(spark):
    rows = [("f", 1, "10.0.0.9 10.0.0.1"), ("f", 2, "10.0.0.5"), ("f", 3, "10.0.0.5 10.0.0.7")]
    counts = rollup.token_counts(extract.ip_tokens(spark.createDataFrame(rows, SCHEMA)))
    top = tops.top_tokens(counts, 3).orderBy("rank").collect()
    assert [r.value for r in top] == ["10.0.0.5", "10.0.0.9", "10.0.0.1"]


def test_timeline_sorts_time_as_text(spark):
    rows = [("f", 9, "nmap"), ("f", 10, "nmap"), ("f", 11, "2024-01-01T00:00:00 nmap"), ("f", 12, "2024-01-01 23:00:00 nmap")]
    rules = RuleSet(tuple(r for r in RuleSet.builtin() if r.rule_id == "network_scan"))
    hits = detect.hits(spark.createDataFrame(rows, SCHEMA), rules)
    events = findings.first_events(findings.timeline(hits, rules.frame(spark)), 3).orderBy("rank").collect()
    assert [r.time for r in events] == ["2024-01-01 23:00:00", "2024-01-01T00:00:00", "Line 10"]


def test_hot_file_and_hot_rule(spark):
    """A third of all rows in one file, nearly all of one rule, in many small tasks."""
    lines = spark.range(0, 30000, 1, 200).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("file_id"),
        (F.col("id") + 1).alias("line_no"),
        F.concat(F.lit("xmrig started from 10.0.0."), (F.col("id") % 200).cast("string")).alias("line"),
    )
    first = findings.first_findings(detect.hits(lines, RuleSet.builtin()), 50)
    hot = first.where("file_id = 'hot' and rule_id = 'xmrig_detect'").orderBy("rank").collect()
    assert [r.line_no for r in hot] == [3 * n + 1 for n in range(50)]
    analysis = Analysis(lines)
    assert analysis.files.where("file_id = 'hot'").first().total_lines == 10000
    top = analysis.top_ips(10).where("file_id = 'hot'").orderBy("rank").collect()
    assert [(r.value, r.cnt) for r in top] == [(f"10.0.0.{3 * n % 200}", 50) for n in range(10)]


def test_document_and_json(spark, lines, rows):
    import json

    analysis = Analysis(lines)
    documents = {r.file_id: json.loads(r.report) for r in report.as_json(report.documents(analysis)).collect()}
    assert set(documents) == {r[0] for r in rows}
    document = documents["f0"]
    assert list(document) == [
        "tool", "version", "generated", "file", "file_md5", "file_sha256", "file_size_bytes", "total_lines",
        "log_start", "log_end", "unique_ips", "unique_users", "threat_score", "threat_level", "top_ips", "top_users",
        "event_id_summary", "detection_rules_total", "sigma_rules_loaded", "detection_rules_triggered",
        "mitre_techniques_detected", "correlations", "iocs", "findings_summary", "findings_detail",
    ]
    wanted = [h for h in plain.rule_hits(rows) if h[0] == "f0"]
    assert list(document["findings_summary"]) == list(dict.fromkeys(h[2] for h in wanted))
    assert {k: v["count"] for k, v in document["findings_summary"].items()} == Counter(h[2] for h in wanted)
    text = {(f, n): line for f, n, line in rows}
    assert document["findings_detail"] == {
        rule_id: [{"line": n, "content": text["f0", n].strip()} for _, n, r in wanted if r == rule_id][:50]
        for rule_id in document["findings_summary"]
    }
    assert all(isinstance(ip, str) and isinstance(n, int) for ip, n in document["top_ips"])
    assert document["iocs"] == {
        kind: sorted(v for f, k, v in plain.indicators(rows) if (f, k) == ("f0", kind))
        for kind in document["iocs"]
    }


def test_stix_bundle(spark, lines):
    import json

    indicators = stix.stix_indicators(Analysis(lines).iocs)
    assert indicators.where("ioc_type = 'cve'").count() == 0
    bundle = json.loads(stix.stix_bundle(stix.stix_objects(indicators)).first().bundle)
    assert bundle["type"] == "bundle" and bundle["id"].startswith("bundle--")
    assert list(bundle["objects"][0]) == ["type", "spec_version", "id", "created", "modified", "name", "pattern",
                                          "pattern_type", "valid_from", "labels"]
    assert len({o["id"] for o in bundle["objects"]}) == len(bundle["objects"])


def test_hash_pattern_in_stix(spark):
    frame = spark.createDataFrame([("sha1", "ab"), ("url", "http://x")], "ioc_type string, value string")
    found = [r[0] for r in frame.select(stix.stix_pattern(F.col("ioc_type"), F.col("value"))).collect()]
    assert found == ["[file:hashes.'SHA1' = 'ab']", "[url:value = 'http://x']"]
