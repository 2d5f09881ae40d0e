"""DuckDB SQL that states what each named query returns.

Built from the same fixed rows as the engine, but with its own logic: RE2 regexes,
plain joins and windows.  RE2 reads ``\\b \\d \\s`` as ASCII, so texts that may hold
other letters go through ``ascii_view`` first, which keeps every boundary in place.
"""

import uuid

from tracelantern.sources.phrases import PHRASES
from tracelantern.tables import lookups
from tracelantern.tables.correlations import CORRELATIONS
from tracelantern.tables.rules import DETECTION_RULES
from tracelantern.tables.techniques import TECHNIQUES
from tracelantern.plans.catalog import family_query
from tracelantern.functions.text import WHITESPACE


def q(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(q(v) for v in value) + "]" if value else "[]::VARCHAR[]"
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ",\n".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES\n{body})"


EVENT_LOG = f"""event_log AS (
  SELECT user_id::VARCHAR || strftime(ts, '-%Y-%m-%d') AS file_id,
         event_id + 1 AS line_no,
         concat_ws(' ',
           CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                           WHEN 'purchase' THEN '-'
                           ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END,
           CASE event_type WHEN 'error' THEN 'EventID=4625' WHEN 'signup' THEN 'EventID: 4720'
                           WHEN 'purchase' THEN 'EventID 4663' WHEN 'click' THEN 'EventID=4624'
                           ELSE 'audit' END,
           'user=u' || user_id::VARCHAR,
           'src=198.51.' || (user_id % 200)::VARCHAR || '.' || (event_id % 97)::VARCHAR,
           CASE event_type
             WHEN 'error' THEN 'sha256=' || sha256(event_id::VARCHAR) || ' ref CVE-2024-' || (10000 + event_id % 5000)::VARCHAR
             WHEN 'signup' THEN 'sha1=' || sha1(event_id::VARCHAR) || ' mail u' || user_id::VARCHAR || '@corp' || (event_id % 7)::VARCHAR || '.org'
             WHEN 'purchase' THEN 'md5=' || md5(event_id::VARCHAR)
             WHEN 'view' THEN 'page http://h' || user_id::VARCHAR || '.example.com/p/' || event_id::VARCHAR
             ELSE '-' END,
           {q(PHRASES)}[event_id % {len(PHRASES)} + 1]) AS line
  FROM events)"""


def split_view(name: str, table: str, key: str, text: str) -> str:
    return rf"""{name} AS (
  SELECT file_id, unnest(generate_series(1, len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT {key}::VARCHAR AS file_id,
               string_split_regex(regexp_replace({text}, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS parts
        FROM {table} WHERE {text} <> ''))"""


DOC_LINES = split_view("doc_lines", "documents", "doc_id", "text")
PAGE_LINES = split_view("page_lines", "pages", "page_id", "html")
WHOLE_PAGES = (PAGE_LINES, """whole_pages AS (
  SELECT file_id, line_no, line FROM page_lines UNION ALL SELECT page_id::VARCHAR, 0, url FROM pages)""")
CHAT_LINES = """chat_lines AS (
  SELECT conv_id::VARCHAR AS file_id, turn + 1 AS line_no, text AS line FROM conversations)"""

_WIDE_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def ascii_view(name: str, source: str) -> str:
    """Lines with other letters and digits as _, other spaces as a space, other marks as \\x01."""
    spaced = rf"regexp_replace(line, '[{_WIDE_SPACE}]', ' ', 'g')"
    marked = rf"regexp_replace({spaced}, '[^\x00-\x7F\p{{L}}\p{{N}}]', chr(1), 'g')"
    return rf"""{name} AS (
  SELECT file_id, line_no, regexp_replace({marked}, '[^\x00-\x7F]', '_', 'g') AS line FROM {source})"""


def hits_cte(source: str, rules=DETECTION_RULES, name: str = "hits") -> str:
    cases = ",\n".join(
        "CASE WHEN regexp_matches(line, " + q("(?i)" + "|".join(f"(?:{p})" for p in r[6])) + f") THEN {q(r[0])} END"
        for r in rules
    )
    return f"""{name} AS (
  SELECT * FROM (SELECT file_id, line_no, line, unnest([{cases}]) AS rule_id FROM {source})
  WHERE rule_id IS NOT NULL)"""


def rule_rows(rules) -> str:
    return values(
        "rules", "rule_ord, rule_id, severity, weight, category, technique_id, description",
        [(n, *r[:6]) for n, r in enumerate(rules, 1)],
    )


RULES = rule_rows(DETECTION_RULES)
TECHNIQUE_ROWS = values("techniques", "technique_id, technique_name", TECHNIQUES)
CORRELATION_ROWS = values(
    "correlation_rows", "corr_ord, name, severity, score_boost, requires, description",
    [(n, *c) for n, c in enumerate(CORRELATIONS, 1)],
)
COUNTS = """counts AS (
  SELECT file_id, rule_id, count(*) AS cnt, min(line_no) AS first_line FROM hits GROUP BY ALL)"""
RULED = """ruled AS (
  SELECT counts.*, severity, weight, category, technique_id, description, rule_ord
  FROM counts JOIN rules USING (rule_id))"""
MATCHES = """matches AS (
  SELECT f.file_id, c.corr_ord, c.name, c.severity, c.score_boost, c.requires, c.description
  FROM (SELECT file_id, list(rule_id) AS fired FROM counts GROUP BY file_id) f
  JOIN correlation_rows c ON list_has_all(f.fired, c.requires))"""
SCORED = """scored AS (
  SELECT file_id, rule_id, cnt, weight, first_line, rule_ord,
         CASE WHEN cnt = 1 THEN weight::DOUBLE
              WHEN cnt <= 5 THEN weight::DOUBLE + (cnt - 1) * (weight::DOUBLE * 0.3::DOUBLE)
              ELSE weight::DOUBLE + 4 * (weight::DOUBLE * 0.3::DOUBLE) + (cnt - 5) * (weight::DOUBLE * 0.1::DOUBLE)
         END AS rule_score
  FROM ruled)"""
FILES = "files AS (SELECT file_id, count(*) AS total_lines FROM {source} GROUP BY file_id)"
SCORES = f"""scores AS (
  SELECT file_id, threat_score,
         CASE {" ".join(f"WHEN threat_score >= {floor} THEN {q(name)}" for floor, name in lookups.THREAT_LEVELS)}
              ELSE {q(lookups.LOWEST_LEVEL)} END AS threat_level
  FROM (SELECT file_id, least(floor(coalesce(from_rules, 0) + coalesce(from_chains, 0)), 100)::INT AS threat_score
        FROM files
        LEFT JOIN (SELECT file_id, sum(rule_score ORDER BY first_line, rule_ord) AS from_rules
                   FROM scored GROUP BY file_id) USING (file_id)
        LEFT JOIN (SELECT file_id, sum(score_boost) AS from_chains FROM matches GROUP BY file_id) USING (file_id)))"""
TECHNIQUE_HITS = """technique_hits AS (
  SELECT r.file_id, r.technique_id, any_value(t.technique_name) AS technique_name, sum(cnt)::BIGINT AS hits,
         min((first_line, rule_ord)) AS seen
  FROM ruled r LEFT JOIN techniques t USING (technique_id)
  WHERE r.technique_id <> '' GROUP BY r.file_id, r.technique_id)"""


def token_cte(name: str, source: str, pattern: str, group: int, flags: str = "") -> str:
    found = f"regexp_extract_all(line, {q(flags + pattern)}, {group})"
    return f"""{name} AS (
  SELECT file_id, line_no, unnest(generate_series(0, len(found) - 1)) AS place, unnest(found) AS value
  FROM (SELECT file_id, line_no, {found} AS found FROM {source}))"""


IPS = token_cte("ips", "event_log", lookups.IP_TOKEN, 1)
USERS = token_cte("users", "event_log", lookups.USER_TOKEN, 1, "(?i)")
EVENT_IDS = token_cte("event_ids", "event_log", lookups.EVENT_ID_TOKEN, 1, "(?i)")
STAMPS = token_cte("stamps", "event_log", lookups.TIMESTAMP_TOKEN, 0)
IOC_PATTERNS = dict(lookups.IOC_PATTERNS)
IOC_NOISE = {
    **{kind: "len(list_distinct(string_split(value, ''))) > 4" for kind in ("md5", "sha1", "sha256")},
    "ipv4": "NOT (value LIKE '0.%' OR value LIKE '127.%' OR value LIKE '255.%')",
}


def ioc_select(kind: str, source: str, pattern: str | None = None) -> str:
    found = f"regexp_extract_all(line, {q(pattern or IOC_PATTERNS[kind])})"
    return f"""SELECT file_id, line_no, {q(kind)} AS ioc_type, value
  FROM (SELECT file_id, line_no, unnest({found}) AS value FROM {source}) WHERE {IOC_NOISE.get(kind, 'true')}"""


IOC_KINDS = list(IOC_PATTERNS)
IOCS = "iocs AS (\n" + "\nUNION ALL\n".join(ioc_select(k, "event_log") for k in IOC_KINDS) + ")"
IOC_SET = "ioc_set AS (SELECT DISTINCT file_id, ioc_type, value FROM iocs)"
NAMES = values("names", "value, event_name", [(i, name) for i, name, _ in lookups.EVENT_ID_NAMES])
SHORT_NAMES = values("names", "value, event_name", [(i, s) for i, _, s in lookups.EVENT_ID_NAMES if s])
LABELS = values("labels_of", "ioc_ord, ioc_type, ioc_label",
                [(n, *row) for n, row in enumerate(lookups.IOC_LABELS, 1)])
ADVICE = values("advice", "rec_ord, any_rule, any_corr, recommendation",
                [(n, list(r), c, t) for n, (r, c, t) in enumerate(lookups.RECOMMENDATIONS, 1)])
STRIPPED = "trim(line, " + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
EVENT_TIME = (
    f"coalesce(nullif(regexp_extract(line, {q(lookups.TIMESTAMP_TOKEN)}), ''), 'Line ' || line_no::VARCHAR)"
)
PERIOD = """period AS (
  SELECT file_id, arg_min(value, (line_no, place)) AS log_start, arg_max(value, (line_no, place)) AS log_end
  FROM stamps GROUP BY file_id)"""
HEADLINE = """headline AS (
  SELECT f.file_id, f.total_lines, coalesce(i.n, 0) AS unique_ips, coalesce(u.n, 0) AS unique_users,
         coalesce(e.n, 0) AS unique_event_ids, coalesce(r.n, 0) AS rules_triggered, coalesce(o.n, 0) AS total_iocs,
         coalesce(t.n, 0) AS techniques, coalesce(c.n, 0) AS correlations, s.threat_score, s.threat_level
  FROM files f JOIN scores s USING (file_id)
  LEFT JOIN (SELECT file_id, count(DISTINCT value) AS n FROM ips GROUP BY 1) i USING (file_id)
  LEFT JOIN (SELECT file_id, count(DISTINCT value) AS n FROM users GROUP BY 1) u USING (file_id)
  LEFT JOIN (SELECT file_id, count(DISTINCT value) AS n FROM event_ids GROUP BY 1) e USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n FROM counts GROUP BY 1) r USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n FROM ioc_set GROUP BY 1) o USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n FROM technique_hits GROUP BY 1) t USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS n FROM matches GROUP BY 1) c USING (file_id))"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


EVENT_HITS = (EVENT_LOG, hits_cte("event_log"))
EVENT_COUNTS = (*EVENT_HITS, COUNTS, RULES, RULED)
EVENT_SCORES = (
    *EVENT_COUNTS, FILES.format(source="event_log"), CORRELATION_ROWS, MATCHES, SCORED, SCORES,
)
EVENT_HEADLINE = (
    *EVENT_SCORES, IPS, USERS, EVENT_IDS, IOCS, IOC_SET, TECHNIQUE_ROWS, TECHNIQUE_HITS, HEADLINE,
)


# The built-in rules and the user rule of ``plans.catalog``.
WITH_USER_RULE = (*DETECTION_RULES, (
    "sigma_console_tools", "HIGH", 25, "Sigma Rule", "T1059.001", "Console tools in service sessions",
    ("whoami /all", "net view", ".*powershell.*hidden", "systeminfo collected"),
))
# The built-in rules and those of the rule files of ``plans.catalog``.
WITH_RULE_FILES = (
    *DETECTION_RULES,
    ("sigma__odd name", "CRITICAL", 40, "Sigma Rule", "", "Odd name", ("net view",)),
    ("sigma_console_tools", "LOW", 5, "Sigma Rule", "T1135", "Only views", ("net view", "vssadmin")),
)
OWN_CORRELATION_ROWS = values(
    "correlation_rows", "corr_ord, name, severity, score_boost, requires, description",
    [(n, *c) for n, c in enumerate((*CORRELATIONS, (
        "Login then account", "HIGH", 7, ("account_creation", "failed_login"), "A failed login and a new account in one log",
    )), 1)],
)
NULLED_LOG = (
    EVENT_LOG.replace("event_log AS", "raw_log AS", 1),
    "event_log AS (SELECT file_id, line_no, CASE WHEN NOT contains(line, ' audit ') THEN line END AS line FROM raw_log)",
)
# UUID of version 5 in the name space of version 5 of 'tracelantern' among domain names.
UUID_OF_PATTERN = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
EXPORT_SPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "tracelantern").hex
# Rendered events as files, one per event type and day.
FILE_LOG = (
    EVENT_LOG.replace("event_log AS", "rendered AS", 1),
    """event_log AS (
  SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS file_id, line,
         row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS line_no
  FROM rendered JOIN events ON event_id + 1 = rendered.line_no)""",
    """manifest AS (
  SELECT file_id, md5(body) AS md5, sha256(body) AS sha256, strlen(body) AS size
  FROM (SELECT file_id, string_agg(line || chr(10), '' ORDER BY line_no) AS body FROM event_log GROUP BY 1))""",
)


def counted(tokens: str) -> str:
    return f"""counted AS (
  SELECT file_id, value, count(*) AS cnt, min((line_no, place)) AS seen, min(line_no) AS first_line
  FROM {tokens} GROUP BY file_id, value)"""


def ranked(n: int) -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cnt DESC, seen) AS rank FROM counted
  QUALIFY rank <= {n})"""


def token_counts(cte: str, name: str) -> str:
    return sql("SELECT file_id, value, cnt, first_line FROM counted", EVENT_LOG, cte, counted(name))


def top_tokens(cte: str, name: str, n: int) -> str:
    return sql("SELECT file_id, value, cnt, first_line, rank FROM ranked",
               EVENT_LOG, cte, counted(name), ranked(n))


def ioc_query(kind: str, view: str, source: str, *more: str, pattern: str | None = None) -> str:
    return sql("SELECT DISTINCT file_id, value FROM found",
               view, *more, f"found AS ({ioc_select(kind, source, pattern)})")


def tactic_case() -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(technique_name, {q(w)})" for w in words) + f" THEN {q(tactic)}"
        for tactic, words in lookups.TACTIC_WORDS
    )
    return f"CASE {whens} END"


def stix_case() -> str:
    return "CASE ioc_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lookups.STIX_TYPES) + " END"


def top_list(name: str, tokens: str, n: int) -> str:
    return f"""{name} AS (
  SELECT file_id, to_json(list(json_array(value, cnt) ORDER BY cnt DESC, seen)[1:{n}]) AS listed
  FROM (SELECT file_id, value, count(*) AS cnt, min((line_no, place)) AS seen FROM {tokens} GROUP BY file_id, value)
  GROUP BY file_id)"""


DOCUMENT_PARTS = (
    top_list("ip_list", "ips", 10),
    top_list("user_list", "users", 10),
    top_list("event_id_list", "event_ids", 20),
    """technique_list AS (
  SELECT file_id, to_json(list({'id': technique_id, 'name': coalesce(technique_name, ''), 'hits': hits}
                               ORDER BY hits DESC, seen)) AS listed
  FROM technique_hits GROUP BY file_id)""",
    """match_list AS (
  SELECT file_id, to_json(list({'name': name, 'severity': severity, 'description': description}
                               ORDER BY corr_ord)) AS listed
  FROM matches GROUP BY file_id)""",
    f"""ioc_map AS (
  SELECT file_id, to_json(map_from_entries(list({{'k': ioc_type, 'v': vals}} ORDER BY seen))) AS listed
  FROM (SELECT file_id, ioc_type, list_sort(list(DISTINCT value))[1:100] AS vals,
               min((line_no, list_position({q(IOC_KINDS)}, ioc_type))) AS seen
        FROM iocs GROUP BY file_id, ioc_type)
  GROUP BY file_id)""",
    """summary_map AS (
  SELECT file_id, to_json(map_from_entries(list(
    {'k': rule_id, 'v': {'count': cnt, 'severity': severity, 'category': category,
                         'description': description, 'mitre': technique_id}}
    ORDER BY first_line, rule_ord))) AS listed
  FROM ruled GROUP BY file_id)""",
    f"""detail_map AS (
  SELECT file_id, to_json(map_from_entries(list({{'k': rule_id, 'v': details}} ORDER BY first_line, rule_ord))) AS listed
  FROM ruled JOIN (
    SELECT file_id, rule_id, list({{'line': line_no, 'content': {STRIPPED}}} ORDER BY line_no)[1:50] AS details
    FROM hits GROUP BY file_id, rule_id) USING (file_id, rule_id)
  GROUP BY file_id)""",
)
DOCUMENT = f"""SELECT h.file_id, json_object(
  'file', h.file_id, 'file_md5', NULL, 'file_sha256', NULL, 'file_size_bytes', NULL,
  'total_lines', h.total_lines, 'log_start', log_start, 'log_end', log_end,
  'unique_ips', h.unique_ips, 'unique_users', h.unique_users,
  'threat_score', h.threat_score, 'threat_level', h.threat_level,
  'top_ips', coalesce(i.listed, '[]'::JSON), 'top_users', coalesce(u.listed, '[]'::JSON),
  'event_id_summary', coalesce(e.listed, '[]'::JSON),
  'detection_rules_total', {len(DETECTION_RULES)}, 'sigma_rules_loaded', 0,
  'detection_rules_triggered', h.rules_triggered,
  'mitre_techniques_detected', coalesce(t.listed, '[]'::JSON), 'correlations', coalesce(m.listed, '[]'::JSON),
  'iocs', coalesce(o.listed, '{{}}'::JSON), 'findings_summary', coalesce(s.listed, '{{}}'::JSON),
  'findings_detail', coalesce(d.listed, '{{}}'::JSON))::VARCHAR AS report
FROM headline h LEFT JOIN period USING (file_id)
LEFT JOIN ip_list i USING (file_id) LEFT JOIN user_list u USING (file_id)
LEFT JOIN event_id_list e USING (file_id) LEFT JOIN technique_list t USING (file_id)
LEFT JOIN match_list m USING (file_id) LEFT JOIN ioc_map o USING (file_id)
LEFT JOIN summary_map s USING (file_id) LEFT JOIN detail_map d USING (file_id)"""

KEYWORD_HIT = (
    "regexp_matches(line, '(?i)whoami /all|net view|.*powershell.*hidden|systeminfo collected')"
)


def oracle_sql() -> dict[str, str]:
    """SQL per query name; names without an entry have no equal in SQL."""
    out = {
        "lines_numbered": sql("SELECT file_id, line_no, line FROM doc_lines", DOC_LINES),
        "page_lines_numbered": sql("SELECT file_id, line_no, line FROM page_lines", PAGE_LINES),
        "chat_records_numbered": sql("SELECT file_id, line_no, line FROM chat_lines", CHAT_LINES),
        "event_log_lines": sql("SELECT file_id, line_no, line FROM event_log", EVENT_LOG),
        "line_snippets": sql(
            f"""SELECT file_id, line_no, content,
  CASE WHEN length(content) > 80 THEN left(content, 80) || '...' ELSE content END AS snippet_80,
  left(content, 100) AS snippet_100, left(content, 120) AS snippet_120, time
FROM (SELECT file_id, line_no, {STRIPPED} AS content, {EVENT_TIME} AS time FROM doc_lines)""", DOC_LINES),
        "file_manifest": sql(
            """SELECT d.doc_id::VARCHAR AS file_id, d.doc_id::VARCHAR AS name,
  CASE WHEN lower(d.doc_id::VARCHAR) LIKE '%.evtx' THEN 'EVTX (Windows Event Log)' ELSE 'Text Log' END AS type,
  strlen(text) AS size_bytes,
  CASE WHEN strlen(text) >= 1048576 THEN format('{:.1f} MB', strlen(text) / 1048576.0)
       ELSE format('{:,} bytes', strlen(text)) END AS size_label,
  md5(text) AS md5, sha256(text) AS sha256, coalesce(n, 0) AS total_lines
FROM documents d LEFT JOIN (SELECT file_id, count(*) AS n FROM doc_lines GROUP BY 1) l
  ON l.file_id = d.doc_id::VARCHAR""", DOC_LINES),
        "text_scan": sql(
            """SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS file_id, line,
  row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS line_no
FROM event_log JOIN events ON event_id + 1 = event_log.line_no""", EVENT_LOG),
        "event_xml_scan": sql(
            r"""SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS file_id,
  '<Event xmlns=''e''><System>' || chr(10) || '<Data>' || regexp_replace(line, '[<>&]', '_', 'g') || '</Data>'
    || chr(10) || '</System></Event>' AS line,
  row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS line_no
FROM event_log JOIN events ON event_id + 1 = event_log.line_no""", EVENT_LOG),
        "file_manifest_scan": sql(
            """SELECT file_id, 'Text Log' AS type, strlen(body) AS size_bytes,
  CASE WHEN strlen(body) >= 1048576 THEN format('{:.1f} MB', strlen(body) / 1048576.0)
       ELSE format('{:,} bytes', strlen(body)) END AS size_label,
  md5(body) AS md5, sha256(body) AS sha256, total_lines
FROM (SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS file_id, count(*) AS total_lines,
             string_agg(line || chr(10), '' ORDER BY event_id) AS body
      FROM event_log JOIN events ON event_id + 1 = event_log.line_no GROUP BY 1)""", EVENT_LOG),
        "timestamps": sql("SELECT file_id, line_no, place, value FROM stamps", EVENT_LOG, STAMPS),
        "ip_counts": token_counts(IPS, "ips"),
        "user_counts": token_counts(USERS, "users"),
        "event_id_counts": token_counts(EVENT_IDS, "event_ids"),
        "distinct_tokens": sql(
            """SELECT file_id, coalesce(i, 0) AS unique_ips, coalesce(u, 0) AS unique_users, coalesce(e, 0) AS unique_event_ids
FROM (SELECT DISTINCT file_id FROM event_log)
LEFT JOIN (SELECT file_id, count(DISTINCT value) AS i FROM ips GROUP BY 1) USING (file_id)
LEFT JOIN (SELECT file_id, count(DISTINCT value) AS u FROM users GROUP BY 1) USING (file_id)
LEFT JOIN (SELECT file_id, count(DISTINCT value) AS e FROM event_ids GROUP BY 1) USING (file_id)""",
            EVENT_LOG, IPS, USERS, EVENT_IDS),
        "log_period": sql("SELECT file_id, log_start, log_end FROM period", EVENT_LOG, STAMPS, PERIOD),
        "total_lines": sql("SELECT file_id, count(*) AS total_lines FROM doc_lines GROUP BY file_id", DOC_LINES),
        "top_ips": top_tokens(IPS, "ips", 10),
        "top_users": top_tokens(USERS, "users", 10),
        "top_users_30": top_tokens(USERS, "users", 30),
        "top_event_ids_named": sql(
            """SELECT file_id, value, cnt, first_line, rank, coalesce(event_name, '') AS event_name
FROM ranked LEFT JOIN names USING (value)""",
            EVENT_LOG, EVENT_IDS, counted("event_ids"), ranked(15), NAMES),
        "top_event_ids_short": sql(
            """SELECT file_id, value, cnt, first_line, rank, coalesce(event_name, '') AS event_name
FROM ranked LEFT JOIN names USING (value)""",
            EVENT_LOG, EVENT_IDS, counted("event_ids"), ranked(20), SHORT_NAMES),
        "relative_bars": sql(
            """SELECT file_id, value, cnt, rank,
  floor(cnt / max(cnt) OVER (PARTITION BY file_id) * 30)::INT AS relative_bar, least(cnt, 30)::INT AS capped_bar
FROM ranked""", EVENT_LOG, IPS, counted("ips"), ranked(50)),
        "ioc_totals": sql(
            """SELECT file_id, coalesce(ioc_type, 'all') AS ioc_type, count(*) AS total
FROM ioc_set GROUP BY GROUPING SETS ((file_id, ioc_type), (file_id))""", EVENT_LOG, IOCS, IOC_SET),
        "ioc_capped": sql(
            """SELECT file_id, ioc_ord, ioc_type, ioc_label, rank, value, cnt, greatest(cnt - 10, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, ioc_type ORDER BY value) AS rank,
             count(*) OVER (PARTITION BY file_id, ioc_type) AS cnt FROM ioc_set)
JOIN labels_of USING (ioc_type) WHERE rank <= 10""", EVENT_LOG, IOCS, IOC_SET, LABELS),
        "ioc_tab": sql(
            """SELECT file_id, ioc_ord, ioc_type, ioc_label, rank, value, cnt, greatest(cnt - 100, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, ioc_type ORDER BY value) AS rank,
             count(*) OVER (PARTITION BY file_id, ioc_type) AS cnt FROM ioc_set)
JOIN labels_of USING (ioc_type) WHERE rank <= 100""", EVENT_LOG, IOCS, IOC_SET, LABELS),
        "correlation_section": sql(
            """SELECT file_id, corr_ord, severity, name, description, array_to_string(requires, ', ') AS signals
FROM matches""", *EVENT_HITS, COUNTS, CORRELATION_ROWS, MATCHES),
        "event_record_decode": sql(
            """SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS line_no,
  line_no AS record_id, line FROM event_log""", EVENT_LOG),
        "mixed_log_scan": sql(
            r"""SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS file_id,
  row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS line_no,
  CASE WHEN event_type = 'error' THEN line_no END AS record_id,
  CASE WHEN event_type = 'signup' THEN '<Event>' || chr(10) || regexp_replace(line, '[<>&]', '_', 'g') || chr(10) || '</Event>'
       ELSE line END AS line
FROM event_log JOIN events ON event_id + 1 = event_log.line_no""", EVENT_LOG),
        "log_format_scan": sql(
            r"""SELECT * FROM (SELECT event_type || ' ' || strftime(ts, '%Y-%m-%d') AS file_id,
  row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS line_no,
  CASE WHEN event_type = 'error' THEN line_no END AS record_id,
  CASE WHEN event_type = 'signup' THEN '<Event>' || chr(10) || regexp_replace(line, '[<>&]', '_', 'g') || chr(10) || '</Event>'
       ELSE line END AS line
FROM event_log JOIN events ON event_id + 1 = event_log.line_no) WHERE line_no >= 2""", EVENT_LOG),
        "ioc_ipv4_docs": ioc_query("ipv4", DOC_LINES, "plain", ascii_view("plain", "doc_lines")),
        "ioc_domain_docs": ioc_query("domain", DOC_LINES, "plain", ascii_view("plain", "doc_lines")),
        "ioc_url_pages": ioc_query(
            "url", WHOLE_PAGES[0], "whole_pages", WHOLE_PAGES[1],
            pattern=rf"https?://[^\s\x0b\x1c-\x1f{_WIDE_SPACE}\"'<>]+"),
        "ioc_domain_pages": ioc_query(
            "domain", WHOLE_PAGES[0], "plain", WHOLE_PAGES[1], ascii_view("plain", "whole_pages")),
        "hits_all": sql("SELECT file_id, line_no, rule_id FROM hits", *EVENT_HITS),
        "hits_pages": sql("SELECT file_id, line_no, rule_id FROM hits",
                          PAGE_LINES, ascii_view("plain", "page_lines"), hits_cte("plain")),
        "hits_docs": sql("SELECT file_id, line_no, rule_id FROM hits",
                         DOC_LINES, ascii_view("plain", "doc_lines"), hits_cte("plain")),
        "hits_chats": sql("SELECT file_id, line_no, rule_id FROM hits",
                          CHAT_LINES, ascii_view("plain", "chat_lines"), hits_cte("plain")),
        "hits_per_rule": sql("SELECT file_id, rule_id, cnt, first_line FROM counts", *EVENT_HITS, COUNTS),
        "findings_first_n": sql(
            f"""SELECT file_id, rule_id, line_no, {STRIPPED} AS content,
  row_number() OVER (PARTITION BY file_id, rule_id ORDER BY line_no) AS rank
FROM hits QUALIFY rank <= 50""", *EVENT_HITS),
        "findings_by_category": sql(
            """SELECT file_id, category,
  string_agg(rule_id || ':' || cnt::VARCHAR, ', ' ORDER BY first_line, rule_ord) AS rules, sum(cnt)::BIGINT AS hits
FROM ruled GROUP BY file_id, category""", *EVENT_COUNTS),
        "findings_summary": sql(
            """SELECT file_id, rule_id, cnt, severity, category, description, technique_id, first_line
FROM ruled""", *EVENT_COUNTS),
        "findings_section": sql(
            f"""SELECT r.file_id, r.place, upper(r.category) AS category, r.rule_id, r.severity, r.description,
  r.technique_id, r.cnt, h.rank, h.line_no,
  CASE WHEN length(h.content) > 80 THEN left(h.content, 80) || '...' ELSE h.content END AS snippet,
  greatest(r.cnt - 3, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY category, first_line, rule_ord) AS place FROM ruled) r
JOIN (SELECT file_id, rule_id, line_no, {STRIPPED} AS content,
             row_number() OVER (PARTITION BY file_id, rule_id ORDER BY line_no) AS rank FROM hits) h
  ON h.file_id = r.file_id AND h.rule_id = r.rule_id AND h.rank <= 3""", *EVENT_COUNTS),
        "technique_hits": sql(
            """SELECT file_id, technique_id, coalesce(technique_name, 'Unknown Technique') AS technique_name, hits,
  seen[1] AS first_line FROM technique_hits""", *EVENT_COUNTS, TECHNIQUE_ROWS, TECHNIQUE_HITS),
        "technique_top20": sql(
            """SELECT file_id, technique_id, coalesce(technique_name, 'Unknown') AS technique_name, hits,
  seen[1] AS first_line, row_number() OVER (PARTITION BY file_id ORDER BY hits DESC, seen) AS rank
FROM technique_hits QUALIFY rank <= 20""", *EVENT_COUNTS, TECHNIQUE_ROWS, TECHNIQUE_HITS),
        "timeline_500": sql(
            f"""SELECT file_id, time, rule_id AS rule, severity, category, line_no AS line, content,
  row_number() OVER (PARTITION BY file_id ORDER BY time, line_no, rule_ord) AS rank
FROM (SELECT *, {EVENT_TIME} AS time, left({STRIPPED}, 120) AS content FROM hits) JOIN rules USING (rule_id)
QUALIFY rank <= 500""", *EVENT_HITS, RULES),
        "correlation_matches": sql(
            """SELECT file_id, corr_ord, name, severity, score_boost, array_to_string(requires, ', ') AS requires, description
FROM matches""", *EVENT_HITS, COUNTS, CORRELATION_ROWS, MATCHES),
        "rule_scores": sql("SELECT file_id, rule_id, cnt, weight, rule_score FROM scored", *EVENT_COUNTS, SCORED),
        "threat_score": sql(
            """SELECT file_id, total_lines, coalesce(n, 0) AS rules_triggered, threat_score, threat_level
FROM files JOIN scores USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n FROM counts GROUP BY 1) USING (file_id)""", *EVENT_SCORES),
        "threat_level": sql(
            "SELECT file_id, threat_score, threat_level, (threat_score // 5)::INT AS score_bar FROM scores",
            *EVENT_SCORES),
        "recommendations": sql(
            f"""SELECT file_id, rec_ord, recommendation FROM given
UNION ALL
SELECT file_id, 1, {q(lookups.DEFAULT_RECOMMENDATION)} FROM files WHERE file_id NOT IN (SELECT file_id FROM given)""",
            *EVENT_HITS, COUNTS, FILES.format(source="event_log"), CORRELATION_ROWS, MATCHES, ADVICE,
            """given AS (
  SELECT DISTINCT c.file_id, a.rec_ord, a.recommendation
  FROM (SELECT file_id, rule_id, NULL AS name FROM counts UNION ALL SELECT file_id, NULL, name FROM matches) c
  JOIN advice a ON list_contains(a.any_rule, c.rule_id) OR a.any_corr = c.name)"""),
        "tactic_coverage": sql(
            """SELECT f.file_id, t.tactic_ord, t.tactic, list_contains(f.seen, t.tactic) AS detected
FROM (SELECT file_id, list(tactic) FILTER (tactic IS NOT NULL) AS seen FROM tactic_of GROUP BY file_id) f, tactics t""",
            *EVENT_COUNTS, TECHNIQUE_ROWS, TECHNIQUE_HITS,
            f"tactic_of AS (SELECT file_id, {tactic_case()} AS tactic FROM technique_hits)",
            values("tactics", "tactic_ord, tactic", enumerate(lookups.TACTICS, 1)))
        .replace("list_contains(f.seen, t.tactic)", "coalesce(list_contains(f.seen, t.tactic), false)"),
        "raw_head": sql("SELECT file_id, line_no, line FROM doc_lines WHERE line_no <= 2000", DOC_LINES),
        "file_report": sql(
            f"""SELECT headline.*, log_start, log_end, (threat_score // 5)::INT AS score_bar,
  {len(DETECTION_RULES)} AS detection_rules_total, 0 AS keyword_rules_loaded,
  {len({r[3] for r in DETECTION_RULES})} AS rule_categories
FROM headline LEFT JOIN period USING (file_id)""", *EVENT_HEADLINE, STAMPS, PERIOD),
        "json_report": sql(DOCUMENT, *EVENT_HEADLINE, STAMPS, PERIOD, *DOCUMENT_PARTS),
        "json_report_files": sql(
            DOCUMENT.replace("'file', h.file_id, 'file_md5', NULL, 'file_sha256', NULL, 'file_size_bytes', NULL",
                             "'file_md5', md5, 'file_sha256', sha256, 'file_size_bytes', size")
            + " JOIN manifest USING (file_id)",
            *FILE_LOG, *EVENT_HEADLINE[1:], STAMPS, PERIOD, *DOCUMENT_PARTS),
        "keyword_rule_report": sql(
            f"""SELECT file_id, total_lines, rules_triggered, techniques, correlations, threat_score, threat_level,
  {len(WITH_USER_RULE)} AS detection_rules_total, 1 AS keyword_rules_loaded,
  {len({r[3] for r in WITH_USER_RULE})} AS rule_categories FROM headline""",
            EVENT_LOG, hits_cte("event_log", WITH_USER_RULE), COUNTS, rule_rows(WITH_USER_RULE), *EVENT_HEADLINE[4:]),
        "rule_file_report": sql(
            f"""SELECT file_id, rules_triggered, techniques, threat_score, threat_level,
  {len(WITH_RULE_FILES)} AS detection_rules_total, 2 AS keyword_rules_loaded FROM headline""",
            EVENT_LOG, hits_cte("event_log", WITH_RULE_FILES), COUNTS, rule_rows(WITH_RULE_FILES), *EVENT_HEADLINE[4:]),
        "own_correlation": sql(
            "SELECT file_id, correlations, threat_score, threat_level FROM headline",
            *[OWN_CORRELATION_ROWS if cte is CORRELATION_ROWS else cte for cte in EVENT_HEADLINE]),
        "null_lines": sql(
            """SELECT file_id, total_lines, unique_ips, unique_users, rules_triggered, total_iocs, threat_score
FROM headline""", *NULLED_LOG, *EVENT_HEADLINE[1:]),
        "json_report_export": sql(
            """SELECT f.file_id, f.total_lines, s.threat_score, s.threat_level,
  coalesce(n, 0)::INT AS rules, coalesce(q, 0)::INT AS quoted
FROM files f JOIN scores s USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n, sum(cnt) AS q FROM counts GROUP BY 1) c USING (file_id)""",
            DOC_LINES, ascii_view("plain", "doc_lines"), hits_cte("plain"), COUNTS, RULES, RULED,
            FILES.format(source="doc_lines"), CORRELATION_ROWS, MATCHES, SCORED, SCORES),
        "stix_export": sql(
            f"""SELECT file_id, 'indicator--' || {UUID_OF_PATTERN} AS id, '2024-05-06T07:08:09.000Z' AS created,
  '2024-05-06T07:08:09.000Z' AS modified, name, pattern
FROM (SELECT *, sha1(unhex('{EXPORT_SPACE}') || encode(pattern)) AS h
      FROM (SELECT file_id, upper(ioc_type) || ': ' || left(value, 80) AS name,
                   CASE WHEN stix_type = 'file' THEN '[file:hashes.' || chr(39) || upper(ioc_type) || chr(39) || ' = ' || chr(39) || value || chr(39) || ']'
                        ELSE '[' || stix_type || ':value = ' || chr(39) || value || chr(39) || ']' END AS pattern
            FROM (SELECT *, {stix_case()} AS stix_type FROM ioc_set) WHERE stix_type IS NOT NULL))""",
            EVENT_LOG, IOCS, IOC_SET),
        "stix_bundle": sql(
            f"""SELECT file_id, '{{"type":"bundle","id":"bundle--ID","objects":['
    || string_agg(object, ',' ORDER BY ioc_type, rank) || ']}}' AS bundle
FROM (SELECT *, '{{"type":"indicator","spec_version":"2.1","id":"indicator--ID","created":"NOW","modified":"NOW","name":'
    || to_json(upper(ioc_type) || ': ' || left(value, 80)) || ',"pattern":'
    || to_json(CASE WHEN stix_type = 'file' THEN '[file:hashes.''' || upper(ioc_type) || ''' = ''' || value || ''']'
                    ELSE '[' || stix_type || ':value = ''' || value || ''']' END)
    || ',"pattern_type":"stix","valid_from":"NOW","labels":["malicious-activity"]}}' AS object
  FROM (SELECT *, {stix_case()} AS stix_type,
               row_number() OVER (PARTITION BY file_id, ioc_type ORDER BY value) AS rank FROM ioc_set)
  WHERE stix_type IS NOT NULL AND rank <= 200)
GROUP BY file_id""", EVENT_LOG, IOCS, IOC_SET),
        "page_report": sql(
            """SELECT file_id, total_lines, coalesce(n, 0) AS rules_triggered, coalesce(t, 0) AS techniques,
  threat_score, threat_level
FROM files JOIN scores USING (file_id)
LEFT JOIN (SELECT file_id, count(*) AS n, count(DISTINCT technique_id) AS t FROM ruled GROUP BY 1) USING (file_id)""",
            PAGE_LINES, ascii_view("plain", "page_lines"), hits_cte("plain"), COUNTS, RULES, RULED,
            FILES.format(source="page_lines"), CORRELATION_ROWS, MATCHES, SCORED, SCORES),
        "stix_indicators": sql(
            f"""SELECT file_id, ioc_type, rank, value, stix_type, upper(ioc_type) || ': ' || left(value, 80) AS name,
  CASE WHEN stix_type = 'file' THEN '[file:hashes.''' || upper(ioc_type) || ''' = ''' || value || ''']'
       ELSE '[' || stix_type || ':value = ''' || value || ''']' END AS pattern
FROM (SELECT *, {stix_case()} AS stix_type,
             row_number() OVER (PARTITION BY file_id, ioc_type ORDER BY value) AS rank FROM ioc_set)
WHERE stix_type IS NOT NULL AND rank <= 200""", EVENT_LOG, IOCS, IOC_SET),
        "keyword_rule_hits": sql(
            f"""SELECT file_id, 'sigma_console_tools' AS rule_id, count(*) AS cnt, 'HIGH' AS severity, 25 AS weight,
  'Sigma Rule' AS category, 'T1059.001' AS technique_id, 'Console tools in service sessions' AS description
FROM event_log WHERE {KEYWORD_HIT} GROUP BY file_id""", EVENT_LOG),
    }
    for kind in IOC_KINDS:
        out[f"ioc_{kind}"] = ioc_query(kind, EVENT_LOG, "event_log")
    for category in dict.fromkeys(r[3] for r in DETECTION_RULES):
        rules = [r for r in DETECTION_RULES if r[3] == category]
        out[family_query(category)] = sql(
            "SELECT file_id, line_no, rule_id FROM hits", EVENT_LOG, hits_cte("event_log", rules))
    return out
