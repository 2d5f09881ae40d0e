"""The same results by plain loops, for small inputs."""

import re
from collections import defaultdict

from tracelantern.tables import lookups
from tracelantern.tables.correlations import CORRELATIONS
from tracelantern.tables.rules import DETECTION_RULES

COMPILED = [(row, [re.compile(p, re.I) for p in row[6]]) for row in DETECTION_RULES]
IOC = [(kind, re.compile(p)) for kind, p in lookups.IOC_PATTERNS]


def rule_hits(rows):
    """[(file, line number, rule id)] in line and rule order."""
    return [
        (file, number, rule[0])
        for file, number, line in rows
        for rule, patterns in COMPILED
        if line is not None and any(p.search(line) for p in patterns)
    ]


def tokens(rows, pattern, flags=0):
    """{(file, token): count}"""
    counts = defaultdict(int)
    for file, _, line in rows:
        for token in re.findall(pattern, line or "", flags):
            counts[file, token] += 1
    return dict(counts)


def indicators(rows):
    """{(file, type, value)}"""
    found = set()
    for file, _, line in rows:
        for kind, pattern in IOC:
            for value in pattern.findall(line or ""):
                if kind == "ipv4" and value.split(".")[0] in ("0", "127", "255"):
                    continue
                if kind in ("md5", "sha1", "sha256") and len(set(value)) < 5:
                    continue
                found.add((file, kind, value))
    return found


def scores(rows):
    """{file: score}"""
    per_file = {file: {} for file, _, _ in rows}
    for file, _, rule_id in rule_hits(rows):
        per_file[file][rule_id] = per_file[file].get(rule_id, 0) + 1
    weights = {row[0]: row[2] for row in DETECTION_RULES}
    out = {}
    for file, counts in per_file.items():
        total = 0
        for rule_id, n in counts.items():
            w = weights[rule_id]
            parts = [w, min(n - 1, 4) * (w * 0.3), max(n - 5, 0) * (w * 0.1)]
            total += sum(parts) if n > 1 else w
        total += sum(boost for _, _, boost, needed, _ in CORRELATIONS if set(needed) <= set(counts))
        out[file] = min(int(total), 100)
    return out


def first_and_last_stamp(rows):
    """{file: (first, last)} by position."""
    seen = {}
    for file, _, line in sorted(rows, key=lambda r: r[1]):
        for stamp in re.findall(lookups.TIMESTAMP_TOKEN, line or ""):
            seen[file] = (seen.get(file, (stamp,))[0], stamp)
    return seen
