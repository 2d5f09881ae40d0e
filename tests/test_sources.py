"""File scans against plain Python readings of the same files."""

import hashlib
import json
import struct
from pathlib import Path

import pytest

from tracelantern.plans import report
from tracelantern.plans.analysis import Analysis
from tracelantern.sources import event_records, keyword_rules, manifest, text_files


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


def name_of(file_id):
    return file_id.rsplit("/", 1)[1]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_numbers_over_many_splits(spark, small_splits, tmp_path, end):
    wanted = {}
    for n, size in enumerate((1, 40, 700)):
        name = f"log {n}.txt"
        lines = [f"line {i} " + "x" * (i % 37) for i in range(size)]
        (tmp_path / name).write_bytes((end.join(lines) + (end if n else "")).encode())
        wanted.update({(name, i): line for i, line in enumerate(lines, 1)})
    found = text_files.read_log_lines(spark, str(tmp_path))
    rows = {(name_of(r.file_id).replace("%20", " "), r.line_no): r.line for r in found.collect()}
    assert rows == wanted


def test_bad_bytes_and_empty_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n\xff\xfetwo\xc3\n")
    with open(tmp_path / "a.log", encoding="utf-8", errors="replace") as f:
        wanted = [line.rstrip("\n") for line in f]
    rows = text_files.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line for r in rows] == wanted


def test_event_xml(spark, small_splits, tmp_path):
    events = [f'<Event xmlns="x"><System>\n<EventID>{i}</EventID>\n</System></Event>' for i in range(200)]
    (tmp_path / "e.xml").write_text("<?xml version='1.0'?>\n<Events>\n" + "\n".join(events) + "\n</Events>\n")
    rows = text_files.read_event_xml(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line for r in rows] == events
    assert [r.line_no for r in rows] == list(range(1, 201))


def record(record_id, text, size=None):
    body = text.encode("utf-16le")
    return struct.pack("<4sIQ", b"\x2a\x2a\x00\x00", size if size is not None else 16 + len(body), record_id) + body


def event_file(chunks, stop=True):
    out = b"ElfFile\x00".ljust(4096, b"\x00")
    for records in chunks:
        out += (b"ElfChnk\x00" + b"".join(records)).ljust(65536, b"\x01")
    return out + (b"NoChunk\x00".ljust(65536, b"\x00") if stop else b"")


def text_of(piece):
    return piece.decode("utf-16le", errors="ignore")


def test_event_records(spark, tmp_path):
    first = [record(7, "alpha user=bob"), record(8, "beta"), b"junk!", record(9, "gamma")]
    second = [record(10, "delta"), record(11, "", size=0), record(12, "EventID=4625")]
    after_stop = [record(13, "never")]
    data = event_file([first, second]) + event_file([after_stop])[4096:]
    (tmp_path / "a.evtx").write_bytes(data)
    (tmp_path / "b.evtx").write_bytes(event_file([[record(1, "one")]], stop=False))
    (tmp_path / "tiny.evtx").write_bytes(b"ElfFile\x00")
    rows = event_records.read_event_records(spark, str(tmp_path)).collect()
    found = {(name_of(r.file_id), r.line_no): r.line for r in rows}
    wanted_a = [f"RecordID:{i} {text_of(r)}" for i, r in
                ((7, first[0]), (8, first[1]), (9, first[3]), (10, second[0]), (12, second[2]))]
    assert found == {
        **{("a.evtx", n): line for n, line in enumerate(wanted_a, 1)},
        ("b.evtx", 1): f"RecordID:1 {text_of(record(1, 'one'))}",
    }


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "no_suffix").write_text("three")
    (tmp_path / "b.EVTX").write_bytes(event_file([[record(1, "first"), record(2, "second")]]))
    found = {(name_of(r.file_id), r.line_no): r.line[:10] for r in text_files.read_logs(spark, str(tmp_path)).collect()}
    assert found == {
        ("a.log", 1): "one", ("a.log", 2): "two", ("no_suffix", 1): "three", ("b.EVTX", 1): "RecordID:1", ("b.EVTX", 2): "RecordID:2",
    }


def test_report_with_file_facts(spark, tmp_path):
    data = b"x user=bob 10.1.2.3\nwhoami /all\n"
    (tmp_path / "a.log").write_bytes(data)
    lines = text_files.read_logs(spark, str(tmp_path))
    with Analysis(lines) as analysis:
        documents = report.documents(analysis, manifest.file_manifest(spark, str(tmp_path), lines))
        report.write_json(documents, str(tmp_path / "out"))
        kept_at = Path(analysis._kept[0])
        assert kept_at.exists()
    assert not kept_at.exists()
    written = [json.loads(f.read_text()) for f in (tmp_path / "out").iterdir()]
    assert [f.name.endswith("a.log.json") for f in (tmp_path / "out").iterdir()] == [True]
    assert [(d["file"], d["file_md5"], d["file_size_bytes"], d["total_lines"]) for d in written] == [
        ("a.log", hashlib.md5(data).hexdigest(), len(data), 2)
    ]


def test_event_records_stop_at_the_first_foreign_chunk(spark, tmp_path):
    data = event_file([[record(1, "in")]]) + event_file([[record(2, "out")]], stop=False)[4096:]
    (tmp_path / "a.evtx").write_bytes(data)
    rows = event_records.read_event_records(spark, str(tmp_path)).collect()
    assert [r.line.split()[0] for r in rows] == ["RecordID:1"]


def test_file_manifest(spark, tmp_path):
    (tmp_path / "big.log").write_bytes(b"x" * 1_500_000 + b"\n")
    (tmp_path / "a b.EVTX").write_bytes(b"ElfFile")
    lines = text_files.read_log_lines(spark, str(tmp_path / "big.log"))
    rows = {r["name"]: r for r in manifest.file_manifest(spark, str(tmp_path), lines).collect()}
    for name, kind, label, count in (
        ("big.log", "Text Log", "1.4 MB", 1), ("a b.EVTX", "EVTX (Windows Event Log)", "7 bytes", 0)
    ):
        data = (tmp_path / name).read_bytes()
        row = rows[name]
        assert (row.type, row.size_label, row.size_bytes, row.total_lines) == (kind, label, len(data), count)
        assert (row.md5, row.sha256) == (hashlib.md5(data).hexdigest(), hashlib.sha256(data).hexdigest())


RULE = """
title: T
level: {level}
tags: {tags}
detection:
  keywords: {keywords}
"""


def test_keyword_rules(spark, tmp_path):
    folder = tmp_path / "sigma_rules"
    folder.mkdir()
    files = {
        "good.yml": RULE.format(level="high", tags="[attack.execution, attack.t1059.001, attack.t1]",
                                keywords='["a.b -c", "*x*y"]'),
        "odd_level.yml": RULE.format(level="extreme", tags="[]", keywords="[k]"),
        "no_title.yml": "detection: {keywords: [k]}",
        "null_level.yml": RULE.format(level="null", tags="[]", keywords="[k]"),
        "null_tags.yml": RULE.format(level="low", tags="null", keywords="[k]"),
        "no_detection.yml": "title: x",
        "empty.yml": "# nothing\n",
        "map.yml": RULE.format(level="low", tags="[]", keywords="{a: b}"),
        "none.yml": RULE.format(level="low", tags="[]", keywords="[]"),
        "number.yml": RULE.format(level="low", tags="[]", keywords="[1]"),
        "broken.yml": "a: [",
        "other.yaml": RULE.format(level="low", tags="[]", keywords="[k]"),
        "_odd name.yml": RULE.format(level="low", tags="[]", keywords="[k]"),
        ".dot.yml": RULE.format(level="low", tags="[]", keywords="[k]"),
    }
    for name, body in files.items():
        (folder / name).write_text(body)
    (folder / "bytes.yml").write_bytes(b"detection: {keywords: [\xff]}")
    (folder / "below").mkdir()
    (folder / "below" / "deep.yml").write_text(files["good.yml"])
    assert keyword_rules.rule_folder(str(tmp_path)) == str(folder)
    assert keyword_rules.rule_folder(str(folder)) is None
    parsed = keyword_rules.parse_rules(keyword_rules.read_rule_files(spark, str(folder)))
    good = {r.rule_id: r for r in keyword_rules.accepted(parsed).collect()}
    assert set(good) == {"sigma_good", "sigma_odd_level", "sigma_no_title", "sigma__odd name", "sigma_.dot"}
    row = good["sigma_good"]
    assert (row.severity, row.weight, row.technique_id, row.description) == ("HIGH", 25, "T1059.001", "T")
    assert row.patterns == [r"a\.b\ \-c", ".*x.*y"]
    assert (good["sigma_odd_level"].severity, good["sigma_odd_level"].weight) == ("MEDIUM", 15)
    assert good["sigma_no_title"].description == "no_title"
    bad = {r.stem for r in keyword_rules.rejected(parsed).collect()}
    assert bad == {"null_level", "null_tags", "no_detection", "empty", "map", "none", "number", "broken", "bytes"}
