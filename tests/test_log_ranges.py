"""Reading logs by byte range, against whole-file readings."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_sources import event_file, record, text_of
from tracelantern.sources import log_ranges, manifest, text_files
from tracelantern.sources.log_ranges import LogFolder
from tracelantern.sources.store import Store


def read(folder, **span):
    return {(r.file_id.rsplit("/", 1)[1], r.line_no): r.line for r in folder.lines(**span).collect()}


def lines_of(data):
    text = data.decode("utf-8", "replace").removeprefix("﻿")
    lines = re.split(r"\r\n|\r|\n", text)
    return lines[:-1] if data[-1:] in (b"\n", b"\r") else lines


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_text_ranges_hold_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(log_ranges, "_PIECE", 5)
    rng = random.Random(size)
    for n in range(60):
        data = b"".join(rng.choice([b"a", b"\xff", "é".encode(), b"\n", b"\r", b"\r\n", b"xyz " * 9]) for _ in range(rng.randrange(1, 60)))
        if n % 5 == 0:
            data = b"\xef\xbb\xbf" + data
        (tmp_path / "f").write_bytes(data)
        found, counted = [], 0
        with Store().open(str(tmp_path / "f")) as file:
            for start in range(0, len(data), size):
                for lines in log_ranges._text(file, start, min(start + size, len(data))):
                    found += lines
                counted += log_ranges._count_text(file, start, min(start + size, len(data)))[0]
        assert counted == len(found)
        if size >= 64 or b"\xff" not in data and "é".encode() not in data:
            assert found == lines_of(data)
        else:
            assert len(found) == len(lines_of(data))


@pytest.mark.parametrize("size", [5, 8, 50, 1 << 20])
def test_element_ranges_hold_each_element_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(log_ranges, "_PIECE", 11)
    events = [f"<Event x='{k}'>\n" + "e" * (k % 40) + "</Event>" for k in range(60)]
    data = ("<?xml?><Events>\n" + "\n".join(events) + "\n</Events><Event> open").encode()
    (tmp_path / "f.xml").write_bytes(data)
    with Store().open(str(tmp_path / "f.xml")) as file:
        starts = range(0, len(data), size)
        found = [e for s in starts for es in log_ranges._xml(file, s, min(s + size, len(data))) for e in es]
        counted = sum(log_ranges._count_xml(file, s, min(s + size, len(data)))[0] for s in starts)
    assert found == events and counted == len(events)


@pytest.fixture
def mixed(tmp_path):
    """A folder of text, XML and binary files, some under odd names, and what they hold."""
    wanted = {}
    texts = {"_hidden.log": "one\ntwo\r\nthree\r", ".dot": "x\n\ny", "a b+c%é.txt": "line\n" * 300, "sub/deep/z": "w", "empty.log": ""}
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
        wanted |= {(name.rsplit("/", 1)[-1], k): line for k, line in enumerate(lines_of(text.encode()), 1) if text}
    events = [f"<Event>{k}\n</Event>" for k in range(40)]
    (tmp_path / "e.XML").write_text("<Events>" + " ".join(events) + "</Events>")
    wanted |= {("e.XML", k): e for k, e in enumerate(events, 1)}
    chunks = [[record(3 * k + j, f"record {k} {j}") for j in range(3)] for k in range(5)]
    foreign = event_file([[record(99, "never")]], stop=False)[4096:]
    (tmp_path / "_b.evtx").write_bytes(event_file(chunks) + foreign)
    wanted |= {("_b.evtx", 3 * k + j + 1): f"RecordID:{3 * k + j} {text_of(chunks[k][j])}" for k in range(5) for j in range(3)}
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / ".part-0.crc").write_bytes(b"crc")
    return tmp_path, wanted


def spark_name(name):
    return name.replace(" ", "%20").replace("c%é", "c%25é")


@pytest.mark.parametrize("size", [50, 1 << 16, 1 << 26])
def test_mixed_folder(spark, mixed, size):
    path, wanted = mixed
    folder = LogFolder(spark, str(path), size=size)
    assert read(folder) == {(spark_name(name), k): line for (name, k), line in wanted.items()}
    folder.close()


def test_only_wanted_ranges_are_opened(spark, mixed, monkeypatch):
    path, wanted = mixed
    folder = LogFolder(spark, str(path), size=100)
    text = F.col("file_id").endswith(".txt")
    assert set(read(folder, files=text, first=90, last=110)) == {(spark_name("a b+c%é.txt"), k) for k in range(90, 111)}
    spans = folder.index.where(text).where("before < 110 AND before + n >= 90").count()
    assert spans < folder.index.where(text).count()
    # a file that may not be opened shows that it is not
    (path / "e.XML").write_text("gone")
    assert len(read(folder, files=text)) == 300


def test_a_changed_file_is_noticed(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    folder = LogFolder(spark, str(tmp_path))
    (tmp_path / "a.log").write_text("one\n")
    with pytest.raises(Exception, match="changed while it was read"):
        folder.lines().collect()


def test_addresses_are_spark_s(spark, tmp_path):
    for name in ("a b+c%é.txt", "x;y&z=1,@.log", "q#[r].log", "plain.log"):
        (tmp_path / name).write_text("one\n")
    mine = {r.file_id for r in LogFolder(spark, str(tmp_path)).lines().collect()}
    assert mine == {r.file_id for r in text_files.read_log_lines(spark, str(tmp_path)).collect()}


def test_no_files(spark, tmp_path):
    assert not read(LogFolder(spark, str(tmp_path)))
    with pytest.raises(FileNotFoundError):
        LogFolder(spark, str(tmp_path / "none"))


def test_chosen_file_systems(spark, tmp_path):
    """A scheme that no library knows, served by a factory."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    root = str(tmp_path)

    def factory(host):
        from pyarrow import fs

        return fs.SubTreeFileSystem(root, fs.LocalFileSystem())

    folder = LogFolder(spark, "mine://shelf/in", Store({"mine": factory}))
    assert [(r.file_id, r.line_no, r.line) for r in folder.lines().orderBy("line_no").collect()] == [
        ("mine://shelf/in/a.log", 1, "one"), ("mine://shelf/in/a.log", 2, "two")
    ]


def test_manifest_streams_files_of_any_size(spark, mixed):
    path, wanted = mixed
    big = b"0123456789abcdef" * (5 << 18)  # several pieces
    (path / "big.bin").write_bytes(big)
    folder = LogFolder(spark, str(path))
    facts = {r.name: r for r in manifest.file_manifest(spark, str(path), folder.lines()).collect()}
    names = {p.name for p in path.rglob("*") if p.is_file()} - {"_SUCCESS", ".part-0.crc"}
    assert set(facts) == names
    for p in path.rglob("*"):
        if p.name in facts:
            data, row = p.read_bytes(), facts[p.name]
            assert (row.size_bytes, row.md5, row.sha256) == (len(data), hashlib.md5(data).hexdigest(), hashlib.sha256(data).hexdigest())
            assert p.name == "big.bin" or row.total_lines == sum(name == p.name for name, _ in wanted)
