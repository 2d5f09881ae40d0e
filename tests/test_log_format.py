"""The log format of ``spark.read`` against ``LogFolder``."""

import pytest
from pyspark.sql import functions as F

from tests.test_log_ranges import mixed  # noqa: F401
from tracelantern.sources import log_format
from tracelantern.sources.log_ranges import LogFolder


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def frames(spark, mixed):  # noqa: F811
    """All lines by ``LogFolder``, by the format with its index, and by the format alone."""
    path = str(mixed[0])
    folder = LogFolder(spark, path, size=1 << 16)
    log_format.register(spark)
    yield rows(folder.lines()), log_format.read_indexed(spark, folder), spark.read.format(log_format.FORMAT).load(path)
    folder.close()


def test_mixed_folder(frames):
    wanted, indexed, plain = frames
    assert wanted and rows(indexed) == wanted and rows(plain) == wanted


def test_filters_on_files_and_lines(frames):
    wanted, *both = frames
    name = next(file for file, number, _ in wanted if number == 300)
    others = {file for file, *_ in wanted} - {name}
    tests = [
        (F.col("file_id") == name, lambda f, n, t: f == name),
        (F.col("file_id").isin(*others), lambda f, n, t: f in others),
        (F.col("file_id").startswith(name[:-3]), lambda f, n, t: f.startswith(name[:-3])),
        ((F.col("line_no") > 2) & (F.col("line_no") <= 290), lambda f, n, t: 2 < n <= 290),
        (F.col("line_no") == 2, lambda f, n, t: n == 2),
        ((F.col("line_no") < 2) & F.col("line").contains("e"), lambda f, n, t: n < 2 and "e" in t),
        ((F.col("line_no") < 2) & (F.col("line_no") > 5), lambda f, n, t: False),
    ]
    for condition, holds in tests:
        for frame in both:
            assert rows(frame.where(condition)) == [row for row in wanted if holds(*row)], str(condition)


def test_ranges_that_no_line_is_wanted_of_are_not_planned(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("line of text\n" * 40_000)
    folder = LogFolder(spark, str(tmp_path), size=1 << 16)
    options = {"index": folder.index_path, "rangeBytes": str(1 << 16)}
    assert len(log_format.LogReader(options).partitions()) > 12
    frame = log_format.read_indexed(spark, folder).where("line_no = 30000")
    assert frame.count() == 2
    reader = log_format.LogReader(options)
    from pyspark.sql.datasource import EqualTo, IsNotNull
    rest = list(reader.pushFilters([EqualTo(("line_no",), 30_000), IsNotNull(("line",))]))
    assert rest == [IsNotNull(("line",))]
    assert sum(len(p.ranges) for p in reader.partitions()) == 2
    folder.close()


def test_empty_folder(spark, tmp_path):
    log_format.register(spark)
    assert spark.read.format(log_format.FORMAT).load(str(tmp_path)).count() == 0
