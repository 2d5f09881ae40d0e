"""Stamps as decimals, there and back."""

import random
import unicodedata

from pyspark.sql import functions as F

from tracelantern.functions import stamps
from tracelantern.operators import rollup


def test_there_and_back(spark):
    rng = random.Random(1)
    zeros = [chr(c) for c in range(0x110000) if unicodedata.decimal(chr(c), -1) == 0]
    texts = ["2024-02-29T23:59:59", "0000-00-00 00:00:00", "9999-99-99T99:99:99", None]
    for _ in range(60):
        digits = [chr(ord(rng.choice(zeros)) + rng.randrange(10)) for _ in range(14)]
        texts.append("{}{}{}{}-{}{}-{}{}".format(*digits[:8]) + rng.choice("T ") + "{}{}:{}{}:{}{}".format(*digits[8:]))
    frame = spark.createDataFrame([(rng.randrange(10**11), t) for t in texts], "n long, t string")
    value, scripts = stamps.packed(F.col("n"), F.col("t"))
    back = frame.select("t", value.alias("v"), scripts.alias("s")).select("t", stamps.unpacked(F.col("v"), F.col("s")).alias("b"))
    assert [(r.t, r.b) for r in back.collect() if r.t != r.b] == []


def test_period_is_a_hash_aggregation(spark):
    rows = [
        ("f", 3, "2024-01-03T00:00:00 to 2024-01-04 00:00:00"), ("f", 1, "none"), ("f", 9, "२०२४-०१-०१ ००:००:०१ 2020-01-01 00:00:00 x"),
        ("f", 7, "2024-01-09 00:00:00"), ("g", 1, "no stamp"), ("h", 0, "x 2024-01-02T03:04:05"), ("h", 5, None), ("k", 2, "２０２４-01-01 00:00:00"),
    ]
    frame = spark.createDataFrame(rows, "file_id string, line_no long, line string").repartition(4)
    found = rollup.log_period(frame)
    assert sorted(map(tuple, found.collect())) == [
        ("f", "2024-01-03T00:00:00", "2020-01-01 00:00:00"), ("h", "2024-01-02T03:04:05", "2024-01-02T03:04:05"),
        ("k", "２０２４-01-01 00:00:00", "２０２４-01-01 00:00:00"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
