"""The fixed-size filter loses nothing and lets little through."""

from tracelantern.functions.membership import maybe_in


def test_nothing_is_lost(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("concat('f', id % 7) AS file_id", "id AS line_no", "'t' AS line")
    wanted = rows.where("line_no % 100 = 3").select("file_id", "line_no")
    wanted.write.parquet(str(tmp_path / "w"))
    wanted = spark.read.parquet(str(tmp_path / "w"))
    found = maybe_in(rows, wanted, "file_id", "line_no")
    assert found.columns == rows.columns
    assert found.join(wanted, ["file_id", "line_no"]).count() == 2000
    assert found.count() < 2000 + 200
    assert maybe_in(rows, wanted.limit(0), "file_id", "line_no").count() == 0
