"""Tables whose tasks have an end, however many rows a byte of input holds."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept, spread_rows
from tracelantern.operators import rollup
from tracelantern.plans import analysis
from tracelantern.plans.analysis import Analysis
from tracelantern.sources import views
from tracelantern.sources.store import Store


def test_splits_follow_the_number_of_rows(spark):
    rows = kept(spark.range(10_000).withColumn("one", F.lit(1)).coalesce(1))
    assert rows.rdd.getNumPartitions() == 1
    dealt = spread_rows(rows, 500, key=("id",))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == 20 and sum(sizes) == 10_000 and max(sizes) < 1000
    assert spread_rows(rows, 10_000) is rows and spread_rows(rows, 10_000, 3).rdd.getNumPartitions() == 3


def test_events_and_roll_up_are_dealt_by_rows(spark, monkeypatch, tmp_path):
    day = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)")
    events = spark.range(4000).select(
        F.when(F.col("id") % 9 > 0, F.col("id")).alias("event_id"), day.alias("ts"), F.lit(7).cast("long").alias("user_id"),
        F.lit("error").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"),
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = views.rendered_events(spark, str(tmp_path)).select("file_id", "line_no", "line")
    monkeypatch.setattr(views, "EVENTS_AT_ONCE", 100)
    lines = views.event_log(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 40
    assert lines.exceptAll(whole).isEmpty() and whole.exceptAll(lines).isEmpty()
    lines = lines.withColumn("line_no", F.coalesce("line_no", F.lit(0)))
    with Analysis(lines, kinds=rollup.DETAILED) as plain:
        want = sorted(map(str, plain.rollup.collect()))
    monkeypatch.setattr(analysis, "ROWS_AT_ONCE", 100)
    with Analysis(lines, kinds=rollup.DETAILED) as dealt:
        assert dealt.rollup.rdd.getNumPartitions() == -(-len(want) // 100)
        assert sorted(map(str, dealt.rollup.collect())) == want


class Watched(Store):
    """Answers the bytes of the largest batch that a worker got, and writes nothing."""

    def _writer(self, folder):
        def watch(batches):
            most = max((batch.nbytes for batch in batches), default=0)
            yield pa.RecordBatch.from_pydict({"name": pa.array(["most"]), "size": pa.array([most], pa.int64())})

        return watch


def test_long_bodies_reach_the_writer_in_small_batches(spark):
    rows = spark.range(400).select(F.lit("one").alias("name"), F.col("id").alias("part"), F.repeat(F.lit("x"), 65536).alias("body"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    most = Watched().write(rows, "/nowhere")[1]  # one name, so one task has them all
    assert 1 << 20 < most < 6 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_rows_come_together_unless_a_task_would_be_crowded(spark):
    rows = kept(spark.range(10_000).withColumn("k", F.col("id") % 400).withColumn("hot", F.when(F.col("id") < 9000, 0).otherwise(F.col("id"))).coalesce(1))
    dealt = spread_rows(rows, 500, key=("id",), together="k")
    assert dealt.rdd.getNumPartitions() == 20
    assert dealt.select("k", F.spark_partition_id().alias("task")).distinct().count() == 400
    grouped = dealt.groupBy("k").agg(F.max("id"))._jdf.queryExecution().executedPlan().toString()
    assert grouped.count("Exchange") == 1
    hot = spread_rows(rows, 500, key=("id",), together="hot")
    assert hot.rdd.getNumPartitions() == 20
    assert max(r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()) < 1000


def _shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {block for k in range(blocks.size()) if (block := blocks.apply(k).name()).startswith("shuffle_")}


def test_a_kept_table_leaves_no_shuffle_behind(spark):
    rows = spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).count()
    before = _shuffled(spark)
    assert kept(rows).count() == 999
    until = time.time() + 20
    # the count has a shuffle of its own, of one block a task
    while len(left := {b.split("_")[1] for b in _shuffled(spark) - before}) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


class Counted(Store):
    """Answers the number of tasks that got rows and of the rows, and writes nothing."""

    def _writer(self, folder):
        def count(batches):
            rows = sum(batch.num_rows for batch in batches)
            yield pa.RecordBatch.from_pydict({"name": pa.array(["rows"] * (rows > 0)), "size": pa.array([rows] * (rows > 0), pa.int64())})

        return count


def test_whole_files_are_written_where_they_are(spark):
    rows = spark.range(0, 300, 1, 3).select(F.col("id").cast("string").alias("name"), F.lit(0).alias("part"), F.lit("x").alias("body"))
    assert Counted().write(rows, "/nowhere", whole=True) == (3, 300)
    assert Counted().write(rows, "/nowhere") == (1, 300)  # a small shuffle comes as one partition
