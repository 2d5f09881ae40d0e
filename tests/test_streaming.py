"""A stream over files that arrive in turn ends at the counts of a single read."""

from pyspark.sql import functions as F

from tracelantern.operators import detect, rollup, score
from tracelantern.sources import text_files
from tracelantern.sources.phrases import PHRASES
from tracelantern.streaming import tail
from tracelantern.tables.ruleset import RuleSet


def test_running_counts(spark, tmp_path):
    logs, out, state = (str(tmp_path / name) for name in ("logs", "out", "state"))
    (tmp_path / "logs").mkdir()
    rules = RuleSet.builtin()

    def run():
        lines = tail.stream_lines(spark, logs, files_per_batch=1)
        query = tail.write_rule_scores(tail.stream_hit_counts(lines, rules), rules, out, state)
        query.trigger(availableNow=True).start().awaitTermination(120)

    (tmp_path / "logs" / "a.log").write_text("\n".join(PHRASES[:90]))
    run()
    (tmp_path / "logs" / "b.log").write_text("\n".join(PHRASES[60:] * 2))
    run()
    latest = spark.read.parquet(out).groupBy("file_id", "rule_id").agg(
        F.max_by("cnt", "batch").alias("cnt"), F.max_by("rule_score", "batch").alias("rule_score"))
    counts = rollup.hit_counts(detect.hits(text_files.read_log_lines(spark, logs), rules))
    wanted = score.rule_scores(counts, rules.frame(spark)).select("file_id", "rule_id", "cnt", "rule_score")
    assert {tuple(r) for r in latest.collect()} == {tuple(r) for r in wanted.collect()}


def test_state_of_old_files_goes(spark, tmp_path):
    import time

    logs, out, state = (str(tmp_path / name) for name in ("logs", "out", "state"))
    (tmp_path / "logs").mkdir()
    rules = RuleSet.builtin()
    left = []
    for name in ("a.log", "b.log", "c.log"):
        (tmp_path / "logs" / name).write_text("\n".join(PHRASES[:40]))
        counts = tail.stream_hit_counts(tail.stream_lines(spark, logs), rules, keep="1 second")
        query = tail.write_rule_scores(counts, rules, out, state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(3)
    assert left[-1] < 3 * left[0]
