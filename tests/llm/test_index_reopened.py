"""A digest index opened under another shuffle setting."""

import pytest

from tracelantern.functions.stages import new_path
from tracelantern.llm import exact_dedup


def test_index_reopens_with_its_own_buckets(spark):
    path, setting = new_path(spark), "spark.sql.shuffle.partitions"
    texts = spark.range(200).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, 4)
        exact_dedup.deduplicate(texts, exact_dedup.DigestIndex(spark, path), "one").collect()
        spark.conf.set(setting, 7)
        index = exact_dedup.DigestIndex(spark, path)
        assert index.buckets == 4
        assert exact_dedup.deduplicate(texts, index, "two").where("kept").count() == 0
        with pytest.raises(ValueError, match="4 buckets"):
            exact_dedup.DigestIndex(spark, path, 7)
    finally:
        spark.conf.set(setting, before)
