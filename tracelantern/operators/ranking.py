"""First rows per group, without one task seeing a whole hot group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SHARDS = 64
# A limit that keeps all rows.
NO_LIMIT = (1 << 31) - 1


def first_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    rank: str = "rank",
    large_groups: bool = True,
) -> DataFrame:
    """Rows with rank 1..n in each group, ranked by ``order``.

    Spark cuts every group to n rows per task before the shuffle.  Where a group may
    have rows in very many tasks, the survivors are cut once more in shards of tasks,
    so the last task gets at most 64 * n rows of a group.  The result does not depend
    on which shard a row is in.  Without a limit nothing can be cut, and rows are ranked at once.
    """
    if large_groups and n < NO_LIMIT:
        sharded = df.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(_SHARDS)))
        df = _cut(sharded, [*keys, "shard"], order, n, rank).drop("shard", rank)
    return _cut(df, keys, order, n, rank)


def _cut(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= n)
