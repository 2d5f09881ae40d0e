"""Rows that may belong to a set, by a filter whose size does not depend on the tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 16 MB of bits, in bitmaps of 4 KB.
_BITS = 1 << 27


def maybe_in(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """``rows`` whose key is in ``wanted``, and a few more: one in 134 for a million keys wanted.

    The bitmaps are broadcast, so rows stay where they are, and a join with ``wanted`` that
    follows moves hardly any but its own.  ``wanted`` should come from a written table.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(_BITS)) + 1
    bitmaps = wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bitmap")
    )
    marked = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    byte = "conv(hex(substring(_bitmap, cast(_bit div 8 AS int) + 1, 1)), 16, 10)"
    near = marked.join(F.broadcast(bitmaps), "_bucket").where(F.expr(f"shiftright(cast({byte} AS int), cast(_bit % 8 AS int)) & 1 = 1"))
    return near.select(*rows.columns)
