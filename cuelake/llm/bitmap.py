"""A filter for keys, of a size that follows their number, held in rows of Spark's own bitmap functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.staging import written


#: What is broadcast of a bitmap is an eighth of this in bytes at most.
MOST_BITS = 1 << 28


def bits_for(keys: int) -> int:
    """Sixteen bits for each of so many keys, so that a sixteenth of other keys is marked at most; from 16 million keys on
    the bitmap stays at MOST_BITS and marks more and more of them, which costs their exact comparison and changes no result."""
    return min(MOST_BITS, 1 << max(16, (16 * keys - 1).bit_length()))


def bitmap_of(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Rows (_bucket, _bitmap, buckets from 1) with a bit set for each key (a 64-bit hash): bits / 8 bytes at most, whatever
    the number of keys."""
    bit = keys.select((F.pmod(key, F.lit(bits)) + 1).alias("_bit"))
    rows = bit.groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bitmap"))
    return written(rows, "bitmap")


def marked(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int) -> DataFrame:
    """`rows` with _marked: whether the key's bit is set. Keys of the bitmap always are, others rarely."""
    placed = rows.withColumn("_bit", F.pmod(key, F.lit(bits)) + 1)
    placed = placed.withColumns({"_bucket": F.bitmap_bucket_number("_bit"), "_pos": F.bitmap_bit_position("_bit")})
    is_set = F.expr("getbit(cast(conv(hex(substring(_bitmap, cast(_pos div 8 as int) + 1, 1)), 16, 10) as int), cast(_pos % 8 as int)) = 1")
    joined = placed.join(F.broadcast(bitmap), "_bucket", "left").withColumn("_marked", F.coalesce(is_set, F.lit(False)))
    return joined.drop("_bitmap", "_bucket", "_pos", "_bit")
