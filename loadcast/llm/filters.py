"""Approximate set membership of fixed size, from built-in bitmap functions.

A join against many keys shuffles every row of the other side. Where few rows have a partner, a bitmap of the
keys' hashes lets the others go before the shuffle. Its size does not depend on the data, so it may always be
broadcast; a full bitmap only lets more rows through, and the join that follows is what decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** 26 bits are 8 MB.
FILTER_BITS = 26


def _slot(hash64: Column, bits: int) -> Column:
    return hash64.bitwiseAND(F.lit((1 << bits) - 1)) + 1


def bitmap_of(keys: DataFrame, *columns: str, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmap of the hashes of ``columns``: at most 2 ** (bits - 15) rows of 4 KB."""
    slot = _slot(F.xxhash64(*columns), bits)
    return (keys.select(slot.alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap")))


def maybe_in(rows: DataFrame, bitmap: DataFrame, *columns: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose ``columns`` may be among the keys of ``bitmap``; none that is among them is missing."""
    return _with_answer(rows, bitmap, columns, bits).where("_maybe").drop("_maybe")


def _with_answer(rows: DataFrame, bitmap: DataFrame, columns: tuple[str, ...], bits: int) -> DataFrame:
    slot = _slot(F.xxhash64(*columns), bits)
    place = F.bitmap_bit_position(slot)
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_place", place).join(
        F.broadcast(bitmap), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_place % 8 as int)) & 1")
    return (joined.withColumn("_byte", F.coalesce(byte, F.lit(0)))
            .withColumn("_maybe", bit == 1).drop("_bucket", "_place", "_bitmap", "_byte"))


def split_by(rows: DataFrame, bitmap: DataFrame, *columns: str, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among the keys, and rows that are certainly not."""
    answer = _with_answer(rows, bitmap, columns, bits)
    return answer.where("_maybe").drop("_maybe"), answer.where("NOT _maybe").drop("_maybe")
