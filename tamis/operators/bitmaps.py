"""Sets of keys as bitmaps of bounded size, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis.session import materialize

BLOCK_BITS = 32_768  # of one bitmap row
SET_BITS = 27  # a set of keys takes 2^27 bits (16 MB) at most


def bitmap(cells: DataFrame, cell: str) -> DataFrame:
    """``block, bits``: the numbers in a column, from 0 on, as bitmaps of 32 768 bits; a number may come often."""
    place = F.col(cell) + 1  # the functions count from 1
    return cells.groupBy((F.bitmap_bucket_number(place) - 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def bit_set(bits: Column, cell: Column) -> Column:
    """Whether a number's bit is set in the bitmap of its block; false where there is none."""
    place = F.pmod(cell, F.lit(BLOCK_BITS))
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def possible_members(rows: DataFrame, key: str, keys: DataFrame, most_bits: int = SET_BITS) -> DataFrame:
    """Rows whose ``key`` may be among ``keys``; every row whose key is among them stays.

    The keys' hashes are bits of a bitmap that is broadcast, 16 MB at most, so no row crosses an
    exchange. Of other rows about one in sixteen stays, more once there are over eight million
    keys; an exact join of what is computed from the rows has to follow. NULL keys go.
    """
    bits = min(most_bits, max(15, (16 * keys.count()).bit_length()))

    def cell(column: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(column.cast("string")), 64 - bits)

    marks = materialize(bitmap(keys.where(F.col(key).isNotNull()).select(cell(F.col(key)).alias("__cell")), "__cell"), "key-marks")
    marks = marks.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    return (
        rows.where(F.col(key).isNotNull())
        .join(F.broadcast(marks), F.floor(cell(rows[key]) / BLOCK_BITS) == F.col("__block"))
        .where(bit_set(F.col("__bits"), cell(rows[key]))).select(*[rows[c] for c in rows.columns])
    )
