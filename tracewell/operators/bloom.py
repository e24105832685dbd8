"""Mergeable Bloom filters of hashes as tables of bitmaps.

A hash falls into one block by its own value, and sets ``BITS`` bits of that block; so a filter is a table (block,
bits) that grows with what it holds, merges by bitwise or, and is asked by an equi-join on blocks. With ``PER_HASH``
bits for each hash about 1 in 100 hashes that it does not hold seem to be held; none that it holds is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block (fixed by Spark's bitmaps), bits that a hash sets, and bits of the filter for each hash.
BLOCK_BITS, BITS, PER_HASH = 32_768, 7, 10


def blocks_for(hashes: int) -> int:
    return max(1, -(-hashes * PER_HASH // BLOCK_BITS))


def block_of(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks))


def places(value: Column) -> Column:
    """The bits that a hash sets in its block."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), value), F.lit(BLOCK_BITS)) for k in range(BITS)])


def filter_of(rows: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter (block, bits) of a column's values."""
    value = F.col(column)
    set_bits = rows.where(value.isNotNull()).select(block_of(value, blocks).alias("block"), F.explode(places(value)).alias("place"))
    return set_bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all that several filters of as many blocks hold."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def asked(rows: DataFrame, column: str, held: DataFrame, blocks: int, name: str = "maybe") -> DataFrame:
    """``rows`` with ``name``: whether the filter may hold the column's value. Nulls are not held."""
    value = F.col(column)
    at = rows.withColumn("block", block_of(value, blocks)).join(held, "block", "left")
    byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = lambda p: F.bit_get(byte(p), p.bitwiseAND(7).cast("int")) == 1
    return at.withColumn(name, F.coalesce(value.isNotNull() & F.col("bits").isNotNull() & F.forall(places(value), is_set), F.lit(False))).drop("block", "bits")
