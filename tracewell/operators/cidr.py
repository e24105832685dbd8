"""Addresses against a table of ranges: the first range, in the order of the list, that holds an address.

A range of length n holds exactly the addresses whose first n bits are its own, so each address is looked up once for
each length that occurs in the table, by equality. There are 32 lengths of one family and 128 of the other at most,
whatever the table's size. A range within an earlier one is never the first and goes beforehand; of those that stay each
is earlier than all around it, so the longest that holds an address is the first, and an address meets one at most of a
length. What stays is broadcast up to ``BROADCAST_RANGES`` rows; more are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import ip
from tracewell.operators.shared import cut

#: Ranges (some 200 bytes each) up to which the table is broadcast.
BROADCAST_RANGES = 100_000


def bits(address: Column) -> Column:
    """An address as its family and its bits, as text; null if it is no address."""
    four = F.concat(F.lit("4"), F.lpad(F.bin(ip.ipv4_number(address)), 32, "0"))
    halves = [F.lpad(F.conv(F.substring(ip.ipv6_key(address), at, 16), 16, 2), 64, "0") for at in (1, 17)]
    return F.coalesce(four, F.concat(F.lit("6"), *halves))


def ranges_of(table: DataFrame, cidr: str = "cidr", order: str = "ord") -> DataFrame:
    """(ord, prefix, size) and the other columns of a table of ranges in slash notation; host bits are ignored.

    A row that is no range (no address, or a length beyond its family's) has no part.
    """
    found = bits(F.substring_index(cidr, "/", 1))
    size = F.when(F.col(cidr).contains("/"), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(F.length(found) - 1)
    rows = table.withColumns({"prefix": found, "size": size}).where((F.col("size") >= 0) & (F.col("size") < F.length("prefix")))
    return rows.withColumn("prefix", F.expr("substring(prefix, 1, size + 1)"))


def first_match(addresses: DataFrame, address: str, ranges: DataFrame, order: str = "ord", keep: list[str] | None = None) -> DataFrame:
    """``addresses`` with the columns ``keep`` of the first range of ``ranges`` (see ranges_of) that holds each; null where none does.

    Equal addresses are looked up once. Addresses that are null or none at all are in no range.
    """
    keep = keep or [c for c in ranges.columns if c not in (order, "prefix", "size")]
    ranges = foremost(ranges.select("prefix", "size", order, *keep), order, keep)
    asked = addresses.select(address).distinct().withColumn("__bits", bits(F.col(address))).where("__bits is not null")
    few = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    table = F.broadcast(ranges) if few else ranges
    prefix = F.expr("substring(__bits, 1, size + 1)").alias("prefix")
    asked = asked.withColumn("size", F.explode(lengths_of(ranges, F.col("__bits")))).select(address, "__bits", "size", prefix)
    # Lengths are numbers, so their greatest is kept without sorting; the columns of its range are joined after.
    best = asked.join(table.select("prefix", "size"), ["prefix", "size"]).groupBy(address, "__bits").agg(F.max("size").alias("size"))
    best = best.select(address, "size", prefix).join(table, ["prefix", "size"]).select(address, F.struct(*keep).alias("__best"))
    return addresses.join(best, address, "left").select(*addresses.columns, *[F.col("__best")[c].alias(c) for c in keep])


def lengths_of(ranges: DataFrame, found: Column) -> Column:
    """The lengths that occur in a table of ranges, for the family of some bits."""
    sizes = [(r["family"], r["size"]) for r in ranges.select(F.substring("prefix", 1, 1).alias("family"), "size").distinct().collect()]
    of = lambda family: F.array(*[F.lit(s) for f, s in sizes if f == family]).cast("array<int>")
    return F.when(found.startswith("4"), of("4")).otherwise(of("6"))


def foremost(ranges: DataFrame, order: str, keep: list[str]) -> DataFrame:
    """(prefix, size, order and ``keep``) of the ranges that are first for some address: no equal or wider one is earlier.

    Of an equal order the wider one stands first. A range without an order is none.
    """
    first = cut(ranges.where(F.col(order).isNotNull()).groupBy("prefix", "size").agg(F.min(order).alias(order), F.min_by(F.struct(*keep), order).alias("kept")))
    around = first.select("prefix", "size", F.col(order).alias("own"), F.explode(F.filter(lengths_of(first, F.col("prefix")), lambda n: n < F.col("size"))).alias("wide"))
    around = around.withColumn("outer", F.expr("substring(prefix, 1, wide + 1)"))
    wider = first.select(F.col("prefix").alias("outer"), F.col("size").alias("wide"), F.col(order).alias("before"))
    covered = around.join(wider, ["outer", "wide"]).where("before <= own").select("prefix", "size").distinct()
    return cut(first.join(covered, ["prefix", "size"], "left_anti").select("prefix", "size", order, *[F.col("kept")[c].alias(c) for c in keep]))
