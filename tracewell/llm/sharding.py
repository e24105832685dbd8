"""Reproducible sharding by a Feistel permutation over global row numbers (operator 2).

Rows get global numbers in the order of (id, checksum, size). A keyed Feistel network permutes the smallest
even-bit domain that holds them; numbers that fall outside are walked along their cycle until they come back in.
The place p of a row then gives shard p mod shards and slot p div shards, so shard sizes differ by one at most,
slots have no gaps, and both are computable from the row number alone (``locate``) and back (``row_of``).

Defined results: a null text counts as empty. Rows that are equal in id, checksum and size are interchangeable.
An empty table gives an empty result. Null ids come first and stay null; ids of any size and type are handed on as they
are. Texts are never moved, whatever their length: only id, size and checksum are shuffled, and no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut

SHARDS, SEED, ROUNDS = 40, 20_240_607, 6
#: monotonically_increasing_id() holds the partition above this many bits and the row within it below.
ROW_BITS = 33


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) as round function."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, half: int, seed: int, back: bool = False) -> np.ndarray:
    """One pass of the network over 2 * half bits, or its inverse."""
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (mixed(left, seed + k) & mask), left
        else:
            left, right = right, left ^ (mixed(right, seed + k) & mask)
    return (left << h) | right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) by cycle walking."""
    half = half_bits(n)
    out = feistel(x.astype(np.uint64), half, seed, back)
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = feistel(out[far], half, seed, back)
    return out.astype(np.int64)


def locate(row: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers."""
    place = permute(row, n, seed)
    return place % shards, place // shards


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The global row numbers that stand in a shard's slots."""
    return permute(slot * shards + shard, n, seed, back=True)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with ``row_number`` from 0 in the given order, and their count. Only a count a partition reaches the driver."""
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("at", F.monotonically_increasing_id())
    counts = rows.groupBy(F.shiftright("at", ROW_BITS).alias("part")).agg(F.count("*").alias("n")).collect()
    first = np.zeros(max([r["part"] for r in counts], default=0) + 2, np.int64)
    for r in counts:
        first[r["part"] + 1] = r["n"]
    first = np.cumsum(first)

    @F.pandas_udf("bigint")
    def number(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series(first[at >> ROW_BITS] + (at & ((1 << ROW_BITS) - 1)))

    return rows.withColumn("row_number", number("at")).drop("at"), int(first[-1])


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id") -> DataFrame:
    """Put all rows into shards: id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col(id_column), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(narrow, [id_column, "text_crc32", "size"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, slot = locate(batch.column("row_number").to_numpy(), n, shards, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.int32)), pa.array(slot)], names=[*batch.schema.names, "shard", "slot"])

    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, size bigint, text_crc32 bigint, row_number bigint, shard int, slot bigint")
