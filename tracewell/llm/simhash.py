"""SimHash near-duplicate groups by pigeonring filtering (operator 9).

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints are one vertex from the start, so groups of
exact copies cost a partial aggregation. Two fingerprints at ``radius`` or fewer differing bits, cut into
``SEGMENTS`` segments on a ring, must have a segment from which every chain of l consecutive segments differs in at
most l * radius / SEGMENTS bits. The chain of one gives the index: that segment is equal. The chain of two, where its
budget is one bit, narrows it: of the next segment's halves one is equal too. Within a bucket the longer chains are
checked, and only what passes them gets the full Hamming check.

A bucket is searched breadth first with what is not yet reached, so it gives links that join its members and never
all its pairs. Components come from alternating large-star and small-star steps; nothing but counts reaches the driver.

Defined results: texts with fewer words than a shingle give one shingle of all their words; texts with none (null
too) have fingerprint zero and link like any other. Repeated rows are exact copies. A group's id is its smallest
non-null document id. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, boxed, cut, has, row_key, text_slices, unboxed

SHINGLE_WORDS, RADIUS, HASH_SEED = 3, 3, 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Buckets of at most this many fingerprints are compared by shifted arrays, larger ones breadth first.
SMALL_BUCKET = 16
#: Hashes that are unpacked into bits at once.
BITS_ROWS = 1 << 16


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit over unsigned 64-bit hashes; a tie is 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_ROWS):
        part = hashes[at : at + BITS_ROWS].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, words_in: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the shingles, repeats included."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*[words[k:] for k in range(words_in)], strict=False) if len(words) >= words_in else [words]
    n = max(1, len(words) - words_in + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(HASH_SEED)), np.uint64, n)


def fingerprints(docs: DataFrame, words_in: int = SHINGLE_WORDS, id_column: str = "doc_id") -> DataFrame:
    """id, ``fp`` (the fingerprint's bits as a long). A narrow map."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            fp = np.array([fingerprint(shingle_hashes(t, words_in)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_column, "fp"])

    return docs.select(id_column, "text").mapInArrow(bounded(run), f"`{id_column}` {kind}, fp bigint")


def budgets(radius: int = RADIUS) -> list[int]:
    """The most bits in which a chain of 1, 2, ... segments may differ."""
    return [chain * radius // SEGMENTS for chain in range(1, SEGMENTS + 1)]


def chained(a: np.ndarray, b: np.ndarray, segment: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs pass the chains that begin at the segment, and then the full check."""
    differ = a ^ b
    at = np.arange(len(differ))
    total = np.zeros(len(differ), np.int64)
    for chain, budget in enumerate(budgets(radius)):
        shift = (SEGMENT_BITS * ((segment[at] + chain) % SEGMENTS)).astype(np.uint64)
        total = total + np.bitwise_count((differ[at] >> shift) & np.uint64(0xFFFF))
        ok = total <= budget
        at, total = at[ok], total[ok]
    return at[np.bitwise_count(differ[at]) <= radius]


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within each bucket; rows come sorted by key, whose top bits hold the segment."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    segment = key >> 32
    left, right = [], []
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    for d in range(1, SMALL_BUCKET):
        i = np.flatnonzero(small[:-d] & (key[:-d] == key[d:]))
        if not len(i):
            break
        i = i[chained(fp[i], fp[i + d], segment[i], radius)]
        left.append(fp[i])
        right.append(fp[i + d])
    for s, n in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        rest, first = fp[s : s + n], segment[s : s + 1]
        while len(rest):  # a component of the bucket at a time
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = chained(np.full(len(rest), x, np.uint64), rest, np.broadcast_to(first, len(rest)), radius)
                if len(near):
                    left.append(np.full(len(near), x, np.uint64))
                    right.append(rest[near])
                    front += rest[near].tolist()
                    rest = np.delete(rest, near)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` within ``radius``; enough of them to join every component."""
    if not 0 <= radius < SEGMENTS:
        raise ValueError(f"radius must be from 0 to {SEGMENTS - 1}: the chain of one must be exact")
    narrow = budgets(radius)[1] <= 1  # then one half of the next segment is equal
    entries = []
    for s in range(SEGMENTS):
        own = F.shiftrightunsigned("fp", SEGMENT_BITS * s).bitwiseAND(0xFFFF)
        after = F.shiftrightunsigned("fp", SEGMENT_BITS * ((s + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        for half in range(2 if narrow else 1):
            part = F.shiftright(after, 8 * half).bitwiseAND(0xFF) if narrow else F.lit(0)
            entries.append(F.shiftleft(F.lit(s).cast("long"), 32) + F.shiftleft(F.lit(half).cast("long"), 24) + F.shiftleft(own, 8) + part)
    keyed = fps.select("fp", F.explode(F.array(*entries)).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def made(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(key, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_key = np.r_[held_key, batch.column("key").to_numpy()]
            held_fp = np.r_[held_fp, batch.column("fp").to_numpy().view(np.uint64)]
            end = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0  # the last bucket may go on
            if end:
                yield made(held_key[:end], held_fp[:end])
                held_key, held_fp = held_key[end:], held_fp[end:]
        if len(held_key):
            yield made(held_key, held_fp)

    return keyed.select("key", "fp").mapInArrow(bounded(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of all vertices with a link, by alternating large-star and small-star until nothing changes."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while has(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours of u move to its smallest neighbour.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # Done when both hold the same edges: the edge sets only shrink towards stars.
        mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark(after) == mark(edges):
            break
        edges = after
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, words_in: int = SHINGLE_WORDS, radius: int = RADIUS, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, ``fp`` and ``component_id``, the smallest id that links reach."""
    marked = cut(fingerprints(docs, words_in, id_column))
    distinct = marked.groupBy("fp").agg(F.min(id_column).alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(groups, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_column, "fp", "component_id")


def keyed(docs: DataFrame, id_column: str) -> DataFrame:
    """``key`` (128 bits, shared by rows of equal id and text only), ``id``, ``text``, and the other columns as ``rest``."""
    return boxed(docs, row_key(id_column).alias("key"), F.col(id_column).alias("id"))


def firsts(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Of ``rows`` one row of each group (key, ``by``): that of the smallest id, rows without an id last."""
    named = groups.join(rows.select("key", "id").distinct(), "key")
    kept = named.groupBy(by).agg(F.min(F.struct(F.isnull("id"), "id", "key")).alias("best")).select(F.col("best.key").alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"])


def deduplicate(docs: DataFrame, words_in: int = SHINGLE_WORDS, radius: int = RADIUS, id_column: str = "doc_id") -> DataFrame:
    """One row of each group: that of its smallest id, rows without an id last, with all its columns.

    Each row has a key of its own, which only rows with equal id and text share; ids may repeat or be null. Columns of
    any name are carried as one struct. Texts are shuffled once, by key: the semi-join and the removal of repeated keys
    share that exchange.
    """
    rows = keyed(docs, id_column)
    groups = near_duplicates(rows, words_in, radius, "key").distinct()
    return unboxed(firsts(rows, groups.select("key", "component_id"), "component_id"), docs.columns)
