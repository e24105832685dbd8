"""Best-fit packing of token sequences by bin completion branch-and-bound (operator 7).

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver. The search
works on it: it takes the largest length that is left, enumerates the undominated fillings of the room around it,
prunes by waste, and repeats the chosen filling as often as the counts allow, so that every step uses up a length.
Best-fit decreasing gives the first incumbent and waste bounds cut the rest. Pieces then find their place by their
rank among the pieces of their length: ranks are made within salted groups of a length, so no length, however
common, meets in one task.

Defined results: a null or empty text is the one id 0. Texts longer than the capacity are cut into pieces of the
capacity, the last one shorter. Repeated rows are packed each on their own. An empty table gives an empty result.
Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import bpe
from tracewell.llm.common import bounded, cut, text_slices

CAPACITY = 2048
#: Rows that one rank group holds about.
GROUP_ROWS = 1 << 16
#: Fillings that the search compares around one document, and states it opens in all.
FILL_NODES, STATE_NODES = 4000, 3000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), how often


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id") -> DataFrame:
    """Token pieces of every whole text: id, piece, start, length, ids_crc32. A narrow map."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache = bpe.load(path), bpe.id_cache(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch, texts in text_slices(batches):
            split = [vocabulary.parts(t) for t in texts]
            known = cache.get_all(split)
            row, piece, start, length, crc = [], [], [], [], []
            for i, p in enumerate(split):
                ids = b"".join([*map(known.__getitem__, p), end])
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_column, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_column, "text").mapInArrow(bounded(run, keep_words=True), f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: by volume, and by the pairs of items over half (Martello and Toth's L2)."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in [0, *[n for n in lengths if n <= capacity // 2]]:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        half = [(n, c) for n, c in counts.items() if capacity - k >= n > capacity // 2]
        small = sum(n * c for n, c in counts.items() if capacity // 2 >= n >= k)
        room = sum((capacity - n) * c for n, c in half)
        best = max(best, large + sum(c for _, c in half) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing on the histogram: bins with equal contents are one group with a count."""
    groups: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}

    def put(room: int, items: tuple[tuple[int, int], ...], n: int) -> None:
        at = groups.setdefault(room, {})
        at[items] = at.get(items, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, at in groups.items() if r >= length and at), default=None)
            if room is None:
                k = min(capacity // length, left)
                put(capacity - k * length, ((length, k),), left // k)
                left -= left // k * k
                continue
            items, n = groups[room].popitem()
            k = min(room // length, max(1, left // n))
            use = min(n, left // k)
            if n > use:
                put(room, items, n - use)
            put(room - k * length, (*items, (length, k)), use)
            left -= use * k
    return [(items, n) for at in groups.values() for items, n in at.items()]


def fillings(room: int, counts: dict[int, int], lengths: list[int], most: int = 3, nodes: int = FILL_NODES) -> list[tuple[tuple[int, int], ...]]:
    """Undominated fillings of ``room``, least waste first.

    Larger documents are tried before smaller ones, a branch is cut when even all that is left cannot beat the
    worst filling kept, and a filling without waste ends the search. A filling with room for another document is
    dominated and never kept. ``lengths`` runs from the largest to the smallest with a count left.
    """
    lengths = lengths[bisect.bisect_left(lengths, -room, key=lambda n: -n) :]
    volume = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        volume[i] = volume[i + 1] + lengths[i] * counts[lengths[i]]
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    budget = nodes

    def search(i: int, left: int, items: tuple[tuple[int, int], ...]) -> bool:
        nonlocal budget
        budget -= 1
        for j in range(max(i, bisect.bisect_left(lengths, -left, key=lambda n: -n)), len(lengths)):
            if budget <= 0 or len(found) >= most and left - volume[j] >= found[-1][0]:
                break
            n = lengths[j]
            for k in range(min(left // n, counts[n]), 0, -1):
                if search(j + 1, left - k * n, (*items, (n, k))):
                    return True
        taken = dict(items)
        if left and any(counts[n] > taken.get(n, 0) for n in lengths[bisect.bisect_left(lengths, -left, key=lambda n: -n) :]):
            return False
        found.append((left, items))
        found.sort(key=lambda x: x[0])
        del found[most:]
        return not left

    search(0, room, ())
    if not found:  # the budget ended before any leaf: fill greedily
        items, left = [], room
        for n in lengths:
            if k := min(left // n, counts[n]):
                items.append((n, k))
                left -= k * n
        found.append((left, tuple(items)))
    return [items for _, items in found]


def solve(counts: dict[int, int], capacity: int = CAPACITY, states: int = STATE_NODES) -> list[Pattern]:
    """Patterns that pack all lengths into few bins: bin completion, depth first, from the best-fit incumbent."""
    counts = {n: c for n, c in counts.items() if c}
    incumbent = best_fit(counts, capacity)
    bins, bound = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    stack: list[tuple[dict[int, int], int, tuple | None]] = [(counts, 0, None)]
    while stack and bins > bound and states:
        states -= 1
        left, used, chain = stack.pop()
        if not left:
            if used < bins:
                bins, incumbent = used, []
                while chain:
                    incumbent.append(chain[0])
                    chain = chain[1]
            continue
        if used - (-sum(n * c for n, c in left.items()) // capacity) >= bins:
            continue
        lengths = sorted(left, reverse=True)
        largest = lengths[0]
        rest = left | {largest: left[largest] - 1}
        around = [n for n in lengths if rest[n]]
        for items in reversed(fillings(capacity - largest, rest, around)):
            whole = dict(items)
            whole[largest] = whole.get(largest, 0) + 1
            times = min(left[n] // k for n, k in whole.items())
            after = {n: c for n, c in ((n, c - times * whole.get(n, 0)) for n, c in left.items()) if c}
            stack.append((after, used + times, ((tuple(whole.items()), times), chain)))
    return incumbent


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """Where the pieces of a length go, by rank: rows (length, first rank, base sequence, offset, how many in a sequence)."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for items, times in patterns:
        offset = 0
        for n, k in items:
            rows.append((n, seen.get(n, 0), base, offset, k))
            seen[n] = seen.get(n, 0) + times * k
            offset += n * k
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "base", "offset", "many"], dtype=np.int64).sort_values(["length", "first"], ignore_index=True)


def pack(parts: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """Give every piece (id, piece, start, length, ids_crc32) its ``sequence_id`` and ``offset``."""
    parts = cut(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = slots(solve(counts, capacity))
    salts = max(8, sum(counts.values()) // GROUP_ROWS)
    order = [id_column, "piece", "ids_crc32"]
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("size"))
    before = sizes.select("length", "salt", (F.sum("size").over(Window.partitionBy("length").orderBy("salt")) - F.col("size")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    keys, first = at["length"].to_numpy() << 40, at["first"].to_numpy()
    keys, base, offset, many = keys + first, at["base"].to_numpy(), at["offset"].to_numpy(), at["many"].to_numpy()

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, (length.to_numpy() << 40) + rank.to_numpy(), "right") - 1
        along = rank.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": base[k] + along // many[k], "offset": offset[k] + along % many[k] * length.to_numpy()})

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select(id_column, "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """Tokenize, cut and pack all documents."""
    return pack(pieces(docs, path, capacity, id_column=id_column), capacity, id_column)
