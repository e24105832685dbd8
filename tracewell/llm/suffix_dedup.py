"""Exact removal of repeated byte strings by suffix arrays and interval expansion (operator 6).

Every window of ``MINIMUM`` bytes is assigned to one anchor: the leftmost of its k-grams with the smallest hash. Equal
windows have equal anchors at equal offsets, so a window can only repeat among the contexts of its anchor. Contexts
(an anchor's windows in one text, as one string) that are equal are counted by partial aggregation: where there are
two, all their windows repeat, and one of them stands for the rest. What remains are contexts that share an anchor but
are not equal: the ends of repeats. Only their bytes are shuffled, by anchor, pruned by digests of what their windows
must share, and searched in bounded batches:

a suffix array (prefix doubling on what is still tied, no deeper than needed) gives the Burrows-Wheeler transform.
Breadth-first backward extension then expands intervals level by level: an interval of w found at level l settles the
common prefix of the two suffixes at its end as l, if nothing settled it before. The expansion stops at MINIMUM, and
boundaries that are not settled by then are those of suffixes which share MINIMUM bytes or more.

An anchor with more contexts than a batch holds is split by the windows themselves: their 128-bit digests are counted
by partial aggregation. Nothing is collected on the driver.

Defined results: a null text is empty; texts under MINIMUM bytes lose nothing. Rows are told apart by 128 bits of their
id and text, so rows that repeat a whole row count as copies of each other, and null or repeated ids are no exception.
An empty table gives an empty result. Columns other than the id and the text pass through ``remove_repeats`` as one
struct, so their names cannot clash. What a text holds at once (its contexts and spans) is in proportion to its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, cut, written

MINIMUM = 400
#: Bytes of an anchor (a power of two).
ANCHOR = 64
#: Bytes that a batch of suffixes, and a slice of texts, hold at most (a longer text makes a slice of its own).
BATCH_BYTES, SLICE_BYTES = 1 << 19, 1 << 20
#: An anchor with more contexts (of 500 bytes about) is split by windows.
HOT_CONTEXTS = 6000
#: Contexts that are pruned at once, and the step of offsets in which they are compared for it.
PRUNE_ROWS, CELL = 4000, 16
#: Keys up to which a key set is broadcast: 16 bytes a key. Beyond it, both sides are shuffled.
BROADCAST_KEYS = 1_000_000
#: The columns that tell a row by its id and text.
KEY = ["k1", "k2"]
#: Bits of a place within a slice in a packed minimum; longer slices take 64-bit minima in two passes.
PLACE_BITS = 26


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Random odd factors of the rolling hashes, the same on every machine.
BYTE, STEP = _odd(7, 256), _odd(11, 16)


def gram_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes (a power of two), by doubling."""
    h, m, k = BYTE[flat], 1, 0
    while m < width:
        h = h[:-m] * STEP[k] + h[m:]
        m, k = 2 * m, k + 1
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def contexts(flat: np.ndarray, sizes: np.ndarray, minimum: int = MINIMUM, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor place, anchor hash) of every context; places are in ``flat``."""
    none = np.zeros(0, np.int64)
    windows = len(flat) - minimum + 1
    if windows <= 0 or not (sizes >= minimum).any():
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(flat, anchor)
    span, n = minimum - anchor + 1, len(h)
    if n >= 1 << PLACE_BITS:
        raise ValueError("slices must be cut before they come here")
    # Equal hashes (in their upper bits) are told apart by place, so the leftmost is the smallest.
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = np.full(-(-n // span) * span, np.iinfo(np.uint64).max)
    packed[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    blocks = packed.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & low).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[:windows]
    valid = np.arange(windows) <= (starts + sizes - minimum)[text]
    change = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], windows] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return text[first], first, last, place[first], h[place[first]]


def byte_slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text, and the texts as bytes."""
    for batch in batches:
        raw = lambda part: part.column("text").fill_null("").cast(pa.binary()).to_pylist()
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield (part := batch.slice(start, i - start)), raw(part)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield (part := batch.slice(start)), raw(part)


def long_contexts(text: bytes, minimum: int, anchor: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """contexts() of one text of any length, in overlapping blocks that agree on every window."""
    block = 1 << (PLACE_BITS - 1)
    for at in range(0, max(1, len(text) - minimum + 1), block):
        part = np.frombuffer(text, np.uint8)[at : at + block + minimum - 1]
        yield at, part, contexts(part, np.array([len(part)]), minimum, anchor)


def records(docs: DataFrame, minimum: int = MINIMUM, anchor: int = ANCHOR) -> DataFrame:
    """Every context of ``docs`` (k1, k2, text): anchor, context digest, k1, k2, and ``at``, its place (see ``packed``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest

        def made(key: list[np.ndarray], view: memoryview, begin: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            whole = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + minimum).tolist(), strict=True)), np.uint64, len(first))
            at = packed(first - begin, last - first, place - first)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), *map(pa.array, key), pa.array(at)], names=["anchor", "context", *KEY, "at"])

        for batch, texts in byte_slices(batches):
            key = [batch.column(k).to_numpy() for k in KEY]
            if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
                for at, part, (_, first, last, place, h) in long_contexts(texts[0], minimum, anchor):
                    yield made([np.repeat(k, len(first)) for k in key], memoryview(part), np.full(len(first), -at), first, last, place, h)
                continue
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = np.frombuffer(b"".join(texts), np.uint8)
            text, first, last, place, h = contexts(flat, sizes, minimum, anchor)
            if len(first):
                yield made([k[text] for k in key], memoryview(flat), (np.cumsum(sizes) - sizes)[text], first, last, place, h)

    return docs.select(*KEY, "text").mapInArrow(bounded(run), "anchor bigint, context bigint, k1 bigint, k2 bigint, at bigint")


def packed(lo: np.ndarray, more: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First window, further windows and the anchor's place behind the first window in one number."""
    return lo << 32 | more << 16 | place


def unpacked(at: int) -> tuple[int, int, int]:
    return at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least. Symbol 0 separates strings: each 0 is smaller than
    all else and a symbol of its own, in the order of places."""
    n = len(symbols)
    wide = 7
    ends = np.flatnonzero(symbols == 0)
    to_end = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)  # the text ends with a separator
    short = to_end < wide  # these hold a separator, and are told apart by place
    key = np.zeros(n, np.int64)
    for k in range(min(wide, n)):
        key <<= 9
        key[: n - k] |= np.where(to_end[: n - k] >= k, symbols[k:], 0)
    order = np.argsort(key)
    own = short[order]
    tail = order[own]
    order[own] = tail[np.lexsort((tail, key[tail]))]
    sorted_key = key[order]
    head = np.r_[True, (sorted_key[1:] != sorted_key[:-1]) | own[1:] | own[:-1]]
    del key, sorted_key, own, to_end, short
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    done = wide
    tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while done < depth and len(tied):
        at = order[tied]
        sub = rank[at].astype(np.int64) << 32 | rank[np.minimum(at + done, n - 1)]
        by = np.argsort(sub)
        at, sub = at[by], sub[by]
        order[tied] = at
        head = np.r_[True, sub[1:] != sub[:-1]]
        rank[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        tied = tied[~(head & np.r_[head[1:], True])]
        done *= 2
    return order


def unsettled(symbols: np.ndarray, order: np.ndarray, minimum: int) -> np.ndarray:
    """Which boundaries i (between the suffixes of ranks i - 1 and i) have a common prefix of ``minimum`` or more.

    Breadth-first backward extension: all intervals of one level are extended at once by every symbol before them. An
    interval with one symbol before all its suffixes keeps their order, so the steps of its ends are those of the next.
    """
    n = len(symbols)
    before = symbols[order - 1]  # the transform; the first suffix wraps around to the last separator
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)
    step[by_symbol] = np.arange(n, dtype=np.int32)
    keyed = before[by_symbol].astype(np.int64) * n + by_symbol  # (symbol, rank): sorted, so counting is a binary search
    step[before == 0] = -1
    change = np.r_[True, before[1:] != before[:-1]]
    heads, run = np.flatnonzero(change).astype(np.int32), np.cumsum(change, dtype=np.int32)  # runs of equal symbols
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for level in range(minimum):
        if not len(low):
            break
        one = run[low] == run[high - 1]
        begin, end = step[low[one]], step[high[one] - 1] + 1
        live = begin >= 0
        begin, end = begin[live], end[live]
        if not one.all():
            low, high = low[~one], high[~one]
            # The symbols before an interval: at its start, and at the heads of runs within it.
            first, count = run[low], run[high - 1] - run[low] + 1
            owner = np.repeat(np.arange(len(low)), count)
            along = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            symbol = before[heads[first[owner] - 1 + along]].astype(np.int64)
            pair = np.sort(owner[symbol > 0] << 9 | symbol[symbol > 0])
            pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
            owner, symbol = pair >> 9, pair & 511
            begin = np.r_[begin, np.searchsorted(keyed, symbol * n + low[owner]).astype(np.int32)]
            end = np.r_[end, np.searchsorted(keyed, symbol * n + high[owner]).astype(np.int32)]
        if level == 0:  # each separator is a symbol of its own, with one suffix
            single = np.arange(np.count_nonzero(symbols == 0), dtype=np.int32)
            begin, end = np.r_[begin, single], np.r_[end, single + 1]
        new = ~settled[end]
        low, high = begin[new], end[new]
        settled[high] = True
    return ~settled


def repeated(strings: list[bytes], minimum: int = MINIMUM) -> list[np.ndarray]:
    """For each string, the places from which ``minimum`` bytes start that start somewhere else among all strings too."""
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(strings), np.int16)
    owner = np.repeat(np.arange(len(strings)), sizes)
    symbols[np.arange(len(flat)) + owner] = flat
    order = suffix_array(symbols, minimum)
    same = unsettled(symbols, order, minimum)
    hit = np.zeros(len(symbols), bool)
    hit[order[same[:-1] | same[1:]]] = True
    return [np.flatnonzero(hit[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive sorted places."""
    gap = np.flatnonzero(np.diff(places) > 1)
    return places[np.r_[0, gap + 1]], places[np.r_[gap, len(places) - 1]]


class Row(NamedTuple):
    """A context, or the part of it that may repeat: windows from ``lo`` on, the anchor's place in ``raw``."""

    anchor: int
    many: bool  # stands for equal ones elsewhere
    k1: int
    k2: int
    lo: int
    place: int
    raw: bytes


def pruned(rows: list[Row], minimum: int) -> list[Row]:
    """What of the contexts of whole anchors may repeat.

    Windows with their anchor at an offset from g to g + CELL - 1 all hold the ``minimum - CELL + 1`` bytes around the
    anchor that begin at offset g; windows of two contexts can only be equal if these are. A context without such a
    partner goes, and the others are trimmed to the offsets that have one.
    """
    seen: dict[tuple[int, int, int], int] = {}
    cells = []
    for r in rows:
        own = []
        view = memoryview(r.raw)
        for g in range((r.place - (len(r.raw) - minimum)) // CELL, r.place // CELL + 1):
            start = r.place - g * CELL
            cell = (r.anchor, g, xxhash.xxh3_64_intdigest(view[max(start, 0) : start - CELL + 1 + minimum]))
            seen[cell] = seen.get(cell, 0) + 1
            own.append(cell)
        cells.append(own)
    out = []
    for r, own in zip(rows, cells, strict=True):
        shared = [c[1] for c in own if seen[c] > 1]
        if shared:
            first = max(0, r.place - shared[-1] * CELL - CELL + 1)
            last = min(len(r.raw) - minimum, r.place - shared[0] * CELL)
            out.append(Row(r.anchor, r.many, r.k1, r.k2, r.lo + first, r.place - first, r.raw[first : last + minimum]))
    return out


def batch_repeats(rows: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Rows (see ``Row``) to ranges (k1, k2, lo, hi) of repeated windows."""

    def search(held: list[Row]) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        for r, places in zip(held, repeated([r.raw for r in held], minimum), strict=True):
            if len(places) and not r.many:
                first, last = runs(places)
                for column, x in zip(out, ([r.k1] * len(first), [r.k2] * len(first), (first + r.lo).tolist(), (last + r.lo).tolist()), strict=True):
                    column += x
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[*KEY, "lo", "hi"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[Row] = []  # pruned rows of whole anchors
        ready_bytes = 0
        group: list[Row] = []  # rows of the anchor that is being read
        pending: list[Row] = []  # rows of whole anchors, not yet pruned

        for batch in batches:
            for row in map(Row._make, zip(*[batch.column(c).to_pylist() for c in Row._fields], strict=True)):
                if group and (row.anchor, *row[2:5]) == (group[-1].anchor, *group[-1][2:5]):
                    continue  # from a row that repeats another as a whole
                if group and row.anchor != group[-1].anchor:
                    pending += group
                    group = []
                    if len(pending) >= PRUNE_ROWS:
                        for r in pruned(pending, minimum):
                            if ready and ready_bytes >= BATCH_BYTES and r.anchor != ready[-1].anchor:
                                yield search(ready)
                                ready, ready_bytes = [], 0
                            ready.append(r)
                            ready_bytes += len(r.raw)
                        pending = []
                group.append(row)
        for r in pruned(pending + group, minimum):
            if ready and ready_bytes >= BATCH_BYTES and r.anchor != ready[-1].anchor:
                yield search(ready)
                ready, ready_bytes = [], 0
            ready.append(r)
            ready_bytes += len(r.raw)
        if ready:
            yield search(ready)

    return rows.repartition("anchor").sortWithinPartitions("anchor", *KEY, "lo").mapInArrow(bounded(run), "k1 bigint, k2 bigint, lo bigint, hi bigint")


def context_rows(texts: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Rows (k1, k2, text, wanted) to the bytes of the wanted contexts; ``wanted`` holds (anchor, many, at)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in byte_slices(batches):
            out: list[list] = [[] for _ in Row._fields]
            for k1, k2, text, wanted in zip(*[batch.column(k).to_pylist() for k in KEY], raw, batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    lo, more, place = unpacked(w["at"])
                    for column, x in zip(out, (w["anchor"], w["many"], k1, k2, lo, place, text[lo : lo + more + minimum]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=list(Row._fields))

    return texts.select(*KEY, "text", "wanted").mapInArrow(bounded(run), "anchor bigint, many boolean, k1 bigint, k2 bigint, lo bigint, place bigint, raw binary")


def window_repeats(rows: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Like batch_repeats() for anchors with too many contexts: windows counted by 128-bit digest, which splits at any size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for many, k1, k2, lo, raw in zip(*[batch.column(c).to_pylist() for c in ("many", *KEY, "lo", "raw")], strict=True):
                view, n = memoryview(raw), len(raw) - minimum + 1
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(view[i : i + minimum]) for i in range(n)], pa.binary()), pa.array([many] * n), *[pa.array([k] * n, pa.int64()) for k in (k1, k2)], pa.array(range(lo, lo + n), pa.int64())], names=["window", "many", *KEY, "lo"])

    once = rows.dropDuplicates(["anchor", *KEY, "lo"])  # rows may repeat others as a whole
    windows = cut(once.mapInArrow(bounded(run), "window binary, many boolean, k1 bigint, k2 bigint, lo bigint"))
    often = windows.groupBy("window").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1")
    return windows.where("not many").join(often, "window", "left_semi").select(*KEY, "lo", F.col("lo").alias("hi"))


def of_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join; the key set is broadcast only where its size is bounded, else both sides are shuffled."""
    keys = keys.select(*on)
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, on, how)


def repeated_windows(found: DataFrame, docs: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Ranges (k1, k2, lo, hi) of windows that start elsewhere too, over ``docs`` (k1, k2, text) with the contexts ``found``."""
    # Any member may stand for its class: the three first values come from one row.
    classes = cut(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*KEY, "at")]))
    often = cut(classes.where("n > 1").select("anchor", "context"))
    lo = F.shiftright("at", 32)
    whole = of_keys(found, often, ["anchor", "context"], "left_semi").select(*KEY, lo.alias("lo"), (lo + F.shiftright("at", 16).bitwiseAND(0xFFFF)).alias("hi"))
    # Contexts that are not equal can share a window only with another one of their anchor.
    shared = cut(classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("rarest")).where("k > 1 and rarest = 1").select("anchor", (F.col("k") > HOT_CONTEXTS).alias("hot")))
    near = of_keys(classes, shared, ["anchor"], "left_semi").join(shared, "anchor")
    wanted = cut(near.groupBy(*KEY).agg(F.collect_set(F.struct("anchor", (F.col("n") > 1).alias("many"), "at", "hot")).alias("wanted")))
    texts = of_keys(docs, wanted, KEY, "left_semi").join(wanted, KEY)
    pick = lambda hot: texts.withColumn("wanted", F.filter("wanted", lambda w: w["hot"] == F.lit(hot))).where(F.size("wanted") > 0)
    out = whole.unionByName(batch_repeats(context_rows(pick(False), minimum), minimum))
    if shared.where("hot").take(1):
        out = out.unionByName(window_repeats(context_rows(pick(True), minimum), minimum))
    return out


def keyed(docs: DataFrame, id_column: str, *columns: Column) -> DataFrame:
    """``k1`` and ``k2`` (128 bits, the same for rows with equal id and text only), ``text`` and the columns."""
    half = lambda *seed: F.xxhash64(*seed, F.isnull(id_column), id_column, F.isnull("text"), "text")
    return docs.select(half().alias("k1"), half(F.lit(1)).alias("k2"), "text", *columns)


def removed(spans: list[dict] | None, minimum: int) -> list[tuple[int, int]]:
    """Maximal runs [first, end) of bytes that spans of windows cover."""
    out: list[tuple[int, int]] = []
    for lo, end in sorted((s["lo"], s["hi"] + minimum) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((lo, end))
    return out


def spans_of(rows: DataFrame, minimum: int, anchor: int, name: str) -> DataFrame:
    """(k1, k2, ``name``) of every row with repeated windows: their ranges."""
    with written(records(rows, minimum, anchor)) as found:
        ranges = repeated_windows(found, rows.select(*KEY, "text"), minimum)
        return cut(ranges.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias(name)))


def with_spans(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that have spans, with them, and the rows without."""
    return of_keys(rows, spans, KEY, "left_semi").join(spans, KEY), of_keys(rows, spans, KEY, "left_anti")


def kept_digests(docs: DataFrame, minimum: int = MINIMUM, anchor: int = ANCHOR, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs, id_column, F.col(id_column).alias("id"))
    touched, rest = with_spans(rows, spans_of(rows, minimum, anchor, "spans"))
    numbers = ["n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches):
            out, sha = [], []
            for text, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                cuts, at, kept = removed(spans, minimum), 0, hashlib.sha256()
                for a, b in cuts:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in cuts), len(cuts)))
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([x[k] for x in out], pa.int64()) for k in range(len(numbers))], pa.array(sha, pa.string())], names=["id", *numbers, "kept_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    changed = touched.select("id", "text", "spans").mapInArrow(bounded(run), f"id {kind}, {', '.join(f'{n} bigint' for n in numbers)}, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    none = F.lit(0).cast("long")
    same = rest.select("id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return changed.unionByName(same).select(F.col("id").alias(id_column), *numbers, "kept_sha256")


def remove_repeats(docs: DataFrame, minimum: int = MINIMUM, anchor: int = ANCHOR, id_column: str = "doc_id") -> DataFrame:
    """The documents with repeated bytes taken out of ``text`` (bytes cut within a character become U+FFFD); other columns stay."""
    rows = keyed(docs, id_column, F.struct(*[F.lit(None).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]).alias("rest"))
    touched, untouched = with_spans(rows, spans_of(rows, minimum, anchor, "spans"))

    @F.pandas_udf("string")
    def cut_text(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, s in zip(text, spans, strict=True):
            raw, at, kept = t.encode(), 0, []
            for a, b in removed(list(s), minimum):
                kept.append(raw[at:a])
                at = b
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
        return pd.Series(out)

    back = lambda df, text: df.select(*[(text if c == "text" else F.col("rest")[c]).alias(c) for c in docs.columns])
    return back(touched, cut_text("text", "spans")).unionByName(back(untouched, F.col("text")))
