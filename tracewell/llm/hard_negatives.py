"""Hard negatives by dual-tree search over inner products (operator 11).

One tree, split at the medians of a bounded sample along its longest axes, sorts all rows into leaves; anchors form
groups by an upper part of the same tree. Leaves and groups are written as blocks of bounded size with their bounding
box, centre, radius and labels: a vector that any share of the rows repeats fills blocks by id, not one leaf. A pair of
nodes bounds the inner products below it from both sides, by the boxes and by the balls. Two searches follow, first for
the positives, then for the negatives of each positive's window. Each scores a few leaves for every group first; what
the k-th best of an anchor reaches there is its floor, and the traversal from both roots drops a pair of nodes as soon as
its interval lies under the floors (or over the windows) of all anchors below, or its labels cannot match. The pairs of
leaf and group that are left meet by an equi-join, and blocks are scored exactly as matrices, again by descending bound
and against rising floors. The driver holds the tree with its bounds only: at most ``LEAVES`` leaves, whatever the input.

Where vectors have no structure, intervals of wide nodes stay wide, and most pairs of leaf and group are scored: the work
is then anchors times rows, in blocks, and moves a block once for each group of ``GROUP`` anchors.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do those
whose dimension is not the most common one (the smaller on a tie); a zero vector does. Labels are integers. A component x
counts as floor(256 x), within the range of an int; scores are exact. Ties go to the smaller id. A row that repeats id,
label and vector counts once; an id with different vectors or labels counts as several rows, and no row of its id is an
anchor's positive or negative. An anchor without positives has no rows. An empty table gives an empty result. Only the
id, the vector and what the conditions name are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, cut, stored

FIT_ROWS, SPLIT_TURNS, SEED = 16_384, 8, 11
#: Rows of a block and anchors of a group at most; leaves at most; rows that are scored first; blocks that a task takes together.
BLOCK, GROUP, LEAVES, FIRST_ROWS, TOGETHER = 1024, 128, 4096, 4096, 16
SCALE = 256
#: Node pairs whose bounds are worked out at once.
PAIRS = 1 << 14
BLOCKS = "node int, gid bigint, n int, ids binary, labels binary, x binary, low binary, high binary, centre binary, radius double, mask bigint, lone bigint"


@dataclass
class Splits:
    """A complete binary tree as a heap (its root is 1): rows whose projection exceeds the threshold go right."""

    depth: int
    axes: np.ndarray
    at: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.axes[node]) > self.at[node])
        return node - (1 << self.depth)


def split(x: np.ndarray, depth: int) -> Splits:
    """Median splits of a sample, each along the axis on which its part spreads most."""
    axes, at = np.zeros((1 << depth, x.shape[1])), np.zeros(1 << depth)
    parts = {1: x}
    rng = np.random.default_rng(SEED)
    for node in range(1, 1 << depth):
        own = parts.pop(node)
        if len(own) > 1:
            flat = own - own.mean(axis=0)
            axis = rng.standard_normal(x.shape[1])
            for _ in range(SPLIT_TURNS):
                axis = flat.T @ (flat @ axis)
                axis /= np.linalg.norm(axis) or 1
            axes[node], at[node] = axis, np.median(own @ axis)
        right = own @ axes[node] > at[node]
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return Splits(depth, axes, at)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def label_bits(labels: np.ndarray) -> int:
    """A set of labels as 64 bits; sets that share no bit share no label. As a signed number."""
    return int(np.bitwise_or.reduce(np.uint64(1) << (labels % 64).astype(np.uint64)).astype(np.int64))


def packer(most: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the rows of a node (or a part of them) into blocks of ``most`` rows."""

    def pack(rows: pa.Table) -> pa.Table:
        ids, labels, x = rows.column("id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("x"))
        whole = np.ascontiguousarray(np.c_[ids.view(np.float64), labels.view(np.float64), x])
        _, first = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_index=True)
        first = first[np.lexsort((ids[first], labels[first]))]
        ids, labels, x = ids[first], labels[first], x[first]
        node, part = rows.column("node")[0].as_py(), rows.column("part")[0].as_py()
        out = []
        for k, s in enumerate(range(0, len(ids), most)):
            i, y, v = ids[s : s + most], labels[s : s + most], x[s : s + most]
            centre = v.mean(axis=0)
            radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1).max()))
            gid = ((node << 24 | part) << 8 | k) << 8
            out.append((node, gid, len(i), i.tobytes(), y.tobytes(), v.astype(np.int32).tobytes(), v.min(axis=0).astype(float).tobytes(), v.max(axis=0).astype(float).tobytes(), centre.tobytes(), radius, label_bits(y), int(y[0]) if y[0] == y[-1] else None))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.float64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return pack


def packed(rows: DataFrame, node: Column, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows of a node. Rows of large nodes are dealt out by id."""
    rows = rows.withColumn("node", node.cast("int"))
    parts = rows.groupBy("node").agg(F.ceil(F.count("*") / most).alias("parts"))
    rows = rows.join(F.broadcast(parts), "node")  # one row a node, LEAVES at most
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return stored(rows.withColumn("part", part).groupBy("node", "part").applyInArrow(packer(most), BLOCKS))


@dataclass
class Bounds:
    """What is known of some nodes: box, ball and labels; floors and ceilings of the scores they can use."""

    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    mask: np.ndarray
    lone: np.ndarray  # their only label, or MIXED
    floor: np.ndarray
    ceiling: np.ndarray


MIXED = np.iinfo(np.int64).min


def heap(low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray, count: np.ndarray, mask: np.ndarray, lone: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> Bounds:
    """All nodes of the complete tree over these leaves, as a heap; leaves of count 0 are empty."""
    n, dim = 1 << max(0, int(len(count) - 1).bit_length()), low.shape[1]
    b = Bounds(np.full((2 * n, dim), np.inf), np.full((2 * n, dim), -np.inf), np.zeros((2 * n, dim)), np.zeros(2 * n), np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint64), np.full(2 * n, MIXED), np.full(2 * n, np.inf), np.full(2 * n, -np.inf))
    own = slice(n, n + len(count))
    b.low[own], b.high[own], b.centre[own], b.radius[own], b.count[own], b.mask[own], b.lone[own], b.floor[own], b.ceiling[own] = low, high, centre, radius, count, mask, lone, floor, ceiling
    start = n
    while start > 1:
        start //= 2
        up, left, right = np.arange(start, 2 * start), np.arange(2 * start, 4 * start, 2), np.arange(2 * start + 1, 4 * start, 2)
        b.low[up], b.high[up] = np.minimum(b.low[left], b.low[right]), np.maximum(b.high[left], b.high[right])
        b.count[up], b.mask[up] = b.count[left] + b.count[right], b.mask[left] | b.mask[right]
        b.floor[up], b.ceiling[up] = np.minimum(b.floor[left], b.floor[right]), np.maximum(b.ceiling[left], b.ceiling[right])
        share = (b.count[left] / np.maximum(b.count[up], 1))[:, None]
        b.centre[up] = share * b.centre[left] + (1 - share) * b.centre[right]
        far = [np.where(b.count[x] > 0, np.linalg.norm(b.centre[x] - b.centre[up], axis=1) + b.radius[x], 0) for x in (left, right)]
        b.radius[up] = np.maximum(*far)
        same = np.where(b.count[left] == 0, b.lone[right], np.where((b.count[right] == 0) | (b.lone[left] == b.lone[right]), b.lone[left], MIXED))
        b.lone[up] = same
    return b


def intervals(a: Bounds, i: np.ndarray, c: Bounds, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that node pairs can have."""
    least, most = np.empty(len(i)), np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        p, q = i[s : s + PAIRS], j[s : s + PAIRS]
        ends = [x[p] * y[q] for x in (a.low, a.high) for y in (c.low, c.high)]
        box = np.minimum.reduce(ends).sum(axis=1), np.maximum.reduce(ends).sum(axis=1)
        middle = np.einsum("ij,ij->i", a.centre[p], c.centre[q])
        reach = a.radius[p] * np.linalg.norm(c.centre[q], axis=1) + c.radius[q] * np.linalg.norm(a.centre[p], axis=1) + a.radius[p] * c.radius[q]
        reach = reach * (1 + 1e-9) + 1e-6 * (1 + abs(middle))
        least[s : s + PAIRS], most[s : s + PAIRS] = np.maximum(box[0], middle - reach), np.minimum(box[1], middle + reach)
    return least, most


def surviving(a: Bounds, c: Bounds, same_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, leaf, greatest score) of the pairs that no interval and no label rules out, from both roots down."""
    leaves_a, leaves_c = len(a.count) // 2, len(c.count) // 2
    i, j = np.ones(1, np.int64), np.ones(1, np.int64)
    while True:
        live = (a.count[i] > 0) & (c.count[j] > 0)
        live &= (a.mask[i] & c.mask[j] != 0) if same_label else (a.lone[i] == MIXED) | (a.lone[i] != c.lone[j])
        i, j = i[live], j[live]
        least, most = intervals(a, i, c, j)
        live = (most >= a.floor[i]) & (least <= a.ceiling[i])
        i, j, most = i[live], j[live], most[live]
        inner_a, inner_c = i < leaves_a, j < leaves_c
        if not (inner_a.any() or inner_c.any()):
            return i - leaves_a, j - leaves_c, most
        i = np.where(inner_a, 2 * i, i), np.where(inner_a, 2 * i + 1, -1)
        j = np.where(inner_c, 2 * j, j), np.where(inner_c, 2 * j + 1, -1)
        i, j = np.concatenate([x for x in i for _ in j]), np.concatenate([y for _ in i for y in j])
        real = (i > 0) & (j > 0)
        i, j = i[real], j[real]


def numbers(column: pa.Array, kind: type = float) -> np.ndarray:
    """Binary values of one length as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def node_bounds(batch: pa.RecordBatch | pa.Table, floor: np.ndarray, ceiling: np.ndarray) -> list[np.ndarray]:
    lone = np.array([MIXED if v is None else v for v in batch.column("lone").to_pylist()], np.int64)
    mask = batch.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    return [*[numbers(batch.column(c)) for c in ("low", "high", "centre")], batch.column("radius").to_numpy(), batch.column("n").to_numpy().astype(np.int64), mask, lone, floor, ceiling]


def candidate_tree(blocks: DataFrame, leaves: int, dim: int) -> Bounds:
    """The bounds of all nodes: blocks are merged leaf by leaf in tasks, leaves on the driver."""

    def merge(rows: pa.Table) -> pa.Table:
        b = heap(*node_bounds(rows.combine_chunks(), np.zeros(rows.num_rows), np.zeros(rows.num_rows)))
        lone = None if b.lone[1] == MIXED else int(b.lone[1])
        node = rows.column("node")[0].as_py()
        arrays = [[node], [int(b.count[1])], [b.low[1].tobytes()], [b.high[1].tobytes()], [b.centre[1].tobytes()], [float(b.radius[1])], [int(b.mask[1].astype(np.int64))], [lone]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(arrays, kinds, strict=True)], names=["node", "n", "low", "high", "centre", "radius", "mask", "lone"])

    narrow = blocks.select("node", "n", "low", "high", "centre", "radius", "mask", "lone")
    # First within the tasks that read them, so that a leaf of many blocks stays a bounded group.
    merged, schema = narrow, "node int, n bigint, low binary, high binary, centre binary, radius double, mask bigint, lone bigint"
    for by in (F.spark_partition_id(), F.lit(0)):
        merged = merged.withColumn("by", by).groupBy("node", "by").applyInArrow(lambda rows: merge(rows), schema)
    got = merged.toArrow()
    at = got.column("node").to_numpy()
    own = node_bounds(got.combine_chunks(), np.zeros(len(at)), np.zeros(len(at)))
    empty = [np.zeros((leaves, dim)), np.zeros((leaves, dim)), np.zeros((leaves, dim)), np.zeros(leaves), np.zeros(leaves, np.int64), np.zeros(leaves, np.uint64), np.full(leaves, MIXED), np.zeros(leaves), np.zeros(leaves)]
    for whole, part in zip(empty, own, strict=True):
        whole[at] = part
    return heap(*empty)


def best_of(k: int, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each ``who``: higher scores, then smaller ids."""
    by = np.lexsort((ids, -score, who))
    who, score, ids = who[by], score[by], ids[by]
    place = np.arange(len(who))
    first = np.maximum.accumulate(np.where(np.r_[True, who[1:] != who[:-1]], place, 0)) if len(who) else place
    keep = place - first < k
    return who[keep], score[keep], ids[keep]


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles where every sum is below 2^53."""
    if abs(a).max(initial=0) * abs(x).max(initial=0) * a.shape[1] < 2.0**53:
        return a @ x.T
    return (a.astype(np.int64) @ x.astype(np.int64).T).astype(float)


def scorer(k: int, same_label: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first k rows of every window of one group's anchors, among some blocks: who (the anchor), w (its window), id, score.

    A group's anchors have one window each for positives, and one for each positive for negatives; ``floors`` and
    ``ceilings`` bound them, NaN where there is none.
    """

    def score(group: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("bound", "descending")])
        head = group.to_pylist()[0]
        n = head["n"]
        ids, labels = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["labels"], np.int64)
        a = np.frombuffer(head["x"], np.int32).reshape(n, -1).astype(float)
        floors, ceilings = (np.frombuffer(head[c]).reshape(n, -1).copy() for c in ("floors", "ceilings"))
        wide = floors.shape[1]
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for bound, other_ids, other_labels, other in zip(*[rows.column(c).to_pylist() for c in ("bound", "ids", "labels", "x")], strict=True):
            if not bound >= np.nanmin(floors, initial=np.inf):
                continue
            c_ids, c_labels = np.frombuffer(other_ids, np.int64), np.frombuffer(other_labels, np.int64)
            s = products(a, np.frombuffer(other, np.int32).reshape(len(c_ids), -1).astype(float))
            fit = (labels[:, None] == c_labels) == same_label
            fit &= ids[:, None] != c_ids
            found = [best]
            for w in range(wide):
                of, at = np.nonzero(fit & (s >= floors[:, w : w + 1]) & (s <= ceilings[:, w : w + 1]))
                found.append((of * wide + w, s[of, at], c_ids[at]))
            best = best_of(k, *[np.concatenate(c) for c in zip(*found, strict=True)])
            full, count = np.unique(best[0], return_counts=True)
            last = np.cumsum(count)[count == k] - 1
            at = full[count == k]
            floors[at // wide, at % wide] = np.maximum(floors[at // wide, at % wide], best[1][last])
        who = head["group"] + (best[0] // wide)
        return pa.Table.from_arrays([pa.array(who), pa.array((best[0] % wide).astype(np.int32)), pa.array(best[2]), pa.array(best[1].astype(np.int64))], names=["who", "w", "id", "score"])

    return score


def searched(groups: DataFrame, blocks: DataFrame, tree: Bounds, k: int, same_label: bool, pieces: int) -> DataFrame:
    """(who, w, id, score): the first k of each window (w) of each anchor (who). ``groups`` has floors and ceilings."""
    spark = groups.sparkSession
    sent = spark.sparkContext.broadcast(tree)

    def traverse(first: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            leaves = len(tree.count) // 2
            for whole in batches:
                for s in range(0, whole.num_rows, 64):
                    batch = whole.slice(s, 64)
                    floors, ceilings = (np.array([f(np.frombuffer(v), initial=e) for v in batch.column(c).to_pylist()]) for c, f, e in (("floors", np.nanmin, np.inf), ("ceilings", np.nanmax, -np.inf)))
                    a = heap(*node_bounds(batch, floors, ceilings))
                    of, leaf, bound = surviving(a, tree, same_label)
                    if first:  # of each group's pairs, those whose middle comes nearest to the ceiling, until they hold enough rows
                        own = of + len(a.count) // 2
                        near = np.einsum("ij,ij->i", a.centre[own], tree.centre[leaf + leaves])
                        with np.errstate(invalid="ignore"):
                            order = np.lexsort((np.where(np.isinf(a.ceiling[own]), -near, abs(a.ceiling[own] - near)), of))
                        of, leaf, bound = of[order], leaf[order], bound[order]
                        rows = tree.count[leaf + leaves]
                        before = np.cumsum(rows) - rows
                        start = np.searchsorted(of, of)
                        keep = before - before[start] < FIRST_ROWS if len(of) else np.zeros(0, bool)
                        of, leaf, bound = of[keep], leaf[keep], bound[keep]
                    gids = batch.column("gid").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(gids[of]), pa.array(leaf.astype(np.int32)), pa.array(bound)], names=["gid", "node", "bound"])

        return run

    def scored(groups: DataFrame, pairs: DataFrame) -> DataFrame:
        # Narrow pairs first become pairs of group and block; every block is then fetched by its own number.
        pairs = pairs.join(blocks.select("node", F.col("gid").alias("block")), "node").withColumn("piece", F.pmod(F.xxhash64("block"), F.lit(pieces)))
        met = pairs.select("gid", "piece", "block", "bound").join(blocks.select(F.col("gid").alias("block"), "ids", "labels", "x"), "block")
        asking = pairs.select("gid", F.col("piece").alias("of")).distinct().join(groups.select("gid", "n", "ids", "labels", "x", "floors", "ceilings"), "gid").withColumnRenamed("gid", "group")
        return asking.groupBy("group", "of").cogroup(met.groupBy("gid", "piece")).applyInArrow(scorer(k, same_label), "who bigint, w int, id bigint, score bigint")

    def firsts(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("who", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    bounds = ["gid", "n", "low", "high", "centre", "radius", "mask", "lone", "floors", "ceilings"]
    kind = "gid bigint, node int, bound double"
    start = cut(groups.select(*bounds).mapInArrow(bounded(traverse(True)), kind))
    early = cut(firsts(scored(groups, start)))
    # An anchor's floor is the k-th of what it has found so far.
    raised = cut(with_windows(groups, early.where(F.col("rank") == k).select("who", "w", "score"), "floors", k))
    pairs = cut(raised.select(*bounds).mapInArrow(bounded(traverse(False)), kind).join(start.select("gid", "node"), ["gid", "node"], "left_anti"))
    return firsts(scored(raised, pairs).unionByName(early.drop("rank")))


def with_windows(groups: DataFrame, found: DataFrame, column: str, k: int) -> DataFrame:
    """``groups`` with the numbers (who, w, score) in the binary matrix ``column`` raised to them."""

    def put(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        x = np.frombuffer(left.column(column)[0].as_py()).reshape(left.column("n")[0].as_py(), -1).copy()
        at, w = right.column("who").to_numpy() - left.column("gid")[0].as_py(), right.column("w").to_numpy()
        x[at, w] = np.maximum(x[at, w], right.column("score").to_numpy())
        i = left.schema.get_field_index(column)
        return left.set_column(i, column, pa.array([x.tobytes()], pa.binary()))

    found = found.withColumn("group", F.shiftleft(F.shiftright("who", 8), 8))
    return groups.groupBy("gid").cogroup(found.groupBy("group")).applyInArrow(put, groups.schema)


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its ``positives`` first rows of the same label, and for each of these the ``negatives`` first rows of
    other labels whose score is from ``least`` to ``most`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    none = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    ints = F.transform("v", lambda x: F.greatest(F.lit(-(2.0**31)), F.least(F.lit(2.0**31 - 1), F.floor(x.cast("double") * SCALE).cast("double"))))
    base = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    base = base.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("id", "label", "asks", ints.alias("x"))
    sizes = base.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("asks")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes or not sizes[0]["asks"]:
        return none
    dim, n, asking = sizes[0]
    base = base.where(F.size("x") == dim)
    drawn, parts = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)), 1 << 30
    sample = matrix(base.where(drawn <= min(parts, 2 * FIT_ROWS * parts // n)).orderBy(drawn, "id").limit(FIT_ROWS).select("x").toArrow().column("x"))
    depth = min(max(0, (n - 1) // BLOCK).bit_length(), LEAVES.bit_length() - 1, max(0, (len(sample) // 4).bit_length() - 1))
    upper = min(depth, max(0, (asking - 1) // GROUP).bit_length())
    splits = spark.sparkContext.broadcast(split(sample, depth))

    def sorted_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = splits.value.leaves(matrix(batch.column("x"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])

    placed = stored(base.mapInArrow(bounded(sorted_in), "id bigint, label bigint, asks boolean, x array<double>, leaf int"))
    blocks = packed(placed.drop("asks"), F.col("leaf"), BLOCK)
    groups = packed(placed.where("asks").drop("asks"), F.shiftright("leaf", depth - upper), GROUP)
    tree = candidate_tree(blocks, 1 << depth, dim)
    pieces = max(1, -(-blocks.count() // TOGETHER))
    number = lambda v, wide=1: F.unhex(F.repeat(F.lit(np.full(wide, v).tobytes().hex()), F.col("n")))
    asked = groups.withColumn("floors", number(-np.inf)).withColumn("ceilings", number(np.inf))
    near = cut(searched(asked, blocks, tree, positives, True, pieces).select("who", "id", "score", "rank"))
    windows = near.withColumn("w", F.col("rank") - 1)
    asked = groups.withColumn("floors", number(np.nan, positives)).withColumn("ceilings", number(np.nan, positives))
    asked = cut(between(asked, windows, least, most))
    far = searched(asked, blocks, tree, negatives, False, pieces)
    names = groups.mapInArrow(anchor_names, "who bigint, anchor_id bigint")
    out = far.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(windows.select("who", "w", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["who", "w"]).join(names, "who")
    return out.select(*none.columns)


def anchor_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id behind each anchor's number."""
    for batch in batches:
        for gid, n, ids in zip(*[batch.column(c).to_pylist() for c in ("gid", "n", "ids")], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(gid + np.arange(n)), pa.array(np.frombuffer(ids, np.int64))], names=["who", "anchor_id"])


def between(groups: DataFrame, windows: DataFrame, least: int, most: int) -> DataFrame:
    """``groups`` with the windows that positives (who, w, score) set: floors and ceilings of the integer scores."""

    def put(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        n = left.column("n")[0].as_py()
        at, w, p = right.column("who").to_numpy() - left.column("gid")[0].as_py(), right.column("w").to_numpy(), right.column("score").to_numpy()
        out = left
        for column, value in (("floors", -(-least * p // 100)), ("ceilings", most * p // 100)):
            x = np.frombuffer(left.column(column)[0].as_py()).reshape(n, -1).copy()
            x[at, w] = value
            out = out.set_column(out.schema.get_field_index(column), column, pa.array([x.tobytes()], pa.binary()))
        return out

    found = windows.select("who", "w", "score").withColumn("group", F.shiftleft(F.shiftright("who", 8), 8))
    return groups.groupBy("gid").cogroup(found.groupBy("group")).applyInArrow(put, groups.schema)
