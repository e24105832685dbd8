"""Merkle manifest of a dataset: a hash tree for each group of rows and one over the groups, with proofs (operator 12).

A row is a leaf. The leaves of a group stand in the order of a key; every ``fanout`` consecutive nodes become the hash
of their digests as long as there are several, the last run as short as it is (nothing is padded). The groups' roots,
in the order of their names, make one more such tree.

Leaves are hashed where they are read, dealt out by range of (group, key) and written with their place. Every task then
walks its own stretch with a stack of unfinished runs: a run that fills carries one node up, and the stack is all that is
held. What the ends of a stretch cut apart is left as edges: a logarithmic number for each stretch, which a few rounds of
grouping by common ancestor finish, ``BAND`` leaves wide each. Proofs go down again by the same bands: a group of ``BAND``
leaves gets the one path of its ancestor and works out what lies below. No group exceeds ``BAND`` nodes, whatever share
of the rows a group or a key has.

Defined results: null groups come first, then groups bytewise; null keys come first. Rows that are equal in group, key
and leaf are interchangeable, and each counts. A null value is hashed as ``-``, any other as its UTF-8 byte count, a colon
and itself, so an empty text differs from null; texts are hashed whole, of any length. An empty table has no groups and
an empty result. Only the group, the key and the columns hashed are read; other columns, of whatever name, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, cut, stored

#: Nodes under one ancestor that a task works on together.
BAND = 1024
#: Bytes of stretch records (group name, places) up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: monotonically_increasing_id() holds the row within its partition below this many bits.
ROW_BITS = 33
HEX = 64
#: What an ancestor hands down.
HANDED = ["path", "subroot", "r_idx", "r_n"]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def leaf_digest(values: list[Column]) -> Column:
    """The digest of one row's values."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def hashed(digests: bytes) -> bytes:
    return sha256(digests).hexdigest().encode()


def height(n: int, fanout: int) -> int:
    """Levels above the leaves of a tree over n of them."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def width(n: int, level: int, fanout: int) -> int:
    """Nodes at a level of a tree over n leaves."""
    return -(-n // fanout**level)


class Mountains:
    """The unfinished runs above one stretch of consecutive leaves; ``out`` gets (level, index, digest, edge)."""

    def __init__(self, n: int, fanout: int, out: list[tuple[int, int, bytes, bool]]) -> None:
        self.n, self.fanout, self.out = n, fanout, out
        self.open: list[list[tuple[int, bytes]]] = []

    def add(self, index: int, digest: bytes, level: int = 0) -> None:
        """Push a node; every run that it fills becomes a node of the level above."""
        b = self.fanout
        while (count := width(self.n, level, b)) > 1:
            if level == len(self.open):
                self.open.append([])
            run = self.open[level]
            run.append((index, digest))
            if index % b != b - 1 and index != count - 1:
                return
            self.open[level] = []
            if run[0][0] != index // b * b:  # it began before this stretch
                self.out += [(level, i, d, True) for i, d in run]
                return
            if level:
                self.out += [(level, i, d, False) for i, d in run]
            index, digest, level = index // b, hashed(b"".join(d for _, d in run)), level + 1
        self.out.append((level, index, digest, False))  # the root

    def end(self) -> None:
        """The stretch ends: open runs are edges."""
        for level, run in enumerate(self.open):
            self.out += [(level, i, d, True) for i, d in run]
        self.open = []


NODES = "g string, n bigint, level int, idx bigint, digest string, edge boolean"


def node_batch(found: list[tuple[str, int, list]]) -> pa.RecordBatch:
    flat = [(g, n, *x) for g, n, out in found for x in out]
    g, n, level, idx, digest, edge = zip(*flat, strict=True) if flat else [()] * 6
    arrays = [pa.array(g, pa.string()), pa.array(n, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array([d.decode() for d in digest], pa.string()), pa.array(edge, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["g", "n", "level", "idx", "digest", "edge"])


def peaks(indexed: DataFrame, fanout: int) -> DataFrame:
    """Node records of every stretch, and the edges that it leaves. Whatever breaks the row order only makes more edges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, found = ("", 0, -1), None, []
        for batch in batches:
            for g, n, i, leaf in zip(*[batch.column(c).to_pylist() for c in ("g", "n", "idx", "leaf")], strict=True):
                if stack is None or at != (g, n, i):
                    if stack is not None:
                        stack.end()
                    found.append((g, n, []))
                    stack = Mountains(n, fanout, found[-1][2])
                stack.add(i, leaf.encode())
                at = (g, n, i + 1)
            yield node_batch(found)
            found = [(at[0], at[1], [])]
            if stack is not None:
                stack.out = found[0][2]
        if stack is not None:
            stack.end()
            yield node_batch(found)

    return indexed.select("g", "n", "idx", "leaf").mapInArrow(bounded(run), NODES)


def band_levels(fanout: int) -> int:
    return max(1, next(k for k in range(1, 12) if fanout ** (k + 1) > BAND))


def finisher(low: int, fanout: int) -> Callable[[pa.Table], pa.Table]:
    """Makes the nodes of a band from the edges under one ancestor."""
    high = low + band_levels(fanout)

    def finish(rows: pa.Table) -> pa.Table:
        g, n = rows.column("g")[0].as_py(), rows.column("n")[0].as_py()
        by_level: dict[int, dict[int, bytes]] = {}
        for level, i, d in zip(*[rows.column(c).to_pylist() for c in ("level", "idx", "digest")], strict=True):
            by_level.setdefault(level, {})[i] = d.encode()
        made = []
        for level in range(low, high):
            here = by_level.get(level, {})
            if width(n, level, fanout) == 1:
                break
            runs: dict[int, list[bytes]] = {}
            for i in sorted(here):
                runs.setdefault(i // fanout, []).append(here[i])
            for j, digests in runs.items():
                d = hashed(b"".join(digests))
                by_level.setdefault(level + 1, {})[j] = d
                made.append((level + 1, j, d, level + 1 == high))
        return pa.Table.from_batches([node_batch([(g, n, made)])])

    return finish


def merged(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The node records that the edges of all stretches make, band by band."""
    k, out = band_levels(fanout), []
    edges = nodes.where("edge").drop("edge")
    for low in range(0, height(most, fanout), k):
        # The ancestor above the band; a node of a lower level lies as many levels further below it.
        above = F.expr(f"idx div cast(pow({fanout}, {low + k} - level) as bigint)")
        group = edges.where(F.col("level") < low + k).withColumn("above", above)
        made = cut(group.groupBy("g", "above").applyInArrow(finisher(low, fanout), NODES))
        out.append(made)
        edges = edges.where(F.col("level") >= low + k).unionByName(made.where("edge").drop("edge"))
    return out


@dataclass
class Trees:
    """leaves: g, n, idx, leaf and what else the rows had; nodes: g, n, level, idx, digest; roots: g, n, digest; most: leaves of the largest."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    most: int


def trees(rows: DataFrame, fanout: int) -> Trees:
    """A tree for each ``g`` over its rows in the order of ``k``, whose digests are ``leaf``."""
    # Equal rows may make up any share of all: a last key of their own deals them out.
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    order = ["g", "k", "leaf", "salt"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    at = F.monotonically_increasing_id()
    placed = stored(placed.withColumn("part", F.shiftright(at, ROW_BITS).cast("int")).withColumn("pos", at.bitwiseAND((1 << ROW_BITS) - 1)))
    pieces = placed.groupBy("part", "g").agg(F.count("*").alias("rows"), F.min("pos").alias("first"))
    of_group = Window.partitionBy("g")
    before = F.sum("rows").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = cut(pieces.select("part", "g", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("rows").over(of_group).alias("n")))
    size, most = pieces.agg(F.coalesce(F.sum(F.octet_length("g") + 64), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    joined = placed.join(F.broadcast(pieces) if size <= BROADCAST_BYTES else pieces, ["part", "g"])
    leaves = joined.withColumn("idx", F.col("pos") - F.col("first") + F.col("start")).drop("part", "pos", "first", "start")
    nodes = stored(peaks(leaves, fanout))
    records = [nodes, *merged(nodes, most, fanout)]
    every = records[0]
    for made in records[1:]:
        every = every.unionByName(made)
    every = every.drop("edge")
    # A tree of one level fewer than its leaves' count says: the level that has a single node.
    is_root = F.expr(f"cast(ceil(n / pow({fanout}, level)) as bigint) = 1 and (level = 0 or cast(ceil(n / pow({fanout}, level - 1)) as bigint) > 1)")
    return Trees(leaves, every, every.where(is_root).select("g", "n", "digest"), most)


def siblings(levels: list[list[bytes]], i: int, fanout: int) -> bytes:
    """The other members of the runs on the way up from place i, level by level, left to right."""
    out = []
    for digests in levels:
        start = i // fanout * fanout
        out += digests[start:i] + digests[i + 1 : start + fanout]
        i //= fanout
    return b"".join(out)


def fold(digest: bytes, beside: bytes, idx: int, n: int, fanout: int) -> tuple[bytes, int]:
    """The root that a leaf and its siblings give, and how many bytes of siblings that took."""
    at = 0
    while n > 1:
        mine = idx % fanout
        size = min(fanout, n - idx + mine) - 1
        digest = hashed(beside[at : at + HEX * mine] + digest + beside[at + HEX * mine : at + HEX * size])
        at += HEX * size
        idx, n = idx // fanout, -(-n // fanout)
    return digest, at


def descender(low: int, fanout: int, extra: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Hands an ancestor's path down to the nodes of level ``low`` under it."""
    k = band_levels(fanout)

    def descend(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")  # the ancestor's row stands first
        head = rows.slice(0, 1).to_pylist()[0]
        rows = rows.slice(1).combine_chunks()
        places, n = rows.column("idx").to_pylist(), head["n"]
        levels = [[d.encode() for d in rows.column("leaf").to_pylist()]]
        while len(levels) < k and width(n, low + len(levels), fanout) > 1:
            levels.append([hashed(b"".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        if n == 1:
            levels = []
        path = [siblings(levels, i - places[0], fanout).decode() + head["path"] for i in places]
        columns = [rows.column(c) for c in ("g", "n", "idx", "leaf", *extra)]
        same = [pa.repeat(pa.scalar(head[c], rows.schema.field(c).type), rows.num_rows) for c in HANDED[1:]]
        return pa.Table.from_arrays([*columns, pa.array(path, pa.string()), *same], names=["g", "n", "idx", "leaf", *extra, *HANDED])

    return descend


def paths(t: Trees, top: DataFrame, fanout: int) -> DataFrame:
    """Each leaf with the siblings on its way up: its own columns, and path, subroot, r_idx, r_n from its group's row of ``top``.

    ``top``: g, n, path (of the group's root in the tree above), subroot, r_idx, r_n.
    """
    k = band_levels(fanout)
    own = [c for c in t.leaves.columns if c not in ("g", "n", "idx", "leaf")]
    bands = max(1, -(-height(t.most, fanout) // k))
    # A tree's root counts as ancestor in the band that reaches it first.
    reach = [f"n <= {fanout ** (k * (b + 1))}" + (f" and n > {fanout ** (k * b)}" if b else "") for b in range(bands)]
    handed = None
    for band in reversed(range(bands)):
        low = band * k
        nodes = t.leaves if not band else t.nodes.where((F.col("level") == low) & (F.col("n") > fanout**low)).select("g", "n", "idx", F.col("digest").alias("leaf"))
        extra = own if not band else []
        kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
        above = top.where(reach[band]).withColumn("idx", F.lit(0).cast("long"))
        above = above if handed is None else above.unionByName(handed)
        above = above.select("g", "n", F.col("idx").alias("above"), F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("string").alias("leaf"), *HANDED)
        group = nodes.withColumn("above", F.expr(f"idx div {fanout**k}")).unionByName(above, allowMissingColumns=True)

        schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("g", "n", "idx", "leaf", *extra)) + ", path string, subroot string, r_idx bigint, r_n bigint"
        handed = group.groupBy("g", "above").applyInArrow(descender(low, fanout, extra), schema)
        if band:
            handed = cut(handed.drop("leaf"))
    return handed


def prove(docs: DataFrame, columns: list[str], group: str, key: str, shown: tuple[Column, dict[str, Column]] | None = None, fanout: int = 2) -> DataFrame:
    """Every row's place and proof: key, group, leaf, subroot, root, proof, folded_root, verified.

    ``proof`` holds the siblings as hexadecimal text, level by level up to the root. ``folded_root`` is what the row
    that a reader is shown gives with these siblings: ``shown`` is a condition and the values that stand for columns in
    the rows that meet it. ``verified`` tells whether that is the root.
    """
    values = {c: quoted(c) for c in columns}
    altered = F.lit(None).cast("string") if shown is None else F.when(shown[0], leaf_digest([shown[1].get(c, v) for c, v in values.items()]))
    g = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), quoted(key).alias("k"), leaf_digest(list(values.values())).alias("leaf"), altered.alias("altered"))
    t = trees(rows, fanout)
    # The tree over the groups' roots; for it the groups' names are the keys.
    upper = trees(t.roots.select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("digest").alias("leaf"), F.col("n").alias("of")), fanout)
    start = upper.roots.select("g", "n", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("r_idx"), F.lit(1).cast("long").alias("r_n"))
    up = paths(upper, start, fanout)
    # In the rows that are handed down, subroot holds the group's root and the root of all.
    top = cut(up.select(F.col("k").alias("g"), F.col("of").alias("n"), "path", F.concat("leaf", "subroot").alias("subroot"), F.col("idx").alias("r_idx"), F.col("n").alias("r_n")))
    down = paths(t, top, fanout)

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, altered, idx, n, path, r_idx, r_n in zip(*[batch.column(c).to_pylist() for c in ("leaf", "altered", "idx", "n", "path", "r_idx", "r_n")], strict=True):
                beside = path.encode()
                digest, at = fold((leaf if altered is None else altered).encode(), beside, idx, n, fanout)
                out.append(fold(digest, beside[at:], r_idx, r_n, fanout)[0].decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "folded_root"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in down.schema)
    done = down.mapInArrow(bounded(folded), f"{kinds}, folded_root string")
    root = F.substring("subroot", HEX + 1, HEX)
    name = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30))
    return done.select(F.col("k").alias(key), name.alias(group), "leaf", F.substring("subroot", 1, HEX).alias("subroot"), root.alias("root"), F.col("path").alias("proof"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def node_records(docs: DataFrame, columns: list[str], group: str, key: str, fanout: int = 2) -> DataFrame:
    """The manifest itself: every inner node as (group, n, level, idx, digest); a lone leaf is the node of level 0."""
    g = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))
    t = trees(docs.select(g.alias("g"), quoted(key).alias("k"), leaf_digest([quoted(c) for c in columns]).alias("leaf")), fanout)
    nodes = t.nodes.where(F.expr("level > 0 or n = 1"))
    return nodes.select(F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group), "n", "level", "idx", "digest")
