"""Approximate nearest neighbours by multi-index hashing (operator 5).

A rotation learned on a bounded sample (principal axes, then iterative quantization) turns vectors into 64-bit codes.
A code is cut into ``TABLES`` substrings, and each substring is an index of its own. Codes within a Hamming radius
differ in at most radius / TABLES bits in one of the substrings at least, so probing every substring value within
that many bits of the query's finds all of them; each pair is taken in the first table that finds it. What is within
the radius is ranked by exact Euclidean distance. The radius is the ``QUANTILE`` of the code distances of true
neighbours in the sample, so it follows the data; queries that find too few go again with twice the radius.

The index is dealt out by documents: every task indexes the rows that it reads, ``GROUP_ROWS`` at a time, and answers
for them. So no vector is shuffled or copied, neither by table nor by query, and a vector or a code that a third of
all rows share is spread over all tasks. Queries come in blocks of about ``BLOCK_QUERIES``, one broadcast and one pass
over the table for each block; a pass hands on at most k + 1 ids and distances for each query and task, which are
merged by query. Only the sample and one block of queries at a time reach the driver.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
dimension is not the most common one (the smaller one on a tie). Equal distances go to the smaller id. A row that
repeats an id and a vector counts once; an id with different vectors counts as several candidates, and as a query it asks
for each of them. An empty table, or one without usable vectors, gives an empty result. Only the id, the vector and what
the query condition names are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut

BITS, TABLES = 64, 8
FIT_ROWS, FIT_QUERIES, FIT_ROUNDS, QUANTILE, SEED = 8192, 256, 30, 0.95, 3
GROUP_ROWS, BLOCK_QUERIES = 32_768, 4096
POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))


@dataclass
class Coder:
    """Mean and projection: the sign of each projected coordinate is a bit."""

    mean: np.ndarray
    axes: np.ndarray  # dimension, BITS

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes: one column for each table."""
        return np.packbits((x - self.mean) @ self.axes > 0, axis=1)


def fit(x: np.ndarray, seed: int = SEED) -> Coder:
    """Principal axes of the sample, and rotations that bring its projections close to the corners of a cube.

    Vectors of fewer than BITS dimensions get several rotations, of more the first BITS axes.
    """
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    _, _, principal = np.linalg.svd(x - mean, full_matrices=False)
    basis = principal[:BITS].T
    flat = (x - mean) @ basis
    turns, width = [], basis.shape[1]
    while len(turns) * width < BITS:
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(FIT_ROUNDS):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        turns.append(turn)
    return Coder(mean, (basis @ np.concatenate(turns, axis=1))[:, :BITS])


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one vector, in double precision."""
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def radius_of(coder: Coder, x: np.ndarray, k: int) -> int:
    """The radius that holds QUANTILE of the sample's own neighbours."""
    codes = coder.codes(x)
    near = []
    for i in range(0, len(x), max(1, len(x) // FIT_QUERIES)):
        d = distances(x, x[i])
        d[i] = np.inf
        best = np.argsort(d)[: min(k, len(x) - 1)]
        near.append(np.bitwise_count(codes[best] ^ codes[i]).sum(axis=1))
    found = np.concatenate(near) if near else np.zeros(0)
    return int(np.quantile(found, QUANTILE, method="higher")) if len(found) else BITS


def usable(rows: DataFrame, is_query: Column, id_column: str, vector: str) -> DataFrame:
    """Rows (id, v, asks) that take part, of one dimension for queries and candidates alike."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).where(finite)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0]["n"]) if sizes else rows


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def probe(t: int, radius: int, k: int, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q_codes: np.ndarray, q: np.ndarray) -> tuple[list, list, list]:
    """The k nearest of the codes within the radius that table ``t`` is the first to find, for each query."""
    flips = radius // TABLES
    order = np.argsort(codes[:, t], kind="stable")
    ids, codes, x = ids[order], codes[order], x[order]
    first = np.searchsorted(codes[:, t], np.arange(257))
    whole = codes.view(np.uint64).ravel()
    offsets = np.flatnonzero(POPCOUNT <= flips)
    out: tuple[list, list, list] = ([], [], [])
    for qid, code, v in zip(q_ids.tolist(), q_codes, q, strict=True):
        values = np.sort(offsets ^ int(code[t]))
        start, count = first[values], first[values + 1] - first[values]
        n = int(count.sum())
        if not n:
            continue
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(n)
        at = at[np.bitwise_count(whole[at] ^ code.view(np.uint64)[0]) <= radius]
        if t and len(at):
            at = at[(np.bitwise_count(codes[at, :t] ^ code[:t]) > flips).all(axis=1)]
        if not len(at):
            continue
        d = distances(x[at], v)
        if len(at) > k:
            near = d <= np.partition(d, k - 1)[k - 1]
            at, d = at[near], d[near]
        best = np.lexsort((ids[at], d))[:k]
        out[0].extend([qid] * len(best))
        out[1].extend(ids[at[best]].tolist())
        out[2].extend(d[best].tolist())
    return out


def best_of(k: int, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, smaller ids first; an id at one distance counts once."""
    by = np.lexsort((ids, d, q))
    q, ids, d = q[by], ids[by], d[by]
    new = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (d[1:] != d[:-1])] if len(q) else np.zeros(0, bool)
    q, ids, d = q[new], ids[new], d[new]
    place = np.arange(len(q))
    first = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], place, 0)) if len(q) else place
    keep = place - first < k
    return q[keep], ids[keep], d[keep]


def once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without rows that repeat an id and a vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, x
    _, at = np.unique(np.c_[ids.view(np.float64), x].view(np.dtype((np.void, 8 * (x.shape[1] + 1)))).ravel(), return_index=True)
    return ids[at], x[at]


def within(base: DataFrame, coder: Coder, q_ids: np.ndarray, q: np.ndarray, radius: int, k: int) -> DataFrame:
    """(qid, id, score): of what each task reads, the k nearest within the radius of each query of a block."""
    sent = base.sparkSession.sparkContext.broadcast((coder, q_ids, coder.codes(q), q))
    group_rows = GROUP_ROWS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, q_ids, q_codes, q = sent.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def searched(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = pa.Table.from_batches(held)
            ids, x = once(rows.column("id").to_numpy(), matrix(rows.column("v")))
            out = best
            codes = coder.codes(x)
            for t in range(TABLES):
                found = probe(t, radius, k, ids, codes, x, q_ids, q_codes, q)
                out = best_of(k, *[np.r_[a, np.array(b, a.dtype)] for a, b in zip(out, found, strict=True)])
            return out

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, group_rows):
                part = batch.slice(at, group_rows)
                if n and n + part.num_rows > group_rows:
                    best, held, n = searched(held), [], 0
                held.append(part)
                n += part.num_rows
        if n:
            best = searched(held)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["qid", "id", "score"])

    return base.select("id", "v").mapInArrow(run, "qid bigint, id bigint, score double")


def search(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row with ``is_query`` its k nearest other rows: query_id, rank, vec_id, score."""
    base = usable(rows, is_query, id_column, vector)
    n = base.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    parts = 1 << 30
    drawn = F.pmod(F.xxhash64("id", "v"), F.lit(parts))
    taken = base.where(drawn <= min(parts, 2 * FIT_ROWS * parts // n)).orderBy(drawn, "id").limit(FIT_ROWS).select("v").toArrow()
    x = matrix(taken.column("v"))
    coder = fit(x)
    radius = radius_of(coder, x, k)
    # Equal query vectors are searched once; one more than k, since a query may find itself.
    asking = cut(base.where("asks").select("id", "v").distinct())
    queries = cut(asking.groupBy("v").agg(F.min("id").alias("qid")).select("qid", "v", F.xxhash64("v").alias("deal")))
    blocks = -(-queries.count() // BLOCK_QUERIES)
    none = rows.sparkSession.createDataFrame([], "qid bigint, id bigint, score double")
    found = [none]
    for b in range(blocks):
        block = queries.where(F.pmod("deal", F.lit(blocks)) == b).select("qid", "v").toArrow()
        ids, q, reach = block.column("qid").to_numpy(), matrix(block.column("v")), radius
        while len(ids):
            order = Window.partitionBy("qid").orderBy("score", "id")
            near = within(base, coder, ids, q, reach, k + 1).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
            near = cut(near.drop("n"))
            if reach >= BITS:
                found.append(near)
                break
            short = near.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, n)).select("qid").toArrow()
            enough = np.isin(ids, short.column("qid").to_numpy())
            if enough.all():
                found.append(near)
                break
            answered = rows.sparkSession.createDataFrame(pd.DataFrame({"qid": ids[enough]}), "qid bigint")
            found.append(near.join(F.broadcast(answered), "qid", "left_semi"))
            ids, q, reach = ids[~enough], q[~enough], min(BITS, 2 * max(1, reach))
    every = functools.reduce(DataFrame.unionByName, found)
    answers = asking.select(F.col("id").alias("query_id"), "v").join(queries.select("qid", "v"), "v").select("query_id", "qid").join(every, "qid").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
