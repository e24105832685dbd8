"""Dual-tree search against all pairs."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, gid int, x string, `a.b` int, node int"


def plain(rows, positives=5, negatives=10, least=30, most=90):
    sizes = collections.Counter(len(v) for i, v, y in rows if usable(i, v, y))
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    kept = {(i, y, tuple(math.floor(float(np.float32(x)) * 256) for x in v)) for i, v, y in rows if usable(i, v, y) and len(v) == dim}
    out = collections.Counter()
    for a in kept:
        if a[0] % 10:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in kept if b[0] != a[0]), key=lambda s: s[:2])
        for p, i, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fit = [s for s in scored if s[2] != a[1] and least * -p <= 100 * -s[0] <= most * -p][:negatives]
            out.update((a[0], i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit))
    return out


def usable(i, v, y):
    return i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)


def vectors(n, dim, spread):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((6, dim))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + spread * rng.standard_normal(dim)], int(rng.integers(0, 4)) - 1) for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, same, 1) for i in range(60)]  # one vector many times: ties by id
    rows += [rows[20], rows[20], (30, [1.0] * dim, 2), (2000, [0.0] * dim, 1), (2010, [1e4] * dim, 0), (2020, [-1e4] * dim, 1)]
    return rows + [(None, same, 1), (3000, None, 1), (3010, same, None), (3020, [math.nan] * dim, 1), (3030, [None] + same[1:], 1), (3040, [math.inf] + same[1:], 1), (3050, [1.0], 1), (3060, [], 1)]


def mined(spark, rows):
    full = spark.createDataFrame([(i, v, y, 1, "x", 2, 3) for i, v, y in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(full, F.col("vec_id") % 10 == 0, F.col("label"))
    return collections.Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("block", "spread"), [(16, 0.1), (1024, 1.0)])
def test_hard_negatives(spark, monkeypatch, block, spread):
    for name, value in (("BLOCK", block), ("GROUP", max(4, block // 8)), ("FIRST_ROWS", 2 * block), ("TOGETHER", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(300, 5, spread)
    assert mined(spark, rows) == plain(rows)


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(1)
    points = [rng.standard_normal(4) * 3 + 0.2 * rng.standard_normal((9, 4)) for _ in range(13)]
    side = lambda parts: hard_negatives.heap(*[np.array(x) for x in zip(*[(p.min(0), p.max(0), p.mean(0), np.linalg.norm(p - p.mean(0), axis=1).max(), len(p), np.uint64(1), 0, 20.0, 30.0) for p in parts], strict=True)])
    a, c = side(points[:5]), side(points)
    a.lone[:] = hard_negatives.MIXED
    of, leaf, bound = hard_negatives.surviving(a, c, True)
    found = set(zip(of.tolist(), leaf.tolist(), strict=True))
    assert len(found) < 5 * 13
    for i in range(5):
        for j in range(13):
            s = points[i] @ points[j].T
            assert (i, j) in found or not ((s >= 20) & (s <= 30)).any()
    for s, i, j in zip(bound, of, leaf, strict=True):
        assert (points[i] @ points[j].T).max() <= s


def test_empty_and_query(spark, tmp_path):
    assert not mined(spark, []) and not mined(spark, [(1, [1.0], 1)]) and not mined(spark, [(10, [1.0], 1)])
    rows = [(i, v, y) for i, v, y in vectors(120, 4, 0.5) if y is not None and y >= 0]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.count() > 0
