"""Caches over logs against a plain simulation."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import crawl, recency, shared


def plain(log, capacity, ttl):
    caches, seen, out = collections.defaultdict(collections.OrderedDict), set(), {}
    for cache, at, n, key in sorted(log, key=lambda r: (r[1], r[2])):
        held = caches[cache]
        until = held.pop(key, None)
        out[n] = "cold" if (cache, key) not in seen else "evicted" if until is None else "expired" if at >= until else "hit"
        seen.add((cache, key))
        held[key] = until if out[n] == "hit" else at + ttl
        if len(held) > capacity:
            held.popitem(last=False)
    return out


@pytest.mark.parametrize(("capacity", "ttl"), [(5, 300), (1, 10_000), (40, 25)])
def test_outcomes(spark, monkeypatch, capacity, ttl):
    monkeypatch.setattr(recency, "BLOCK", 16)
    rnd = random.Random(capacity)
    # One cache has most accesses, one key a third of them; times repeat.
    log = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(2000), n, "k0" if rnd.random() < 0.33 else f"k{rnd.randrange(12)}") for n in range(600)]
    rows = spark.createDataFrame([(*r, "x") for r in log] + [("a", 5, 9001, None, "x"), ("a", None, 9002, "k1", "x")], "cache string, at long, n long, key string, pos_ string").repartition(5)
    got = {r["n"]: r["outcome"] for r in recency.outcomes(rows, F.col("cache"), F.col("key"), F.col("at"), ["n"], capacity, ttl).collect()}
    assert got.pop(9001) == got.pop(9002) == "cold"
    assert got == plain(log, capacity, ttl)
    assert set(got.values()) >= {"hit", "cold", "expired"} or capacity == 1


def test_no_lifetime_and_empty(spark):
    rows = spark.createDataFrame([("a", 1, 1, "k"), ("a", 1, 2, "k")], "cache string, at long, n long, key string")
    assert {r["outcome"] for r in recency.outcomes(rows, F.col("cache"), F.col("key"), F.col("at"), ["n"], 5, 0).collect()} == {"cold"}
    assert recency.outcomes(rows.limit(0), F.col("cache"), F.col("key"), F.col("at"), ["n"]).count() == 0


def test_numbered(spark):
    rows = spark.createDataFrame([(g, i) for i in range(200) for g in ("a", None, "b")], "g string, i int").repartition(7)
    got = shared.numbered(rows, ["g"], ["i"]).collect()
    assert len(got) == 600 and all(r["pos"] == r["i"] for r in got)


def test_schedule_without_a_fold(spark):
    rnd = random.Random(4)
    rows = [(g, k, rnd.randrange(3000), rnd.randrange(600), rnd.randrange(3)) for g in "abc" for k in range(25)]
    got = {(r["g"], r["seq"]): (r["start_ms"], r["offered"], r["retries_used"], r["reason"]) for r in crawl.exact_schedule(spark.createDataFrame(rows, "g string, seq int, ready_ms long, delay_ms long, want_retries long"), ["g"], 9, 5000, 250, 2).collect()}
    for g in "abc":
        clock, left = None, 9
        for _, k, ready, gap, want in [r for r in rows if r[0] == g]:
            start = ready if clock is None else max(ready, clock + max(250, before))
            offered = left if k % 2 == 0 else 0
            if start >= 5000:
                assert got[g, k] == (start, offered, 0, "max_time")
                assert all(got[g, later] == (start, 0, 0, "max_time") for later in range(k + 1, 25))
                break
            used = min(offered, want)
            assert got[g, k] == (start, offered, used, None)
            clock, before, left = start, gap, left - used
