"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tracewell.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rnd, text, edits):
    words = text.split()
    for k in rnd.sample(range(len(words)), edits):
        words[k] = f"edit{rnd.randrange(10**6)}"
    return " ".join(words)


def test_stage_finds_edited_copies(spark):
    rnd = random.Random(3)
    rows, seen = [], []
    for n in range(60):
        text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(120, 400)))
        rows.append(text)
        rows += [edited(rnd, text, k) for k in (1, len(text.split()) // 50, len(text.split()) // 45, len(text.split()) // 20) if k]
    rows += [rows[0].upper(), "one two", "ONE two", "one three", "", None]
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    sets = [shingles(t) for t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if (s := similarity(a, sets[j])) >= 0.8:
                seen.append(s)
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert sum(0.8 <= s < 0.85 for s in seen) > 10 and sum(0.85 <= s < 0.95 for s in seen) > 10
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], SCHEMA).repartition(3)
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted({root(x) for x in range(len(rows))})


def test_stage_keeps_one_row_of_each_group(spark):
    rnd = random.Random(4)
    a, b, c = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(200)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (None, edited(rnd, a, 2), "x"), (None, c, "x"), (None, edited(rnd, c.upper(), 1), "x"), (7, a, "x"), (7, a, "x")]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 1] and {a, b} == {r["text"] for r in out if r["doc_id"]}
    assert corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_simhash_keeps_one_row_of_each_group(spark):
    rnd = random.Random(5)
    a, b, c = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(200)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (None, a.upper(), "x"), (None, c, "x"), (None, c.upper(), "x"), (7, a, "x"), (7, a, "x")]
    out = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 1] and {a, b} == {r["text"] for r in out if r["doc_id"]}


def test_candidates_are_simhash_bands():
    """A bit of the fingerprint is a majority over the shingles, and the bands are cuts of the fingerprint."""
    rng = np.random.default_rng(6)
    for size in (1, 4, 5, 6, 301, 5000):
        sets = rng.integers(0, 2**64, size, np.uint64)
        single = [near_copies.fingerprint(sets[k : k + 1], 12).tolist() for k in range(size)]
        bits = [sum(h[b // 64] >> b % 64 & 1 for h in single) * 2 > size for b in range(64 * 12)]
        fp = near_copies.fingerprint(sets, 12)
        assert bits == [bool(int(fp[b // 64]) >> b % 64 & 1) for b in range(64 * 12)]
        assert near_copies.fingerprint(sets, 9).tolist() == fp[:9].tolist()
        for width in (8, 11):
            want = [(k << 32) + sum(bits[k * width + b] << b for b in range(width)) for k in range(64 * 12 // width)]
            assert near_copies.band_keys(fp, width).tolist() == want


@pytest.mark.parametrize("pairs", [1, 300, 1 << 16])
def test_near_groups_are_components(monkeypatch, pairs):
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 30, 90):
        fps = rng.integers(0, 2**64, (max(1, n // 3), near_copies.CHECKED), np.uint64)[rng.integers(0, max(1, n // 3), n)]
        for fp in fps:
            for bit in rng.integers(0, 64 * near_copies.CHECKED, rng.integers(0, 100)).tolist():
                fp[bit // 64] ^= np.uint64(1 << bit % 64)
        parent = list(range(n))
        for i in range(n):
            for j in range(i):
                if sum((int(a) ^ int(b)).bit_count() for a, b in zip(fps[i], fps[j], strict=True)) <= near_copies.RADIUS:
                    parent = [parent[j] if x == parent[i] else x for x in parent]
        want = sorted(m for root in set(parent) if len(m := [i for i in range(n) if parent[i] == root]) > 1)
        assert sorted(sorted(g.tolist()) for g in near_copies.near_groups(fps)) == want


@pytest.mark.parametrize(("bits", "members"), [(8, 2000), (11, 1)])
def test_stage_finds_the_least_similar_pairs(spark, monkeypatch, bits, members):
    """Pairs of exactly 0.8, of few shingles (where bits agree least) and of many, by narrow bands or wider ones, groups joined or not."""
    monkeypatch.setattr(near_copies, "LEAST_BITS", bits)
    monkeypatch.setattr(near_copies, "JOINED", members)
    rnd, rows = random.Random(9), []
    for n in range(300):
        words = [f"w{rnd.randrange(10**6)}" for _ in range([9, 19, 54, 404][n % 4])]
        rows += [(2 * n, " ".join(words), "x"), (2 * n + 1, " ".join(words[: 4 + (len(words) - 4) * 4 // 5]), "x")]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(0, 600, 2))


def test_texts_that_share_a_passage_make_no_large_group(spark):
    """Unlike texts around one long passage are within the radius of the first words, and no longer within that of all."""
    rnd = random.Random(10)
    passage = " ".join(f"p{k}" for k in range(200))
    texts = [f"{passage} " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = near_copies.band_bits(60)
    entries = near_copies.marked(near_copies.keyed(docs, "doc_id"), bits).cache()
    groups = near_copies.grouped(entries, bits).cache()
    assert groups.count() > 100
    assert near_copies.regrouped(groups, entries, bits).count() == 0
    assert near_copies.deduplicate(docs).count() == 60


@pytest.mark.parametrize("entries", [2, 60])
def test_large_groups_meet_pair_by_pair(spark, monkeypatch, entries):
    """Groups of more than JOINED members: every two that shared a bucket share one still, and members are not moved by band if that is more."""
    monkeypatch.setattr(near_copies, "JOINED", 20)
    rnd, seen, rows = random.Random(11), set(), []
    for n in range(3 * entries):
        members = rnd.sample(range(50), 30) if n % 3 else rnd.sample(range(100, 115), 9)
        rows += [(v, min(members), n) for v in members]
        seen |= {(a, b) for a in members for b in members if a < b}
    out = near_copies.joined(spark.createDataFrame(rows, "v long, least long, bucket long")).collect()
    met, sizes = {}, {}
    for r in out:
        met.setdefault(r["bucket"], set()).add(r["v"])
        sizes[r["v"]] = sizes.get(r["v"], 0) + 1
    assert all(any({a, b} <= m for m in met.values()) for a, b in seen)
    assert all(sizes[v] == 1 for v in sizes if v >= 100) and max(sizes.values()) <= 4
    assert len(out) == len({(r["v"], r["bucket"]) for r in out})
