"""Fingerprints against a plain version on lists and dictionaries."""

import collections
import hashlib
import random
import re
import struct

import pytest
import xxhash

from tracewell.llm import imatch, queries

SCHEMA = "doc_id long, text string, u long, id string, `a.b` int, t string, times long"


def h(*parts):
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<q", p)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def bits(t, at, n):
    return (t % (1 << 64) >> at) & ((1 << n) - 1)


def terms(text):
    found = {h((imatch.SEED,), w) for w in re.split(imatch.NOT_WORD, text.lower()) if w}
    return {t for t in found if bits(t, 0, imatch.USED) == 0}


def signed(own, lexicon, text):
    kept = own & lexicon
    kept = sorted(kept if len(kept) >= imatch.FEW else own)
    sign = lambda x: 1 + x % 65535
    if not kept:
        return [sign(h(h(text), (k,))) for k in range(1, imatch.BUCKETS * imatch.LEVELS + 1)]
    out = []
    for q in range(imatch.BUCKETS):
        bucket = [t for t in kept if bits(t, imatch.USED, imatch.BUCKET_BITS) == q]
        for k in range(imatch.LEVELS):
            x = [t for t in bucket if bits(t, imatch.USED + imatch.BUCKET_BITS, k) == 0]
            out.append(sign(h(*x)) if x else 0)
    return out


def like(a, b):
    n = imatch.LEVELS
    pairs = [list(zip(a[q : q + n], b[q : q + n], strict=True)) for q in range(0, len(a), n)]
    either = [p for p in pairs if any(x or y for x, y in p)]
    return sum(any(x and x == y for x, y in p) for p in either) / len(either)


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h((int(r[0] is None),), *([] if r[0] is None else [r[0]]), r[1])))
    n = len(rows)
    found = [terms(t) for _, t in rows]
    counts = collections.Counter(t for x in found for t in x)
    lexicon = {t for t, d in counts.items() if max(imatch.LEAST_DOCS, imatch.LEAST_SHARE * n) <= d <= imatch.MOST_SHARE * n}
    fps = [signed(x, lexicon, t) for x, (_, t) in zip(found, rows, strict=True)]
    out = collections.Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        fp = signed(terms(edited), lexicon, edited)
        hexed = lambda x: "".join(f"{v:04x}" for v in x)
        out[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(fps[k]), hexed(fp), round(like(fps[k], fp), 9), round(like(fps[k], fps[(k + 1) % n]), 9)] += 1
    return out


def corpus(n):
    rnd = random.Random(n)
    words = ["".join(rnd.choice("etaoinshrdlué") for _ in range(rnd.randint(1, 9))) for _ in range(900)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 250)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "日本語 🎉 x"), (1003, "!?"), (1004, rows[4][1]), (5, rows[6][1]), (None, "no id"), (None, None)] + [(3, rows[3][1])] * 4 + [(1005, "long words " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 9) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", most)
    monkeypatch.setattr(imatch, "COPIES", 2)
    rows = corpus(70)
    got = imatch.fingerprinted(frame(spark, rows).repartition(5)).collect()
    found = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert found == plain(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1004]["fingerprint"] == by_id[4]["fingerprint"] and by_id[1000]["fingerprint"] == by_id[1001]["fingerprint"] != by_id[1003]["fingerprint"]


@pytest.mark.parametrize("rows", [[(7, "only one text")], [(None, None)], [(1, "same")] * 3])
def test_few_rows(spark, rows):
    got = imatch.fingerprinted(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["near_next"] == 1 for r in got)


def test_empty_table_and_query(spark, tmp_path):
    assert imatch.fingerprinted(frame(spark, [])).count() == 0
    frame(spark, corpus(20)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_imatch(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and got.count() == len(corpus(20))


def test_every_term_counts(spark):
    """No term is left out by its hash: each changes the fingerprint, and is counted where a document has few of them."""
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(words[:k] + words[k + 1 :])) for k in range(60)] + [(100, " ".join(words))]
    rows += [(200 + k, f"only{k} rare{k}") for k in range(2500)]
    rows += [(101, " ".join(words[:4])), (102, " ".join(words[:4] + ["single"]))]  # four terms of the band, with and without a rarer one
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprinted(frame(spark, rows)).collect()}
    assert len({got[k] for k in [*range(60), 100]}) == 61
    assert got[101] == got[102]
