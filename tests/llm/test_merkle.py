"""Manifest trees and proofs against plain lists, with bands of a few nodes so that every way of merging is taken."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import merkle, queries

SCHEMA = "doc_id long, source string, `a.b` string, text string, lang string, n_chars long, g string, k long, leaf string, part int"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def levels(digests, b):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + b])) for i in range(0, len(out[-1]), b)])
    return out


def beside(tree, i, b):
    out = ""
    for x in tree[:-1]:
        s = i // b * b
        out += "".join(x[s:i] + x[i + 1 : s + b])
        i //= b
    return out


def rows_of(n):
    out = [(i * 7 % n, ["s", None][i % 2], "x", [None, "", "é" * i, "long " * 2000][i % 4], ["en", "de", None, "en", "En", "ü"][i % 6], [None, i][i % 3 > 0], "c", 1, "d", 2) for i in range(n)]
    return out + [out[3 % n]] * 5 + [(None, "s", "x", "t", "en", 1, "c", 1, "d", 2)] * 3 if n else out


@pytest.mark.parametrize(("n", "fanout", "parts", "band"), [(60, 2, 9, 4), (60, 3, 1, 1024), (1, 2, 1, 1024)])
def test_proofs_and_nodes(spark, monkeypatch, n, fanout, parts, band):
    monkeypatch.setattr(merkle, "BAND", band)
    docs = spark.createDataFrame(rows_of(n), SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
        got = merkle.prove(docs, COLUMNS, "lang", "doc_id", (touched, {"n_chars": F.col("n_chars") + 1}), fanout).collect()
        nodes = merkle.node_records(docs, COLUMNS, "lang", "doc_id", fanout).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = collections.defaultdict(list)
    for r in docs.collect():
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"], leaf(r), r))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by[g], key=lambda x: (x[0], x[1] or 0, x[2]))], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    want = collections.Counter()
    for k, g in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(by[g], key=lambda x: (x[0], x[1] or 0, x[2]))):
            same = r["n_chars"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 > 0
            want[r["doc_id"], g, digest, trees[g][-1][0], top[-1][0], beside(trees[g], i, fanout) + beside(top, k, fanout), same] += 1
    assert collections.Counter((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], r["proof"], r["verified"]) for r in got) == want
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in got)
    assert {(r["lang"], r["level"], r["idx"]): r["digest"] for r in nodes} == {(g, k, i): d for g, t in trees.items() for k, x in enumerate(t) for i, d in enumerate(x) if k or len(x) == 1}
    assert len({(r["lang"], r["level"], r["idx"]) for r in nodes}) == len(nodes)


def test_a_stretch_holds_few_nodes():
    out = []
    stack = merkle.Mountains(100_000, 2, out)
    for i in range(777, 60_000):
        stack.add(i, b"x")
        assert sum(map(len, stack.open)) <= 17
    stack.end()
    assert sum(edge for *_, edge in out) <= 34


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.prove(docs, COLUMNS, "lang", "doc_id").count() == 0 == merkle.node_records(docs, COLUMNS, "lang", "doc_id").count()


def test_query(spark, tmp_path):
    spark.createDataFrame(rows_of(30), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 38
    assert {r["verified"] for r in got.collect()} == {True, False}
