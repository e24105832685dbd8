"""The registered queries themselves, on one small folder of tables, against plain versions of their contracts."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tracewell.llm import queries


def texts():
    rnd = random.Random(21)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 150))) for _ in range(40)]
    out += [out[0] + " once", out[1], out[2].upper(), "Apache License, MIT license cc-by", "x " * 3000, "#$% " * 30, "", None, "日本語 🎉", "one", "one\ntwo\none\n\none"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t, ["en", "de", None][i % 3], ["a", "b"][i % 2], None if t is None else len(t)) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(5)
    vectors = [(i, rng.standard_normal(16).tolist(), int(i % 5)) for i in range(400)] + [(1000, None, 1), (1100, [0.0] * 16, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_op1(spark, folder, rows):
    got = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = collections.Counter(windows)
        repeated = len({k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)})
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * repeated > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op2(spark, folder, rows):
    got = queries.op2_sharding(spark, folder).collect()
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    assert all((r["size"], r["text_crc32"]) == (len(raw[r["doc_id"]]) + 16, zlib.crc32(raw[r["doc_id"]])) and r["law"] == "rows" and r["grown_shard"] is None for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(got) == len(rows)


def test_op7(spark, folder, rows):
    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    got = queries.op7_packing(spark, folder).collect()
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["length"] for r in own] == [min(2048, len(ids) - s) for s in range(0, len(ids), 2048)]
        assert all(r["start"] == 2048 * k and r["ids_crc32"] == zlib.crc32(np.array(ids[2048 * k : 2048 * (k + 1)], "<u4").tobytes()) for k, r in enumerate(own))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op9(spark, folder, rows):
    def fingerprint(text):
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {i: fingerprint(t) for i, t, *_ in rows}
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, folder).collect()}
    assert got == {i: (f"{fp:016x}", root(i)) for i, fp in fps.items()}


@pytest.mark.parametrize(("name", "columns"), [
    ("op3_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]), ("op6_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    ("op8_license_scan", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]), ("op10_token_counts", ["doc_id", "n_pretokens", "n_tokens"]),
])
def test_rows_and_columns(spark, folder, rows, name, columns):
    got = queries.queries()[name](spark, folder)
    assert got.columns[: len(columns)] == columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in rows)


def test_op5(spark, folder):
    got = queries.op5_ann(spark, folder).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert set(by) == {0, 100, 200, 300}
    for found in by.values():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)


def test_every_number_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))
