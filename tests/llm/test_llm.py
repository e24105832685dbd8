"""The training-data operators against brute force, an outside library, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import plain
from tracewell.llm import ann, bpe, language_id, license_scan, packing, quality, queries, sharding, simhash, suffix_dedup, unigram

WORD_BPE, PIECES = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("piece_bpe_32k.model")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("key", T.StringType()), T.StructField("fp", T.StringType())])
ODD = [None, "", " ", "\x1c x\x1dy \x85z", "Σas ΣΑΣ İ KK é é ﬁ", "aaa " * 40, "日本語🎉 x", "a" * 700, "<|endoftext|> don't<|x 12345 <|startoftext|>", "#$%&|<>* x", "Gnu General Public License cc-by MIT license, apache LICENSE", "\n\n a\n a\nb"]


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 260))) for _ in range(n)]
    passage = " ".join(rnd.choice(words) for _ in range(90))
    out += [o[: len(o) // 2] + passage + o[len(o) // 2 :] for o in out[:8]] + out[:3] + [out[3] + " x", out[9] * 3]
    return ODD + out


@pytest.fixture(scope="module")
def corpus():
    return texts()


def frame(spark, rows):
    full = [(i, t, ["en", None, "de"][k % 3], ["a", "b", None][k % 3], None if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """Every odd text, a repeated row and a null id."""
    return frame(spark, [*enumerate(corpus), (5, corpus[5]), (None, "null id text"), (None, None)])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return collections.Counter((r["doc_id"], tuple(r)) for r in df.collect())


def test_bpe_matches_the_library_and_round_trips(spark, docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, WORD_BPE, digests=False).collect()}
    for i, text in enumerate(corpus):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == " ".join(map(str, ids)) and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs, WORD_BPE).count() == docs.count() and bpe.encode_decode(empty(spark), WORD_BPE).count() == 0


def test_bpe_rounds_of_long_words():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(WORD_BPE), bpe.Bpe(WORD_BPE)
    rnd = random.Random(2)
    for n in [*range(1, 60), 300, 5000]:
        w = "".join(rnd.choice("aaabtheing") for _ in range(n))
        raw = np.frombuffer(w.encode(), np.uint8)
        ids, _ = b.rounds(raw, np.array([len(w)]))
        assert ids.tolist() == b.long_rounds(raw).tolist() == t.encode(w, add_special_tokens=False).ids


def test_caches_stay_bounded():
    from tracewell.llm.common import WordCache

    c = WordCache(lambda ws: [w * 2 for w in ws], limit=3)
    for words in (["a", "b"], ["c", "d"], ["x" * 500], ["a", "b", "c", "d", "e"]):
        got = c.get_all([words])
        assert all(got[w] == w * 2 for w in words) and len(c.known) <= 3


def plain_tokens(u, word):
    best = [(0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + u.score[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in u.score]
        if word[j - 1] not in u.score:
            raw = word[j - 1].encode("utf-8", "surrogatepass")
            options.append((best[j - 1][0] + sum(u.byte[b] for b in raw), best[j - 1][1] - len(raw)))
        best[j] = max(options)
    return -best[-1][1]


def test_unigram_counts(spark, docs, corpus):
    u = unigram.Unigram(PIECES)
    got = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(docs, PIECES).collect()}
    for i, text in enumerate(corpus):
        assert got[i] == sum(plain_tokens(u, "▁" + w) for w in (text or "").split())
    assert unigram.token_counts(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("rebase", [3, 1024])
def test_unigram_counts_of_long_pretokens(monkeypatch, rebase):
    monkeypatch.setattr(unigram, "REBASE", rebase)
    u = unigram.Unigram(PIECES)
    rnd = random.Random(3)
    words = sorted({"▁" + "".join(rnd.choice("theinga é日") for _ in range(n)) for n in [*range(1, 40), 200, 3000] for _ in range(3)} | {"▁" + "a" * 2500, "▁the", "▁the" * 40})
    assert u.counts(words) == [plain_tokens(u, w) for w in words]


def test_sharding(spark, docs):
    for n in (1, 2, 3, 40, 1000):
        rows = np.arange(n)
        s, slot = sharding.locate(rows, n)
        assert (sharding.row_of(s, slot, n) == rows).all() and len(set(zip(s.tolist(), slot.tolist(), strict=True))) == n
    out = sharding.shard(docs, 7).toPandas()
    assert sorted(out["row_number"]) == list(range(len(out))) and out.groupby("shard").size().agg(["min", "max"]).diff().iloc[1] <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    again = sharding.shard(docs.repartition(5), 7).toPandas()
    assert sorted(map(tuple, out.fillna(-1).to_numpy().tolist())) == sorted(map(tuple, again.fillna(-1).to_numpy().tolist()))
    assert sharding.shard(empty(spark)).count() == 0


def test_sharding_keeps_ids_and_places_them_by_the_plain_permutation(spark):
    rows = [(2**60 + 1, "é" * 3), (2**60 + 3, "a"), (None, "b"), (None, None), (7, ""), (7, "")]
    got = sharding.shard(frame(spark, rows), 3).collect()
    sizes = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes

    def plain_place(x, n):
        half = sharding.half_bits(n)
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for k in range(sharding.ROUNDS):
                z = (right + (sharding.SEED + k) * 0x9E3779B97F4A7C15) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                left, right = right, left ^ (z ^ z >> 31) & ((1 << half) - 1)
            x = left << half | right
            if x < n:
                return x

    assert all(plain_place(r["row_number"], len(rows)) == r["slot"] * 3 + r["shard"] for r in got)
    order = sorted(got, key=lambda r: r["row_number"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in order]
    assert keys == sorted(keys) and [r["row_number"] for r in order] == list(range(len(rows)))


def test_packing(spark, docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    out = packing.pack_documents(docs, WORD_BPE, capacity=128).toPandas()
    for i, text in enumerate(corpus):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        mine = out[out["doc_id"] == i].drop_duplicates(["piece", "start"]).sort_values("piece")
        assert mine["length"].tolist() == [len(ids[k : k + 128]) for k in range(0, len(ids), 128)]
        assert mine["ids_crc32"].tolist() == [zlib.crc32(np.array(ids[k : k + 128], "<u4").tobytes()) for k in range(0, len(ids), 128)]
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 128
    counts = out["length"].value_counts().to_dict()
    assert out["sequence_id"].nunique() <= packing.lower_bound(counts, 128) + 1
    assert packing.pack_documents(empty(spark), WORD_BPE).count() == 0


def least_bins(sizes, capacity):
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_bin_completion_against_exhaustive_search():
    rnd = random.Random(4)
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 11))), reverse=True)
        patterns = packing.solve(dict(collections.Counter(sizes)), 20)
        used = collections.Counter()
        for items, times in patterns:
            assert sum(n * k for n, k in items) <= 20
            for n, k in items:
                used[n] += k * times
        assert used == collections.Counter(sizes) and sum(t for _, t in patterns) == least_bins(sizes, 20)


def brute_repeats(raws, m):
    def gone(raws, m):
        seen = collections.Counter(r[i : i + m] for r in raws for i in range(len(r) - m + 1))
        for r in raws:
            out = bytearray(len(r))
            for i in range(len(r) - m + 1):
                if seen[r[i : i + m]] > 1:
                    out[i : i + m] = b"\1" * m
            yield out

    out = []
    for r, g in zip(raws, gone(raws, m), strict=True):
        sha = hashlib.sha256(bytes(b for b, x in zip(r, g, strict=True) if not x)).hexdigest()
        out.append((len(r), sum(g), len(re.findall(b"\1+", g)), sha))
    return out


def test_suffix_array_and_intervals():
    rnd = random.Random(3)
    for _ in range(150):
        m = rnd.choice([1, 2, 3, 5, 8, 13])
        base = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        strings = [b"".join(rnd.choice(base) for _ in range(rnd.randint(0, 3))) + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 8))]
        seen = collections.Counter(s[i : i + m] for s in strings for i in range(len(s) - m + 1))
        for s, places in zip(strings, suffix_dedup.repeated(strings, m), strict=True):
            assert places.tolist() == [i for i in range(len(s) - m + 1) if seen[s[i : i + m]] > 1]


@pytest.mark.parametrize("hot", [6000, 1])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rows = docs.collect()
    want = collections.Counter((r["doc_id"], *w) for r, w in zip(rows, brute_repeats([(r["text"] or "").encode() for r in rows], 80), strict=True))
    assert collections.Counter(map(tuple, suffix_dedup.kept_digests(docs, 80, 16).collect())) == want
    assert {bool(k[2]) for k in want} == {True, False}
    assert suffix_dedup.kept_digests(empty(spark)).count() == 0


def test_repeats_leave_other_columns_alone(spark, docs):
    clash = docs.withColumns({"spans": F.lit("s"), "rest": F.col("doc_id") * 2, "id": F.lit(None).cast("int"), "key": F.lit(7)})
    rows = clash.collect()
    kept = plain.without_repeats({k: r["text"] or "" for k, r in enumerate(rows)}, 80)
    want = collections.Counter((*r[:1], r["text"] and kept[k], *r[2:]) for k, r in enumerate(rows))
    out = suffix_dedup.remove_repeats(clash, 80, 16)
    assert out.columns == clash.columns and collections.Counter(map(tuple, out.collect())) == want
    assert any(kept[k] != (r["text"] or "") for k, r in enumerate(rows))


def test_suffix_dedup_with_production_parameters(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    long = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 600))) for _ in range(30)]
    passages = [" ".join(rnd.choice(words) for _ in range(n)) for n in (51, 55, 90, 200)]
    rows = long + [a[:300] + p + a[300:] for p in passages for a in rnd.sample(long, 3)] + long[:3] + [passages[3] * 3]
    df = frame(spark, enumerate(rows))
    want = collections.Counter((i, *w) for i, w in enumerate(brute_repeats([r.encode() for r in rows], 400)))
    assert collections.Counter(map(tuple, suffix_dedup.kept_digests(df).collect())) == want


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 10)
    raw = "".join(texts()[12:20]).encode()[:2000]
    whole = {(at + int(a), at + int(b), int(h)) for at, _, (_, first, last, _, hashes) in suffix_dedup.long_contexts(raw, 60, 16) for a, b, h in zip(first, last, hashes, strict=True)}
    covered = sorted(x for a, b, _ in whole for x in range(a, b + 1))
    assert covered == list(range(len(raw) - 59))


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark, docs):
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in got) == collections.Counter((r["doc_id"], plain_fingerprint(r["text"])) for r in rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    one = simhash.deduplicate(docs)
    ids = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({r["component_id"] for r in got} - {None})
    assert ids.count(None) == 1  # the null text stands under an id too


@pytest.mark.parametrize("small", [1, 16])
def test_pigeonring_loses_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = np.random.default_rng(small)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.r_[base, [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5), dtype=np.uint64)) for b in np.repeat(base, 12)]])
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 3]:
            parent[root(int(x))] = root(int(y))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    label = {r["vertex"] & (2**64 - 1): r["root"] for r in simhash.components(simhash.links(df)).collect()}
    groups = collections.defaultdict(set)
    for x in parent:
        groups[root(x)].add(x)
    for g in groups.values():
        assert len({label.get(x, x) for x in g}) == 1
    assert len({label.get(x, x) for x in parent}) == len(groups)


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = collections.defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    repeat = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), n < 10 or 100 * len(repeat) > 20 * n


def test_quality_measures(spark, docs):
    got = by_id(quality.judged(docs).select("doc_id", *[f"__q_{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]))
    assert got == collections.Counter((r["doc_id"], (r["doc_id"], *plain_quality(r["text"]))) for r in docs.collect())
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judged(docs).where("__q_kept").count() > 0
    assert quality.judged(docs).where("__q_kept and __q_base_failed").count() == 0
    assert quality.judged(empty(spark)).count() == 0 and quality.filtered(empty(spark)).count() == 0


def test_quality_drops_what_stands_out(spark):
    clean = texts(5, 200)[len(ODD) : len(ODD) + 200]
    clean = [c for c in clean if not plain_quality(c)[5]]
    junk = [re.sub(" ", "$$$ ", c) for c in clean[:5]]
    df = frame(spark, enumerate(clean + junk))
    kept = {r["doc_id"] for r in quality.filtered(df).collect()}
    assert kept == set(range(len(clean)))


@pytest.mark.parametrize("rule", ["symbols", "repeats", "dup_lines", "word_length"])
def test_each_quality_rule_rejects_alone(spark, rule):
    """Documents that pass the base rules, and one that stands out by the one measure."""
    rnd = random.Random(len(rule))
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(4, 6)))
    clean = ["\n".join(" ".join(word() for _ in range(10)) for _ in range(12)) for _ in range(600)]
    line = clean[0].split("\n")
    odd = {
        "symbols": clean[0].replace("\n", " ### "),
        "repeats": clean[0] + "\n" + " ".join(w for k in (0, 2) for w in line[k].split()[:5] + [word()]),
        "dup_lines": "\n".join([*line, "a b", "a b", "c d", "c d", "e f", "e f"]),
        "word_length": "\n".join(" ".join(word() * 3 for _ in range(10)) for _ in range(12)),
    }[rule]
    got = {r["doc_id"]: r for r in quality.judged(frame(spark, [*enumerate(clean), (900, odd)])).collect()}
    assert not got[900]["__q_base_failed"] and not got[900]["__q_kept"]
    assert sum(got[i]["__q_kept"] for i in range(600)) >= 594


def test_license_scan(spark, docs, corpus):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(corpus):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        places = [(k, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({p[1] for p in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(empty(spark)).count() == 0


def test_license_voting(spark):
    notice = next(n for n, label in license_scan.NOTICES.items() if label == "mit-notice").split()
    changed = [w for k, w in enumerate(notice) if k != 9]
    rows = [(1, "x " * 30 + " ".join(notice).upper()), (2, "y " + " ".join(changed) + " z"), (3, " ".join(notice[:6])), (4, " ".join(reversed(notice)))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1] == ("mit-notice", 1.0) and got[2][0] == "mit-notice" and 0.75 <= got[2][1] < 1 and got[3] == got[4] == ("", 0.0)


def test_language_gradients():
    rng = np.random.default_rng(0)
    m = language_id.Model(["a", "b"], *[0.3 * rng.standard_normal(s) for s in ((2, 256, 12), (2, 4, 12), (2, 4, 2), (2,))])
    matrix, length, owner, own = language_id.windows([b"abc", b"a" * 40, b"zz"])
    assert own.sum(axis=1).tolist() == [3, 32, 8, 2] and length.tolist() == [3, 40, 24, 2]
    label = np.array([0, 1, 0])[owner]
    _, grads = language_id.gradients(m, matrix, length, label)
    for x, g, at in zip(m.parameters(), grads, [(0, 97, 5), (1, 2, 9), (1, 3, 1), (1,)], strict=True):
        old, loss = x[at], []
        for e in (1e-5, -1e-5):
            x[at] = old + e
            loss.append(language_id.gradients(m, matrix, length, label)[0])
        x[at] = old
        assert abs((loss[0] - loss[1]) / 2e-5 - g[at]) < 1e-6


def test_language_id(spark, docs):
    rnd = random.Random(6)
    stems = {"aa": ["ther", "ing", "shon", "wha"], "bb": ["keit", "sch", "über", "ung"], "cc": ["ción", "osa", "ñez", "que"]}
    rows = [(i, " ".join("".join(rnd.choice(stems[k]) for _ in range(2)) for _ in range(20)), k) for i, k in enumerate(rnd.choices(list(stems), k=300))]
    df = spark.createDataFrame([(i, t, k, "s", len(t), "x", "y", "z") for i, t, k in rows], DOCS)
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(got[i]["lang_pred"] == k for i, k in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert [odd[i] for i in (0, 1, 2)] == ["und"] * 3 and odd[9] != "und"
    assert language_id.predict(empty(spark), language_id.fit(empty(spark))).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(empty(spark))).collect()} == {"und"}
    kept = language_id.identified(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(1 for v in language_id.predict(docs, model).collect() if v["lang_pred"] != "und")


def test_labels_equal_a_plain_network_byte_by_byte():
    rng = np.random.default_rng(4)
    m = language_id.Model(["a", "b", "c"], *[0.5 * rng.standard_normal(s) for s in ((2, 256, 12), (2, 4, 12), (2, 4, 3), (3,))])
    sig = lambda x: 1 / (1 + np.exp(-x))

    def plain(raw):
        logits = np.tile(m.c, (len(raw), 1))
        for d in range(2):
            state = np.zeros(4)
            for t in range(len(raw)) if d == 0 else reversed(range(len(raw))):
                x = m.w[d][raw[t]]
                z, r = sig(x[:4] + state @ m.u[d][:, :4]), sig(x[4:8] + state @ m.u[d][:, 4:8])
                new = np.tanh(x[8:] + r * (state @ m.u[d][:, 8:]))
                state = new + z * (state - new)
                logits[t] += state @ m.v[d]
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)

    texts = ["Hello there 12", "x", "日本語のテキスト" * 9, "a 日本 b"]
    names, score = language_id.Labeller(m).label(texts)
    for text, name, s in zip(texts, names, score, strict=True):
        total = []
        for chunk in text.lower().split():
            raw, out = chunk.encode(), []
            if not any(c.isalpha() for c in chunk):
                continue
            for at in range(0, len(raw), 32):
                enter = max(0, at - 16)
                out += plain(raw[enter : at + 48])[at - enter : at - enter + 32].tolist()
            assert len(out) == len(raw)
            total += out
        mean = np.mean(total, axis=0)
        assert name == m.languages[mean.argmax()] and abs(mean.max() - s) < 1e-4


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 6)
    rnd = random.Random(7)
    long = "".join(rnd.choice(["keit", "sch ", "über", "ung "]) for _ in range(9000))
    rows = [(i, "the thing was shown", "en") for i in range(400)] + [(1000 + i, long, "de") for i in range(3)]
    df = spark.createDataFrame([(i, t, k, "s", len(t), "x", "y", "z") for i, t, k in rows], DOCS)
    texts, languages = language_id.sample(df)
    assert set(languages) == {"en", "de"} and languages.count("en") == 3 and max(map(len, texts)) == language_id.EXCERPT
    model = language_id.train(texts, languages, steps=60)
    assert language_id.Labeller(model).label([long])[0] == ["de"] and model.languages == ["de", "en"]


def brute_near(ids, x, q_id, k):
    d = np.sqrt(((x - x[ids == q_id][0]) ** 2).sum(axis=1))
    return [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q_id][:k]


@pytest.mark.parametrize("group_rows", [32_768, 100])
def test_nearest_neighbours(spark, monkeypatch, group_rows):
    monkeypatch.setattr(ann, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[100:140] = x[7]  # a group of exact copies
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(900, None, "q"), (901, [0.0] * 24, "q"), (902, [float("nan")] * 24, "q"), (903, [1.0], "q"), (904, [None] * 24, "q"), (5, x[5].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = ann.search(df, F.col("vec_id") % 50 == 0).toPandas()
    ids, exact = np.arange(600), x.astype(float)
    hits = 0
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], [np.sqrt(((exact[v] - exact[q]) ** 2).sum()) for v in g["vec_id"]], atol=1e-12)
        hits += len(set(g["vec_id"]) & set(brute_near(ids, exact, q, 10)))
    assert out["query_id"].nunique() == 12 and hits >= 0.9 * 120
    assert out[out["query_id"] == 100]["vec_id"].tolist()[:3] == [7, 101, 102]
    odd = spark.createDataFrame([(i, v.tolist()[: 8 if i % 50 else 6], "q") for i, v in enumerate(x)], df.schema)
    assert ann.search(odd, F.col("vec_id") % 50 == 0).count() == 0  # queries of another dimension than the table's
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3 and ann.search(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_multi_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    codes[50:90] = codes[3] ^ (rng.random((40, 8)) < 0.3).astype(np.uint8)
    x = rng.standard_normal((500, 4))
    for radius in (0, 5, 9, 20, 40, 64):
        found = set()
        for t in range(ann.TABLES):
            out = ann.probe(t, radius, 500, np.arange(500), codes, x, np.array([3]), codes[3:4], x[3:4])
            assert not found & set(out[1])
            found |= set(out[1])
        assert found == set(np.flatnonzero(np.bitwise_count(codes ^ codes[3]).sum(axis=1) <= radius).tolist())


def test_entry_registers_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
