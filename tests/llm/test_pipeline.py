"""The pipeline against a plain version of its stages."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from tracewell.llm import bpe, common, near_copies
from tracewell.llm.queries import tokenizer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = {k: ["".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(400)] for k, s in {"en": ["the", "ing", "sho", "wha"], "de": ["kei", "sch", "ube", "ung"]}.items()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        rows.append([i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(30, 200))), lang, f"s{i % 2}"])
    passage = " ".join(rnd.choice(words["en"]) for _ in range(70))
    for i in range(20, 26):
        rows[i][1] += " " + passage
    rows += [[200, rows[5][1], "en", "s0"], [201, rows[5][1] + " ", "en", "s0"], [202, "12 34 !!", "en", "s0"], [203, None, "en", None], [204, rows[7][1].replace(" ", "$$$ "), "de", "s1"], [205, "too short", "en", "s0"]]
    path = tmp_path_factory.mktemp("data")
    data = [(i, t, k, s, None if t is None else len(t)) for i, t, k, s in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = start = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == start.columns and out.dtypes == start.dtypes
            out = spark.createDataFrame(out.collect(), start.schema)
        left[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    assert not {202, 203} & set(left["language_id"]) and {204, 205} <= set(left["language_id"])
    assert not {204, 205} & set(left["quality_rules"]) and set(range(160)) <= set(left["quality_rules"])
    assert set(left["simhash_near_dedup"]) == set(left["quality_rules"]) - {200, 201}
    before, after = left["simhash_near_dedup"], left["suffix_array_dedup"]
    want = plain.without_repeats({i: r["text"] for i, r in before.items()}, corpus_pipeline.REPEAT_BYTES)
    assert {i: r["text"] for i, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert any(len(want[i]) < len(before[i]["text"]) for i in range(20, 26))
    assert set(left["best_fit_packing"]) == set(after)


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r["doc_id"] for r in rows} == set(range(160))


def test_stages_keep_columns_of_any_name(spark, folder):
    """Names that operators use inside, and one with a dot, come through every stage as they were."""
    extra = ["__key", "key", "v", "spans", "rest", "id", "a.b", "c0", "__q_n_words", "wanted"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == start.columns and out.dtypes == start.dtypes, name
        docs = spark.createDataFrame(out.collect(), start.schema)
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in docs.collect() for c in extra), name
    assert corpus_pipeline.packing_stage(spark, docs, folder).count() >= docs.count() > 150


def test_stages_on_empty_tables_and_null_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        nameless = spark.createDataFrame((out := stage(spark, nameless, folder)).collect(), out.schema)
    assert nameless.where("doc_id is null").count() > 50


@pytest.mark.parametrize(("asked", "most"), [("10000", 2000), ("0", 2000), ("300", 300)])
def test_python_stages_take_small_batches(spark, monkeypatch, asked, most):
    """A worker and its JVM hold at most BATCH_ROWS documents a batch, fewer where the session asks for fewer."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    monkeypatch.setattr(near_copies, "deduplicate", lambda docs: docs.mapInArrow(run, "n bigint"))
    try:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, asked)
        sizes = [r["n"] for r in corpus_pipeline.near_dedup_stage(spark, spark.range(5000).coalesce(1), "").collect()]
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before)
    assert sum(sizes) == 5000 and max(sizes) == most


def test_other_operators_find_no_words_of_the_tokenizer():
    """What a worker remembers of packing goes before another operator's task begins, pre-tokens too."""
    path = tokenizer("word_bpe_49k.json")
    known, cache = bpe.load(path), bpe.id_cache(path)
    cache.get_all([["several", "words", "here"]])
    assert len(known.index) > 1 and cache.known
    common.forget_words()
    assert len(known.index) == 1 and not cache.known and len(known.store) == 0
    assert cache.get_all([["several"]])["several"] == known.encode_chunks(["several"])[0]
