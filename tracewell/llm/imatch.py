"""I-Match fingerprints over randomised lexicons, and how they stand an edit (operator 13). DataFrame functions only.

A lexicon holds the terms whose inverse document frequency lies in a band: not in more than ``MOST_SHARE`` of all
documents, in ``LEAST_DOCS`` documents and ``LEAST_SHARE`` of all at least. The terms' hashes deal all of it to
``BUCKETS`` disjoint subsets, and in each are ``LEVELS`` nested ones, every next one half of the one before. A
signature hashes a document's distinct terms in one subset, sorted; the fingerprint is all of them in order. Likeness is
the share of buckets, of those with a term of either document, in which the signatures of some level agree: the wide
subsets change with any edit, the narrow ones outlive it. Every term of every document is counted, and each term of the
band has its part in the fingerprint.

Documents are read three times: once to count their terms (partial sums move, no terms of documents), once for narrow
rows of (id, hash of id and text, length), whose order gives each document the next one, and once for the texts, which
are shuffled once by that hash and handed on as far as the document before needs them. Rows equal in id and text are
collapsed before texts move, so a text that any share of the rows repeats stays one row of each task. The lexicon is
broadcast up to ``BROADCAST_TERMS`` terms, and terms are looked up where the texts are. Beyond that the hashed terms are
joined to it by shuffle without the terms above the band; these are a bounded number (the mean count of terms in a
document through ``MOST_SHARE``), and broadcast.

Defined results: a null text counts as empty. Words are lower-cased runs of what is not ASCII punctuation, space or
control; texts of any length are taken whole. Equal texts have equal fingerprints. A document with fewer than ``FEW`` terms
of the band keeps all its terms; one without any is fingerprinted by its whole text. Documents of one
id follow one another by hash, copies of one row after itself; a null id is the smallest. The only document is its own
next. Every row counts and comes back; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut, remove, stored, work_folder

#: The band, as counts of documents and shares of all: inverse document frequencies of 3 to 11.5.
LEAST_DOCS, LEAST_SHARE, MOST_SHARE = 2, 1e-5, 0.05
BUCKETS, LEVELS, FEW, SEED = 16, 8, 4, 13
#: Hash bits: those that only tell which terms are taken (none: all terms are), those of the bucket, those of the levels.
USED, BUCKET_BITS = 0, 4
#: Terms up to which the lexicon is broadcast (8 bytes each).
BROADCAST_TERMS = 1_000_000
#: Copies of one row that a task writes out.
COPIES = 10_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within go when each action ends, where Spark offers that; else whenever it collects."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
    except PySparkException:
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def terms(text: Column) -> Column:
    """Distinct hashes of the words."""
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lit(SEED), w)))


def signatures(found: Column, whole: Column) -> Column:
    """By bucket, the signatures of a document's terms; of its whole text (as a hash) if it has none. 0 stands for no term."""
    sign = lambda x: (F.lit(1) + F.pmod(x, F.lit(65535))).cast("int")
    bits = lambda t, at, n: F.shiftrightunsigned(t, at).bitwiseAND((1 << n) - 1)
    level = lambda k: lambda t: bits(t, USED + BUCKET_BITS, k) == 0
    signed = lambda x: F.when(F.size(x) == 0, 0).otherwise(sign(F.xxhash64(x)))
    buckets = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    split = lambda terms: F.transform(buckets, lambda q: F.filter(terms, lambda t: bits(t, USED, BUCKET_BITS) == q))
    # Functions of a lambda's argument are worked out once, so the sorted terms and the buckets are arguments.
    by_bucket = F.get(F.transform(F.array(F.sort_array(found)), split), 0)
    by_level = F.transform(by_bucket, lambda own: F.array(*[signed(F.filter(own, level(k)) if k else own) for k in range(LEVELS)]))
    alone = F.transform(buckets, lambda q: F.array(*[sign(F.xxhash64(whole, q * LEVELS + k + 1)) for k in range(LEVELS)]))
    return F.when(F.size(found) > 0, by_level).otherwise(alone)


def likeness(a: Column, b: Column) -> Column:
    """The share of buckets in which a signature of some level agrees, among those that hold a term of either."""
    mark = lambda x, y: F.when((x != 0) & (x == y), 2).when((x != 0) | (y != 0), 1).otherwise(0)
    best = F.zip_with(a, b, lambda x, y: F.array_max(F.zip_with(x, y, mark)))
    counted = lambda s, m: s + F.when(m == 2, 1 << 16 | 1).when(m == 1, 1).otherwise(0)
    return F.aggregate(best, F.lit(0), counted, lambda s: F.shiftright(s, 16) / s.bitwiseAND(0xFFFF))


def printed(signed: Column) -> Column:
    return F.array_join(F.transform(F.flatten(signed), lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def followed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows (u, v, ...), which are distinct, with nu, nv of the next one in the order; the first comes after the last."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))
    own = Window.partitionBy("part").orderBy("pos")
    key = F.struct("u", "v")
    # One row a partition: where each begins.
    firsts = placed.groupBy("part").agg(F.min_by(key, "pos").alias("begins"))
    around = Window.orderBy("part")
    after = F.coalesce(F.lead("begins").over(around), F.first("begins").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("part", after.alias("after"))
    out = placed.withColumn("next", F.lead(key).over(own)).join(firsts, "part").withColumn("next", F.coalesce("next", "after"))
    return out.withColumn("nu", F.col("next.u")).withColumn("nv", F.col("next.v")).drop("next", "after", "part", "pos")


def edited_terms(docs: DataFrame, id_column: str) -> DataFrame:
    """id, u, v, k, nu, nv, times, n_chars, whole, edited_whole, edited_sha256, own, edited: one row for each document and next one, with their terms."""
    text = F.coalesce("text", F.lit(""))
    key = [F.xxhash64(F.col(id_column).isNull(), id_column, text).alias("u"), F.xxhash64(F.lit(SEED), F.col(id_column).isNull(), id_column, text).alias("v")]
    narrow = docs.select(*key, F.col(id_column).alias("id"), F.length(text).alias("n")).groupBy("u", "v").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    chain = cut(followed(narrow, [F.desc_nulls_last("id"), F.col("u"), F.col("v")]))
    texts = docs.select(*key, text.alias("text")).groupBy("u", "v").agg(F.first("text").alias("text"))
    half = F.expr("n div 2").cast("int")
    before = chain.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("nu").alias("u"), F.col("nv").alias("v"), half.alias("need"))
    starts = texts.join(before, ["u", "v"]).select(F.col("pu").alias("u"), F.col("pv").alias("v"), F.expr("substring(text, 1, need)").alias("start"))
    both = texts.join(chain, ["u", "v"]).join(starts, ["u", "v"])
    head = F.expr("substring(text, 1, cast(n - n div 2 as int))")
    # All copies of a row but the last are followed by another copy.
    last = F.struct(F.lit(0).alias("k"), "nu", "nv", F.lit(1).cast("long").alias("times"), F.concat(head, "start").alias("text"))
    other = F.struct(F.lit(1).alias("k"), F.col("u").alias("nu"), F.col("v").alias("nv"), (F.col("copies") - 1).alias("times"), F.concat(head, F.expr("substring(text, 1, cast(n div 2 as int))")).alias("text"))
    each = F.explode(F.when(F.col("copies") > 1, F.array(last, other)).otherwise(F.array(last)))
    wide = both.select("id", "u", "v", F.col("n").cast("long").alias("n_chars"), F.xxhash64("text").alias("whole"), terms(F.col("text")).alias("own"), each.alias("x"))
    return wide.select(
        "id", "u", "v", "x.k", "x.nu", "x.nv", "x.times", "n_chars", "whole", F.xxhash64("x.text").alias("edited_whole"), F.unhex(F.sha2(F.col("x.text").cast("binary"), 256)).alias("edited_sha256"), "own", terms(F.col("x.text")).alias("edited")
    )


def in_band(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the terms (t) of all documents: those of the lexicon, and those too common for it."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("d"))
    counts = cut(counts.where(F.col("d") >= max(LEAST_DOCS, LEAST_SHARE * n)))
    return counts.where(F.col("d") <= MOST_SHARE * n).select("t"), counts.where(F.col("d") > MOST_SHARE * n).select("t")


def enough(name: str) -> Column:
    """A document's terms of the lexicon, or all its terms if those are fewer than ``FEW``."""
    return F.when(F.coalesce(F.size(f"{name}_kept"), F.lit(0)) >= FEW, F.col(f"{name}_kept")).otherwise(F.col(name)).alias(name)


def collected() -> list[Column]:
    return [F.collect_list(F.when(F.col("known") & (F.col("of") == k), F.col("t"))).alias(f"{c}_kept") for k, c in enumerate(("own", "edited"))]


def looked_up(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The rows with those of their ``own`` and ``edited`` terms that count. The lexicon goes where the rows are, so no term moves."""
    key = ["u", "v", "k"]
    rest = [c for c in rows.columns if c not in key]
    kind = rows.select(F.struct(*rest).alias("rest")).schema["rest"].dataType
    # One row of each document carries the other columns.
    item = lambda of, t, rest: F.struct(F.lit(of).alias("of"), t.alias("t"), rest.cast(kind).alias("rest"))
    each = lambda of: lambda t: item(of, t, F.lit(None))
    items = F.concat(F.array(item(-1, F.lit(None).cast("long"), F.struct(*rest))), F.transform("own", each(0)), F.transform("edited", each(1)))
    found = rows.select(*key, F.explode(items).alias("x")).select(*key, "x.of", "x.t", "x.rest")
    found = found.join(F.broadcast(lexicon.withColumn("known", F.lit(True))), "t", "left")
    found = found.groupBy(*key).agg(F.first("rest", ignorenulls=True).alias("rest"), *collected()).select(*key, "rest.*", "own_kept", "edited_kept")
    return found.select(*[enough(c) if c in ("own", "edited") else c for c in rows.columns])


def joined(rows: DataFrame, lexicon: DataFrame, common: DataFrame) -> DataFrame:
    """As ``looked_up``, by shuffle."""
    key = ["u", "v", "k"]
    pairs = rows.select(*key, F.lit(0).alias("of"), F.explode("own").alias("t")).unionByName(rows.select(*key, F.lit(1).alias("of"), F.explode("edited").alias("t")))
    pairs = pairs.join(F.broadcast(common), "t", "left_anti").join(lexicon.withColumn("known", F.lit(True)), "t")
    return rows.join(pairs.groupBy(*key).agg(*collected()), key, "left").select(*[enough(c) if c in ("own", "edited") else c for c in rows.columns])


def fingerprinted(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the start of the next document, in descending order of ids.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    with shuffles_end(spark):
        lexicon, common = in_band(docs)
        rows = edited_terms(docs, id_column)
        rows = looked_up(rows, lexicon) if lexicon.count() <= BROADCAST_TERMS else joined(stored(rows, folder), lexicon, common)
        signed = stored(rows.select(
            "id", "u", "v", "nu", "nv", "times", "n_chars", "edited_sha256", signatures(F.col("own"), F.col("whole")).alias("fp"), signatures(F.col("edited"), F.col("edited_whole")).alias("edited_fp")
        ))
    remove(spark, folder)
    after = signed.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("fp").alias("next_fp")).dropDuplicates(["nu", "nv"])
    out = signed.join(after, ["nu", "nv"]).select(
        F.col("id").alias(id_column), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "times",
    )
    # Copies beyond the first of a row are written out by several tasks if they are many.
    once, many = out.where(F.col("times") == 1).drop("times"), out.where(F.col("times") > 1)
    many = many.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES).cast("long")))).repartition("piece", "fingerprint")
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("times") - F.col("piece"), F.lit(COPIES)))))
    return once.unionByName(many.drop("times", "piece", "copy"))
