"""Helpers that the training-data operators share: reading, shared-storage cuts and bounded word caches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word cache holds at most; beyond that it starts anew, so memory stays bounded.
CACHE_WORDS = 500_000
#: Words longer than this many bytes are worked out each time and never cached.
CACHE_WORD_BYTES = 200
#: Bytes of text that one slice of an Arrow batch holds at most (a single longer text makes a slice of its own).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset, and only on one machine, a folder is made here."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    folder, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a work folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    folder = folder or work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a Parquet table in the shared folder, which goes at the end: what is made of them must be cut before."""
    folder = work_folder(df.sparkSession)
    try:
        yield stored(df, folder)
    finally:
        remove(df.sparkSession, folder)


def boxed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``text``, every other column of the documents as one struct ``rest``, whatever their names, and ``columns``."""
    other = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]
    return docs.select("text", F.struct(F.lit(0).alias("c"), *other).alias("rest"), *columns)


def unboxed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The documents of ``boxed``, with their columns as they were."""
    return rows.select(*[(F.col("text") if c == "text" else F.col("rest")[f"c{k}"]).alias(c) for k, c in enumerate(names)])


def row_key(id_column: str) -> Column:
    """128 bits of a row's id and text, as 16 bytes: rows that share them are copies of each other."""
    half = lambda *seed: F.lpad(F.hex(F.xxhash64(*seed, F.isnull(id_column), id_column, F.isnull("text"), "text")), 16, "0")
    return F.unhex(F.concat(half(), half(F.lit(1))))


def has(df: DataFrame) -> bool:
    """Whether any row exists."""
    return bool(df.take(1))


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about ``most`` bytes of text each, and their texts, so that memory stays bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, part.column(column).to_pylist()


#: The caches of this worker process; each has ``forget``.
WORD_CACHES: list = []


def forget_words() -> None:
    """Empty this worker's caches: tasks that need the memory for something else begin with it."""
    for cache in WORD_CACHES:
        cache.forget()


def bounded(run: Callable, keep_words: bool = False) -> Callable:
    """A map function that leaves its worker's memory as small as it found it: workers are used again, by other operators.

    Word caches of earlier tasks are emptied first, unless the task itself uses them, and memory that was freed goes
    back to the system in the end.
    """

    def wrapped(batches: Iterable) -> Iterator:
        if not keep_words:
            forget_words()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


class WordCache:
    """Values by word, filled for many unseen words at once.

    ``fill`` takes a list of distinct words and returns their values in order. The cache holds at most
    ``limit`` entries; ``get_all`` starts it anew when the next words would not fit.
    """

    def __init__(self, fill: Callable[[list], list], limit: int = CACHE_WORDS) -> None:
        self.fill, self.limit, self.known = fill, limit, {}
        WORD_CACHES.append(self)

    def forget(self) -> None:
        self.known = {}

    def get_all(self, split: list[list]) -> dict:
        """A dictionary that has every word of the lists."""
        wanted = set().union(*split)
        unseen = list(wanted.difference(self.known))
        if not unseen:
            return self.known
        values = self.fill(unseen)
        if len(self.known) + len(unseen) <= self.limit and max(map(len, unseen)) <= CACHE_WORD_BYTES:
            self.known.update(zip(unseen, values, strict=True))
            return self.known
        # What this call needs stands beside the cache, which starts anew with what fits of it.
        fresh = {w: self.known[w] for w in wanted if w in self.known}
        fresh.update(zip(unseen, values, strict=True))
        if len(self.known) + len(unseen) > self.limit:
            self.known = {}
        if len(self.known) + len(fresh) <= self.limit:
            self.known.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_WORD_BYTES)
        return fresh


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, as far as words of ASCII letters can tell: the Kelvin sign, which lower() would turn into k, is put aside first."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffc")))
