"""Append-only tables that streams write once for each batch, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_of(spark: SparkSession, folder: str) -> tuple:
    """A folder and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class BatchLog:
    """A table in which every batch has a folder of its own, and counts once its commit record is there.

    A batch is written to its folder, over what a failed try has left, and then committed by a file that names it: a
    replay of a committed batch does nothing, and readers see committed batches only. With ``once_by``, a row whose key
    was committed by an earlier batch, or stands earlier in the same one, is not written again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, once_by: list[str] | None = None) -> None:
        self.spark, self.folder, self.schema, self.once_by = spark, folder.rstrip("/"), schema, once_by

    def record(self, batch: int) -> str:
        return f"{self.folder}/commits/{batch}"

    def committed(self) -> list[int]:
        fs, path = path_of(self.spark, f"{self.folder}/commits")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Write and commit one batch; False if it was committed before."""
        fs, record = path_of(self.spark, self.record(batch))
        if fs.exists(record):
            return False
        if self.once_by:
            rows = rows.dropDuplicates(self.once_by).join(self.read().select(*self.once_by), self.once_by, "left_anti")
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        fs.create(record, False).close()
        return True

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        batches = [f"{self.folder}/rows/batch={b}" for b in self.committed()]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(empty.schema).parquet(*batches) if batches else empty

    def sink(self, make: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def put(rows: DataFrame, batch: int) -> None:
            self.write(make(rows) if make else rows, batch)

        return put


class BucketTable:
    """A keyed table in buckets by hash, updated by rewriting the buckets that new rows fall into, and no others.

    A version names the folder of each bucket; it is written as one file, after all its buckets, and the last one stands.
    A reader keeps the version it began with: files of older versions stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        fs, path = path_of(self.spark, f"{self.folder}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []

    def current(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        if not (found := self.versions()):
            return {}
        lines = self.spark.read.text(f"{self.folder}/versions/{found[-1]}").collect()
        return {int(b): p for b, p in (r["value"].split(" ", 1) for r in lines if r["value"])}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self.current().items()) if buckets is None or b in buckets]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def merge(self, new: DataFrame, latest: Callable[[DataFrame], DataFrame]) -> set[int]:
        """Put new rows in; of old and new rows of a key ``latest`` says which stays. The buckets that were rewritten."""
        now = self.current()
        number = (self.versions() or [-1])[-1] + 1
        new = new.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = {r["b"] for r in new.select(self.bucket().alias("b")).distinct().collect()}
        if not touched:
            return touched
        rows = latest(self.read(touched).unionByName(new)).withColumn("bucket", self.bucket())
        into = f"{self.folder}/rows/{number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(into)
        now |= {b: f"{into}/bucket={b}" for b in touched}
        fs, path = path_of(self.spark, f"{self.folder}/versions/{number}")
        out = fs.create(path, False)  # another writer of the same version fails here
        out.write(bytearray("".join(f"{b} {p}\n" for b, p in sorted(now.items())).encode()))
        out.close()
        return touched

    def vacuum(self) -> None:
        """Remove what the current version does not name."""
        kept = {p.rsplit("/", 1)[0] for p in self.current().values()}
        for number in self.versions()[:-1]:
            fs, path = path_of(self.spark, f"{self.folder}/versions/{number}")
            fs.delete(path, True)
            if f"{self.folder}/rows/{number}" not in kept:
                fs.delete(path_of(self.spark, f"{self.folder}/rows/{number}")[1], True)
