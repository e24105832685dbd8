"""Cuts of lineage and row numbers, by way of the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the row within its partition below this many bits.
ROW_BITS = 33


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


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with Parquet in the shared folder: for rows that are many, as it takes a fraction of a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Rows with their number from 0 within ``by``, in ``order``, which must tell the rows of a group apart.

    Rows are dealt out by range, so a group of any size lies in as many partitions as it needs; what is counted by window
    are the stretches: one row for each group in each partition.
    """
    placed = cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order))
    at = F.monotonically_increasing_id()
    placed = placed.withColumn("__part", F.shiftright(at, ROW_BITS)).withColumn("__row", at.bitwiseAND((1 << ROW_BITS) - 1))
    own = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = placed.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    stretches = stretches.withColumn("__start", F.coalesce(F.sum("__n").over(own), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    # Null groups are groups too.
    stretches = stretches.select("__start", *[F.col(c).alias(f"__s{k}") for k, c in enumerate(["__part", *by])])
    met = placed.join(stretches, [F.col(c).eqNullSafe(F.col(f"__s{k}")) for k, c in enumerate(["__part", *by])])
    return met.withColumn(name, F.col("__row") + F.col("__start")).select(*rows.columns, name)
