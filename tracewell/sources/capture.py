"""Readers and writers of captured data: responses, journals, objects, and body decoding."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.values import digest, object_path

MAX_BODY = 5 << 20
DECODED = T.StructType([T.StructField("body", T.BinaryType()), T.StructField("outcome", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decode_body(body: bytes | None, encoding: str | None, most: int = MAX_BODY) -> tuple[bytes | None, str]:
    """Decoded body and outcome: ok, hard_limit past the cap, unsupported for brotli and stacked codings, or failed."""
    name = (encoding or "identity").strip().lower()
    if body is None:
        return None, "ok"
    if name in ("", "identity"):
        return (body, "ok") if len(body) <= most else (None, "hard_limit")
    bits = {"gzip": 31, "x-gzip": 31, "deflate": 15}.get(name)
    if bits is None:
        return None, "unsupported"
    try:
        d = zlib.decompressobj(bits)
        out = d.decompress(body, most + 1)
    except zlib.error:
        return None, "failed"
    if len(out) > most or d.unconsumed_tail:
        return None, "hard_limit"
    return (out, "ok") if d.eof else (None, "failed")


def decoded(body: Column, encoding: Column, most: int = MAX_BODY) -> Column:
    """decode_body() for columns; plain bodies never leave the JVM."""

    @F.pandas_udf(DECODED)
    def run(b: pd.Series, e: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_body(x, y, most) for x, y in zip(b, e, strict=True)], columns=["body", "outcome"])

    plain = F.coalesce(F.lower(F.trim(encoding)), F.lit("identity")).isin("", "identity")
    fits = F.octet_length(body) <= most
    own = F.struct(F.when(fits, body).alias("body"), F.when(fits | body.isNull(), "ok").otherwise("hard_limit").alias("outcome"))
    return F.when(plain, own).otherwise(run(body, encoding))


def bounded(body: Column, most: int = MAX_BODY) -> Column:
    """Outcome of a bounded read: no partial success."""
    return F.when(F.octet_length(body) > most, "hard_limit").otherwise("ok")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, line_no, raw) of NDJSON journals at <path>/<run_id>/attempts.ndjson. Lines of one journal (16 MiB at
    most) are numbered by their place in the whole file."""
    whole = spark.read.text(path, wholetext=True).withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return whole.select("run_id", F.posexplode(F.split("value", "\n")).alias("line_no", "raw")).where("raw <> ''")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects with their own hash, and whether it is the one in their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.concat(F.lit("sha256:"), name).alias("hash"), "content", F.col("length").alias("bytes"))
    return rows.withColumn("intact", digest(F.col("content")) == F.col("hash"))


def write_objects(rows: DataFrame, path: str) -> None:
    """Append objects (hash, content), spread over folders by the first two digits of their hash."""
    rows.withColumn("prefix", F.substring("hash", 8, 2)).withColumn("object_path", object_path(F.col("hash"))).write.mode("append").partitionBy("prefix").parquet(path)


def append_attempts(rows: DataFrame, path: str) -> None:
    """Append attempt events as JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def result_lines(rows: DataFrame, as_json: bool = True) -> DataFrame:
    """Result rows as one JSON line or tab-separated line each."""
    return rows.select((F.to_json(F.struct(*rows.columns)) if as_json else F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns])).alias("line"))
