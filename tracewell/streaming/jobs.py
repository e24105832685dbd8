"""Stateful streams: deduplication within a watermark, a TTL cache, and retries, on the events stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.retry import Limits, State, advance
from tracewell.operators.shared import shared_folder


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream with an event time that watermarks take. ``path`` names one Parquet file or folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first event of each key; state goes once the watermark has passed."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def counted(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events and value by type in tumbling windows."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def ttl_cache(stream: DataFrame, key: str, ttl_ms: int, delay: str = "1 hour") -> DataFrame:
    """Hits and misses of a cache by key whose entries live ttl_ms: the state of a key is when its entry was fetched.

    State of a key goes once the watermark has passed its last event by the TTL, so it stays bounded.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (fetched, hits, misses) = state.get if state.exists else (None, 0, 0)
        times = sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"])
        for t in times:
            if fetched is not None and t < fetched + ttl_ms:
                hits += 1
            else:
                fetched, misses = t, misses + 1
        state.update((fetched, hits, misses))
        state.setTimeoutTimestamp(max(times[-1] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "hits": [hits], "misses": [misses]})

    timed = stream.withWatermark("ts", delay)
    return timed.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, hits long, misses long", "fetched long, hits long, misses long", "update", GroupStateTimeout.EventTimeTimeout)


def retries(stream: DataFrame, key: str, limits: Limits = Limits(), delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Retry timelines of jobs whose attempts arrive as a stream (key, ts, kind, code, duration_ms, retry_after_ms).

    A job's state goes once the watermark has passed its last attempt by ``idle_ms``, so it stays bounded; attempts
    that come later begin a new timeline.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = State(*state.get) if state.exists else State()
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for r in rows.itertuples():
            now, row = advance(now, r.kind, r.code, int(r.duration_ms), int(r.retry_after_ms), limits)
            if row:
                out.append({key: k[0], **row})
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].value // 1_000_000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out)[[key, "attempt", "started_ms", "duration_ms", "code", "delay_ms", "capped"]]

    schema = f"`{key}` {kind}, attempt int, started_ms long, duration_ms long, code string, delay_ms long, capped boolean"
    timed = stream.withWatermark("ts", delay)
    return timed.groupBy(key).applyInPandasWithState(step, schema, "clock_ms long, attempt long, retries long, limited long, outcome string", "append", GroupStateTimeout.EventTimeTimeout)


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append", latest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Everything a stream gives for what is there now, through a Parquet sink in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, n: int) -> None:
            batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}")

        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out") if mode == "append" else spark.read.parquet(f"{folder}/out").drop("n")
    return latest(out) if latest else out
