"""Attempts: retry decisions as a fold a job, and the numbering and durations of attempt logs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSIENT = ("network", "timeout", "http_5xx")


class Limits(NamedTuple):
    retries: int = 2
    max_retry_after_ms: int = 30_000
    wall_ms: int = 60_000
    per_attempt_ms: int = 15_000


class State(NamedTuple):
    """What a job carries from attempt to attempt; durations come with the log."""

    clock_ms: int = 0
    attempt: int = 0
    retries: int = 0
    limited: int = 0
    outcome: str | None = None


def advance(state: State, kind: str, code: str, duration_ms: int, retry_after_ms: int, limits: Limits) -> tuple[State, dict | None]:
    """One more attempt of a job: the new state and its timeline row (None once the job has ended)."""
    if state.outcome is not None:
        return state, None
    if state.clock_ms >= limits.wall_ms:
        return state._replace(outcome="hard_limit"), None
    end = state.clock_ms + max(0, min(duration_ms, limits.per_attempt_ms, limits.wall_ms - state.clock_ms))
    row = {"attempt": state.attempt + 1, "started_ms": state.clock_ms, "duration_ms": end - state.clock_ms, "code": code, "delay_ms": 0, "capped": False}
    state = state._replace(clock_ms=end, attempt=state.attempt + 1)
    asked = max(0, retry_after_ms)
    limited = code == "rate_limited"
    again = kind == "retryable" and state.retries < limits.retries and (state.limited < 1 if limited else code in TRANSIENT)
    if not again:
        return state._replace(outcome=code), row
    delay = min(asked, limits.max_retry_after_ms) if limited else 0
    if end + delay >= limits.wall_ms:
        return state._replace(outcome="hard_limit"), row
    row |= {"delay_ms": delay, "capped": limited and asked > limits.max_retry_after_ms}
    return state._replace(clock_ms=end + delay, retries=state.retries + 1, limited=state.limited + limited), row


def timeline(log: Iterable[tuple], limits: Limits) -> tuple[list[dict], str]:
    """Timeline and outcome of one job's scripted attempts (kind, code, duration_ms, retry_after_ms)."""
    state, rows = State(), []
    for kind, code, duration, after in log:
        state, row = advance(state, kind, code, duration, after, limits)
        if row:
            rows.append(row)
    return rows, state.outcome or "interrupted"


def timelines(attempts: DataFrame, by: list[str], limits: Limits = Limits()) -> DataFrame:
    """Timelines of all jobs. ``attempts``: by, seq, kind, code, duration_ms, retry_after_ms. A job's attempts are
    bounded by its retries, whatever the log holds after them."""
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema.fields}
    first = attempts.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("nth") <= limits.retries + 2)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        out, outcome = timeline(rows[["kind", "code", "duration_ms", "retry_after_ms"]].itertuples(index=False), limits)
        frame = pd.DataFrame(out, columns=["attempt", "started_ms", "duration_ms", "code", "delay_ms", "capped"]).assign(outcome=outcome)
        for c in by:
            frame[c] = rows[c].iloc[0]
        return frame

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", attempt int, started_ms long, duration_ms long, code string, delay_ms long, capped boolean, outcome string"
    return first.groupBy(*by).applyInPandas(fold, schema)


def native_timelines(attempts: DataFrame, by: list[str], limits: Limits = Limits()) -> DataFrame:
    """The part of timelines() that windows can express: attempts up to the one that ends a job, numbered, with delays.

    An attempt is retried while retries remain; rate limiting once only. So a job ends at its first attempt that is
    not retryable, its second rate-limited one, or the one after its last retry.
    """
    w = Window.partitionBy(*by).orderBy("seq")
    limited = (F.col("code") == "rate_limited").cast("int")
    rows = attempts.withColumn("attempt", F.row_number().over(w)).withColumn("limited", F.sum(limited).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    again = (F.col("kind") == "retryable") & (F.col("attempt") <= limits.retries) & ((F.col("code") != "rate_limited") | (F.col("limited") <= 1))
    rows = rows.withColumn("again", again)
    ended = F.sum((~F.col("again")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0")
    delay = F.when(F.col("again") & (F.col("code") == "rate_limited"), F.least("retry_after_ms", F.lit(limits.max_retry_after_ms))).otherwise(0)
    capped = F.col("again") & (F.col("code") == "rate_limited") & (F.col("retry_after_ms") > limits.max_retry_after_ms)
    return rows.select(*by, "seq", "attempt", "code", delay.cast("long").alias("delay_ms"), capped.alias("capped"), (~F.col("again")).alias("last"))


def duration(started: Column, finished: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), finished - started)


def usage(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Retries (attempts that are no transforms, less one) and redirects (lengths of the chains)."""
    return attempts.groupBy(*by).agg(F.greatest(F.count_if(F.col("type") != "transform") - 1, F.lit(0)).alias("retries"), F.sum(F.size("redirect_chain")).cast("long").alias("redirects"))
