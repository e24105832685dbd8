"""Search candidates: strict responses, ordered distinct, ranks, scrape plans and shared budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RESULTS, MAX_TEXT = 100, 100_000


def invalid_responses(results: DataFrame, by: list[str]) -> DataFrame:
    """Runs whose provider response breaks the contract: no or too many results, missing or overlong texts."""
    texts = [F.col(c).isNull() | (F.length(c) > MAX_TEXT) for c in ("url", "title", "snippet")]
    bad = texts[0] | texts[1] | texts[2]
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad")).where(F.col("bad") | (F.col("n") > MAX_RESULTS))


def candidates(results: DataFrame, by: list[str], order: str, canonical: Column) -> DataFrame:
    """Results with ``canonical`` and ``state``: invalid without one, duplicate after the first of an equal one, else allowed."""
    rows = results.withColumn("canonical", canonical)
    nth = F.row_number().over(Window.partitionBy(*by, "canonical").orderBy(order))
    return rows.withColumn("state", F.when(F.col("canonical").isNull(), "invalid").when(nth > 1, "duplicate").otherwise("allowed"))


def ranked(rows: DataFrame, by: list[str], order: str, top: int) -> DataFrame:
    """The scrape plan: allowed candidates by rank, ``top`` of each run (ranked within partitions first)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.where("state = 'allowed'").withColumn("rank", rank).where(F.col("rank") <= top)


def warnings(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counters of rejected candidates as warnings."""
    n = {s: F.count_if(F.col("state") == s) for s in ("invalid", "duplicate")}
    texts = [F.when(n["invalid"] > 0, F.concat(F.lit("search_candidate_private_or_invalid:"), n["invalid"])), F.when(n["duplicate"] > 0, F.concat(F.lit("search_candidate_duplicate:"), n["duplicate"]))]
    return rows.groupBy(*by).agg(F.count_if(F.col("state") == "allowed").alias("allowed"), F.array_join(F.array_compact(F.array(*texts)), ",").alias("warnings"))


def within_deadline(plan: DataFrame, by: list[str], duration: str, deadline_ms: int) -> DataFrame:
    """Candidates that are begun before the shared deadline, one after another."""
    before = F.coalesce(F.sum(duration).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return plan.withColumn("started_ms", before).where(F.col("started_ms") < deadline_ms)


def with_children(plan: DataFrame, children: DataFrame, by: list[str]) -> DataFrame:
    """The plan beside its child results (by, url, status, source_hash); captured sources count as evidence."""
    rows = plan.join(children, [*by, "url"], "left")
    return rows.withColumn("evidence", F.when((F.col("status") == "ok") & F.col("source_hash").isNotNull(), "destination_source_captured"))
