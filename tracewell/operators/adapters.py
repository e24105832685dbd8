"""Acquisition adapters as a table function: each job's candidates in order, under one contract for outcomes.

An adapter is a function from a request to an outcome, a dictionary with a text ``kind`` and a text ``code``. Spark deals
the candidates out by job and hands them over in order; a job's attempts end with the first outcome that ends it. An
adapter that throws gives ``broken, adapter_crash``, and one that answers anything else, or is not there,
``broken, adapter_protocol_error``; either ends its job and no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

OUTCOME = "job_id string, attempt int, adapter string, url string, kind string, code string, detail string"
CRASH, PROTOCOL = ("broken", "adapter_crash"), ("broken", "adapter_protocol_error")


def checked(outcome: object) -> tuple[str, str, str | None]:
    """Kind, code and detail of what an adapter answered."""
    if isinstance(outcome, dict) and isinstance(outcome.get("kind"), str) and isinstance(outcome.get("code"), str):
        detail = outcome.get("detail")
        return outcome["kind"], outcome["code"], detail if isinstance(detail, str) else None
    return (*PROTOCOL, None)


def goes_on(kind: str, code: str) -> bool:
    """Whether the next candidate is asked after an outcome."""
    return kind in ("skip", "inadequate") or kind == "retryable" and code != "rate_limited"


def register(spark: SparkSession, name: str, adapters: dict[str, Callable[[dict], object]]) -> None:
    """Make the adapters a table function ``name`` of a table (job_id, ord, adapter, url), partitioned by job."""

    class Acquire:
        def __init__(self) -> None:
            self.attempt, self.ended = 0, False

        def eval(self, row: Row) -> Iterator[tuple]:
            if self.ended:
                return
            self.attempt += 1
            run, detail = adapters.get(row["adapter"]), None
            try:
                kind, code, detail = checked(run({"job_id": row["job_id"], "url": row["url"], "attempt": self.attempt})) if run else (*PROTOCOL, None)
            except Exception as e:  # noqa: BLE001
                (kind, code), detail = CRASH, type(e).__name__
            self.ended = not goes_on(kind, code)
            yield row["job_id"], self.attempt, row["adapter"], row["url"], kind, code, detail

    spark.udtf.register(name, udtf(Acquire, returnType=OUTCOME))


def attempts(candidates: DataFrame, name: str) -> DataFrame:
    """Attempts (job_id, attempt, adapter, url, kind, code, detail) of candidates (job_id, ord, adapter, url).

    Jobs are told apart by their id; a null id is one job. Candidates of equal ``ord`` stand in the order of adapter and URL.
    """
    rows = candidates.selectExpr("cast(job_id as string) as job_id", "ord", "adapter", "url")
    return candidates.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{rows}}) PARTITION BY job_id ORDER BY (ord, adapter, url))", rows=rows)
