"""Routes and costs: capability registry, eligibility, health, and credit gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.values import is_fresh

BALANCE_AGE_MS = 5 * 60 * 1000
COMMANDS = ["url", "crawl", "extract", "search", "health"]
#: The default capability registry, in order of preference.
REGISTRY = [
    ("core", "ready", "runtime", False, ["health"], "local-zero", 0.0, "none"),
    ("native", "disabled", "phase_2_not_connected", True, ["url", "crawl", "extract"], "local-zero", 0.0, "core-http"),
    ("beautifulsoup", "missing", "optional_parser_not_probed", False, ["extract"], "local-zero", 0.0, "none"),
    ("playwright", "unavailable_security_gate", "hostile_egress_proof_missing:sandbox_platform_unsupported", True, ["url", "crawl", "extract"], "local-zero", 0.0, "guard-proxy"),
    ("crawl4ai", "unavailable_security_gate", "independent_security_proof_missing", True, ["url", "crawl", "extract"], "local-zero", 0.0, "guard-proxy"),
    ("browser-use", "disabled", "automatic_path_forbidden", False, ["url", "crawl", "extract"], "local-zero", 0.0, "guard-proxy"),
    ("firecrawl", "disabled", "free_cloud_not_allowed", True, ["url", "crawl", "extract", "search"], "free-credit", None, "provider-managed"),
    ("scrapegraphai", "disabled", "free_cloud_not_allowed", True, ["url", "extract", "search"], "free-credit", None, "provider-managed"),
]


def registry(spark: SparkSession) -> DataFrame:
    rows = [(k, *r) for k, r in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "ord int, id string, state string, reason string, automatic boolean, commands array<string>, cost string, price double, network_model string")


def cost_state(cost: Column, price: Column) -> Column:
    return F.when((cost == "local-zero") & (price == 0), "allowed_zero").otherwise("unknown_and_blocked")


def route_plan(jobs: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Candidates of every job (job_id, kind, forced_engine, allow_rendered, allow_cloud) with eligibility and the first
    reason against it. Capabilities are a handful of rows, so each job meets all of them in place."""
    rows = jobs.join(F.broadcast(capabilities), how="cross")
    chosen = F.when(F.col("forced_engine").isNull(), F.col("automatic") & F.array_contains("commands", F.col("kind"))).otherwise(F.col("id") == F.col("forced_engine"))
    state = cost_state(F.col("cost"), F.col("price"))
    why = (
        F.when(~F.array_contains("commands", F.col("kind")), "unsupported_command")
        .when(F.col("state") != "ready", F.col("reason"))
        .when(state != "allowed_zero", state)
        .when((F.col("network_model") == "guard-proxy") & ~F.col("allow_rendered"), "rendered_not_allowed")
        .when((F.col("network_model") == "provider-managed") & ~F.col("allow_cloud"), "free_cloud_not_allowed")
        .otherwise("eligible")
    )
    return rows.where(chosen).select("job_id", "ord", "id", "state", why.alias("reason"), state.alias("cost_state"), (why == "eligible").alias("eligible"))


def probed(capabilities: DataFrame, probes: DataFrame, order: list[str]) -> DataFrame:
    """Capabilities with the state and reason of their last probe (id, state, reason, ``order``); a probe without a state changes nothing."""
    last = probes.groupBy("id").agg(F.max_by(F.struct("state", "reason"), F.struct(*order)).alias("last"))
    rows = capabilities.join(last, "id", "left")
    told = F.col("last.state").isNotNull()
    return rows.withColumns({"state": F.when(told, F.col("last.state")).otherwise(F.col("state")), "reason": F.when(told, F.col("last.reason")).otherwise(F.col("reason"))}).drop("last")


def health(capabilities: DataFrame) -> DataFrame:
    return capabilities.select("id", "state", "reason", "automatic", F.array_join("commands", ",").alias("commands"), "cost", "network_model")


def credit_reason(now: Column) -> Column:
    """The first failing reason of a credit proof, over provider and ledger columns; cost_proven if none fails."""
    fresh = is_fresh(F.col("balance_observed_at"), now, BALANCE_AGE_MS) & F.col("balance").isNotNull() & is_fresh(F.col("ledger_observed_at"), now, BALANCE_AGE_MS) & F.col("ledger_balance").isNotNull()
    ceiling = F.least("hard_ceiling", "ledger_ceiling")
    available = F.col("ledger_balance") - F.coalesce("committed", F.lit(0.0))
    worst = F.col("worst_case_credits")
    return (
        F.when(~fresh, "balance_unknown_or_stale")
        .when(F.col("price").isNull() | (F.col("price") != 0), "price_unknown")
        .when(ceiling.isNull() | (ceiling <= 0), "no_hard_ceiling")
        .when(worst.isNull() | ~((worst > 0) & (worst <= ceiling) & (worst <= available)), "worst_case_unbounded")
        .when(F.col("free_credits").isNull() | (F.col("free_credits") < worst), "insufficient_free_credits")
        .when(~F.col("preflight_may_charge").eqNullSafe(False), "preflight_may_charge")
        .otherwise("cost_proven")
    )


def cloud_eligible(reason: Column) -> Column:
    """Cloud runs stay blocked, even where the cost is proven."""
    return F.lit(False) & reason.isNotNull()
