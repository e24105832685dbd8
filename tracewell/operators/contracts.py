"""Vocabularies and outcome tables: HTTP statuses, error codes, acceptance, transitions, run statuses, exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Run statuses and the exit code of each (an interrupted run's depends on its end).
EXIT_CODES = {"ok": 0, "invalid_input": 2, "partial": 3, "exhausted": 4, "blocked": 5, "internal_error": 70, "output_failure": 74}
INTERRUPTED_EXITS = {"timeout": 124, "SIGINT": 130, "SIGTERM": 143}
#: The codes that a run status allows.
ALLOWED_CODES = {
    "ok": ["ok", "health", "route_explained"],
    "invalid_input": ["invalid_input"],
    "partial": ["partial"],
    "exhausted": ["exhausted", "no_eligible_engine", "unavailable_no_free_search_provider", "not_found", "gone"],
    "blocked": ["blocked", "policy_denied", "robots_denied", "access_denied", "auth_required", "captcha", "paywall", "paid_required", "hard_limit", "rate_limited"],
    "internal_error": ["internal_error", "unknown_attempt_code", "adapter_crash", "adapter_protocol_error", "hash_mismatch"],
    "output_failure": ["output_failure"],
    "interrupted": ["interrupted", "timeout"],
}
#: HTTP statuses with an outcome of their own.
STATUS_OUTCOMES = {401: ("terminal", "auth_required"), 402: ("terminal", "paid_required"), 403: ("terminal", "access_denied"), 404: ("terminal", "not_found"), 410: ("terminal", "gone"), 429: ("retryable", "rate_limited")}
TRANSIENT = [408, 425, 500, 502, 503, 504]
#: The kind that goes with an attempt code, and what follows it.
CODE_KINDS = {
    "success": ["ok"],
    "skip": ["unavailable", "unsupported", "cloud_disabled", "policy_unenforceable"],
    "retryable": ["timeout", "network", "http_5xx", "rate_limited"],
    "inadequate": ["js_shell", "empty", "wrong_mime", "parse_failed"],
    "terminal": ["policy_denied", "robots_denied", "access_denied", "auth_required", "captcha", "paywall", "paid_required", "hard_limit", "not_found", "gone"],
    "broken": ["adapter_crash", "adapter_protocol_error", "hash_mismatch"],
}
GOALS = ["raw", "markdown", "text", "metadata", "links", "json"]
#: Error codes of the network layer.
POLICY_ERRORS = ["invalid_intent", "invalid_url", "ambiguous_url", "scheme_denied", "userinfo_denied", "special_hostname", "non_public_ip", "dns_non_public", "peer_mismatch", "invalid_redirect", "redirect_downgrade", "redirect_loop"]
NETWORK_ERRORS = ["request_failed", "dns_resolution_failed", "connect_failed"]


def status_outcome(status: Column) -> tuple[Column, Column]:
    """Kind and code of an HTTP status; 2xx and 304 succeed."""
    ok = status.between(200, 299) | (status == 304)
    kind, code = F.when(ok, "success"), F.when(ok, "ok")
    for s, (k, c) in STATUS_OUTCOMES.items():
        kind, code = kind.when(status == s, k), code.when(status == s, c)
    transient = status.isin(TRANSIENT)
    return kind.when(transient, "retryable").otherwise("terminal"), code.when(transient, "http_5xx").otherwise("access_denied")


def error_outcome(error: Column) -> tuple[Column, Column]:
    """Kind and code of an error raised while fetching."""
    policy, network = error.isin(POLICY_ERRORS), error.isin(NETWORK_ERRORS)
    kind = F.when(error.isin("aborted"), "retryable").when(policy | error.isin("body_limit", "redirect_limit"), "terminal").when(network, "retryable").otherwise("broken")
    code = F.when(error.isin("aborted"), "timeout").when(error.isin("body_limit", "redirect_limit"), "hard_limit").when(policy, "policy_denied").when(network, "network").otherwise("adapter_protocol_error")
    return kind, code


def accept(goal: Column, text: Column, scripts: Column, kind: Column, has_links: Column, has_metadata: Column, n_bytes: Column, missing: Column | None = None) -> tuple[Column, Column]:
    """Kind and code of a representation for a goal; the first rule that applies."""
    nothing = F.coalesce(F.trim(text), F.lit("")) == ""
    code = F.when(kind.isNull(), "parse_failed")
    if missing is not None:
        code = code.when(F.size(missing) > 0, "parse_failed")
    code = (
        code.when(goal.isin("markdown", "text") & nothing & (scripts > 0), "js_shell")
        .when(goal.isin("markdown", "text") & nothing, "empty")
        .when((goal == "json") & ~kind.isin("json", "jsonld", "schema"), "wrong_mime")
        .when((goal == "links") & ~has_links, "wrong_mime")
        .when((goal == "metadata") & ~has_metadata, "wrong_mime")
        .when((goal == "raw") & ~(n_bytes > 0), "empty")
        .when(~goal.isin(GOALS), "wrong_mime")
        .otherwise("ok")
    )
    return F.when(code == "ok", "success").otherwise("inadequate"), code


def code_kind(code: Column) -> Column:
    out = F
    for kind, codes in CODE_KINDS.items():
        out = out.when(code.isin(codes), kind)
    return out


def transition(kind: Column, code: Column, retries_left: Column, has_next: Column) -> dict[str, Column]:
    """What follows an attempt: action, status and code."""
    fits = code_kind(code).eqNullSafe(kind)
    onward = F.when(has_next, "next").otherwise("stop")
    retry = (code_kind(code) == "retryable") & (retries_left > 0)
    limited, gone = code == "rate_limited", code.isin("not_found", "gone")
    moves = kind.isin("skip", "inadequate") | (kind == "retryable") & ~limited
    action = F.when(~fits, "stop").when(retry, "retry_same").when(moves, onward).otherwise("stop")
    status = (
        F.when(~fits, "internal_error").when(action != "stop", None).when(kind == "success", "ok")
        .when(moves | gone, "exhausted").when(limited | (kind == "terminal"), "blocked").otherwise("internal_error")
    )
    out = F.when(~fits, "unknown_attempt_code").when(action != "stop", code).when(moves, "exhausted").otherwise(code)
    return {"action": action, "status": status, "out_code": out}


def run_status(kind: Column, code: Column) -> Column:
    return F.when(kind == "success", "ok").when((kind == "terminal") & code.isin("not_found", "gone"), "exhausted").when(kind == "terminal", "blocked").when(kind == "broken", "internal_error").otherwise("exhausted")


def exit_code(status: Column, termination: Column) -> Column:
    """Exit code of a run; null for an interrupted one without a known end."""
    out = F
    for s, c in EXIT_CODES.items():
        out = out.when(status == s, c)
    for t, c in INTERRUPTED_EXITS.items():
        out = out.when((status == "interrupted") & (termination == t), c)
    return out


def terminal_class(code: Column, exhausted: Column) -> Column:
    """Run status that a code ends a run with; null if it does not end it."""
    blocked = ["policy_denied", "robots_denied", "access_denied", "auth_required", "captcha", "paywall", "paid_required", "hard_limit"]
    return F.when(code.isin(blocked), "blocked").when(code.isin("not_found", "gone"), "exhausted").when((code == "rate_limited") & exhausted, "blocked")


def allowed_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, c) for s, codes in ALLOWED_CODES.items() for c in codes], "status string, code string")


def invalid_envelopes(envelopes: DataFrame) -> DataFrame:
    """Envelopes whose code their status does not allow, or whose fields break the contract."""
    bad = ~F.col("schema_version").eqNullSafe(1) | F.col("command").isNull() | F.col("message").isNull() | F.col("source_hash").isNotNull() & ~F.col("source_hash").rlike("^sha256:[a-f0-9]{64}$") | F.col("cache_status").isNotNull() & ~F.col("cache_status").isin("off", "miss", "hit", "revalidated")
    wrong = envelopes.join(F.broadcast(allowed_codes(envelopes.sparkSession)), ["status", "code"], "left_anti")
    return wrong.unionByName(envelopes.where(bad)).distinct()


def rendered_skip(allowed: Column, kind: Column, code: Column, eligible: Column) -> Column:
    """Whether a rendered fallback is skipped with a record."""
    return allowed & (kind == "inadequate") & code.isin("js_shell", "empty", "parse_failed") & (eligible == F.lit(False))
