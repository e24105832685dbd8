"""Jobs: command-line admission, limits, route plans and the capture pipelines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import formats, markdown, urls, values
from tracewell.operators import contracts, discovery, store, variants
from tracewell.operators.crawl import glob_regex

COMMANDS = {"url": 1, "crawl": 1, "extract": 1, "search": 1, "health": 0}
FORMATS = ["raw", "markdown", "text", "metadata", "links", "json"]
SOURCES = ["html", "sitemap", "rss", "atom", "api"]
#: Bytes of a representation at most.
MAX_ARTIFACT = 50 << 20


@dataclass(frozen=True)
class Limits:
    """Defaults of the command line."""

    max_pages: int = 100
    max_depth: int = 3
    wall_ms: int = 60_000
    per_attempt_ms: int = 15_000
    page_bytes: int = 5 << 20
    total_bytes: int = 50 << 20
    max_frontier: int = 1000
    concurrency: int = 2
    delay_ms: int = 250
    max_redirects: int = 5
    retries: int = 1
    max_retry_after_ms: int = 30_000


@dataclass(frozen=True)
class JobSpec:
    kind: str
    target: str | None = None
    goal: str = "markdown"
    limits: Limits = field(default_factory=Limits)
    include: tuple[str, ...] = ("/**",)
    exclude: tuple[str, ...] = ()
    discover: tuple[str, ...] = ()
    schema: str | None = None
    engine: str | None = None
    explain: bool = False
    as_json: bool = False
    allow_rendered: bool = False
    allow_cloud: bool = False
    cache_mode: str = "use"
    ttl_ms: int = 3_600_000
    search_limit: int = 10
    scrape_results: int = 0
    data_root: str | None = None
    output: str | None = None


class InputError(ValueError):
    """A command line that is refused (exit code 2)."""


#: Option -> (field, converter); flags take no value.
NUMBERS = {"--max-pages": "max_pages", "--max-depth": "max_depth", "--max-time": "wall_ms", "--max-bytes": "total_bytes", "--max-frontier": "max_frontier", "--concurrency": "concurrency", "--delay": "delay_ms", "--max-redirects": "max_redirects", "--retries": "retries"}
FROM_ZERO = {"--max-depth", "--delay", "--max-redirects", "--retries"}
FLAGS = {"--json": "as_json", "--explain": "explain", "--allow-rendered": "allow_rendered", "--allow-free-cloud": "allow_cloud"}
TEXTS = {"--engine": "engine", "--schema": "schema", "--format": "goal", "--output": "output", "--data-root": "data_root"}


def duration_ms(text: str) -> int:
    m = re.fullmatch(r"([1-9]\d*)(ms|s|m|h|d)", text)
    if not m:
        raise InputError(f"duration {text!r}")
    return int(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[m[2]]


def parse_argv(argv: list[str]) -> JobSpec:
    """A command line as a job; anything unknown, doubled or out of range is refused."""
    words, spec, limits, seen = [], {}, {}, set()
    it = iter(argv)

    def value(option: str) -> str:
        v = next(it, None)
        if v is None or v.startswith("--"):
            raise InputError(f"{option} needs a value")
        return v

    for a in it:
        if not a.startswith("--"):
            words.append(a)
            continue
        if a in seen and a not in ("--include", "--exclude"):
            raise InputError(f"{a} twice")
        seen.add(a)
        if a in FLAGS:
            spec[FLAGS[a]] = True
        elif a in TEXTS:
            spec[TEXTS[a]] = value(a)
        elif a in ("--include", "--exclude"):
            glob = value(a)
            try:
                glob_regex(glob)
            except ValueError as e:
                raise InputError(str(e)) from None
            spec[a[2:]] = (*spec.get(a[2:], ()), glob)
        elif a in NUMBERS or a in ("--limit", "--scrape-results"):
            text = value(a)
            if not re.fullmatch(r"\d+", text) or int(text) < (0 if a in FROM_ZERO or a == "--scrape-results" else 1):
                raise InputError(f"{a} {text}")
            if a in NUMBERS:
                limits[NUMBERS[a]] = int(text) * (1000 if a == "--max-time" else 1)
            else:
                spec["search_limit" if a == "--limit" else "scrape_results"] = int(text)
        elif a == "--discover":
            names = value(a).split(",")
            if not set(names) <= set(SOURCES):
                raise InputError(f"--discover {names}")
            spec["discover"] = tuple(sorted(set(names)))
        elif a == "--cache":
            spec["cache_mode"] = value(a)
        elif a == "--ttl":
            spec["ttl_ms"] = duration_ms(value(a))
        elif a == "--prefer-discovered-source":
            pass  # accepted and without effect
        else:
            raise InputError(f"unknown option {a}")
    if not words or words[0] not in COMMANDS or len(words) != 1 + COMMANDS[words[0]]:
        raise InputError("command and target")
    if spec.get("goal", "markdown") not in FORMATS or spec.get("cache_mode", "use") not in ("off", "use", "refresh"):
        raise InputError("format or cache mode")
    if (words[0] == "extract") != ("schema" in spec):
        raise InputError("--schema goes with extract")
    return replace(JobSpec(words[0], words[1] if len(words) > 1 else None, limits=Limits(**limits)), **spec)


def with_defaults(limits: DataFrame, defaults: Limits = Limits()) -> DataFrame:
    """Limit columns with missing values filled in; unset columns are added."""
    return limits.withColumns({k: F.coalesce(F.col(k) if k in limits.columns else F.lit(None).cast("long"), F.lit(v)).cast("long") for k, v in vars(defaults).items()})


def attempt_budget(per_attempt: Column, deadline: Column, now: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(per_attempt, deadline - now))


def capture_audit(pages: DataFrame) -> DataFrame:
    """The flagship: pages as captured, judged and hashed, summed up by origin. One scan, native, one partial aggregation."""
    html = F.col("html")
    parts = urls.plain_parts(F.col("url"))
    text = formats.html_text(html)
    rows = pages.select(
        parts["origin"].alias("origin"),
        formats.detected_kind(F.lit(None).cast("string"), formats.sniffed_kind(html)).alias("kind"),
        F.length(text).cast("long").alias("text_length"),
        formats.script_count(html).alias("scripts"),
        F.size(F.array_distinct(formats.anchor_hrefs(html))).cast("long").alias("links"),
        F.octet_length(html).cast("long").alias("bytes"),
        text.alias("text"),
        values.digest(html).alias("hash"),
        (formats.html_title(html) != "").alias("titled"),
    )
    kind, code = contracts.accept(F.lit("markdown"), F.col("text"), F.col("scripts"), F.col("kind"), F.lit(True), F.lit(True), F.col("bytes"))
    rows = rows.withColumn("accepted", kind == "success")
    return rows.groupBy("origin").agg(
        F.count("*").alias("pages"), F.count_if("accepted").alias("accepted"), F.count_if("titled").alias("titled"), F.sum("bytes").alias("bytes"),
        F.sum("text_length").alias("text_length"), F.sum("links").alias("links"), F.sum("scripts").alias("scripts"), F.min("hash").alias("first_hash"),
    )


def crawl_site(pages: DataFrame, order: str = "page_id", sources: tuple[str, ...] = ()) -> DataFrame:
    """Captured pages (url, html) as what a crawl sees: url (canonical), links of its own origin, kind, code, bytes.

    Links come first, then the alternates whose kind is among the ``sources`` to be discovered. Pages whose URL is not admitted go. Of several captures of one URL the last one by ``order`` stands.
    """
    html = F.col("html")
    detected = formats.detected_kind(F.lit(None).cast("string"), formats.sniffed_kind(html))
    # What is fenced as it stands (XML, JSON) is its own text.
    text = F.when(detected.isin("html", "binary"), formats.html_text(html)).otherwise(html)
    kind, code = contracts.accept(F.lit("markdown"), text, formats.script_count(html), detected, F.lit(True), F.lit(True), F.octet_length(html))
    plain = F.when(urls.is_plain(F.col("url")) & urls.policy_reject(F.col("url")).isNull(), F.regexp_replace("url", "#.*$", ""))
    rows = pages.select(F.coalesce(plain, urls.admit_url("url")["canonical_url"]).alias("url"), markdown.markup_links(html, F.col("url")).alias("links"), kind.alias("kind"), code.alias("code"), F.octet_length(html).cast("long").alias("bytes"), F.col(order).alias("at"), *([discovery.alternates(html, sources).alias("alternates")] if sources else []))
    rows = rows.where("url is not null")
    origin = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/"))
    if sources:
        rows = rows.withColumn("links", F.concat("links", F.array_compact(urls.resolve_each("alternates", "url"))))
    rows = rows.withColumn("own", origin).withColumn("links", F.expr("filter(links, l -> startswith(l, own))"))
    return rows.groupBy("url").agg(F.max_by(F.struct("links", "kind", "code", "bytes"), "at").alias("page")).select("url", "page.*")


def crawl_limits(limits: Limits) -> dict[str, int]:
    """The limits of a job under the names that a crawl knows."""
    return {"pages": limits.max_pages, "depth": limits.max_depth, "frontier": limits.max_frontier, "bytes": limits.total_bytes, "wall_ms": limits.wall_ms, "delay_ms": limits.delay_ms, "concurrency": limits.concurrency, "retries": limits.retries, "redirects": limits.max_redirects}


def cache_hits(requests: DataFrame, cache: DataFrame, manifests: DataFrame, artifacts: DataFrame, now: Column) -> DataFrame:
    """Requests (request_id, fingerprint, mode) that a whole, fresh record answers, with the record's columns."""
    rows = store.cache_lookup(requests, store.valid_cache(cache, manifests, artifacts), now)
    return rows.where("cache_status = 'hit'")


def finish_hits(hits: DataFrame, run: Column, served_at: Column) -> tuple[DataFrame, DataFrame]:
    """What hits leave: a manifest of a new run each, which only looked, and the cache record bound to that run. Source,
    artifact and expiry are the record's own: a hit does not make it live longer."""
    attempt = F.struct(F.lit("cache_hit").alias("type"), served_at.alias("at"), "source_hash")
    manifest = hits.select(run.alias("run_id"), "fingerprint", F.lit("ok").alias("status"), F.lit("hit").alias("cache_status"), "source_hash", "artifact_hash", "fetched_at", served_at.alias("served_at"), F.array(attempt).alias("attempts"))
    record = hits.select("fingerprint", run.alias("run_id"), "source_hash", "artifact_hash", "fetched_at", "expires_at")
    return manifest, record


def child_jobs(plan: DataFrame, run: Column, url: Column) -> DataFrame:
    """Scrape jobs of a search's plan: the search's limits, nothing of its scope, discovery or engine; markdown from a fresh cache."""
    cache = F.struct(F.lit("use").alias("mode"), F.lit(3_600_000).alias("ttl_ms"))
    scope = F.struct(F.array(F.lit("/**")).alias("include"), F.array().cast("array<string>").alias("exclude"))
    return plan.withColumns({"run_id": run, "job": F.struct(F.lit(1).alias("schema_version"), F.lit("url").alias("kind"), url.alias("url"), F.lit("markdown").alias("goal"), scope.alias("scope"), cache.alias("cache"))})


def discovered(canonical: Column, alternates: Column) -> Column:
    """Candidates (type, url) of a page: its canonical URL before its alternates, each once. Ones without type or URL go."""
    own = F.when(canonical.isNotNull() & (canonical != ""), F.array(F.struct(F.lit("canonical").alias("type"), canonical.alias("url"))))
    listed = F.transform(F.filter(alternates, lambda a: a["type"].isNotNull() & a["url"].isNotNull()), lambda a: F.struct(a["type"].alias("type"), a["url"].alias("url")))
    empty = F.array().cast("array<struct<type:string,url:string>>")
    return F.array_distinct(F.concat(F.coalesce(own, empty), F.coalesce(listed, empty)))


def candidates_of(*lists: Column) -> Column:
    """Candidate lists one after another; lists that are not there count as empty."""
    return F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])


def warnings_of(*lists: Column) -> Column:
    """Warnings of several steps, each once, in order."""
    return F.array_distinct(candidates_of(*lists))


def same_keys(value: Column, keys: list[str]) -> Column:
    """Whether a map has exactly these keys."""
    wanted = F.array(*map(F.lit, keys))
    return (F.size(F.array_except(F.map_keys(value), wanted)) == 0) & (F.size(F.array_except(wanted, F.map_keys(value))) == 0)


def extract_job(pages: DataFrame, schema: dict, html: str = "html") -> DataFrame:
    """Fields of a schema from every page, with the run's status: ok, or exhausted with what is missing."""
    from tracewell.functions.markup import extract_schema

    rows = pages.withColumn("out", extract_schema(F.col(html), schema))
    return rows.select("*", "out.data", "out.missing").drop("out").withColumn("status", F.when(F.size("missing") > 0, "exhausted").otherwise("ok"))


XML_KINDS = ["xml", "rss", "atom", "sitemap"]


def links_by_kind(pages: DataFrame) -> DataFrame:
    """Pages (url, html, kind) with ``links``: sorted admitted URLs of markup, markdown or JSON; other kinds have none."""
    html, url, kind = F.col("html"), F.col("url"), F.col("kind")
    found = F.when(kind.isin("html", *XML_KINDS), markdown.markup_candidates(html)).when(kind == "markdown", formats.markdown_links(html))
    in_json = variants.json_links(pages.where(kind == "json").select("url", "html").distinct(), ["url", "html"], F.col("html"))
    in_json = in_json.groupBy("url", "html").agg(F.collect_list("link").alias("__json"))
    rows = pages.join(in_json, ["url", "html"], "left").withColumn("__found", F.coalesce(found, F.when(kind == "json", F.col("__json")), F.array().cast("array<string>")))
    return rows.withColumn("links", urls.resolve_all("__found", "url")).select(*pages.columns, "links")


def derive(pages: DataFrame, goal: str, max_bytes: int = MAX_ARTIFACT) -> DataFrame:
    """Pages (url, html, kind) in a representation: raw, markdown, metadata, links or json.

    ``outcome`` is ``ok``, or ``hard_limit`` where the artifact is larger than ``max_bytes``, which it then is not given,
    or ``output_failure`` where there is none (a text that is no JSON).
    """
    from tracewell.functions import markup

    html, url, kind = F.col("html"), F.col("url"), F.col("kind")
    if goal == "raw":
        rows, out = pages, html
    elif goal == "metadata":
        rows, out = pages, F.to_json(F.struct(F.octet_length(html).alias("bytes"), url.alias("final_url"), F.lit("text/html").alias("media_type")))
    elif goal == "links":
        rows, out = links_by_kind(pages), F.to_json("links")
    elif goal == "json":
        rows, out = pages, markup.stable(html)
    else:
        fence = F.when(kind == "json", formats.fenced(html, "json")).when(kind.isin(XML_KINDS), formats.fenced(html, "xml"))
        rows, out = pages, F.when(kind == "html", markdown.markdown(html, url)).otherwise(F.coalesce(fence, html))
    rows = rows.withColumn("artifact", out).select(*pages.columns, "artifact")
    outcome = F.when(F.col("artifact").isNull(), "output_failure").when(F.octet_length("artifact") > max_bytes, "hard_limit").otherwise("ok")
    rows = rows.withColumn("outcome", outcome).withColumn("artifact", F.when(F.col("outcome") == "ok", F.col("artifact")))
    return rows.withColumn("artifact_hash", values.digest(F.col("artifact")))
