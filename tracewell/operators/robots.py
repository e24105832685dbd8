"""robots.txt: parsing to rule tables, and decisions as an argmax over matching patterns."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.urls import UrlError, parse, sitemap_url

MAX_BODY, MAX_LINE, MAX_RULES, MAX_AGENT = 512 * 1024, 16 * 1024, 10_000, 128
UNRESERVED = re.compile(r"[A-Za-z0-9._~-]")


def percent_normal(text: str) -> str:
    """Escapes of unreserved characters decoded, others in upper case, non-ASCII encoded."""

    def escape(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if UNRESERVED.fullmatch(c) else f"%{m[1].upper()}"

    text = re.sub(r"%([0-9A-Fa-f]{2})", escape, text)
    return "".join(c if c < "\x80" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def rule_regex(pattern: str) -> tuple[str, int]:
    """Java regular expression of a rule, and its specificity: bytes without stars and the end anchor."""
    anchored = pattern.endswith("$")
    text = percent_normal(pattern[:-1] if anchored else pattern)
    body = ".*".join(re.sub(r"([\\^$.*+?()\[\]{}|])", r"\\\1", p) for p in re.split(r"\*+", text))
    return f"^{body}" + ("$" if anchored else ""), len(text.replace("*", "").encode())


def target_path(url: str) -> str | None:
    """Percent-normal path and query of a URL or path."""
    try:
        u = parse(f"https://robots.invalid{url}" if url.startswith("/") else url)
    except UrlError:
        return None
    return percent_normal(u.path + ("" if not u.query else f"?{u.query}"))


def parse_robots(body: bytes | None, agent: str) -> dict:
    """Rules, delay and sitemaps of a file for one user agent; ``failed`` where the file is refused."""
    refused = {"failed": True, "rules": [], "delay_ms": None, "sitemaps": []}
    if body is None or len(body) > MAX_BODY or b"\0" in body:
        return refused
    try:
        text = body.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return refused
    groups: list[dict] = []
    sitemaps: dict[str, None] = {}
    open_agents, n_rules = False, 0
    for raw in re.split(r"\r\n|\n", text):
        if len(raw.encode()) > MAX_LINE:
            return refused
        line = raw.split("#", 1)[0]
        name, colon, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            if (u := sitemap_url(value)) is not None:
                sitemaps[u] = None
        elif name == "user-agent":
            if re.fullmatch(rf"[\x21-\x7e]{{1,{MAX_AGENT}}}", value):
                if not open_agents:
                    groups.append({"agents": [], "rules": [], "delays": []})
                    open_agents = True
                groups[-1]["agents"].append(value.lower())
        elif groups and name in ("allow", "disallow", "crawl-delay"):
            open_agents = False
            if name == "crawl-delay":
                if re.fullmatch(r"\d+(?:\.\d+)?", value) and float(value) <= 86400:
                    groups[-1]["delays"].append(math.ceil(float(value) * 1000))
            elif value:
                n_rules += 1
                if n_rules > MAX_RULES:
                    return refused
                regex, specificity = rule_regex(value)
                groups[-1]["rules"].append({"allow": name == "allow", "pattern": value, "regex": regex, "specificity": specificity})
    token = re.split(r"[ /]", agent.lower(), maxsplit=1)[0]
    score = [max([len(a) for a in g["agents"] if a != "*" and a in token], default=0) for g in groups]
    best = max(score, default=0)
    chosen = [g for g, s in zip(groups, score, strict=True) if s == best] if best else [g for g in groups if "*" in g["agents"]]
    delays = [d for g in chosen for d in g["delays"]]
    return {"failed": False, "rules": [r for g in chosen for r in g["rules"]], "delay_ms": max(delays, default=None), "sitemaps": list(sitemaps)}


RULE = T.StructType([T.StructField("allow", T.BooleanType()), T.StructField("pattern", T.StringType()), T.StructField("regex", T.StringType()), T.StructField("specificity", T.IntegerType())])
PARSED = T.StructType([T.StructField("failed", T.BooleanType()), T.StructField("rules", T.ArrayType(RULE)), T.StructField("delay_ms", T.LongType()), T.StructField("sitemaps", T.ArrayType(T.StringType()))])


def parsed(files: DataFrame, agent: str) -> DataFrame:
    """(origin, status, body) to one row an origin: policy (rules, allow_all, deny_all) and what was parsed."""

    @F.udf(PARSED, useArrow=True)
    def run(body: bytes):  # noqa: ANN202
        return parse_robots(body, agent)

    s = F.col("status")
    policy = F.when(s.between(200, 299), "rules").when(s.isin(401, 403, 429) | s.isNull(), "deny_all").when(s.between(400, 499), "allow_all").otherwise("deny_all")
    rows = files.withColumn("policy", policy).withColumn("parsed", F.when(F.col("policy") == "rules", run("body")))
    return rows.select("origin", F.when(F.col("parsed.failed"), "deny_all").otherwise(F.col("policy")).alias("policy"), "parsed.rules", "parsed.delay_ms", "parsed.sitemaps")


def rules_table(robots: DataFrame) -> DataFrame:
    return robots.select("origin", F.posexplode("rules").alias("rule_no", "rule")).select("origin", "rule_no", "rule.*")


@F.pandas_udf(T.StringType())
def path_of(url: pd.Series) -> pd.Series:
    return url.map(target_path)


def decide(paths: DataFrame, rules: DataFrame, key: str, on: list[str] | None = None) -> DataFrame:
    """The winning rule of every path: the most specific match, allow before deny, the first of equals; none allows.

    ``paths`` holds ``key``, ``path`` and the columns ``on``; ``rules`` regex, specificity, allow, rule_no and ``on``.
    The rules of a file (MAX_RULES at most) become one array with the winner first, so every path meets one row and
    nothing is multiplied or grouped; a rule's literal start is looked at before its expression. A rule table without
    ``on`` is one file's and so is broadcast.
    """
    rule = F.struct("specificity", F.col("allow").cast("int").alias("allow"), (-F.col("rule_no")).alias("place"), anchored_prefix(F.col("pattern")).alias("start"), "regex", "pattern")
    ordered = F.sort_array(F.collect_list(rule), asc=False).alias("rules")
    files = rules.groupBy(*on).agg(ordered) if on else rules.agg(ordered)
    joined = paths.join(files, on, "left") if on else paths.join(F.broadcast(files), how="cross")
    hit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]) & F.regexp_like(F.col("path"), r["regex"])), 0)
    best = joined.withColumn("rule", hit)
    return best.select(key, *(on or []), F.coalesce(F.col("rule.allow") == 1, F.lit(True)).alias("allowed"), F.col("rule.pattern").alias("pattern"), F.col("rule.specificity").alias("specificity"))


def anchored_prefix(pattern: Column) -> Column:
    """The literal part before a pattern's first star or end anchor, or nothing where it is not plain: what a path must start with."""
    start = F.regexp_extract(pattern, r"^[^*$%]*", 0)
    return F.when(start.rlike(r"^[\x21-\x7e]*$"), start).otherwise("")


def gate(urls: DataFrame, robots: DataFrame, sitemaps: bool = False) -> DataFrame:
    """(url, robots, delay_ms, and on request the file's sitemaps) for URLs: what each one's origin says in ``robots`` (of parsed()); an origin without a
    file allows everything, as one whose file is not found."""
    rows = urls.select("url", F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("origin"), path_of("url").alias("path"))
    policies = robots.select("origin", "policy", "delay_ms", *(["sitemaps"] if sitemaps else []))
    decided = decide(rows, rules_table(robots.where("policy = 'rules'")), "url", ["origin"])
    out = decided.join(policies, "origin", "left")
    allowed = F.when(F.col("policy") == "deny_all", False).when(F.col("policy") == "rules", F.col("allowed")).otherwise(True)
    return out.select("url", allowed.alias("robots"), F.coalesce("delay_ms", F.lit(0)).alias("delay_ms"), *(["sitemaps"] if sitemaps else []))
