"""Contracts, robots, crawls, retries, stores, searches and the command line."""

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.operators import contracts, crawl, redirects, retry, robots, search, store
from tracewell.plans import cli, jobs
from tracewell.sources import capture


def test_robots_file():
    body = b"\xef\xbb\xbfUser-agent: *\nAllow: /private/public\nDisallow: /private # c\nDisallow:\nDisallow: /*.pdf$\nCrawl-delay: 0.1\nSitemap: https://a.com/s.xml#x\n\nUser-agent: spec\nUser-agent: other\nDisallow: /\nCrawl-delay: 2\n"
    out = robots.parse_robots(body, "bot/1.0")
    assert [r["pattern"] for r in out["rules"]] == ["/private/public", "/private", "/*.pdf$"] and out["delay_ms"] == 100 and out["sitemaps"] == ["https://a.com/s.xml"]
    assert robots.parse_robots(body, "Special/2 x")["delay_ms"] == 2000
    assert robots.parse_robots(b"\xff", "bot")["failed"] and robots.parse_robots(b"a\0", "bot")["failed"] and robots.parse_robots(b"x" * 20_000, "bot")["failed"]
    assert robots.percent_normal("/%7ea%2fé") == "/~a%2F%C3%A9" and robots.rule_regex("/a**b$") == ("^/a.*b$", 3)


def test_robots_decisions(spark):
    files = spark.createDataFrame([("o1", 200, bytearray(b"User-agent: *\nDisallow: /a\nAllow: /a\nDisallow: /a/b\n")), ("o2", 404, None), ("o3", 503, None)], "origin string, status int, body binary")
    parsed = robots.parsed(files, "bot")
    assert {r["origin"]: r["policy"] for r in parsed.collect()} == {"o1": "rules", "o2": "allow_all", "o3": "deny_all"}
    paths = spark.createDataFrame([("o1", "/a"), ("o1", "/a/b/c"), ("o1", "/z")], "origin string, path string")
    got = {r["path"]: (r["allowed"], r["pattern"]) for r in robots.decide(paths, robots.rules_table(parsed), "path", ["origin"]).collect()}
    assert got == {"/a": (True, "/a"), "/a/b/c": (False, "/a/b"), "/z": (True, None)}


def test_globs():
    import re

    assert re.match(crawl.glob_regex("/a/*/c"), "/a/b/c") and not re.match(crawl.glob_regex("/a/*/c"), "/a/b/x/c") and re.match(crawl.glob_regex("/a/**"), "/a/b/c")
    for bad in ("a", "/a/../b", "/a***", "/a?b", ""):
        with pytest.raises(ValueError):
            crawl.glob_regex(bad)


def test_traversal_of_a_cycle(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src int, dst int")
    assert {r["url"]: r["depth"] for r in crawl.bfs(edges, spark.createDataFrame([(0,)], "url int"), 3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    order = crawl.discovery_order(edges, crawl.bfs(edges, spark.createDataFrame([(0,)], "url int"), 3))
    assert {r["url"]: r["parent"] for r in order.collect()} == {1: 0, 2: 1, 3: 2}


LIMITS = {"pages": 100, "depth": 3, "frontier": 10, "bytes": 10_000, "wall_ms": 60_000, "delay_ms": 250, "concurrency": 1, "retries": 1, "redirects": 5}


def site(**links):
    return {u: {"links": list(to), "robots": True, "kind": "success", "code": "ok", "bytes": 10, "delay_ms": 0, "retries": 0, "redirects": 0} for u, to in links.items()}


def states(rows):
    return [(r["state"], r["url"], r["reason"]) for r in rows]


def test_exact_crawl():
    pages = site(s="ab", a="bs", b="c", c="")
    rows, out = crawl.simulate("s", pages, LIMITS)
    assert states(rows) == [("accepted", "s", None), ("accepted", "a", None), ("skipped", "b", "duplicate"), ("skipped", "s", "duplicate"), ("accepted", "b", None), ("accepted", "c", None)] and out["status"] == "ok"
    rows, out = crawl.simulate("s", pages, LIMITS | {"pages": 2})
    assert states(rows)[-1] == ("unvisited", "b", "max_pages") and (out["status"], out["limit"]) == ("partial", "max_pages")
    rows, out = crawl.simulate("s", pages, LIMITS | {"bytes": 15})
    assert ("blocked", "a", "hard_limit") in states(rows) and ("unvisited", "b", "max_bytes") in states(rows)
    rows, out = crawl.simulate("s", pages, LIMITS | {"depth": 1})
    assert ("unvisited", "c", "max_depth") in states(rows) and out["limit"] == "max_depth"
    rows, out = crawl.simulate("s", pages, LIMITS | {"frontier": 1})
    assert ("unvisited", "b", "max_frontier") in states(rows)
    rows, out = crawl.simulate("s", pages, LIMITS | {"wall_ms": 400})
    assert out["pages"] == 2 and ("unvisited", "b", "max_time") in states(rows)
    pages["a"]["robots"] = False
    rows, out = crawl.simulate("s", pages, LIMITS, lambda u, is_seed: "excluded" if u == "c" else None)
    assert states(rows) == [("accepted", "s", None), ("blocked", "a", "robots_denied"), ("accepted", "b", None), ("skipped", "c", "excluded")] and out["status"] == "partial"
    pages["s"]["robots"] = False
    assert crawl.simulate("s", pages, LIMITS)[1]["status"] == "blocked"


def test_edges(spark):
    from tracewell.operators import admission

    assert admission.comparable("::FFFF:1.2.3.4") == "1.2.3.4" and admission.comparable("[::1]") == "::1" and admission.comparable("x") is None
    row = spark.range(1).select(admission.valid_relative_path(F.lit("a/b.json")).alias("a"), admission.valid_relative_path(F.lit("a/../b")).alias("b"), admission.valid_relative_path(F.lit("/a")).alias("c")).first()
    assert tuple(row) == (True, False, False)
    runs = admission.run_ids(spark.createDataFrame([(1_700_000_000_123, "k")], "ms long, k string"), "ms", "k")
    assert runs.where(admission.valid_run_id(F.col("run_id"))).count() == 1


def test_exact_schedule(spark):
    pages = spark.createDataFrame([("o", k, 0, 300, 2) for k in range(4)], "origin string, seq long, ready_ms long, delay_ms long, want_retries long")
    got = crawl.exact_schedule(pages, ["origin"], 3, 700, 250, 2).orderBy("seq").collect()
    assert [(r["start_ms"], r["offered"], r["retries_used"], r["reason"]) for r in got] == [(0, 3, 2, None), (300, 0, 0, None), (600, 1, 1, None), (900, 0, 0, "max_time")]


def test_retries(spark):
    limits = retry.Limits(retries=2, max_retry_after_ms=1500)
    rows, outcome = retry.timeline([("retryable", "network", 5, 0), ("retryable", "rate_limited", 5, 120_000), ("success", "ok", 5, 0)], limits)
    assert [r["delay_ms"] for r in rows] == [0, 1500, 0] and rows[1]["capped"] and outcome == "ok"
    assert retry.timeline([("retryable", "rate_limited", 0, 0)] * 3, limits)[1] == "rate_limited"
    assert retry.timeline([("retryable", "rate_limited", 0, 90_000)], retry.Limits(2, 90_000, 60_000))[1] == "hard_limit"
    log = spark.createDataFrame([("j", 1, "retryable", "network", 1, 0), ("j", 2, "success", "ok", 1, 0), ("j", 3, "success", "ok", 1, 0)], "job string, seq long, kind string, code string, duration_ms long, retry_after_ms long")
    assert retry.timelines(log, ["job"], limits).count() == 2 and retry.native_timelines(log, ["job"], limits).count() == 2


def test_outcomes(spark):
    codes = spark.createDataFrame([(s,) for s in (200, 304, 403, 429, 503, 418)], "s int").select("s", *[c.alias(n) for n, c in zip("kc", contracts.status_outcome(F.col("s")), strict=True)]).collect()
    assert {r["s"]: (r["k"], r["c"]) for r in codes} == {200: ("success", "ok"), 304: ("success", "ok"), 403: ("terminal", "access_denied"), 429: ("retryable", "rate_limited"), 503: ("retryable", "http_5xx"), 418: ("terminal", "access_denied")}
    row = spark.range(1).select(contracts.exit_code(F.lit("interrupted"), F.lit("SIGINT")).alias("a"), contracts.exit_code(F.lit("ok"), F.lit(None).cast("string")).alias("b"), contracts.terminal_class(F.lit("rate_limited"), F.lit(True)).alias("c"), *[c.alias(n) for n, c in zip("de", contracts.error_outcome(F.lit("redirect_limit")), strict=True)]).first()
    assert tuple(row) == (130, 0, "blocked", "terminal", "hard_limit")


def test_store(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, body string")
    objects = store.objects(docs.where("body is not null"), "body", "id")
    assert sorted((r["copies"], r["first_id"]) for r in objects.collect()) == [(1, 3), (2, 1)]
    fresh, corrupt = store.put(objects, objects.limit(1).withColumn("bytes", F.col("bytes") + 1))
    assert fresh.count() == 1 and corrupt.count() == 1
    manifests = spark.createDataFrame([("r1", "ok"), ("r2", "ok"), ("r3", "odd")], "run_id string, status string")
    h = "sha256:" + "0" * 64
    artifacts = spark.createDataFrame([("r1", h, "source", None), ("r1", h[:-1] + "1", "markdown", h), ("r2", h, "source", "sha256:" + "f" * 64)], "run_id string, hash string, role string, derived_from string")
    assert sorted(map(tuple, store.manifest_faults(manifests, artifacts).collect())) == [("r2", "incomplete"), ("r2", "lineage"), ("r3", "status")]
    cache = spark.createDataFrame([("f", "r1", h, h[:-1] + "1")], "fingerprint string, run_id string, source_hash string, artifact_hash string")
    assert store.valid_cache(cache, manifests, artifacts).count() == 1
    lines = spark.createDataFrame([("r1", 0, '{"type":"a"}'), ("r1", 1, '{"type":"b"}'), ("r2", 0, "[1]")], "run_id string, line_no int, raw string")
    runs = spark.createDataFrame([("r1", True, False), ("r2", True, False), ("r3", True, True), ("r4", True, False)], "run_id string, has_job boolean, has_manifest boolean")
    got = {r["run_id"]: (r["state"], r["last_event"]) for r in store.recovery(runs, lines).collect()}
    assert got == {"r1": ("incomplete", "b"), "r2": ("corrupt", None), "r4": ("incomplete", None)}
    other = "sha256:" + "e" * 64
    journal = [f'{{"a":[{{"hash":"{h}"}}]}}', f'{{"note":"{other}","hash":"not {other}","hashes":["{other}"]}}', f'{{"ref":{{"hash":"{other[:-1]}d","path":"p","bytes":7}}}}', f"{{bad {other}"]
    held = spark.createDataFrame([(other[:-1] + "d", 8)], "hash string, bytes long")
    assert sorted(map(tuple, store.missing_objects(spark.createDataFrame([("r", x) for x in journal], "run_id string, raw string"), held).collect())) == [("r", h, "missing"), ("r", other[:-1] + "d", "size")]


def test_redirects_and_dns(spark):
    hops = spark.createDataFrame([("a", "b", 301), ("b", "c", 302), ("c", "a", 301), ("https:x", "http:y", 308)], "src string, dst string, status int")
    got = {r["start"]: (r["end"], r["hops"], r["outcome"]) for r in redirects.follow(spark.createDataFrame([("a",), ("https:x",), ("z",)], "start string"), hops, 5).collect()}
    assert got == {"a": ("c", 2, "redirect_loop"), "https:x": ("https:x", 0, "redirect_downgrade"), "z": ("z", 0, "ok")}
    answers = spark.createDataFrame([("h", "8.8.8.8"), ("h", "1.1.1.1"), ("k", "8.8.8.8"), ("k", "10.0.0.1")], "host string, address string")
    got = {r["host"]: (r["public"], r["selected"], r["deny_reason"]) for r in redirects.dns_gate(answers).collect()}
    assert got == {"h": (True, "1.1.1.1", None), "k": (False, None, "private")}


def test_search(spark):
    rows = spark.createDataFrame([("r", 1, "u1"), ("r", 2, None), ("r", 3, "u1"), ("r", 4, "u2")], "run string, pos int, canonical string")
    out = search.candidates(rows, ["run"], "pos", F.col("canonical"))
    assert [r["canonical"] for r in search.ranked(out, ["run"], "pos", 2).orderBy("rank").collect()] == ["u1", "u2"]
    assert search.warnings(out, ["run"]).first()["warnings"] == "search_candidate_private_or_invalid:1,search_candidate_duplicate:1"


def test_bodies():
    assert capture.decode_body(gzip.compress(b"x" * 100), "GZIP") == (b"x" * 100, "ok")
    assert capture.decode_body(zlib.compress(b"abc"), "deflate") == (b"abc", "ok")
    assert capture.decode_body(gzip.compress(b"x" * 100), "gzip", 99)[1] == "hard_limit" and capture.decode_body(b"x", "gzip")[1] == "failed" and capture.decode_body(b"x", "gzip, br")[1] == "unsupported"


def test_objects_and_journals(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"d"),)], "content binary")
    (tmp_path / "o" / "ab").mkdir(parents=True)
    import hashlib

    for body, name in ((b"abc", hashlib.sha256(b"abc").hexdigest()), (b"bad", "0" * 64)):
        (tmp_path / "o" / "ab" / name).write_bytes(body)
    assert sorted(r["intact"] for r in capture.read_objects(spark, str(tmp_path / "o")).collect()) == [False, True]
    from tracewell.functions.values import digest

    capture.write_objects(rows.withColumn("hash", digest(F.col("content"))), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "attempts.ndjson").write_text('{"a":1}\n{"a":2}\n')
    assert sorted((r["run_id"], r["line_no"]) for r in capture.read_journals(spark, str(tmp_path / "runs" / "*" / "attempts.ndjson")).collect()) == [("r1", 0), ("r1", 1)]


def test_command_line(spark, capsys):
    spec = jobs.parse_argv(["crawl", "https://a.com", "--max-pages", "5", "--include", "/a/**", "--discover", "rss,html", "--ttl", "5m"])
    assert spec.limits.max_pages == 5 and spec.include == ("/a/**",) and spec.discover == ("html", "rss") and spec.ttl_ms == 300_000
    for bad in (["url"], ["url", "x", "--nope"], ["url", "x", "--json", "--json"], ["extract", "x"], ["url", "x", "--format", "pdf"], ["crawl", "x", "--max-pages", "0"], ["crawl", "x", "--include", "a"]):
        with pytest.raises(jobs.InputError):
            jobs.parse_argv(bad)
    assert cli.execute(spark, jobs.parse_argv(["health"]))[1].count() == 8
    assert cli.execute(spark, jobs.parse_argv(["url", "https://a.com", "--explain"]))[1].count() == 5


def test_crawl_on_demand_equals_replay(spark):
    """Fetching what the queue asks for gives the ledger of a replay that holds the whole site."""
    rng = random.Random(5)
    for _ in range(3):
        site = {f"https://a.com/{i}": {"links": [f"https://a.com/{rng.randrange(45)}" for _ in range(4)], "robots": i % 7 != 3, "kind": "terminal" if i % 11 == 5 else "success", "code": "gone" if i % 11 == 5 else "ok", "bytes": 10 + i, "delay_ms": 0, "retries": 0, "redirects": 0} for i in range(40)}
        limits = {"pages": 9, "depth": 3, "frontier": 6, "bytes": 10_000, "wall_ms": 60_000, "delay_ms": 250, "concurrency": 2, "retries": 1, "redirects": 5}
        missing = {f"https://a.com/{i}": {"links": [], "robots": True, "kind": "terminal", "code": "not_found", "bytes": 0, "delay_ms": 0, "retries": 0, "redirects": 0} for i in range(40, 45)}
        want, summary = crawl.simulate("https://a.com/0", site | missing, limits)
        rows = spark.createDataFrame([(u, p["links"], p["kind"], p["code"], p["bytes"]) for u, p in site.items()], "url string, links array<string>, kind string, code string, bytes long")
        decide = lambda urls: urls.withColumns({"robots": (F.regexp_extract("url", r"(\d+)$", 1).cast("int") % 7 != 3) | (F.regexp_extract("url", r"(\d+)$", 1).cast("int") >= 40), "delay_ms": F.lit(0)})
        crawls = spark.createDataFrame([("c", "https://a.com/0")], "crawl string, seed string")
        got = crawl.crawl_on_demand(crawls, rows, decide, limits).orderBy("seq").collect()
        assert [(r["state"], r["url"], r["depth"], r["reason"]) for r in got] == [(w["state"], w["url"], w["depth"], w["reason"]) for w in want]
        assert {r["status"] for r in got} == {summary["status"]}


def test_cli_crawl_and_output(spark, tmp_path):
    """A crawl follows links under robots and limits; output stays below the data root and out of the store."""
    page = lambda *links: "<html><body>text " + "".join(f'<a href="{x}">x</a>' for x in links) + "</body></html>"
    rows = [(1, "https://a.com/", page("/b", "/private/c", "https://other.com/")), (2, "https://a.com/b", page("/", "/d")), (3, "https://a.com/private/c", page())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([("https://a.com", 200, bytearray(b"User-agent: *\nDisallow: /private\n"))], "origin string, status int, body binary").write.parquet(f"{tmp_path}/robots.parquet")
    status, got = cli.execute(spark, jobs.parse_argv(["crawl", "https://a.com/", "--data-root", str(tmp_path)]))
    assert status == "partial"
    assert [tuple(r) for r in got.collect()] == [
        ("accepted", "https://a.com/", 0, None), ("blocked", "https://a.com/private/c", 1, "robots_denied"),  # while the batch of /b fills
        ("accepted", "https://a.com/b", 1, None), ("skipped", "https://a.com/", 2, "duplicate"), ("blocked", "https://a.com/d", 2, "not_found"),
    ]
    assert cli.output_path("/r", "out/x") == "/r/out/x"
    for bad in ("objects/x", "../x", "/x", "a//b", "", "runs"):
        with pytest.raises(cli.OutputError):
            cli.output_path("/r", bad)


def test_retry_stream_state_ends(spark, tmp_path):
    """A job's state goes after its idle time, and a later attempt begins anew; within it, it continues."""
    from tracewell.streaming import jobs as streams

    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    batches = [[(1, at(1, 0)), (2, at(1, 0))], [(3, at(9, 0))], [(3, at(9, 1))], [(1, at(9, 2))]]
    schema = "k long, ts string, kind string, code string, duration_ms long, retry_after_ms long"
    for i, b in enumerate(batches):
        spark.createDataFrame([(k, t, "retryable", "network", 5, 0) for k, t in b], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
        q = streams.retries(stream, "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "attempt").collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 2)]
