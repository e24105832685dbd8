"""Sitemaps, feeds and alternates, by themselves and within crawls."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import crawl, discovery
from tracewell.plans import jobs, queries

A, B = "https://a.com", "https://b.org"
FILES = [
    (f"{A}/s.xml", f'<sitemapindex xmlns="x"><sitemap><loc> {A}/t.xml </loc></sitemap><sitemap><loc>{A}/s.xml</loc></sitemap><sitemap><loc>{B}/s.xml</loc></sitemap><sitemap><loc>{A}/gone.xml</loc></sitemap></sitemapindex>'),
    (f"{A}/t.xml", f"<m:urlset xmlns:m='x'><m:url><m:loc>{A}/1?x=1&amp;y=2</m:loc></m:url><m:url><m:loc>ftp://a.com/</m:loc></m:url><m:url><m:loc>{B}/out</m:loc></m:url></m:urlset>"),
    (f"{B}/feed", '<feed><link href="/self"/><entry><link href="/e1"/><link rel="enclosure" href="/no"/></entry><entry><link rel="alternate" href="e2"/></entry></feed>'),
    (f"{B}/rss", "<rss><channel><link>/home</link><item><link>/i1</link></item><item><title>none</title></item></channel></rss>"),
    (f"{B}/bad", "<urlset><url><loc>/x"), (f"{B}/text", "no xml"), (f"{B}/null", None), (f"{B}/html", "<html><body>x</body></html>"),
]


def test_listed_and_followed(spark):
    files = spark.createDataFrame(FILES, "url string, body string")
    got = {(r["url"], r["leads"], r["target"]) for r in discovery.listed(files).collect()}
    assert {g for g in got if g[0].startswith(B)} == {(f"{B}/feed", "page", f"{B}/e1"), (f"{B}/feed", "page", f"{B}/e2"), (f"{B}/rss", "page", f"{B}/i1")}
    assert (f"{A}/t.xml", "page", f"{A}/1?x=1&y=2") in got and (f"{A}/s.xml", "sitemap", f"{A}/s.xml") in got
    starts = spark.createDataFrame([("c", f"{A}/s.xml"), ("d", f"{B}/feed"), ("d", f"{B}/nowhere")], "crawl string, url string")
    assert {tuple(r) for r in discovery.follow(starts, files, 9).collect()} == {("c", f"{A}/1?x=1&y=2", 2, f"{A}/t.xml"), ("d", f"{B}/e1", 1, f"{B}/feed"), ("d", f"{B}/e2", 1, f"{B}/feed")}
    assert discovery.follow(starts.limit(0), files, 3).count() == 0


@pytest.mark.parametrize(("sources", "want"), [((), set()), (("rss",), {"/r"}), (("atom", "api"), {"/a", "/j"}), (("html",), {"/h", "/n"})])
def test_alternates_by_kind(spark, sources, want):
    page = '<link rel="Alternate" type="application/rss+xml" href="/r"><link rel=alternate type="application/atom+xml" href="/a"><link rel="x alternate" type="application/feed+json" href="/j"><link rel=alternate type="text/html" href="/h"><link rel=alternate href="/n"><link rel=canonical href="/c"><a href="/link">x</a> text'
    site = jobs.crawl_site(spark.createDataFrame([(1, f"{A}/", page)], "page_id int, url string, html string"), sources=sources)
    links = [u.removeprefix(A) for u in site.first()["links"]]
    # The links of any tag's href come first, sorted; alternates follow.
    assert links[:7] == sorted(links[:7]) and set(links[7:]) == want


def test_robots_sitemaps_are_offered_once_and_before_the_cut(spark):
    page = {"links": [], "robots": True, "kind": "success", "code": "ok", "bytes": 1, "delay_ms": 0, "retries": 0, "redirects": 0, "sitemaps": ["m"]}
    pages = {"s": page | {"links": ["a", "x"]}, "a": page, "m": page | {"links": ["b"]}, "x": page | {"robots": False}, "b": page}
    limits = {"pages": 9, "depth": 3, "frontier": 10, "bytes": 99, "wall_ms": 1000, "delay_ms": 0, "concurrency": 1, "retries": 0, "redirects": 0}
    states = lambda **k: [(r["url"], r["depth"], r["state"], r["reason"]) for r in crawl.simulate("s", pages, limits | k)[0]]
    assert states() == [("s", 0, "accepted", None), ("m", 1, "accepted", None), ("a", 1, "accepted", None), ("x", 1, "blocked", "robots_denied"), ("b", 2, "accepted", None)]
    assert ("m", 1, "unvisited", "max_frontier") in states(frontier=0) or ("s", 0, "unvisited", "max_frontier") in states(frontier=0)
    assert states(pages=0) == [("s", 0, "unvisited", "max_pages"), ("m", 1, "unvisited", "max_pages")]
    assert ("m", 1, "unvisited", "max_depth") in states(depth=0)


def test_discovery_takes_effect_in_the_command_line(spark, tmp_path, capsys):
    from tracewell.plans import cli

    pages = [(1, f"{A}/", "<p>home</p>"), (2, f"{A}/s.xml", f"<urlset><url><loc>{A}/deep</loc></url></urlset>"), (3, f"{A}/deep", "<p>deep</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(A, 200, bytearray(f"User-agent: *\nSitemap: {A}/s.xml\n".encode()))], "origin string, status int, body binary").write.parquet(f"{tmp_path}/robots.parquet")
    for given, want in (([], {f"{A}/"}), (["--discover", "sitemap"], {f"{A}/", f"{A}/s.xml", f"{A}/deep"})):
        status, rows = cli.execute(spark, jobs.parse_argv(["crawl", f"{A}/", "--data-root", str(tmp_path), *given]))
        assert status == "ok" and {r["url"] for r in rows.where(F.col("state") == "accepted").collect()} == want


def test_whole_crawl_equals_replay(spark):
    """Levels by joins give the ledger of a replay whose limits, but for the depth, are never met."""
    rng = random.Random(7)
    page = {"links": [], "robots": True, "kind": "success", "code": "ok", "bytes": 1, "delay_ms": 0, "retries": 0, "redirects": 0, "sitemaps": [f"{A}/m"]}
    site = {f"{A}/{i}": page | {"links": [f"{A}/{'no/' * (rng.random() < 0.1)}{rng.randrange(70)}" for _ in range(3)], "robots": i % 7 != 3} | [{}, {"kind": "terminal", "code": "gone"}, {"kind": "failed", "code": "empty"}][max(0, i % 9 - 6)] for i in range(60)}
    site[f"{A}/m"] = page | {"links": [f"{A}/0", f"{A}/m", f"{A}/69"] + [f"{A}/1"] * 3}
    allowed = (F.regexp_extract("url", r"/(\d+)$", 1).try_cast("int") % 7 != 3) | ~F.col("url").isin(list(site))
    decide = lambda urls: urls.withColumns({"robots": F.coalesce(allowed, F.lit(True)), "delay_ms": F.lit(0), "sitemaps": F.array(F.lit(f"{A}/m"))})
    missing = {u: page | {"kind": "terminal", "code": "not_found"} for p in site.values() for u in p["links"] if u not in site}
    rows = spark.createDataFrame([(u, p["links"], p["kind"], p["code"], p["bytes"]) for u, p in site.items()], "url string, links array<string>, kind string, code string, bytes long")
    crawls = spark.createDataFrame([(k, f"{A}/{k}") for k in range(4)], "crawl int, seed string")
    for depth in (0, 3):
        limits = {"pages": 999, "depth": depth, "frontier": 999, "bytes": 1 << 40, "wall_ms": 1 << 40, "delay_ms": 0, "concurrency": 1, "retries": 0, "redirects": 0}
        scope = lambda url, is_seed: "excluded" if url.startswith(f"{A}/no/") else None
        want = sorted((k, w["url"], w["depth"], w["state"], w["reason"] or "") for k in range(4) for w in crawl.simulate(f"{A}/{k}", site | missing, limits, scope)[0])
        got = crawl.crawl_whole(crawls, rows, decide, depth, exclude=["/no/**"])
        assert sorted((r["crawl"], r["url"], r["depth"], r["state"], r["reason"] or "") for r in got.collect()) == want
    assert {w[3] for w in want} == {"accepted", "skipped", "blocked", "failed", "unvisited"}


def test_registered_crawl_has_no_limit_of_pages(spark, tmp_path):
    """more pages of one origin than the 10 000 at which the query used to stop."""
    url = F.concat(F.lit(f"{A}/"), "id")
    spark.range(10_050).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("<p>x</p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    states = queries.QUERIES["crawl_discover"](spark, str(tmp_path)).groupBy("state", "reason").count().collect()
    # The seed, five files and the pages but the seed; the seed and the first index are met again.
    assert {tuple(r) for r in states} == {("accepted", None, 10_055), ("skipped", "duplicate", 2)}
