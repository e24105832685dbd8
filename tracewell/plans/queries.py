"""The query catalogue: each operator over the driver tables, with DuckDB SQL that says the same independently."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import formats, ip, markdown, markup, urls, values
from tracewell.operators import adapters, admission, bloom, cidr, contracts, cost, crawl, discovery, recency, redirects, retry, robots, search, search_index, shared, store, variants
from tracewell.plans import jobs
from tracewell.sources import capture, packs
from tracewell.streaming import jobs as streams
from tracewell.streaming import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; without SQL only its rows are checked."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def col(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    return capture.table(spark, sf_dir, name).select(*columns)


# SQL fragments of the basic HTML projections.
WS = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BODY = rf"CASE WHEN regexp_matches(html, '(?is)<body\b[^>]*>.*?</body{WS}*>') THEN regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body{WS}*>', 1) ELSE html END"


def sql_without(expression: str, names: list[str], to: str = " ") -> str:
    for n in names:
        expression = rf"regexp_replace({expression}, '(?is)<{n}\b[^>]*>.*?</{n}{WS}*>', '{to}', 'g')"
    return expression


def sql_collapse(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{WS}+', ' ', 'g'), ' ')"


TEXT = sql_collapse(f"regexp_replace(regexp_replace(regexp_replace({sql_without(BODY, formats.TEXT_DROPPED)}, '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g')")
TITLE = sql_collapse(rf"regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title{WS}*>', 1), '<[^>]+>', ' ', 'g')")
SCRIPTS = rf"CAST(len(regexp_extract_all({BODY}, '(?i)<script\b')) AS BIGINT)"
HREF = rf"""regexp_extract(t, '(?i){WS}href{WS}*={WS}*(?:"([^"]*)"|''([^'']*)''|([^\s"''=<>`]+))', %d)"""
HREFS = rf"""list_transform(list_filter(regexp_extract_all(html, '(?i)<a\b[^>]*>'), lambda t: regexp_matches(t, '(?i){WS}href{WS}*=')), lambda t: regexp_replace(regexp_replace({HREF % 1} || {HREF % 2} || {HREF % 3}, '(?i)&amp;', '&', 'g'), '(?i)&quot;', '"', 'g'))"""


@query(rf"""
WITH p AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, {TEXT} AS text, {SCRIPTS} AS scripts, {TITLE} AS title,
  CAST(len(list_distinct({HREFS})) AS BIGINT) AS links, octet_length(encode(html)) AS bytes, 'sha256:' || sha256(html) AS hash FROM pages)
SELECT origin, count(*) AS pages, count(*) FILTER (text <> '') AS accepted, count(*) FILTER (title <> '') AS titled, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(sum(length(text)) AS BIGINT) AS text_length, CAST(sum(links) AS BIGINT) AS links, CAST(sum(scripts) AS BIGINT) AS scripts, min(hash) AS first_hash FROM p GROUP BY origin
""")
def capture_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.capture_audit(col(spark, sf_dir, "pages", "url", "html"))


@query("""
SELECT page_id, regexp_replace(url, '#.*$', '') AS canonical_url, regexp_extract(url, '^(https?)', 1) || ':' AS protocol, regexp_extract(url, '^https?://([^/?#]+)', 1) AS hostname,
  CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages
""")
def url_canonical_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = urls.plain_parts(F.col("url"))
    return col(spark, sf_dir, "pages", "page_id", "url").select("page_id", *[c.alias(k) for k, c in parts.items()])


#: Pages' URLs with a defect that the page's number picks.
MUTATIONS = ["", "?access_token=x", "#frag", "?a=1&Api-Key=2", "?q=mytoken", "?token_id=3"]
HOSTS = ["", "http://localhost/x", "https://u:p@a.com/", "https://a.com:8080/", "ftp://a.com/", "http://127.0.0.1/", "http://8.8.8.8/", "https://x.internal/", "http://a.com/%0d", "http://10.1.2.3/"]


@query("""
WITH m AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN regexp_replace(url, '[?#].*$', '') || ['', '?access_token=x', '#frag', '?a=1&Api-Key=2', '?q=mytoken', '?token_id=3'][(page_id // 10) % 6 + 1]
  ELSE ['', 'http://localhost/x', 'https://u:p@a.com/', 'https://a.com:8080/', 'ftp://a.com/', 'http://127.0.0.1/', 'http://8.8.8.8/', 'https://x.internal/', 'http://a.com/%0d', 'http://10.1.2.3/'][page_id % 10 + 1] END AS url FROM pages)
SELECT page_id, url, CASE WHEN url LIKE '%\\%0d%' ESCAPE '\\' THEN 'ambiguous_url' WHEN url NOT LIKE 'http%' THEN 'scheme_denied' WHEN url LIKE '%@%' THEN 'userinfo_denied' WHEN url LIKE '%:8080%' THEN 'port_denied'
  WHEN url LIKE '%access_token=%' OR url LIKE '%Api-Key=%' THEN 'sensitive_query' WHEN url LIKE '%localhost%' OR url LIKE '%.internal/%' THEN 'special_hostname'
  WHEN url LIKE 'http://127.%' OR url LIKE 'http://10.%' THEN 'non_public_ip' END AS reject FROM m
""")
def url_policy_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = col(spark, sf_dir, "pages", "page_id", "url")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (n + 1).cast("int"))
    n = F.col("page_id")
    url = F.when(n % 10 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), pick(MUTATIONS, F.floor(n / 10) % len(MUTATIONS)))).otherwise(pick(HOSTS, n % 10))
    return pages.select("page_id", url.alias("url")).withColumn("reject", urls.policy_reject(F.col("url")))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS canonical_url FROM pages)
SELECT page_id, CAST(NULL AS VARCHAR) AS reject, canonical_url, regexp_extract(canonical_url, '^[a-z]+:') AS protocol, regexp_extract(canonical_url, '^[a-z]+://([^/?]+)', 1) AS hostname,
  CASE WHEN canonical_url LIKE 'https:%' THEN 443 ELSE 80 END AS port, false AS is_ip_literal FROM p
""")
def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full admission by the parser, for all pages."""
    return col(spark, sf_dir, "pages", "page_id", urls.admit_url("url").alias("a")).select("page_id", "a.*")


V4_CASE = " ".join(f"WHEN n BETWEEN {int(ip.ipaddress.IPv4Address(a))} AND {int(ip.ipaddress.IPv4Address(a)) + 2 ** (32 - b) - 1} THEN '{r}'" for a, b, r in ip.IPV4_RANGES)


@query(f"""
WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders)
SELECT o_orderkey, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS address, CASE {V4_CASE} ELSE 'global' END AS reason FROM a
""")
def ip_classify_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod(F.col("o_orderkey") * 2654435761, F.lit(4294967296))
    address = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    rows = col(spark, sf_dir, "orders", "o_orderkey", address.alias("address"))
    return rows.withColumn("n", ip.ipv4_number(F.col("address"))).select("o_orderkey", "address", ip.ipv4_reason(F.col("n")).alias("reason"))


@query(f"""
WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders),
r AS (SELECT s_suppkey AS ord, (s_suppkey * 2246822519) % 4294967296 AS start, 2 + s_suppkey % 22 AS size, 'block' || s_suppkey AS owner FROM supplier),
m AS (SELECT o_orderkey, min_by(owner, ord) AS owner FROM a JOIN r ON (a.n >> (32 - size)) = (r.start >> (32 - size)) GROUP BY o_orderkey)
SELECT o_orderkey, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS address, owner FROM a LEFT JOIN m USING (o_orderkey)
""")
def cidr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of a table of ranges that holds each address."""
    quad = lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    k = F.col("s_suppkey")
    blocks = col(spark, sf_dir, "supplier", k.alias("ord"), F.concat(quad(F.pmod(k * 2246822519, F.lit(4294967296))), F.lit("/"), (2 + k % 22).cast("string")).alias("cidr"), F.concat(F.lit("block"), k).alias("owner"))
    rows = col(spark, sf_dir, "orders", "o_orderkey", quad(F.pmod(F.col("o_orderkey") * 2654435761, F.lit(4294967296))).alias("address"))
    return cidr.first_match(rows, "address", cidr.ranges_of(blocks), keep=["owner"])


#: IPv6 answers by s_suppkey % 7: as given, in shortest form, and their reason.
V6 = [("2606:4700::1111", "2606:4700::1111", "global"), ("2001:DB8:0:0::1", "2001:db8::1", "documentation"), ("::ffff:8.8.8.8", "::ffff:808:808", "ipv4-mapped"), ("2a00:1450:4001:0:0:0:0:65", "2a00:1450:4001::65", "global")]


@query(f"""
WITH s AS (SELECT *, CASE WHEN s_suppkey % 9 = 0 THEN 167772160 + s_suppkey ELSE 134744072 + s_suppkey * 7 END AS n FROM supplier),
v4 AS (SELECT 'host' || (s_suppkey % 40) AS host, '4' || lpad(printf('%X', n), 8, '0') AS k, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS address, CASE {V4_CASE} ELSE 'global' END AS reason FROM s),
t(k, given, address, reason) AS (VALUES {", ".join(f"('6{int(ip.ipaddress.IPv6Address(b)):032x}', '{a}', '{b}', '{r}')" for a, b, r in V6)}),
v6 AS (SELECT 'host' || (s_suppkey % 40) AS host, t.k, t.address, t.reason FROM supplier JOIN t ON t.given = {[a for a, _, _ in V6]}[s_suppkey % 7 + 1]),
c AS (SELECT * FROM v4 UNION ALL SELECT * FROM v6)
SELECT host, bool_and(reason = 'global') AS public, count(DISTINCT k) AS answers, CASE WHEN bool_and(reason = 'global') THEN min_by(address, k) END AS selected,
  min_by(reason, k) FILTER (reason <> 'global') AS deny_reason FROM c GROUP BY host
""")
def dns_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of both families."""
    k = F.col("s_suppkey")
    n = F.when(k % 9 == 0, 167772160 + k).otherwise(134744072 + k * 7)
    v4 = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    v6 = F.get(F.array(*[F.lit(a) for a, _, _ in V6]), (k % 7).cast("int"))
    host = F.concat(F.lit("host"), (k % 40).cast("string"))
    rows = col(spark, sf_dir, "supplier", host.alias("host"), F.explode(F.array_compact(F.array(v4, v6))).alias("address"))
    return redirects.dns_gate(rows)


KIND_SQL = rf"""CASE WHEN regexp_matches(lower(b), '^(?:<!doctype{WS}+html(?:{WS}|>)|<html(?:{WS}|>))') THEN 'html' WHEN left(b, 1) IN ('{{', '[') THEN 'json' END"""


@query(rf"""
WITH b AS (SELECT 'page' AS origin, page_id AS id, html AS body FROM pages UNION ALL SELECT 'event', event_id, props FROM events UNION ALL SELECT 'document', doc_id, text FROM documents),
c AS (SELECT origin, id, ['', 'text/html; charset=utf-8', 'application/json', 'application/xml', 'Text/Markdown', 'application/ld+json', 'x'][id % 7 + 1] AS content_type, regexp_replace(left(body, 8192), '^{WS}+', '') AS b FROM b),
d AS (SELECT origin, id, CASE WHEN content_type LIKE 'text/html%' THEN 'html' WHEN content_type = 'Text/Markdown' THEN 'markdown' WHEN content_type IN ('application/json', 'application/ld+json') THEN 'json' WHEN content_type = 'application/xml' THEN 'xml' END AS declared, {KIND_SQL} AS sniffed FROM c)
SELECT origin, id, declared, sniffed, coalesce(declared, sniffed, 'binary') AS kind FROM d
""")
def content_kind_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = ["", "text/html; charset=utf-8", "application/json", "application/xml", "Text/Markdown", "application/ld+json", "x"]
    parts = [("page", "pages", "page_id", "html"), ("event", "events", "event_id", "props"), ("document", "documents", "doc_id", "text")]
    out = None
    for origin, name, key, body in parts:
        declared = formats.declared_kind(formats.media_type(F.element_at(F.array(*map(F.lit, types)), (F.col(key) % 7 + 1).cast("int"))))
        rows = col(spark, sf_dir, name, F.lit(origin).alias("origin"), F.col(key).alias("id"), declared.alias("declared"), formats.sniffed_kind(F.col(body)).alias("sniffed"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("kind", formats.detected_kind(F.col("declared"), F.col("sniffed")))


@query(rf"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE {TEXT} END AS text, {SCRIPTS} AS scripts FROM pages), g AS (SELECT unnest(['raw', 'markdown', 'text', 'metadata', 'links', 'json']) AS goal)
SELECT page_id, goal, CASE WHEN goal IN ('markdown', 'text') AND text = '' OR goal = 'json' THEN 'inadequate' ELSE 'success' END AS kind,
  CASE WHEN goal IN ('markdown', 'text') AND text = '' THEN CASE WHEN scripts > 0 THEN 'js_shell' ELSE 'empty' END WHEN goal = 'json' THEN 'wrong_mime' ELSE 'ok' END AS code FROM p CROSS JOIN g
""")
def goal_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    text = F.when(F.col("page_id") % 5 == 0, "").otherwise(formats.html_text(html))
    pages = col(spark, sf_dir, "pages", "page_id", text.alias("text"), formats.script_count(html).alias("scripts"), F.octet_length(html).alias("bytes"))
    rows = pages.withColumn("goal", F.explode(F.array(*map(F.lit, contracts.GOALS))))
    kind, code = contracts.accept(F.col("goal"), F.col("text"), F.col("scripts"), F.lit("html"), F.lit(True), F.lit(True), F.col("bytes"))
    return rows.select("page_id", "goal", kind.alias("kind"), code.alias("code"))


@query(rf"SELECT page_id, CAST(len({HREFS}) AS BIGINT) AS hrefs, array_to_string(list_sort(list_distinct({HREFS})), ' ') AS links FROM pages")
def html_links_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = formats.anchor_hrefs(F.col("html"))
    return col(spark, sf_dir, "pages", "page_id", F.size(h).cast("long").alias("hrefs"), F.array_join(F.array_sort(F.array_distinct(h)), " ").alias("links"))


MARKUP = sql_without("regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g')", formats.DATA_DROPPED, "")


@query(rf"""
WITH c AS (SELECT page_id, {MARKUP} AS html FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(html, '<[^>]+>'), lambda t: regexp_matches(t, '(?i){WS}href{WS}*=')), lambda t: {HREF % 1} || {HREF % 2} || {HREF % 3}))), ' ') AS hrefs FROM c
""")
def html_links_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col(spark, sf_dir, "pages", "page_id", F.array_join(F.array_sort(F.array_distinct(formats.markup_hrefs(F.col("html")))), " ").alias("hrefs"))


@query(rf"""
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages),
r AS (SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(hrefs, lambda x: origin || array_to_string(list_transform(string_split(x, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE url_encode(c) END), '')))), ' ') AS links FROM h)
SELECT page_id, links, links AS anchors FROM r
""")
def html_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the parser and by the native anchor pattern, both resolved and sorted."""
    rows = col(spark, sf_dir, "pages", "page_id", markdown.markup_links(F.col("html"), F.col("url")).alias("links"), urls.resolve_all(formats.anchor_hrefs(F.col("html")), F.col("url")).alias("anchors"))
    return rows.select("page_id", F.array_join("links", " ").alias("links"), F.array_join("anchors", " ").alias("anchors"))


@query(f"SELECT page_id, {TITLE} AS title, sha256({TEXT}) AS text_sha256, CAST(length({TEXT}) AS BIGINT) AS text_length FROM pages")
def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = col(spark, sf_dir, "pages", "page_id", formats.html_title(F.col("html")).alias("title"), formats.html_text(F.col("html")).alias("text"))
    return rows.select("page_id", "title", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("text_length"))


@query(f"SELECT page_id, {SCRIPTS} AS scripts FROM pages")
def html_script_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col(spark, sf_dir, "pages", "page_id", formats.script_count(F.col("html")).alias("scripts"))


def sql_markdown() -> str:
    """Markdown of the pages by rewriting their tags as text: links first, then breaks, then entities."""
    b, n = "chr(2)", "chr(1)"
    target = "origin || array_to_string(list_transform(string_split(regexp_extract(s, '^([^\"]*)\"', 1), ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE url_encode(c) END), '')"
    link = f"'[' || trim(regexp_extract(s, '^[^\"]*\">([^<]*)</a>', 1)) || '](' || {target} || ')' || regexp_replace(s, '^[^\"]*\">[^<]*</a>', '')"
    body = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<head>.*?</head>', '')"
    steps = [(r"'\s+'", "' '"), ("'<h1>'", f"{b} || '# '"), ("'</?(p|div|article|nav|ul|footer|h1)\\b[^>]*>'", b), ("'<br>|</li>'", n), ("'<li>'", f"{n} || '- '"), ("'<[^>]*>'", "''"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"),
             (f"'[ ' || {n} || ']*' || {b} || '[ ' || {n} || {b} || ']*'", "chr(10) || chr(10)"), (f"' *' || {n} || '[ ' || {n} || ']*'", "chr(10)"), ("' +'", "' '")]
    text = "t"
    for pattern, put in steps:
        text = f"regexp_replace({text}, {pattern}, {put}, 'g')"
    return f"""
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, string_split({body}, '<a href="') AS parts FROM pages),
l AS (SELECT page_id, parts[1] || array_to_string(list_transform(parts[2:], lambda s: {link}), '') AS t FROM h)
SELECT page_id, trim({text}, ' ' || chr(10)) || chr(10) AS markdown, 'sha256:' || sha256(trim({text}, ' ' || chr(10)) || chr(10)) AS sha256 FROM l
"""


@query(sql_markdown())
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = col(spark, sf_dir, "pages", "page_id", markdown.markdown(F.col("html"), F.col("url")).alias("markdown"))
    return rows.withColumn("sha256", values.digest(F.col("markdown")))


@query("""SELECT page_id, '{"bytes":' || octet_length(encode(html)) || ',"final_url":"' || url || '","media_type":"text/html"}' AS metadata FROM pages""")
def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.derive(col(spark, sf_dir, "pages", "page_id", "url", "html", F.lit("html").alias("kind")), "metadata").select("page_id", F.col("artifact").alias("metadata"))


@query("""SELECT event_id, '{"A":' || json_extract_string(props, '$.k') || ',"a":{"z":' || user_id || ',"é":"' || event_type || '","😀":{}},"b":[true,null,1.5,' || CASE WHEN event_id % 2 = 0 THEN '1e+21' ELSE '-0.001' END || ']}' AS canonical FROM events""")
def json_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON: keys in order at every depth, numbers in their shortest form."""
    number = F.when(F.col("event_id") % 2 == 0, "1000000000000000000000").otherwise("-0.0010")
    text = F.format_string('{"b": [true, null, 1.50, %s],  "a": {"😀": {}, "é": "%s", "z": %d},"A": %s}', number, F.col("event_type"), F.col("user_id"), F.get_json_object("props", "$.k"))
    return col(spark, sf_dir, "events", "event_id", markup.stable(text).alias("canonical"))


@query("""SELECT event_id, '/user/' || user_id || ' https://e.example.org/' || event_type AS links FROM events""")
def json_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that look like links, wherever they lie in a JSON text."""
    rows = col(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    deep = F.struct(F.array(F.struct(F.concat(F.lit("https://e.example.org/"), "event_type").alias("u")), F.struct(F.lit("see /not/this").alias("u"))).alias("more"))
    body = F.to_json(F.struct(F.concat(F.lit("/user/"), "user_id").alias("path"), F.array(F.lit("plain"), F.concat(F.lit("/user/"), "user_id")).alias("again"), deep.alias("deep"), F.col("user_id").alias("n")))
    return variants.json_links(rows, ["event_id"], body).groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_list("link")), " ").alias("links"))


@query("""
WITH e AS (SELECT event_id AS k, user_id, 'sha256:' || sha256('o' || (event_id % 97)) AS h FROM events),
r AS (SELECT DISTINCT 'run' || user_id AS run_id, h AS hash, k % 97 AS o, k % 4 = 0 AND k % 3 = 0 AS wrong FROM e WHERE k % 4 IN (0, 1)),
f AS (SELECT run_id, hash, any_value(o) AS o, bool_or(wrong) AS wrong FROM r GROUP BY ALL)
SELECT run_id, hash, CASE WHEN o % 5 = 0 THEN 'missing' ELSE 'size' END AS fault FROM f WHERE o % 5 = 0 OR wrong
""")
def journal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that journals name deep in their events: whole references, bare hashes, and hashes in other strings that do not count."""
    k = F.col("event_id")
    h = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("o"), (k % 97).cast("string")).cast("binary"), 256))
    whole = F.to_json(F.struct(F.array(F.struct(F.struct(h.alias("hash"), F.lit("p").alias("path"), F.when(k % 3 == 0, 200).otherwise(100).alias("bytes")).alias("ref"))).alias("refs")))
    bare = F.to_json(F.struct(F.struct(h.alias("source_hash")).alias("a")))
    decoy = F.to_json(F.struct(F.concat(F.lit("it was "), h).alias("hash"), h.alias("note"), F.array(h).alias("hashes")))
    raw = F.when(k % 4 == 0, whole).when(k % 4 == 1, bare).when(k % 4 == 2, decoy).otherwise(F.concat(F.lit("{bad "), h))
    lines = col(spark, sf_dir, "events", F.concat(F.lit("run"), "user_id").alias("run_id"), k.alias("line_no"), raw.alias("raw"))
    stored = col(spark, sf_dir, "events", h.alias("hash"), F.lit(100).cast("long").alias("bytes"), (k % 97 % 5).alias("o")).where("o > 0").select("hash", "bytes").distinct()
    return store.missing_objects(lines, stored)


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, page_id % 5 AS k FROM pages),
l AS (SELECT page_id, k, CASE k WHEN 0 THEN '["' || o || '/h","' || o || '/z"]' WHEN 1 THEN '["' || o || '/j/' || page_id || '"]' WHEN 2 THEN '["https://x.example.org/' || page_id || '"]' WHEN 3 THEN '["' || o || '/m"]' ELSE '[]' END AS a FROM p),
m AS (SELECT page_id, k, strlen(a) > 38 AS over, a FROM l)
SELECT page_id, ['html', 'json', 'sitemap', 'markdown', 'binary'][k + 1] AS kind, CASE WHEN over THEN 'hard_limit' ELSE 'ok' END AS outcome, CASE WHEN NOT over THEN a END AS artifact FROM m
""")
def representation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of bodies of five kinds, each found by its own rules, with a cap on what a representation may weigh."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    bodies = [F.lit('<p><a href="/z">z</a><a href="/h#x">h</a></p>'), F.concat(F.lit('{"a":[{"b":"/j/'), n, F.lit('"}],"c":"no link"}')), F.concat(F.lit("<urlset><url><loc>https://x.example.org/"), n, F.lit("</loc></url></urlset>")), F.lit("see [m](/m 't') and <ftp://x/>"), F.lit("/plain")]
    kinds = ["html", "json", "sitemap", "markdown", "binary"]
    pick = lambda options: F.get(F.array(*options), k.cast("int"))
    pages = col(spark, sf_dir, "pages", "page_id", "url", pick(bodies).alias("html"), pick([F.lit(x) for x in kinds]).alias("kind"))
    return jobs.derive(pages, "links", 38).select("page_id", "kind", "outcome", "artifact")


@query(r"""
WITH d AS (SELECT doc_id, text || chr(10) || '[a](https://x.example/' || doc_id || ' "t") ![i](/i.png) <https://y.example/' || doc_id || '>' AS text FROM documents)
SELECT doc_id, array_to_string(list_concat(regexp_extract_all(text, '!?\[[^\]]*\]\(([^\s)]+)(?:\s+["''][^"'']*["''])?\)', 1), regexp_extract_all(text, '(?i)<(https?://[^\s<>]+)>', 1)), ' ') AS links FROM d
""")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit("\n[a](https://x.example/"), "doc_id", F.lit(' "t") ![i](/i.png) <https://y.example/'), "doc_id", F.lit(">"))
    return col(spark, sf_dir, "documents", "doc_id", F.array_join(formats.markdown_links(text), " ").alias("links"))


@query("""
WITH d AS (SELECT doc_id, text || repeat('`', doc_id % 7) AS text FROM documents),
f AS (SELECT doc_id, text, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)) AS fence FROM d)
SELECT doc_id, CAST(length(fence) AS INTEGER) AS fence, sha256(fence || 'md' || chr(10) || text || CASE WHEN suffix(text, chr(10)) THEN '' ELSE chr(10) END || fence || chr(10)) AS sha256 FROM f
""")
def fenced_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = col(spark, sf_dir, "documents", "doc_id", formats.fenced(F.concat("text", F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int"))), "md").alias("f"))
    return rows.select("doc_id", F.length(F.regexp_extract("f", "^(`+)", 1)).alias("fence"), F.sha2("f", 256).alias("sha256"))


@query()
def dom_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = col(spark, sf_dir, "pages", "page_id", markup.parse_dom("html", "url").alias("d"))
    return rows.select("page_id", "d.title", "d.canonical", F.sha2("d.text", 256).alias("text_sha256"), F.sha2("d.markdown", 256).alias("markdown_sha256"), F.size("d.links").alias("links"), F.size("d.metadata").alias("metadata"), F.size("d.jsonld").alias("jsonld"))


PAGE_SCHEMA = {"schema_version": 1, "fields": {"title": {"source": "css", "selector": "title", "take": "text", "required": True, "type": "string"}, "first_link": {"source": "css", "selector": "nav a, a", "take": "@href"}, "paragraphs": {"source": "css", "selector": "body p", "take": "text", "many": True}}}


@query()
def extract_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.extract_job(col(spark, sf_dir, "pages", "page_id", "html"), PAGE_SCHEMA).select("page_id", "data", "missing", "status")


@query(r"""
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 1 THEN ' ' || CAST(event_id AS VARCHAR) || '.50 ' WHEN 2 THEN 'Yes' ELSE 'n/a' END AS raw FROM events)
SELECT event_id, raw, CASE WHEN regexp_matches(trim(raw), '^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$') THEN CAST(trim(raw) AS DOUBLE) END AS number,
  CASE lower(trim(raw)) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'yes' THEN true WHEN 'false' THEN false WHEN '0' THEN false WHEN 'no' THEN false END AS boolean FROM e
""")
def coerce_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.floor("value").cast("string")).when(k == 1, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".50 "))).when(k == 2, "Yes").otherwise("n/a")
    rows = col(spark, sf_dir, "events", "event_id", raw.alias("raw"))
    return rows.select("event_id", "raw", values.coerce_number(F.col("raw")).alias("number"), values.coerce_boolean(F.col("raw")).alias("boolean"))


@query("""
SELECT 'sha256:' || sha256(text) AS hash, octet_length(encode(any_value(text))) AS bytes, count(*) AS copies, min(doc_id) AS first_doc_id, 'objects/sha256/' || left(sha256(text), 2) || '/' || sha256(text) AS path, CASE WHEN octet_length(encode(any_value(text))) > 52428800 THEN 'object_too_large' ELSE 'ok' END AS outcome FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY sha256(text)
""")
def object_store_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.objects(col(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "doc_id")


@query("""
WITH a AS (SELECT 'run' || (doc_id % 50) AS run_id, 'sha256:' || sha256(text) AS hash, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sha256:' || sha256(CAST(doc_id AS VARCHAR)) WHEN doc_id % 3 = 1 THEN 'sha256:' || sha256(text) END AS derived_from FROM documents)
SELECT a.run_id, a.hash, a.doc_id, a.derived_from FROM a WHERE derived_from IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a b WHERE b.run_id = a.run_id AND b.hash = a.derived_from)
""")
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, own = F.col("doc_id") % 3, values.digest(F.col("text"))
    derived = F.when(k == 0, values.digest(F.col("doc_id").cast("string"))).when(k == 1, own)
    rows = col(spark, sf_dir, "documents", F.concat(F.lit("run"), (F.col("doc_id") % 50).cast("string")).alias("run_id"), own.alias("hash"), "doc_id", derived.alias("derived_from"))
    return store.orphans(rows).select("run_id", "hash", "doc_id", "derived_from")


@query("""SELECT page_id, sha256('{"adapter":"native","canonicalUrl":"' || regexp_replace(url, '#.*$', '') || '","decodeLimit":52428800,"format":"markdown","headers":{},"method":"GET","policy":"public"}') AS fingerprint FROM pages""")
def request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col(spark, sf_dir, "pages", "page_id", values.fingerprint(F.col("url")).alias("fingerprint"))


@query("""
WITH c AS (SELECT o_orderkey % 400 AS k, max(o_orderdate) AS expires_at FROM orders GROUP BY 1),
r AS (SELECT event_id AS request_id, event_id * 7 % 500 AS k, ['off', 'use', 'refresh'][event_id % 3 + 1] AS mode, event_id FROM events)
SELECT request_id, mode, CASE WHEN mode = 'off' THEN 'off' WHEN expires_at IS NULL THEN 'miss' WHEN mode = 'use' AND expires_at > TIMESTAMP '1998-07-15' THEN 'hit' WHEN event_id % 5 = 0 THEN 'revalidated' ELSE 'miss' END AS cache_status
FROM r LEFT JOIN c ON r.k = c.k
""")
def cache_lookup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = col(spark, sf_dir, "orders", (F.col("o_orderkey") % 400).alias("fingerprint"), "o_orderdate").groupBy("fingerprint").agg(F.max("o_orderdate").alias("expires_at"))
    events = capture.table(spark, sf_dir, "events")
    requests = events.select(F.col("event_id").alias("request_id"), (F.col("event_id") * 7 % 500).alias("fingerprint"), F.element_at(F.array(*map(F.lit, ["off", "use", "refresh"])), (F.col("event_id") % 3 + 1).cast("int")).alias("mode"))
    now = F.lit("1998-07-15 00:00:00").cast("timestamp_ntz")
    asked = store.cache_lookup(requests, cache, now)
    responses = events.select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 5 == 0, 304).otherwise(200).alias("status_code"))
    rows = store.revalidated(asked, responses)
    return rows.select("request_id", "mode", F.when(F.col("cache_status") == "unexpected_not_modified", "miss").otherwise(F.col("cache_status")).alias("cache_status"))


@query("""
WITH j AS (SELECT 'run' || user_id AS run_id, event_id AS line_no, CASE WHEN event_id % 401 = 0 THEN '{bad' ELSE '{"type":"' || event_type || '"}' END AS raw, event_type, event_id FROM events),
r AS (SELECT DISTINCT 'run' || user_id AS run_id, user_id % 4 = 0 AS has_manifest FROM events)
SELECT r.run_id, CASE WHEN bool_or(raw = '{bad') THEN 'corrupt' ELSE 'incomplete' END AS state, max_by(CASE WHEN raw = '{bad' THEN NULL ELSE event_type END, line_no) FILTER (true) AS last_event_raw, count(*) AS events FROM r JOIN j USING (run_id) WHERE NOT has_manifest GROUP BY r.run_id
""".replace("max_by(CASE WHEN raw = '{bad' THEN NULL ELSE event_type END, line_no) FILTER (true) AS last_event_raw", "CASE WHEN arg_max(raw, line_no) = '{bad' THEN NULL ELSE arg_max(event_type, line_no) END AS last_event"))
def recovery_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = capture.table(spark, sf_dir, "events")
    run_id = F.concat(F.lit("run"), F.col("user_id").cast("string"))
    raw = F.when(F.col("event_id") % 401 == 0, "{bad").otherwise(F.concat(F.lit('{"type":"'), "event_type", F.lit('"}')))
    lines = events.select(run_id.alias("run_id"), F.col("event_id").alias("line_no"), raw.alias("raw"))
    runs = events.select(run_id.alias("run_id"), F.lit(True).alias("has_job"), (F.col("user_id") % 4 == 0).alias("has_manifest")).distinct()
    return store.recovery(runs, lines)


@query("""
WITH m AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['?code=1&x=2', '?x=2', '', '?a=1&password=z#f'][page_id % 4 + 1] AS url FROM pages)
SELECT page_id, regexp_replace(regexp_replace(url, 'code=1', 'code=%5Bredacted%5D'), 'password=z', 'password=%5Bredacted%5D') AS redacted FROM m
""")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.array(*map(F.lit, ["?code=1&x=2", "?x=2", "", "?a=1&password=z#f"]))
    rows = col(spark, sf_dir, "pages", "page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.element_at(tails, (F.col("page_id") % 4 + 1).cast("int"))).alias("url"))
    return rows.select("page_id", values.redact_query(F.col("url")).alias("redacted"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, [200, 204, 301, 304, 401, 402, 403, 404, 408, 410, 418, 425, 429, 500, 502, 503, 504, 505][(l_orderkey * 7 + l_linenumber) % 18 + 1] AS status FROM lineitem),
o AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 OR status = 304 THEN 'success' WHEN status IN (408, 425, 429, 500, 502, 503, 504) THEN 'retryable' ELSE 'terminal' END AS kind,
  CASE WHEN status BETWEEN 200 AND 299 OR status = 304 THEN 'ok' WHEN status = 401 THEN 'auth_required' WHEN status = 402 THEN 'paid_required' WHEN status = 404 THEN 'not_found' WHEN status = 410 THEN 'gone' WHEN status = 429 THEN 'rate_limited'
    WHEN status IN (408, 425, 500, 502, 503, 504) THEN 'http_5xx' ELSE 'access_denied' END AS code FROM s)
SELECT status, kind, code, CASE WHEN kind = 'success' THEN 'ok' WHEN code IN ('not_found', 'gone') THEN 'exhausted' WHEN kind = 'terminal' THEN 'blocked' ELSE 'exhausted' END AS run_status,
  CASE WHEN kind = 'success' THEN 0 WHEN code IN ('not_found', 'gone') THEN 4 WHEN kind = 'terminal' THEN 5 ELSE 4 END AS exit_code, count(*) AS n FROM o GROUP BY ALL
""")
def http_status_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, [200, 204, 301, 304, 401, 402, 403, 404, 408, 410, 418, 425, 429, 500, 502, 503, 504, 505]))
    rows = col(spark, sf_dir, "lineitem", F.element_at(codes, ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 18 + 1).cast("int")).alias("status"))
    counted = rows.groupBy("status").agg(F.count("*").alias("n"))
    kind, code = contracts.status_outcome(F.col("status"))
    out = counted.withColumn("kind", kind).withColumn("code", code).withColumn("run_status", contracts.run_status(F.col("kind"), F.col("code")))
    return out.withColumn("exit_code", contracts.exit_code(F.col("run_status"), F.lit(None).cast("string"))).select("status", "kind", "code", "run_status", "exit_code", "n")


CODES = [c for codes in contracts.CODE_KINDS.values() for c in codes]
KIND_CASE = " ".join(f"WHEN code IN ({', '.join(repr(c) for c in codes)}) THEN '{k}'" for k, codes in contracts.CODE_KINDS.items())


@query(f"""
WITH e AS (SELECT event_id AS n, {CODES} AS codes, {list(contracts.CODE_KINDS)} AS kinds FROM events),
c AS (SELECT n AS event_id, codes[n % len(codes) + 1] AS code, kinds[n // len(codes) % len(kinds) + 1] AS kind, CAST(n // (len(codes) * len(kinds)) % 2 AS INTEGER) AS retries_left, n // (2 * len(codes) * len(kinds)) % 2 = 0 AS has_next FROM e),
x AS (SELECT *, CASE {KIND_CASE} END = kind AS fits, code IN ('not_found', 'gone') AS lost FROM c),
a AS (SELECT *, CASE WHEN NOT fits THEN 'stop' WHEN kind = 'retryable' AND retries_left > 0 THEN 'retry_same' WHEN (kind IN ('skip', 'inadequate') OR kind = 'retryable' AND code <> 'rate_limited') AND has_next THEN 'next' ELSE 'stop' END AS action FROM x)
SELECT event_id, code, kind, retries_left, has_next, action,
  CASE WHEN NOT fits THEN 'internal_error' WHEN action <> 'stop' THEN NULL WHEN kind = 'success' THEN 'ok' WHEN kind IN ('skip', 'inadequate') OR lost OR kind = 'retryable' AND code <> 'rate_limited' THEN 'exhausted' WHEN kind IN ('retryable', 'terminal') THEN 'blocked' ELSE 'internal_error' END AS status,
  CASE WHEN NOT fits THEN 'unknown_attempt_code' WHEN action <> 'stop' THEN code WHEN kind IN ('skip', 'inadequate') OR kind = 'retryable' AND code <> 'rate_limited' THEN 'exhausted' ELSE code END AS out_code FROM a
""")
def transition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows attempts whose kinds, codes and surroundings go through all combinations."""
    n, codes, kinds = F.col("event_id"), F.array(*map(F.lit, CODES)), F.array(*map(F.lit, contracts.CODE_KINDS))
    at = lambda options, k: F.get(options, k.cast("int"))
    whole = len(CODES) * len(contracts.CODE_KINDS)
    rows = col(spark, sf_dir, "events", n, at(codes, n % len(CODES)).alias("code"), at(kinds, F.floor(n / len(CODES)) % len(contracts.CODE_KINDS)).alias("kind"), (F.floor(n / whole) % 2).cast("int").alias("retries_left"), (F.floor(n / (2 * whole)) % 2 == 0).alias("has_next"))
    step = contracts.transition(F.col("kind"), F.col("code"), F.col("retries_left"), F.col("has_next"))
    return rows.select("event_id", "code", "kind", "retries_left", "has_next", *[c.alias(k) for k, c in step.items()])


EVENT_KIND = "CASE event_type WHEN 'error' THEN 'retryable' WHEN 'signup' THEN 'retryable' WHEN 'view' THEN 'retryable' ELSE 'success' END"
EVENT_CODE = "CASE event_type WHEN 'error' THEN 'http_5xx' WHEN 'signup' THEN 'rate_limited' WHEN 'view' THEN 'network' ELSE 'ok' END"


def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return col(spark, sf_dir, "events", "user_id", F.col("event_id").alias("seq"), F.expr(EVENT_KIND).alias("kind"), F.expr(EVENT_CODE).alias("code"), F.floor(F.abs("value")).cast("long").alias("duration_ms"), (F.col("event_id") % 7 * 10_000).alias("retry_after_ms"))


@query(f"""
WITH e AS (SELECT user_id, event_id AS seq, {EVENT_KIND} AS kind, {EVENT_CODE} AS code, event_id % 7 * 10000 AS retry_after_ms FROM events),
n AS (SELECT *, row_number() OVER w AS attempt, sum(CASE WHEN code = 'rate_limited' THEN 1 ELSE 0 END) OVER w AS limited FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, kind = 'retryable' AND attempt <= 2 AND (code <> 'rate_limited' OR limited <= 1) AS again FROM n),
f AS (SELECT user_id, min(attempt) AS stop FROM a WHERE NOT again GROUP BY user_id)
SELECT user_id, seq, CAST(attempt AS INTEGER) AS attempt, code, CASE WHEN again AND code = 'rate_limited' THEN least(retry_after_ms, 30000) ELSE 0 END AS delay_ms, again AND code = 'rate_limited' AND retry_after_ms > 30000 AS capped, NOT again AS last
FROM a LEFT JOIN f USING (user_id) WHERE stop IS NULL OR attempt <= stop
""")
def retry_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.native_timelines(attempt_events(spark, sf_dir), ["user_id"])


def sql_timeline(order: str, columns: str) -> str:
    """The retry state machine by recursion over a job's attempts, four of them at most: two retries end it before."""
    step = """SELECT e.user_id, e.n, p.clock AS started, e.code, p.retries, p.limited, e.ra,
      p.clock + greatest(0, least(e.d, 15000, 60000 - p.clock)) AS finish,
      e.kind = 'retryable' AND p.retries < 2 AND CASE WHEN e.code = 'rate_limited' THEN p.limited < 1 ELSE e.code IN ('network', 'timeout', 'http_5xx') END AS again
    FROM p JOIN e ON e.user_id = p.user_id AND e.n = p.n + 1 WHERE p.outcome IS NULL"""
    return f"""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS n, {EVENT_KIND} AS kind, {EVENT_CODE} AS code, CAST(floor(abs(value)) AS BIGINT) AS d, event_id % 7 * 10000 AS ra FROM events),
p(user_id, n, started, duration, code, delay, capped, clock, retries, limited, outcome) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), 0, 0, CAST(NULL AS VARCHAR) FROM e
  UNION ALL
  SELECT user_id, n, started, finish - started, code, CASE WHEN goes_on THEN asked ELSE 0 END, goes_on AND asked < ra AND code = 'rate_limited', finish + CASE WHEN goes_on THEN asked ELSE 0 END, retries + CASE WHEN goes_on THEN 1 ELSE 0 END,
    limited + CASE WHEN goes_on AND code = 'rate_limited' THEN 1 ELSE 0 END, CASE WHEN NOT again THEN code WHEN NOT goes_on THEN 'hard_limit' END
  FROM (SELECT *, again AND finish + asked < 60000 AS goes_on FROM (SELECT *, CASE WHEN code = 'rate_limited' THEN least(ra, 30000) ELSE 0 END AS asked FROM ({step}))))
SELECT user_id, CAST(n AS INTEGER) AS attempt, started AS started_ms, duration AS duration_ms, code, delay AS delay_ms, capped{columns} FROM p WHERE n > 0
"""


@query(sql_timeline("event_id", ", coalesce(max_by(outcome, n) OVER (PARTITION BY user_id), 'interrupted') AS outcome"))
def retry_timeline_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the clock: wall deadline and per-attempt limits cut jobs short."""
    return retry.timelines(attempt_events(spark, sf_dir), ["user_id"])


ROBOTS = b"User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\nCrawl-delay: 0.25\n"


@query(r"""
WITH r(rule_no, allow, pattern, re, spec) AS (VALUES (0, false, '/en/', '^/en/', 4), (1, true, '/en/1', '^/en/1', 5), (2, false, '/*.html$', '^/.*\.html$', 6)),
p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
b AS (SELECT page_id, allow, pattern, spec, row_number() OVER (PARTITION BY page_id ORDER BY spec DESC, allow DESC, rule_no) AS k FROM p JOIN r ON regexp_matches(path, re))
SELECT p.page_id, coalesce(allow, true) AS allowed, pattern, spec AS specificity FROM p LEFT JOIN b ON p.page_id = b.page_id AND k = 1
""")
def robots_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("any", 200, bytearray(ROBOTS))], "origin string, status int, body binary")
    rules = robots.rules_table(robots.parsed(files, "tracewell/1.0")).drop("origin")
    pages = col(spark, sf_dir, "pages", "page_id", urls.plain_parts(F.col("url"))["path"].alias("path"))
    return robots.decide(pages, rules, "page_id")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN regexp_matches(path, '^/[^/]*/1.*$') THEN 'excluded' WHEN NOT regexp_matches(path, '^/en/.*$|^/de/[^/]*$') THEN 'not_included' END AS reason FROM p
""")
def scope_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = urls.plain_parts(F.col("url"))["path"]
    return col(spark, sf_dir, "pages", "page_id", path.alias("path")).withColumn("reason", crawl.scope_reason(F.col("path"), ["/en/**", "/de/*"], ["/*/1**"]))


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = capture.table(spark, sf_dir, "pages")
    n = pages.count()
    i = F.col("page_id")
    to = F.explode(F.array((i * 7 + 3) % n, (i * 13 + 5) % n, (i * i + 1) % n))
    return pages.select(i.alias("src"), to.alias("dst"))


GRAPH = "n AS (SELECT count(*) AS n FROM pages), e AS (SELECT DISTINCT page_id AS src, unnest([(page_id * 7 + 3) % n, (page_id * 13 + 5) % n, (page_id * page_id + 1) % n]) AS dst FROM pages, n)"
WALK = f"RECURSIVE {GRAPH}, w AS (SELECT CAST(0 AS BIGINT) AS url, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 4), v AS (SELECT url, min(depth) AS depth FROM w GROUP BY url)"


@query(f"WITH {WALK} SELECT url, depth FROM v")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.bfs(link_graph(spark, sf_dir), spark.createDataFrame([(0,)], "url long"), 4)


@query(f"""
WITH {WALK}, o AS (SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS k FROM v)
SELECT CASE WHEN k > 40 THEN 'unvisited' WHEN url % 11 = 0 THEN 'blocked' WHEN url % 13 = 0 THEN 'failed' ELSE 'accepted' END AS state, url, depth, CASE WHEN k > 40 THEN 'max_pages' WHEN url % 11 = 0 THEN 'robots_denied' WHEN url % 13 = 0 THEN 'not_found' END AS reason FROM o
UNION ALL SELECT 'skipped', dst, v.depth + 1, 'duplicate' FROM v JOIN e ON e.src = v.url JOIN v x ON x.url = e.dst WHERE v.depth < 4 AND x.depth <= v.depth
""")
def crawl_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    edges = link_graph(spark, sf_dir).distinct()
    seen = crawl.bfs(edges, spark.createDataFrame([(0,)], "url long"), 4)
    # The pages that the crawl takes are a top-k; what comes after them needs no order.
    taken = seen.orderBy("depth", "url").limit(40).select("url", F.lit(True).alias("taken"))
    rows = seen.join(F.broadcast(taken), "url", "left")
    u = F.col("url")
    rows = rows.withColumn("state", F.when(F.col("taken").isNull(), "unvisited").when(u % 11 == 0, "blocked").when(u % 13 == 0, "failed").otherwise("accepted"))
    part = lambda state, reason: rows.where(F.col("state") == state).select("url", "depth", F.lit(reason).cast("string").alias("reason"))
    again = seen.where("depth < 4").join(edges, F.col("url") == F.col("src")).select("dst", F.col("depth").alias("at")).join(seen.select(F.col("url").alias("dst"), "depth"), "dst").where("depth <= at")
    skipped = again.select(F.col("dst").alias("url"), (F.col("at") + 1).alias("depth"), F.lit("duplicate").alias("reason"))
    return crawl.ledger(part("accepted", None), skipped, part("blocked", "robots_denied"), part("failed", "not_found"), part("unvisited", "max_pages"))


@query()
def crawl_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls of every origin in exact order: its pages link to the next ones of the origin."""
    from pyspark.sql import Window

    n = F.col("page_id")
    pages = col(spark, sf_dir, "pages", urls.plain_parts(F.col("url"))["origin"].alias("origin"), n.alias("url"), F.octet_length("html").cast("long").alias("bytes"))
    w = Window.partitionBy("origin").orderBy("url")
    rows = pages.withColumn("links", F.array_compact(F.array(*[F.lead("url", k).over(w) for k in (1, 2, 3)]))).withColumn("seed", F.min("url").over(Window.partitionBy("origin")))
    n = F.col("url")
    rows = rows.withColumns({"robots": n % 7 != 0, "kind": F.when(n % 11 == 0, "terminal").otherwise("success"), "code": F.when(n % 11 == 0, "gone").otherwise("ok"), "delay_ms": n % 3 * 100, "retries": n % 2, "redirects": F.lit(0).cast("long")})
    return crawl.crawl_exact(rows, ["origin"], {"pages": 5, "depth": 3, "frontier": 6, "bytes": 60_000, "wall_ms": 60_000, "delay_ms": 250, "concurrency": 2, "retries": 3, "redirects": 3})


SITE_ROBOTS = b"User-agent: *\nDisallow: /t\nDisallow: /*s$\nAllow: /the\nCrawl-delay: 0.1\n"


@query(r"""
WITH p AS (SELECT regexp_replace(url, '#.*$', '') AS url, max_by(html, page_id) AS html, any_value(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin FROM pages GROUP BY 1),
s AS (SELECT origin, min(url) AS seed FROM p GROUP BY origin),
r AS (SELECT s.origin, seed, CASE WHEN length(s.origin) % 5 = 0 THEN 'deny' WHEN length(s.origin) % 2 = 0 THEN 'rules' ELSE 'allow' END AS policy, html FROM s JOIN p ON p.url = s.seed),
l AS (SELECT origin, seed, policy, list_sort(list_distinct(list_transform(regexp_extract_all(html, '<a href="([^"]*)">', 1), lambda x: origin || array_to_string(list_transform(string_split(x, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE url_encode(c) END), '')))) AS links FROM r WHERE policy <> 'deny'),
q AS (SELECT origin, policy, unnest(links) AS url, generate_subscripts(links, 1) AS pos FROM l),
d AS (SELECT *, policy = 'rules' AND NOT starts_with(url, origin || '/the') AND (starts_with(url, origin || '/t') OR suffix(url, 's')) AS denied FROM q),
a AS (SELECT *, coalesce(sum(CASE WHEN denied THEN 0 ELSE 1 END) OVER (PARTITION BY origin ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE pos <= 4)
SELECT origin, seed AS url, 0 AS depth, CASE WHEN policy = 'deny' THEN 'blocked' ELSE 'accepted' END AS state, CASE WHEN policy = 'deny' THEN 'robots_denied' END AS reason FROM r
UNION ALL SELECT origin, url, 1, CASE WHEN before > 2 OR before = 2 AND NOT denied THEN 'unvisited' ELSE 'blocked' END, CASE WHEN before > 2 OR before = 2 AND NOT denied THEN 'max_pages' WHEN denied THEN 'robots_denied' ELSE 'not_found' END FROM a
UNION ALL SELECT origin, url, 1, 'unvisited', 'max_frontier' FROM d WHERE pos > 4
""")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls from the first page of every origin along the links of captured pages, with robots files and limits."""
    site = shared.cut(jobs.crawl_site(capture.table(spark, sf_dir, "pages")))
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    seeds = shared.cut(site.groupBy(origin.alias("crawl")).agg(F.min("url").alias("seed")))
    n = F.length("crawl")
    files = seeds.select(F.col("crawl").alias("origin"), F.when(n % 5 == 0, 503).when(n % 2 == 0, 200).otherwise(404).alias("status"), F.lit(bytearray(SITE_ROBOTS)).alias("body"))
    limits = {"pages": 3, "depth": 3, "frontier": 4, "bytes": 50 << 20, "wall_ms": 60_000, "delay_ms": 250, "concurrency": 2, "retries": 1, "redirects": 5}
    rules = shared.cut(robots.parsed(files, "tracewell/1.0"))
    rows = crawl.crawl_on_demand(seeds, site, lambda u: robots.gate(u, rules), limits)
    return rows.select(F.col("crawl").alias("origin"), "url", "depth", "state", "reason")


@query(rf"""
WITH p AS (SELECT *, CASE WHEN page_id % 5 = 3 THEN 404 ELSE 200 END AS status, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages)
SELECT origin, count(*) AS responses, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, min(sha256(html)) AS first_sha256, CAST(count(*) FILTER (page_id % 2 = 0) AS BIGINT) AS tagged FROM p WHERE status = 200 AND starts_with(url, 'https://') GROUP BY origin
""")
def response_pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captured responses, packed and read again under pushed filters, with their digests checked."""
    packs.register(spark)
    folder = f"{shared.shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    k = F.col("page_id")
    tag = F.when(k % 2 == 0, F.create_map(F.lit("etag"), k.cast("string"))).otherwise(F.create_map(F.lit("server"), F.lit("s")))
    col(spark, sf_dir, "pages", "url", F.when(k % 5 == 3, 404).otherwise(200).alias("status"), tag.alias("headers"), F.encode("html", "utf-8").alias("body"), F.lit(None).cast("string").alias("sha256"), F.lit(True).alias("intact")).write.format("response_pack").mode("append").save(folder)
    rows = spark.read.format("response_pack").option("splitBytes", 1 << 20).load(folder).where("status = 200 AND url LIKE 'https://%'")
    return rows.where("intact").groupBy(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("origin")).agg(F.count("*").alias("responses"), F.sum(F.octet_length("body")).alias("bytes"), F.min(F.sha2("body", 256)).alias("first_sha256"), F.count_if(F.col("headers")["etag"].isNotNull()).alias("tagged"))


@query("""
WITH n AS (SELECT 'sha256:' || sha256(coalesce(text, '')) AS hash, any_value(octet_length(encode(coalesce(text, '')))) AS bytes, min(doc_id) AS first FROM documents GROUP BY 1),
s AS (SELECT 'sha256:' || sha256(coalesce(text, '')) AS hash, any_value(octet_length(encode(coalesce(text, '')))) AS bytes, bool_or(doc_id % 9 = 0) AS odd FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT hash, CASE WHEN s.hash IS NULL THEN 'fresh' ELSE 'corrupt' END AS state FROM n LEFT JOIN s USING (hash) WHERE s.hash IS NULL OR odd
""")
def object_store_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into a store that holds a third of them, some of another size: what is new, and what is corrupt."""
    docs = col(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.select(values.digest(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("bytes"), (F.col("doc_id") % 3 == 0).alias("in_store"), (F.col("doc_id") % 9 == 0).alias("odd")).where("in_store")
    stored = stored.groupBy("hash").agg(F.max(F.col("bytes") + F.col("odd").cast("long")).alias("bytes"))
    blocks = bloom.blocks_for(docs.count())
    fresh, corrupt = store.put(store.objects(docs, "text", "doc_id"), stored, bloom.filter_of(stored, "hash", blocks), blocks)
    return fresh.select("hash", F.lit("fresh").alias("state")).unionByName(corrupt.select("hash", F.lit("corrupt").alias("state")))


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages (origin, page_id, url) and the files (origin, url, body) that list them: an index of a sitemap and another
    index, which lists an Atom feed, an RSS feed and the first index again."""
    url = F.regexp_replace("url", "#.*$", "")
    pages = col(spark, sf_dir, "pages", "page_id", url.alias("url"), F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("origin"))
    pages = pages.groupBy("origin", "url").agg(F.min("page_id").alias("page_id"))
    shown = F.replace("url", F.lit("&"), F.lit("&amp;"))
    part = lambda k, open_, shut: F.array_join(F.sort_array(F.collect_list(F.when(F.col("page_id") % 3 == k, F.concat(F.lit(open_), shown, F.lit(shut))))), "")
    o = F.col("origin")
    lists = pages.groupBy("origin").agg(part(0, "<url><loc>", "</loc></url>").alias("urls"), part(1, '<entry><link href="', '"/></entry>').alias("entries"), part(2, "<item><link>", "</link></item>").alias("items"))
    maps = lambda *names: F.concat(*[F.concat(F.lit("<sitemap><loc>"), o, F.lit(f"/{n}</loc></sitemap>")) for n in names])
    around = lambda root, inner, extra="": F.concat(F.lit(f'<?xml version="1.0"?><{root}{extra}>'), inner, F.lit(f"</{root}>"))
    schema = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    files = {"sitemap.xml": around("sitemapindex", maps("map.xml", "more.xml"), schema), "more.xml": around("sitemapindex", maps("atom.xml", "rss.xml", "sitemap.xml"), schema), "map.xml": around("urlset", F.col("urls"), schema),
             "atom.xml": around("feed", F.col("entries"), ' xmlns="http://www.w3.org/2005/Atom"'), "rss.xml": around("rss", F.concat(F.lit("<channel><title>t</title>"), "items", F.lit("</channel>")), ' version="2.0"')}
    rows = lists.select("origin", F.explode(F.array(*[F.struct(F.concat(o, F.lit(f"/{n}")).alias("url"), b.alias("body")) for n, b in files.items()])).alias("f"))
    return pages, rows.select("origin", "f.*")


LISTED_PAGES = "SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_replace(url, '#.*$', '') AS url, min(page_id) % 3 AS k FROM pages GROUP BY ALL"


@query(f"""
WITH p AS ({LISTED_PAGES})
SELECT origin, url, CASE WHEN k = 0 THEN 2 ELSE 3 END AS depth, origin || ['/map.xml', '/atom.xml', '/rss.xml'][k + 1] AS source FROM p
""")
def discover_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found through indexes, sitemaps and feeds, level by level, past an index that lists itself."""
    _, files = listings(spark, sf_dir)
    starts = files.where("url LIKE '%/sitemap.xml'").select(F.col("origin").alias("crawl"), "url")
    return discovery.follow(starts, files, 5).withColumnRenamed("crawl", "origin")


@query(f"""
WITH p AS ({LISTED_PAGES}), s AS (SELECT origin, min(url) AS seed FROM p GROUP BY origin),
f(name, depth, state, reason) AS (VALUES ('/sitemap.xml', 1, 'accepted', NULL), ('/map.xml', 2, 'accepted', NULL), ('/more.xml', 2, 'accepted', NULL), ('/atom.xml', 3, 'accepted', NULL), ('/rss.xml', 3, 'accepted', NULL), ('/sitemap.xml', 3, 'skipped', 'duplicate'))
SELECT origin, seed AS url, 0 AS depth, 'accepted' AS state, NULL AS reason FROM s
UNION ALL SELECT s.origin, s.origin || name, depth, state, reason FROM s, f
UNION ALL SELECT origin, url, CASE WHEN k = 0 THEN 3 ELSE 4 END, CASE WHEN url = seed THEN 'skipped' ELSE 'accepted' END, CASE WHEN url = seed THEN 'duplicate' END FROM p JOIN s USING (origin)
""")
def crawl_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls that find their pages by the sitemaps of robots files only, four levels deep."""
    pages, files = listings(spark, sf_dir)
    body = F.concat(F.lit("<!DOCTYPE html><html><body><p>page "), F.col("page_id").cast("string"), F.lit("</p></body></html>"))
    captured = pages.select("page_id", "url", body.alias("html")).unionByName(files.select(F.lit(0).cast("long").alias("page_id"), "url", F.col("body").alias("html")))
    site = shared.cut(jobs.crawl_site(captured, sources=("sitemap",)))
    seeds = shared.cut(pages.groupBy(F.col("origin").alias("crawl")).agg(F.min("url").alias("seed")))
    text = F.concat(F.lit("User-agent: *\nDisallow:\nSitemap: "), "crawl", F.lit("/sitemap.xml\n"))
    rules = shared.cut(robots.parsed(seeds.select(F.col("crawl").alias("origin"), F.lit(200).alias("status"), text.cast("binary").alias("body")), "tracewell/1.0"))
    rows = crawl.crawl_whole(seeds, site, lambda u: robots.gate(u, rules, sitemaps=True), 4)
    return rows.select(F.col("crawl").alias("origin"), "url", "depth", "state", "reason")


@query("""
WITH a AS (SELECT s_suppkey, CAST(s_suppkey % 200 AS VARCHAR) AS d FROM supplier)
SELECT s_suppkey, s_suppkey % 3 <> 1 AS matches, CASE s_suppkey % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'bytes' WHEN 2 THEN 'redirects' END AS fault, CASE WHEN s_suppkey % 4 = 0 THEN 'secret_query' WHEN s_suppkey % 4 = 1 THEN 'unsafe_header' END AS fingerprint FROM a
""")
def edge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers, network intents and fingerprint inputs."""
    k = F.col("s_suppkey")
    d = (k % 200).cast("string")
    peer = F.when(k % 3 == 0, F.concat(F.lit("::ffff:10.0.0."), d)).when(k % 3 == 1, "10.1.1.1").otherwise(F.concat(F.lit("10.0.0."), d))
    url = F.concat(F.lit("https://a.com/?q=1"), F.when(k % 4 == 0, "&code=2").otherwise("&tokens=3"))
    headers = F.create_map(F.when(k % 4 == 1, "x-session-id").otherwise("accept"), F.lit("v"))
    rows = col(spark, sf_dir, "supplier", "s_suppkey", F.concat(F.lit("10.0.0."), d).alias("selected"), peer.alias("peer"))
    fault = admission.intent_fault(F.when(k % 5 == 0, "POST").otherwise("get"), F.when(k % 5 == 1, 0).otherwise(10), F.lit(5), F.when(k % 5 == 2, 21).otherwise(5))
    return rows.select("s_suppkey", admission.peer_matches(F.col("selected"), F.col("peer")).alias("matches"), fault.alias("fault"), admission.fingerprint_fault(url, headers).alias("fingerprint"))


@query("""
WITH m AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 6 = 0 THEN 'blocked' ELSE 'ok' END AS status, o_custkey AS fingerprint, o_orderdate AS fetched_at FROM orders WHERE o_orderkey % 5 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY fetched_at DESC, run_id DESC) AS n FROM m WHERE status = 'ok')
SELECT fingerprint, run_id, fetched_at + INTERVAL 3600 SECOND AS expires_at FROM k WHERE n = 1
""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that are written once become cache rows, of which the last one of each fingerprint stays."""
    k = F.col("o_orderkey")
    new = col(spark, sf_dir, "orders", k.alias("run_id"), F.when(k % 6 == 0, "blocked").otherwise("ok").alias("status"), F.col("o_custkey").alias("fingerprint"), F.lit("s").alias("source_hash"), F.lit("a").alias("artifact_hash"), F.col("o_orderdate").alias("fetched_at"), F.lit(None).cast("timestamp_ntz").alias("revalidated_at"))
    fresh = store.commit_manifests(new, new.where("run_id % 10 = 0"), new.where("run_id % 10 = 5"))
    rows = store.cache_records(fresh, 3_600_000)
    return store.latest(rows, "fingerprint", [F.desc("fetched_at"), F.desc("run_id")]).select("fingerprint", "run_id", "expires_at")


LEDGER = "SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'skipped' ELSE 'accepted' END WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'skipped' WHEN 'signup' THEN 'failed' ELSE 'unvisited' END AS state, CASE event_type WHEN 'error' THEN 'reason_' || (event_id % 3) END AS reason FROM events"


@query(f"""
WITH l AS ({LEDGER}), c AS (SELECT run_id, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'blocked') AS blocked, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'unvisited') AS unvisited,
  min_by(reason, seq) FILTER (state = 'blocked') AS blocked_code FROM l GROUP BY run_id)
SELECT *, CASE WHEN accepted > 0 THEN CASE WHEN blocked + failed + unvisited > 0 THEN 'partial' ELSE 'ok' END WHEN blocked > 0 THEN 'blocked' ELSE 'exhausted' END AS status FROM c
""")
def crawl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = capture.table(spark, sf_dir, "events"), F.col("event_type")
    state = F.when((t == "click") & (F.col("user_id") % 3 == 0), "skipped").when(t == "click", "accepted").when(t == "error", "blocked").when(t == "view", "skipped").when(t == "signup", "failed").otherwise("unvisited")
    rows = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), state.alias("state"), F.when(t == "error", F.concat(F.lit("reason_"), (F.col("event_id") % 3).cast("string"))).alias("reason"))
    return crawl.crawl_status(rows, ["run_id"], "seq")


ORIGIN_PAGES = "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, octet_length(encode(html)) AS bytes FROM pages"


@query(f"""
WITH p AS ({ORIGIN_PAGES}), t AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY origin ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM p)
SELECT page_id, origin, bytes, total, CASE WHEN total <= 20000 THEN 'accepted' WHEN total - bytes <= 20000 THEN 'blocked' ELSE 'unvisited' END AS state FROM t
""")
def byte_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = col(spark, sf_dir, "pages", "page_id", urls.plain_parts(F.col("url"))["origin"].alias("origin"), F.octet_length("html").cast("long").alias("bytes"))
    return crawl.byte_budget(pages, ["origin"], "page_id", "bytes", 20_000)


@query(f"""
WITH p AS ({ORIGIN_PAGES}), t AS (SELECT page_id, origin, page_id % 4 <> 0 AS allowed, CAST(sum(CASE WHEN page_id % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS nth FROM p)
SELECT *, CASE WHEN NOT allowed AND nth <= 3 THEN 'blocked' WHEN nth <= 3 THEN 'accepted' ELSE 'unvisited' END AS state FROM t
""")
def page_limit_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = col(spark, sf_dir, "pages", "page_id", urls.plain_parts(F.col("url"))["origin"].alias("origin"), (F.col("page_id") % 4 != 0).alias("allowed"))
    return crawl.page_limit(pages, ["origin"], "page_id", "allowed", 3)


@query(f"""
WITH p AS ({ORIGIN_PAGES}), d AS (SELECT page_id, origin, greatest(250, page_id % 5 * 200) AS delay_ms FROM p),
s AS (SELECT *, CAST(coalesce(sum(delay_ms) OVER (PARTITION BY origin ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM d)
SELECT *, CASE WHEN start_ms >= 2000 THEN 'max_time' END AS reason FROM s
""")
def politeness_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = col(spark, sf_dir, "pages", "page_id", urls.plain_parts(F.col("url"))["origin"].alias("origin"), F.greatest(F.lit(250).cast("long"), F.col("page_id") % 5 * 200).alias("delay_ms"))
    return crawl.schedule(pages, ["origin"], "page_id", "delay_ms", 2000)


@query("""
WITH RECURSIVE q AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, page_id AS seq, row_number() OVER (PARTITION BY regexp_extract(url, '^(https?://[^/?#]+)', 1) ORDER BY page_id) - 1 AS k, page_id % 3 * 100 AS ready, page_id % 5 * 200 AS gap, page_id % 2 AS want FROM pages),
s(origin, seq, k, start_ms, offered, used, gap, budget, late) AS (
  SELECT origin, seq, k, ready, CAST(3 AS BIGINT), CASE WHEN ready >= 5000 THEN 0 ELSE want END, gap, 3 - want, ready >= 5000 FROM q WHERE k = 0
  UNION ALL
  SELECT origin, seq, k, start_ms, offered, used, gap, budget - used, start_ms >= 5000 FROM (
    SELECT *, CASE WHEN late OR start_ms >= 5000 THEN 0 ELSE least(offered, want) END AS used FROM (
      SELECT q.origin, q.seq, q.k, CASE WHEN s.late THEN s.start_ms ELSE greatest(q.ready, s.start_ms + greatest(250, s.gap)) END AS start_ms, CASE WHEN s.late OR q.k % 2 = 1 THEN 0 ELSE s.budget END AS offered, q.want, q.gap, s.budget, s.late
      FROM s JOIN q ON q.origin = s.origin AND q.k = s.k + 1)))
SELECT origin, seq, start_ms, offered, used AS retries_used, CASE WHEN late THEN 'max_time' END AS reason FROM s
""")
def politeness_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    pages = col(spark, sf_dir, "pages", urls.plain_parts(F.col("url"))["origin"].alias("origin"), n.alias("seq"), (n % 3 * 100).alias("ready_ms"), (n % 5 * 200).alias("delay_ms"), (n % 2).alias("want_retries"))
    return crawl.exact_schedule(pages, ["origin"], 3, 5000, 250, 2)


@query("""
WITH r AS (SELECT page_id % 20 AS run_id, page_id AS pos, CASE WHEN page_id % 6 = 0 THEN NULL ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' END AS canonical FROM pages),
c AS (SELECT *, CASE WHEN canonical IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY run_id, canonical ORDER BY pos) > 1 THEN 'duplicate' ELSE 'allowed' END AS state FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rank FROM c WHERE state = 'allowed')
SELECT run_id, pos, canonical, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5
""")
def search_normalize_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(search_rows(spark, sf_dir), ["run_id"], "pos", 5).select("run_id", "pos", "canonical", "rank")


@query(f"""
WITH w AS (SELECT page_id AS page, unnest(list_filter(regexp_split_to_array(lower({TEXT}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS term FROM pages),
t AS (SELECT page, term, count(*) AS tf FROM w GROUP BY ALL),
i AS (SELECT t.page, t.term, least(1000, (SELECT 10 * count(*) FROM pages) // df) * (100 * tf // (tf + 1)) AS impact FROM t JOIN (SELECT term, count(*) AS df FROM t GROUP BY term) USING (term)),
q AS (SELECT page_id AS query, unnest(list_distinct(list_filter(regexp_split_to_array(lower({TITLE}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) AS term FROM pages WHERE page_id % 10 = 0),
s AS (SELECT query, page, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS INTEGER) AS rank, page, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, page) <= 10
""")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best pages for the title of every tenth page, by an index whose bounds skip most lists."""
    pages = capture.table(spark, sf_dir, "pages")
    asked = shared.cut(pages.where("page_id % 10 = 0").select(F.col("page_id").alias("query"), formats.html_title(F.col("html")).alias("text")))
    index = search_index.built(pages, formats.html_text(F.col("html")), asked=asked)
    return search_index.best(asked, index, 10)[0]


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    rows = col(spark, sf_dir, "pages", (n % 20).alias("run_id"), n.alias("pos"), "url")
    canonical = F.when(F.col("pos") % 6 != 0, F.concat(urls.plain_parts(F.col("url"))["origin"], F.lit("/")))
    return search.candidates(rows, ["run_id"], "pos", canonical)


@query("""
WITH r AS (SELECT page_id % 20 AS run_id, page_id AS pos, CASE WHEN page_id % 6 = 0 THEN NULL ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' END AS canonical FROM pages),
c AS (SELECT *, CASE WHEN canonical IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY run_id, canonical ORDER BY pos) > 1 THEN 'duplicate' ELSE 'allowed' END AS state FROM r)
SELECT run_id, count(*) FILTER (state = 'allowed') AS allowed, concat_ws(',', CASE WHEN count(*) FILTER (state = 'invalid') > 0 THEN 'search_candidate_private_or_invalid:' || count(*) FILTER (state = 'invalid') END, CASE WHEN count(*) FILTER (state = 'duplicate') > 0 THEN 'search_candidate_duplicate:' || count(*) FILTER (state = 'duplicate') END) AS warnings FROM c GROUP BY run_id
""")
def search_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.warnings(search_rows(spark, sf_dir), ["run_id"])


CAPABILITIES = ", ".join(f"({k}, '{i}', '{s}', '{r}', {str(a).lower()}, {c}, '{m}', {'NULL' if p is None else p}, '{n}')" for k, (i, s, r, a, c, m, p, n) in enumerate(cost.REGISTRY))


@query(f"""
WITH c(ord, id, state, reason, automatic, commands, cost, price, model) AS (VALUES {CAPABILITIES}),
ready AS (SELECT ord, id, CASE WHEN id IN ('native', 'playwright') THEN 'ready' ELSE state END AS state, reason, automatic, commands, cost, price, model FROM c),
j AS (SELECT p_partkey AS job_id, ['url', 'crawl', 'extract', 'search', 'health'][p_partkey % 5 + 1] AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'native' END AS forced, p_size % 2 = 0 AS rendered FROM part)
SELECT job_id, CAST(ord AS INTEGER) AS ord, id, state, CASE WHEN NOT list_contains(commands, kind) THEN 'unsupported_command' WHEN state <> 'ready' THEN reason WHEN cost <> 'local-zero' OR price IS DISTINCT FROM 0 THEN 'unknown_and_blocked' WHEN model = 'guard-proxy' AND NOT rendered THEN 'rendered_not_allowed' ELSE 'eligible' END AS reason,
  CASE WHEN cost = 'local-zero' AND price = 0 THEN 'allowed_zero' ELSE 'unknown_and_blocked' END AS cost_state,
  list_contains(commands, kind) AND state = 'ready' AND cost = 'local-zero' AND price IS NOT DISTINCT FROM 0 AND (model <> 'guard-proxy' OR rendered) AS eligible
FROM j CROSS JOIN ready WHERE CASE WHEN forced IS NULL THEN automatic AND list_contains(commands, kind) ELSE id = forced END
""")
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["url", "crawl", "extract", "search", "health"]))
    job_rows = col(spark, sf_dir, "part", k.alias("job_id"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("kind"), F.when(k % 4 == 0, "native").alias("forced_engine"), (F.col("p_size") % 2 == 0).alias("allow_rendered"), F.lit(False).alias("allow_cloud"))
    capabilities = cost.registry(spark).withColumn("state", F.when(F.col("id").isin("native", "playwright"), "ready").otherwise(F.col("state")))
    return cost.route_plan(job_rows, capabilities)


@query("""
WITH p AS (SELECT c_custkey, c_acctbal AS balance, c_custkey % 400 * 1000 AS age_ms, c_custkey % 3 AS price, c_acctbal / 10 AS hard_ceiling, c_custkey % 50 AS worst, c_custkey % 60 AS free, c_custkey % 7 = 0 AS charge FROM customer)
SELECT c_custkey, CASE WHEN age_ms > 300000 THEN 'balance_unknown_or_stale' WHEN price <> 0 THEN 'price_unknown' WHEN least(hard_ceiling, 500.0) <= 0 THEN 'no_hard_ceiling' WHEN NOT (worst > 0 AND worst <= least(hard_ceiling, 500.0) AND worst <= 30) THEN 'worst_case_unbounded'
  WHEN free < worst THEN 'insufficient_free_credits' WHEN charge THEN 'preflight_may_charge' ELSE 'cost_proven' END AS reason, false AS eligible FROM p
""")
def credit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = col(
        spark, sf_dir, "customer", "c_custkey", F.col("c_acctbal").alias("balance"), F.timestamp_millis(F.unix_millis(now) - k % 400 * 1000).alias("balance_observed_at"), (k % 3).cast("double").alias("price"), (F.col("c_acctbal") / 10).alias("hard_ceiling"),
        (k % 50).alias("worst_case_credits"), (k % 60).cast("double").alias("free_credits"), (k % 7 == 0).alias("preflight_may_charge"),
        F.lit(40.0).alias("ledger_balance"), now.alias("ledger_observed_at"), F.lit(500.0).alias("ledger_ceiling"), F.lit(10.0).alias("committed"),
    )
    rows = rows.withColumn("reason", cost.credit_reason(now))
    return rows.select("c_custkey", "reason", cost.cloud_eligible(F.col("reason")).alias("eligible"))


@query("""
WITH RECURSIVE h AS (SELECT n_nationkey AS k, 'https://h' || n_nationkey || '/' AS src, CASE WHEN n_nationkey % 6 = 5 THEN 'http://h' || (n_nationkey + 1) || '/' WHEN n_nationkey % 5 = 4 THEN 'https://h' || (n_nationkey - 2) || '/' ELSE 'https://h' || (n_nationkey + 1) || '/' END AS dst, CASE WHEN n_nationkey % 7 = 6 THEN 200 ELSE 301 END AS status FROM nation),
w AS (SELECT src AS origin, src AS here, [src] AS seen, 0 AS hops FROM h UNION ALL SELECT origin, dst, list_append(seen, dst), hops + 1 FROM w JOIN h ON h.src = w.here AND status = 301 WHERE hops < 5 AND NOT list_contains(seen, dst) AND NOT (w.here LIKE 'https:%' AND dst LIKE 'http:%'))
SELECT origin AS "start", here AS "end", hops, CASE WHEN h.dst IS NULL THEN 'ok' WHEN hops >= 5 THEN 'redirect_limit' WHEN list_contains(seen, h.dst) THEN 'redirect_loop' ELSE 'redirect_downgrade' END AS outcome
FROM w LEFT JOIN h ON h.src = w.here AND h.status = 301 WHERE h.dst IS NULL OR hops >= 5 OR list_contains(seen, h.dst) OR (w.here LIKE 'https:%' AND h.dst LIKE 'http:%')
""")
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    host = lambda n: F.concat(F.lit("//h"), n.cast("string"), F.lit("/"))
    dst = F.when(k % 6 == 5, F.concat(F.lit("http:"), host(k + 1))).when(k % 5 == 4, F.concat(F.lit("https:"), host(k - 2))).otherwise(F.concat(F.lit("https:"), host(k + 1)))
    hops = col(spark, sf_dir, "nation", F.concat(F.lit("https:"), host(k)).alias("src"), dst.alias("dst"), F.when(k % 7 == 6, 200).otherwise(301).alias("status"))
    return redirects.follow(hops.select(F.col("src").alias("start")), hops, 5)


@query("""
SELECT user_id AS run_id, greatest(count(*) FILTER (event_type <> 'view') - 1, 0) AS retries, CAST(sum(event_id % 3) AS BIGINT) AS redirects FROM events GROUP BY user_id
""")
def attempt_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("event_id") % 3).cast("int"))
    rows = col(spark, sf_dir, "events", F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "view", "transform").otherwise("acquire").alias("type"), chain.alias("redirect_chain"))
    return retry.usage(rows, ["run_id"])


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(round((event_id % 500) / 4.0 * 1000) AS BIGINT) WHEN 1 THEN 61000 WHEN 2 THEN 0 ELSE 0 END AS retry_after_ms, CASE WHEN event_id % 4 = 0 THEN CAST(ceil((event_id % 500) / 4.0 * 1000) AS BIGINT) END AS crawl_delay_ms FROM events
""")
def header_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.format_string("%.2f", k % 500 / 4.0)).when(k % 4 == 1, "Mon, 01 Jan 2024 00:01:01 GMT").when(k % 4 == 2, "Sun, 31 Dec 2023 00:00:00 GMT").otherwise("soon")
    rows = col(spark, sf_dir, "events", "event_id", raw.alias("raw"))
    return rows.select("event_id", values.retry_after_ms(F.col("raw"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("retry_after_ms"), values.crawl_delay_ms(F.col("raw")).alias("crawl_delay_ms"))


@query("""
WITH e AS (SELECT c_custkey, ['ok', 'partial', 'blocked', 'exhausted', 'interrupted'][c_custkey % 5 + 1] AS status, ['ok', 'gone', 'hard_limit', 'timeout'][c_custkey % 4 + 1] AS code FROM customer)
SELECT status, code, count(*) AS n FROM e WHERE NOT ((status = 'ok' AND code = 'ok') OR (status = 'exhausted' AND code = 'gone') OR (status = 'blocked' AND code = 'hard_limit') OR (status = 'interrupted' AND code = 'timeout')) GROUP BY ALL
""")
def envelope_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda options, m: F.element_at(F.array(*map(F.lit, options)), (k % m + 1).cast("int"))
    rows = col(spark, sf_dir, "customer", "c_custkey", F.lit(1).alias("schema_version"), F.lit("url").alias("command"), pick(["ok", "partial", "blocked", "exhausted", "interrupted"], 5).alias("status"), pick(["ok", "gone", "hard_limit", "timeout"], 4).alias("code"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("source_hash"), F.lit(None).cast("string").alias("cache_status"))
    return contracts.invalid_envelopes(rows).groupBy("status", "code").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT conv_id AS run_id, turn AS seq, role, length(text) AS wire, CASE WHEN turn % 2 = 0 THEN length(text) * 2 END AS total FROM conversations)
SELECT run_id, CAST(sum(CASE WHEN total > 0 THEN total ELSE wire + 10 END) AS BIGINT) AS bytes, max_by(role, seq) AS last_role FROM s GROUP BY run_id
""")
def byte_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    rows = col(spark, sf_dir, "conversations", F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), "role", crawl.byte_total(n, F.lit(10).cast("long"), F.lit(None).cast("long"), F.when(F.col("turn") % 2 == 0, n * 2)).alias("bytes"))
    return rows.groupBy("run_id").agg(F.sum("bytes").alias("bytes"), F.max_by("role", "seq").alias("last_role"))


@query("""
WITH c(ord, id, state, reason, automatic, commands, cost, price, model) AS (VALUES %s),
p AS (SELECT event_id %% 11 AS ord, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id %% 11 ORDER BY ts DESC, event_id DESC) = 1)
SELECT id, CASE WHEN event_type = 'error' THEN 'disabled' WHEN event_type IN ('click', 'view') THEN 'ready' ELSE state END AS state, CASE WHEN event_type = 'error' THEN 'probe_failed' WHEN event_type IN ('click', 'view') THEN 'runtime' ELSE reason END AS reason,
  automatic, array_to_string(commands, ',') AS commands, cost, model AS network_model FROM c LEFT JOIN p USING (ord)
""" % CAPABILITIES)
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as the last probe of each capability left it; some capabilities have none, some probes are of others."""
    registry, t = cost.registry(spark), F.col("event_type")
    ids = registry.select((F.col("ord")).cast("long").alias("n"), "id")
    state = F.when(t == "error", "disabled").when(t.isin("click", "view"), "ready")
    probes = col(spark, sf_dir, "events", (F.col("event_id") % 11).alias("n"), "ts", "event_id", state.alias("state"), F.when(t == "error", "probe_failed").when(t.isin("click", "view"), "runtime").alias("reason"))
    return cost.health(cost.probed(registry, probes.join(F.broadcast(ids), "n"), ["ts", "event_id"]))


@query("SELECT event_type, count(*) AS first_events FROM (SELECT user_id, event_type FROM events GROUP BY ALL) GROUP BY event_type")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events by user and type within a watermark that spans the table."""
    rows = streams.deduplicated(streams.events(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "400 days")
    return streams.drained(spark, rows.select("user_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("first_events"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c(user_id, n, fetched, hits, misses) AS (
  SELECT user_id, n, t, 0, 1 FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e.t < c.fetched + 86400000 THEN c.fetched ELSE e.t END, c.hits + CASE WHEN e.t < c.fetched + 86400000 THEN 1 ELSE 0 END, c.misses + CASE WHEN e.t < c.fetched + 86400000 THEN 0 ELSE 1 END
  FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, max(hits) AS hits, max(misses) AS misses FROM c GROUP BY user_id
""")
def robots_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches of a cache by user whose entries live a day, as a stream."""
    rows = streams.ttl_cache(streams.events(spark, f"{sf_dir}/events.parquet"), "user_id", 86_400_000)
    return streams.drained(spark, rows, "update", lambda df: df.groupBy("user_id").agg(F.max_by("hits", "batch").alias("hits"), F.max_by("misses", "batch").alias("misses")))


@query("""
WITH RECURSIVE a AS (SELECT event_id, event_type AS cache, CAST(user_id AS VARCHAR) AS key, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events),
s(cache, pos, event_id, outcome, seen, held) AS (
  SELECT cache, CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), CAST([] AS STRUCT(key VARCHAR, until BIGINT)[]) FROM (SELECT DISTINCT cache FROM a)
  UNION ALL
  SELECT cache, pos, event_id, CASE WHEN NOT list_contains(seen, key) THEN 'cold' WHEN own IS NULL THEN 'evicted' WHEN t >= own.until THEN 'expired' ELSE 'hit' END,
    CASE WHEN list_contains(seen, key) THEN seen ELSE list_append(seen, key) END,
    list_concat([{'key': key, 'until': CASE WHEN own IS NULL OR t >= own.until THEN t + 86400000 ELSE own.until END}], list_filter(held, lambda x: x.key <> key))[1:24]
  FROM (SELECT a.*, s.seen, s.held, list_filter(s.held, lambda x: x.key = a.key)[1] AS own FROM s JOIN a ON a.cache = s.cache AND a.pos = s.pos + 1))
SELECT event_id, cache, pos, outcome FROM s WHERE pos >= 0
""")
def robots_lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What accesses find in caches of 24 users each, whose entries live a day, least recently used out first."""
    e = capture.table(spark, sf_dir, "events")
    rows = recency.outcomes(e.select("event_id", "event_type", "user_id", "ts"), F.col("event_type"), F.col("user_id"), F.unix_millis(F.col("ts").cast("timestamp")), ["event_id"], capacity=24)
    return rows.select("event_id", F.col("event_type").alias("cache"), "pos", "outcome")


def native(request: dict) -> object:
    """An adapter that answers, throws, or breaks the contract by the number of its job."""
    n = int(request["job_id"]) % 7
    if n == 0:
        raise OSError(request["url"])
    return {1: {"kind": "success", "code": "ok", "detail": request["url"]}, 2: {"kind": "inadequate", "code": "empty"}, 3: {"kind": "retryable", "code": "rate_limited"}, 4: {"kind": "retryable", "code": "network"}, 5: {"kind": 1, "code": "ok"}}.get(n)


def fallback(request: dict) -> object:
    return {"kind": "success", "code": "ok"} if int(request["job_id"]) % 2 else "no outcome"


@query("""
WITH a AS (SELECT event_id AS k, 'https://e.example.org/' || event_type AS url, event_id % 7 AS n FROM events),
f AS (SELECT CAST(k AS VARCHAR) AS job_id, 1 AS attempt, 'native' AS adapter, url, CASE WHEN n IN (0, 5, 6) THEN 'broken' WHEN n = 1 THEN 'success' WHEN n = 2 THEN 'inadequate' ELSE 'retryable' END AS kind,
  ['adapter_crash', 'ok', 'empty', 'rate_limited', 'network', 'adapter_protocol_error', 'adapter_protocol_error'][n + 1] AS code, CASE WHEN n = 0 THEN 'OSError' WHEN n = 1 THEN url END AS detail, n, k FROM a),
g AS (SELECT job_id, 2 AS attempt, 'fallback' AS adapter, url, CASE WHEN k % 2 = 1 THEN 'success' ELSE 'broken' END AS kind, CASE WHEN k % 2 = 1 THEN 'ok' ELSE 'adapter_protocol_error' END AS code, NULL AS detail, n, k FROM f WHERE n IN (2, 4))
SELECT job_id, attempt, adapter, url, kind, code, detail FROM f UNION ALL SELECT job_id, attempt, adapter, url, kind, code, detail FROM g
""")
def adapter_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of jobs with two candidates each, whose adapters answer, throw, or answer what is no outcome."""
    adapters.register(spark, "acquire", {"native": native, "fallback": fallback})
    candidate = F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("fallback").alias("adapter")), F.struct(F.lit(0).alias("ord"), F.lit("native").alias("adapter"))))
    rows = col(spark, sf_dir, "events", F.col("event_id").alias("job_id"), F.concat(F.lit("https://e.example.org/"), "event_type").alias("url"), candidate.alias("c"))
    return adapters.attempts(rows.select("job_id", "url", "c.*"), "acquire")


@query("SELECT user_id, event_type, count(*) AS attempts, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL")
def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that a stream appends to a log, every batch of it delivered twice."""
    folder = f"{shared.shared_folder(spark)}/attempts-{uuid.uuid4().hex}"
    log = sinks.BatchLog(spark, f"{folder}/log", "event_id long, user_id long, event_type string")
    put = log.sink(lambda rows: rows.select("event_id", "user_id", "event_type"))

    def twice(rows: DataFrame, batch: int) -> None:
        put(rows, batch)
        put(rows, batch)

    streams.events(spark, f"{sf_dir}/events.parquet").writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return log.read().groupBy("user_id", "event_type").agg(F.count("*").alias("attempts"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""
SELECT o_custkey AS fingerprint, o_orderkey AS run_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache records merged in two rounds into a bucketed table, of which the last one of each fingerprint stays."""
    rows = col(spark, sf_dir, "orders", F.col("o_custkey").alias("fingerprint"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"))
    table = sinks.BucketTable(spark, f"{shared.shared_folder(spark)}/cache-{uuid.uuid4().hex}", "fingerprint long, run_id long, at timestamp_ntz", "fingerprint", 16)
    last = lambda both: store.latest(both, "fingerprint", [F.desc("at"), F.desc("run_id")])
    table.merge(rows.where("run_id % 3 > 0"), last)
    table.merge(rows.where("run_id % 3 = 0"), last)
    return table.read().select("fingerprint", "run_id")


@query(sql_timeline("ts, event_id", ""))
def retry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same machine on a stream of attempts, in order of time."""
    rows = streams.events(spark, f"{sf_dir}/events.parquet")
    rows = rows.select("user_id", "ts", F.expr(EVENT_KIND).alias("kind"), F.expr(EVENT_CODE).alias("code"), F.floor(F.abs("value")).cast("long").alias("duration_ms"), (F.col("event_id") % 7 * 10_000).alias("retry_after_ms"))
    return streams.drained(spark, streams.retries(rows, "user_id"))


@query(r"""
WITH h AS (SELECT event_id, event_id % 6 AS k, 'https://e.example.org/' || event_type || '/' || event_id AS url FROM events)
SELECT event_id, CASE WHEN k IN (0, 1) THEN url WHEN k = 5 AND event_id % 4 = 1 THEN repeat('a', 8192) END AS location FROM h
""")
def redirect_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect targets: one header of either case, a repeated one, one with two values, one with a line feed, a long one."""
    k = F.col("event_id") % 6
    rows = col(spark, sf_dir, "events", "event_id", F.concat(F.lit("https://e.example.org/"), "event_type", F.lit("/"), "event_id").alias("url"))
    long = F.repeat(F.lit("a"), F.when(F.col("event_id") % 4 == 1, 8192).otherwise(8193))
    one = lambda name, *v: F.create_map(F.lit(name), F.array(*v), F.lit("accept"), F.array(F.lit("x")))
    twice = F.create_map(F.lit("Location"), F.array("url"), F.lit("location"), F.array("url"))
    headers = F.when(k == 0, one("Location", "url")).when(k == 1, one("location", "url")).when(k == 2, twice).when(k == 3, one("location", "url", "url")).when(k == 4, one("location", F.concat("url", F.lit("\n")))).otherwise(one("LOCATION", long))
    return rows.select("event_id", redirects.location(headers).alias("location"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"status_code":' || (200 + event_id % 3) || ',"final_url":"https://e.example.org/' || event_type || '","redirect_chain":[' || CASE WHEN event_id % 2 = 0 THEN '"a"' ELSE '' END || '],"headers":{"etag":"' || event_id || '"},"wire_bytes":' || event_id || '}' END AS evidence FROM events
""")
def response_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of responses as JSON: unset fields are left out, headers beyond the allowlist too."""
    k = F.col("event_id")
    headers = F.create_map(F.lit("ETag"), k.cast("string"), F.lit("Set-Cookie"), F.lit("s"))
    found = redirects.evidence(F.when(k % 5 != 0, 200 + k % 3), F.concat(F.lit("https://e.example.org/"), "event_type"), F.when(k % 2 == 0, F.array(F.lit("a"))), F.lit(None).cast("string"), headers, k, F.lit(None).cast("long"))
    return col(spark, sf_dir, "events", "event_id", F.to_json(found).alias("evidence"))


@query("""
WITH o AS (SELECT o_orderkey, ['use', 'refresh', 'off'][o_orderkey % 3 + 1] AS mode, o_orderkey % 4 <> 0 AS fresh, o_orderkey % 5 <> 0 AS ok, o_orderkey % 7 <> 0 AS sourced FROM orders)
SELECT 'f' || o_orderkey AS fingerprint, 'new' || o_orderkey AS run_id, CASE WHEN fresh THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS expires_at, 'cache_hit' AS attempt FROM o WHERE mode = 'use' AND fresh AND ok AND sourced
""")
def cache_hit_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on whole records give runs of their own; the record keeps its expiry."""
    k = F.col("o_orderkey")
    orders = col(spark, sf_dir, "orders", k, F.concat(F.lit("run"), k).alias("run_id"), F.concat(F.lit("f"), k).alias("fingerprint"))
    cache = orders.select("fingerprint", "run_id", F.lit("s").alias("source_hash"), F.lit("a").alias("artifact_hash"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"), F.when(k % 4 != 0, "2024-02-02 00:00:00").otherwise("2024-01-31 00:00:00").cast("timestamp_ntz").alias("expires_at"))
    manifests = orders.select("run_id", F.when(k % 5 != 0, "ok").otherwise("partial").alias("status"))
    artifacts = orders.select("run_id", F.explode(F.array(F.struct(F.lit("raw").alias("role"), F.lit("a").alias("hash")), F.struct(F.when(k % 7 != 0, "source").otherwise("other").alias("role"), F.lit("s").alias("hash")))).alias("a")).select("run_id", "a.*")
    requests = orders.select(k.alias("request_id"), "fingerprint", F.element_at(F.array(*map(F.lit, ["use", "refresh", "off"])), (k % 3 + 1).cast("int")).alias("mode"))
    hits = jobs.cache_hits(requests, cache, manifests, artifacts, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    manifest, record = jobs.finish_hits(hits, F.concat(F.lit("new"), "request_id"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    attempts = manifest.select("run_id", F.col("attempts")[0]["type"].alias("attempt"))
    return record.join(attempts, "run_id").select("fingerprint", "run_id", "expires_at", "attempt")


@query("""
SELECT o_orderkey AS request_id, o_orderkey % 6 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AS hit, CASE WHEN o_orderkey % 6 > 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) THEN 'cache_record_corrupt' END AS warning FROM orders
""")
def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the cache gives: a hit, nothing, or a record whose manifest or source is not whole."""
    k = F.col("o_orderkey")
    orders = col(spark, sf_dir, "orders", k, F.concat(F.lit("run"), k).alias("run_id"), F.concat(F.lit("f"), k).alias("fingerprint"))
    cache = orders.where(k % 6 > 0).select("fingerprint", "run_id", F.lit("s").alias("source_hash"), F.lit("a").alias("artifact_hash"))
    manifests = orders.select("run_id", F.when(k % 5 > 0, "ok").otherwise("partial").alias("status"))
    artifacts = orders.select("run_id", F.explode(F.array(F.struct(F.lit("raw").alias("role"), F.lit("a").alias("hash")), F.struct(F.when(k % 7 > 0, "source").otherwise("other").alias("role"), F.lit("s").alias("hash")))).alias("a")).select("run_id", "a.*")
    return store.read_cache(orders.select(k.alias("request_id"), "fingerprint"), cache, manifests, artifacts).select("request_id", "hit", "warning")


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k, CASE WHEN k % 3 = 0 THEN '' ELSE 'canonical u' || k || ',' END || CASE WHEN k % 2 = 0 THEN 'rss r,atom r' ELSE 'rss r' END AS candidates,
  'a,b' || CASE WHEN k % 4 = 0 THEN '' ELSE ',c' END AS warnings, k % 5 = 0 AS exact FROM c
""")
def candidate_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical and alternate candidates, warnings of steps, and exact key sets."""
    k = F.col("c_custkey")
    alternate = lambda t, u: F.struct(F.lit(t).cast("string").alias("type"), F.lit(u).alias("url"))
    alternates = F.array(alternate("rss", "r"), F.when(k % 2 == 0, alternate("atom", "r")).otherwise(alternate(None, "r")), alternate("rss", "r"))
    found = jobs.discovered(F.when(k % 3 != 0, F.concat(F.lit("u"), k)), alternates)
    warned = jobs.warnings_of(F.array(F.lit("a"), F.lit("b")), F.when(k % 4 != 0, F.array(F.lit("b"), F.lit("c"))))
    keys = F.when(k % 5 == 0, F.create_map(F.lit("y"), k, F.lit("x"), k)).when(k % 5 == 1, F.create_map(F.lit("x"), k)).otherwise(F.create_map(F.lit("x"), k, F.lit("y"), k, F.lit("z"), k))
    rows = col(spark, sf_dir, "customer", k.alias("k"), found.alias("found"), warned.alias("warned"), jobs.same_keys(keys, ["x", "y"]).alias("exact"))
    return rows.select("k", F.array_join(F.transform("found", lambda c: F.concat_ws(" ", c["type"], c["url"])), ",").alias("candidates"), F.array_join("warned", ",").alias("warnings"), "exact")
