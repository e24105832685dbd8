"""URL, address, format and markup functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import formats, ip, markdown, markup, urls, values
from tracewell.operators import variants

ALLOW = [("https://a.com/x#top", "https://a.com/x"), ("http://93.184.216.34/", "http://93.184.216.34/"), ("https://bücher.de/", "https://xn--bcher-kva.de/"), ("https://a.com:443/", "https://a.com/"), ("HTTP://A.com./b/../c", "http://a.com/c"), ("http://a.com:443/", "http://a.com:443/")]
DENY = [
    ("file:///etc/passwd", "scheme_denied"), ("javascript:alert(1)", "scheme_denied"), ("https://u:p@a.com/", "userinfo_denied"), ("https://a.com:8080/", "port_denied"),
    ("https://a.com/?Api-Key=1", "sensitive_query"), ("https://a.com/?mytoken=1", "sensitive_query"), ("https://a.com\\@b.com/", "ambiguous_url"), ("https://a.com%2f@b.com/", "ambiguous_url"),
    ("http://localhost./", "special_hostname"), ("http://x.internal/", "special_hostname"), ("http://127.1/", "non_public_ip"), ("http://2130706433/", "non_public_ip"), ("http://0x7f000001/", "non_public_ip"),
    ("http://[::ffff:127.0.0.1]/", "non_public_ip"), ("http://[fe80::1%25en0]/", "ambiguous_url"), ("", "invalid_url"), (None, "invalid_url"), (" https://a.com", "ambiguous_url"), ("https://", "invalid_url"), ("https://a.com/?code=1", None),
]


@pytest.mark.parametrize(("text", "canonical"), ALLOW)
def test_admitted(text, canonical):
    assert urls.admit(text).canonical_url == canonical
    assert urls.admit(canonical).canonical_url == canonical


@pytest.mark.parametrize(("text", "reject"), DENY)
def test_denied(text, reject):
    assert urls.admit(text).reject == reject


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_admission_is_total_and_stable(text):
    for t in (text, "https://" + text, "https://a.com/" + text):
        out = urls.admit(t)
        assert (out.reject is None) == (out.canonical_url is not None)
        if out.canonical_url and len(out.canonical_url) <= urls.MAX_URL:
            assert urls.admit(out.canonical_url).canonical_url == out.canonical_url


def test_resolution():
    base = "https://a.com/b/c/d?q"
    assert urls.resolve("../x y?a b#c", base) == "https://a.com/b/x%20y?a%20b"
    assert urls.resolve("//b.com", base) == "https://b.com/"
    assert urls.resolve("?z", base) == "https://a.com/b/c/d?z"
    assert urls.resolve("mailto:x", base) is None and urls.resolve("", base) is None
    assert urls.helper_url("x#y", base) == "https://a.com/b/c/x"
    assert urls.redacted("https://u:p@a.com/?code=1&x=2") == "https://a.com/?code=%5Bredacted%5D&x=2"
    assert urls.frontier_key("/z?b=1#f", base, "https://a.com") == "https://a.com/z?b=1" and urls.frontier_key("//b.com", base, "https://a.com") is None


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=200, deadline=None)
def test_ipv4_round_trip(n):
    text = ".".join(str(b) for b in n.to_bytes(4, "big"))
    assert ip.parse_ipv4(text) == n
    assert ip.classify(text)[0] == 4


def test_addresses():
    assert ip.classify("::1") == (6, False, "ipv4-compatible") and ip.classify("2606:4700::1")[1] and ip.classify("01.2.3.4") is None and ip.classify("[fc00::1]")[2] == "unique-local"


def test_native_paths_agree_with_the_parser(spark):
    rows = [u for u, _ in ALLOW] + [u for u, _ in DENY if u] + ["https://www.a-b.org/x/y.html?q=1&r=2#f", "http://a.com"]
    df = spark.createDataFrame([(u,) for u in rows], "u string").withColumn("a", urls.admit_url("u"))
    parts = urls.plain_parts(F.col("u"))
    for r in df.withColumn("c", parts["canonical_url"]).where("c is not null and a.reject is null").collect():
        assert r["c"] == r["a"]["canonical_url"]
    addresses = ["1.2.3.4", "10.0.0.1", "192.0.2.9", "256.1.1.1", "1.2.3", "0.0.0.0", "255.255.255.255", "8.8.8.8", "08.8.8.8"]
    got = spark.createDataFrame([(a,) for a in addresses], "a string").select("a", ip.ipv4_reason(ip.ipv4_number(F.col("a"))).alias("r")).collect()
    assert {r["a"]: r["r"] for r in got} == {a: (ip.classify(a) or (0, 0, None))[2] for a in addresses}


def test_kinds(spark):
    cases = {"<!DOCTYPE html><p>": "html", "﻿ <HTML lang='x'>": "html", '{"a":1}': "json", "[1]": "json", "<?xml version='1'?><!-- c --><rss version='2'>": "rss", "<feed xmlns='a'>": "atom", "<urlset>": "sitemap", "<a:thing/>": "xml", "plain": None, "": None}
    got = spark.createDataFrame([(c,) for c in cases], "b string").select("b", formats.sniffed_kind(F.col("b")).alias("k")).collect()
    assert {r["b"]: r["k"] for r in got} == cases
    types = {"text/HTML; charset=x": "html", "application/ld+json": "json", "application/rss+xml": "rss", "image/svg+xml": "xml", "text/plain": None, "bad": None}
    got = spark.createDataFrame([(c,) for c in types], "t string").select("t", formats.declared_kind(formats.media_type(F.col("t"))).alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == types


HTML = """<html><head><title>T &amp; x</title><meta name=Author content=" A  B "><link rel="alternate" type="application/rss+xml" href="/feed"><script type="application/ld+json">{"price": "19.5", "n": [1, 2]}</script></head>
<body><h1>Hi <b>x</b></h1><p>a<br>b <a href='/q(1)'>l[i]nk</a></p><ul><li>one</li><li>two</li></ul><script>1</script><div class="price big" data-x=1>19.50</div><img alt=" pic "></body></html>"""


def test_markup():
    dom = markup.dom_parse(HTML, "https://a.com/")
    assert dom["title"] == "T & x" and dom["metadata"] == {"author": "A B"} and dom["alternates"] == [{"type": "application/rss+xml", "url": "https://a.com/feed"}]
    assert dom["markdown"].startswith("# Hi **x**\n\na\nb".replace("\n\na\nb", "\n\na")) and "- one\n\n- two" in dom["markdown"]


#: What pages become, by the rules of blocks, lines, links and white space.
MARKDOWN = {
    HTML: "# Hi x\n\na\nb [l\\[i\\]nk](https://a.com/q%281%29)\n\n- one\n- two\n\n19.50\n\npic\n",
    "<a href=/x> lab </a>tail &amp;lt; &#65;&#x1F600;&#0; &copy;": "[lab](https://a.com/x)tail &lt; A\U0001f600\ufffd &copy;\n",
    'x<script>no</script> y<!-- c --> z <a href="javascript:1">q </a> r': "x y z q r\n",
    'foo<a href="/a"> bar</a>baz<a href="/b"></a>': "foo[bar](https://a.com/a)baz[https://a.com/b](https://a.com/b)\n",
    "a  <i> b</i>  <p> <br> c </p> 5 < 6 and 7 > 3": "a b\n\nc\n\n5 3\n",
    "<head><title>t</title></head><h2></h2><li></li>x": "##\n\n-\nx\n",
    "<pre>a\n  b</pre><H3 class=x>Up</H3>t": "a b\n\n### Up\n\nt\n",
    "a&#10;b<br/><br/>c<br><p>d": "a b\nc\n\nd\n",
    "<p>one<a href='/u'>open": "oneopen\n",
    "</a>x</p>": "x\n",
    "<article><h1>T</h1><p>a &lt;b&gt; [c]</p></article>": "# T\n\na <b> [c]\n",
    "<IMG ALT='two  words'> and <img src=x>": "two words and\n",
    "\ue003odd\ue000 marks": "odd marks\n",
    "": "",
    " \n ": "",
    None: None,
}
LINKS = {
    "<urlset><url><loc> https://a.com/1?x=1&amp;y=2 </loc></url><url><loc>ftp://a.com/2</loc></url></urlset>": ["https://a.com/1?x=1&y=2"],
    '<rss><channel><link>/home</link><item><link>https://b.org/i</link></item></channel></rss>': ["https://a.com/home", "https://b.org/i"],
    '<feed><link href="/e1"/><entry><link rel="alternate" href=\'/e2\'/></entry></feed>': ["https://a.com/e1", "https://a.com/e2"],
    "<p>none</p>": [],
}


def test_markdown_and_links(spark):
    rows = spark.createDataFrame([(h, "https://a.com/d/") for h in [*MARKDOWN, *LINKS]], "html string, url string")
    got = rows.select("html", markdown.markdown(F.col("html"), F.col("url")).alias("text"), markdown.markup_links(F.col("html"), F.col("url")).alias("links")).collect()
    assert {r["html"]: r["text"] for r in got if r["html"] in MARKDOWN} == MARKDOWN
    assert {r["html"]: r["links"] for r in got if r["html"] in LINKS} == LINKS and next(r for r in got if r["html"] is None)["links"] is None


def test_members_of_json(spark):
    rows = spark.createDataFrame([(1, '{"a": "/x", "b": ["//y", "z", {"c": "HTTPS://w", "d": [[["./deep"]]]}]}'), (2, "no"), (3, None), (4, '"/top"'), (5, "[]")], "id int, j string")
    got = variants.json_links(rows, ["id"], F.col("j")).collect()
    assert {(r["id"], r["link"]) for r in got} == {(1, "/x"), (1, "//y"), (1, "HTTPS://w"), (1, "./deep"), (4, "/top")}


def test_extraction():
    fields = markup.valid_schema({"schema_version": 1, "fields": {
        "price": {"source": "css", "selector": "div.price", "take": "text", "type": "number"}, "x": {"source": "css", "selector": "body > div[data-x='1']", "take": "@data-x"},
        "items": {"source": "css", "selector": "ul li, h1", "take": "text", "many": True}, "ld": {"source": "jsonld", "path": ["price"], "type": "number"},
        "gone": {"source": "jsonld", "path": ["no"], "required": True}, "n": {"source": "jsonld", "path": ["n"], "many": True},
    }})
    out, missing = markup.extract_fields(HTML, fields)
    assert out == {"price": 19.5, "x": "1", "items": ["Hi x", "one", "two"], "ld": 19.5, "n": [1, 2]} and missing == ["gone"]
    for bad in ({"schema_version": 2, "fields": {}}, {"schema_version": 1, "fields": {"a": {"source": "css", "selector": "a:hover", "take": "text"}}}, {"schema_version": 1, "fields": {"__proto__": {"source": "jsonld", "path": ["a"]}}}):
        with pytest.raises(ValueError):
            markup.valid_schema(bad)


def test_json_forms():
    assert [markup.js_number(x) for x in (1.5, 1e21, 1e-7, 0.1, -2.5, 100.0, 1e20, 0.000001)] == ["1.5", "1e+21", "1e-7", "0.1", "-2.5", "100", "100000000000000000000", "0.000001"]
    assert markup.stable_json({"b": [True, None, 2.50], "a": "é"}) == '{"a":"é","b":[true,null,2.5]}'


def test_values(spark):
    row = spark.range(1).select(
        values.safe_headers(F.create_map(F.lit("ETag"), F.lit("1"), F.lit("Set-Cookie"), F.lit("x"))).alias("h"), values.object_path(F.lit("sha256:" + "a" * 64)).alias("p"), values.object_path(F.lit("sha256:XX")).alias("q"),
        values.redact_map(F.create_map(F.lit("api_key"), F.lit("1"), F.lit("n"), F.lit("2"))).alias("m"), values.iso_ms(F.lit(1_700_000_000_123)).alias("t"), values.clean_text(F.lit(" a  b \r\n\n c")).alias("c"),
        values.coerced(F.lit("19.0"), "number").alias("n"), values.coerced(F.lit("No"), "boolean").alias("b"), values.coerced(F.lit('q"'), "string").alias("s"),
        values.crawl_delay_ms(F.lit("0.1")).alias("d"), values.retry_after_ms(F.lit("120"), F.lit("2024-01-01").cast("timestamp")).alias("r"), formats.utf16_length(F.lit("a𝒳")).alias("u"),
        formats.fenced(F.lit("```x"), "md").alias("f"), formats.candidate_kind(F.lit("application/RSS+xml")).alias("k"), formats.derived_media_type(F.lit("links"), F.lit("text/html")).alias("dm"),
    ).first()
    assert row["h"] == {"etag": "1"} and row["p"].startswith("objects/sha256/aa/") and row["q"] is None and row["m"] == {"api_key": "[redacted]", "n": "2"}
    assert row["t"] == "2023-11-14T22:13:20.123Z" and row["c"] == "a b\nc" and (row["n"], row["b"], row["s"]) == ("19", "false", '"q\\""') and row["d"] == 100 and row["r"] == 120_000 and row["u"] == 3
    assert row["f"] == "````md\n```x\n````\n" and row["k"] == "rss" and row["dm"] == "application/json"


def test_header_names_that_differ_by_case(spark):
    one = spark.range(1).select(
        values.safe_headers(F.create_map(F.lit("Content-Type"), F.lit("a"), F.lit("content-type"), F.lit("b"), F.lit("X"), F.lit("c"))).alias("safe"),
        formats.flat_headers(F.create_map(F.lit("A"), F.array(F.lit("1"), F.lit("2")), F.lit("a"), F.array(F.lit("3")))).alias("flat"),
        values.safe_headers(F.lit(None).cast("map<string,string>")).alias("none"),
    ).first()
    assert one["safe"] == {"content-type": "b"} and one["flat"] == {"a": "1, 2, 3"} and one["none"] is None


def test_ip_columns_agree_with_single_addresses(spark):
    import ipaddress
    import random

    rnd = random.Random(5)
    v6 = [str(ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128))) for _ in range(200)]
    v6 += [ipaddress.IPv6Address(x).exploded.upper() for x in v6[:40]]
    odd = ["::", "::1", "1::", "::ffff:1.2.3.4", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4"]
    wrong = ["", ":", ":::", "1:2", "1::2::3", "12345::", "g::", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "::256.1.1.1", ":1:2:3:4:5:6:7", "01.2.3.4", "256.1.1.1", "1.2.3", "x"]
    rows = spark.createDataFrame([(a,) for a in [*v6, *odd, *wrong, "8.8.8.8", "10.0.0.1"]], "a string")
    rows = rows.withColumns({"k": ip.ipv6_key(F.col("a")), "n": ip.ipv4_number(F.col("a"))})
    for r in rows.withColumns({"t": ip.ipv6_text(F.col("k")), "r": F.coalesce(ip.ipv6_reason(F.col("k")), ip.ipv4_reason(F.col("n")))}).collect():
        known = ip.classify(r["a"])
        assert r["r"] == (known and known[2]), r
        if known and known[0] == 6:
            value = ip.parse_ipv6(r["a"])
            assert r["k"] == f"{value:032x}" and (r["t"] == ip.format_ipv6(value) or ipaddress.IPv6Address(r["t"]) == ipaddress.IPv6Address(value))
