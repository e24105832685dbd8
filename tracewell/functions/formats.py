"""Content kinds and native document projections: media types, sniffing, basic HTML, links, fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.values import lower_names

#: White space as JavaScript's \s has it, for Java patterns.
S = r"[\s\u000b   -     　﻿]"
#: A name ends here (\b after an ASCII name).
END = "(?![A-Za-z0-9_])"
SNIFF_BYTES = 8192
MEDIA_TYPE = r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"
#: Media types of a declared kind.
DECLARED = {
    "html": ["text/html", "application/xhtml+xml"],
    "markdown": ["text/markdown", "text/x-markdown", "application/markdown"],
    "rss": ["application/rss+xml"],
    "atom": ["application/atom+xml"],
    "sitemap": ["application/sitemap+xml"],
}
#: Elements whose content is no data: dropped from text, and from links and markdown.
TEXT_DROPPED = ["script", "style", "template", "noscript"]
DATA_DROPPED = [*TEXT_DROPPED, "iframe", "object", "svg", "canvas"]


def media_type(value: Column) -> Column:
    """Type before the first semicolon, in lower case; '' if it is no token/token."""
    name = F.lower(F.trim(F.substring_index(value, ";", 1)))
    return F.when(name.rlike(MEDIA_TYPE), name).otherwise("")


def header_value(headers: Column, name: str) -> Column:
    """A header by its lower-case name, whatever the case in the map; of several the first."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0))


def flat_headers(headers: Column) -> Column:
    """Lower-case names; repeated values of a name joined by ', '. ``headers``: map of string to array of strings."""
    return lower_names(headers, lambda values: F.array_join(F.flatten(values), ", "))


def declared_kind(kind: Column) -> Column:
    out = F
    for name, types in DECLARED.items():
        out = out.when(kind.isin(types), name)
    return out.when(kind.isin("application/json", "text/json") | kind.endswith("+json"), "json").when(kind.isin("application/xml", "text/xml") | kind.endswith("+xml"), "xml")


def sniffed_kind(body: Column) -> Column:
    """The kind that the first 8 KiB show, or null."""
    text = F.regexp_replace(F.regexp_replace(F.substring(body, 1, SNIFF_BYTES), "^﻿", ""), f"^{S}+", "")
    first = F.substring(text, 1, 1)
    head = rf"(?is)^(?:<\?xml{END}[^?]*(?:\?>|$){S}*|<!--.*?(?:-->|$){S}*|<!doctype{END}[^>]*(?:>|$){S}*)"
    bare = text
    for _ in range(6):
        bare = F.regexp_replace(bare, head, "")
    root = F.lower(F.regexp_extract(bare, rf"(?i)^<{S}*([a-z_][\w:.-]*)(?:{S}|/?>)", 1))
    local = F.substring_index(root, ":", -1)
    return (
        F.when(text == "", None)
        .when(F.lower(text).rlike(rf"^<!doctype{S}+html(?:{S}|>)") | F.lower(text).rlike(rf"^<html(?:{S}|>)"), "html")
        .when(first.isin("{", "["), "json")
        .when(root == "", None)
        .when(local == "rss", "rss")
        .when(local == "feed", "atom")
        .when(local.isin("urlset", "sitemapindex"), "sitemap")
        .when(local.isin("html", "head", "body"), "html")
        .otherwise("xml")
    )


def detected_kind(declared: Column, sniffed: Column) -> Column:
    """Declared wins; generic XML is refined; else what was sniffed; else binary."""
    kind = F.coalesce(declared, sniffed)
    return F.when((kind == "xml") & sniffed.isin("rss", "atom", "sitemap"), sniffed).otherwise(F.coalesce(kind, F.lit("binary")))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{S}+", " "), "^ | $", "")


def html_body(source: Column) -> Column:
    """Content of the body element, or the whole source without a complete one."""
    pattern = rf"(?is)<body{END}[^>]*>(.*?)</body{S}*>"
    return F.when(source.rlike(pattern), F.regexp_extract(source, pattern, 1)).otherwise(source)


def without_elements(source: Column, names: list[str]) -> Column:
    return F.regexp_replace(source, rf"(?is)<({'|'.join(names)}){END}[^>]*>.*?</\1{S}*>", " ")


def html_text(source: Column) -> Column:
    text = F.regexp_replace(without_elements(html_body(source), TEXT_DROPPED), "<[^>]+>", " ")
    return collapsed(F.regexp_replace(F.regexp_replace(text, "(?i)&nbsp;", " "), "(?i)&amp;", "&"))


def html_title(source: Column) -> Column:
    raw = F.regexp_extract(source, rf"(?is)<title{END}[^>]*>(.*?)</title{S}*>", 1)
    return collapsed(F.regexp_replace(raw, "<[^>]+>", " "))


def script_count(source: Column) -> Column:
    return F.regexp_count(html_body(source), F.lit(rf"(?i)<script{END}")).cast("long")


def attribute(tag: Column, name: str) -> Column:
    """A tag's attribute, double-, single- or unquoted; null without it."""
    start = rf"(?i)(?:^|{S}){name}{S}*={S}*"
    forms = [rf'{start}"([^"]*)"', rf"{start}'([^']*)'", rf"{start}([^\s\"'=<>`]+)"]
    out = F
    for form in forms:
        out = out.when(tag.rlike(form), F.regexp_extract(tag, form, 1))
    return out


def basic_entities(text: Column) -> Column:
    """The three entities of the basic extractor."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)&amp;", "&"), "(?i)&quot;", '"'), "(?i)&#39;|&apos;", "'")


def anchor_hrefs(source: Column) -> Column:
    """Raw hrefs of all <a> tags in the whole source, comments included."""
    tags = F.regexp_extract_all(source, F.lit(rf"(?i)<a{END}[^>]*>"), F.lit(0))
    return F.array_compact(F.transform(tags, lambda t: basic_entities(attribute(t, "href"))))


def link_tags(source: Column) -> Column:
    """rel, type and href of all <link> tags."""
    tags = F.regexp_extract_all(source, F.lit(rf"(?i)<link{END}[^>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), f"{S}+").alias("rel"), F.coalesce(F.lower(attribute(t, "type")), F.lit("text/html")).alias("type"), basic_entities(attribute(t, "href")).alias("href")))


def without_data_markup(source: Column) -> Column:
    """Without comments and elements that hold no data, and stray tags of those names."""
    names = "|".join(DATA_DROPPED)
    text = F.regexp_replace(source, r"(?s)<!--.*?(?:-->|\z)", "")
    text = F.regexp_replace(text, rf"(?is)<({names}){END}[^>]*>.*?</\1{S}*>", "")
    return F.regexp_replace(text, rf"(?i)<(?:{names}){END}[^>]*/?{S}*>", "")


def markup_hrefs(source: Column) -> Column:
    """Raw hrefs of any tag, after cleaning."""
    tags = F.regexp_extract_all(without_data_markup(source), F.lit("<[^>]+>"), F.lit(0))
    return F.array_compact(F.transform(tags, lambda t: attribute(t, "href")))


def markdown_links(source: Column) -> Column:
    """Targets of inline links and images, then of autolinks."""
    inline = F.regexp_extract_all(source, F.lit(rf"!?\[[^\]]*\]\(([^\s)]+)(?:{S}+[\"'][^\"']*[\"'])?\)"), F.lit(1))
    return F.concat(inline, F.regexp_extract_all(source, F.lit(r"(?i)<(https?://[^\s<>]+)>"), F.lit(1)))


def fenced(source: Column, language: str) -> Column:
    """The source in a code fence longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(source, F.lit("`+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit(language + "\n"), source, F.when(source.endswith("\n"), "").otherwise("\n"), fence, F.lit("\n"))


def utf16_length(text: Column) -> Column:
    """Length as JavaScript counts it: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def candidate_kind(raw: Column) -> Column:
    """Bucket of a discovered source."""
    name = F.lower(raw)
    return F.when(name.contains("rss"), "rss").when(name.contains("atom"), "atom").when(name.contains("json") | (name == "api"), "api").when(name.contains("sitemap"), "sitemap").when(name.contains("html"), "html").otherwise(name)


def derived_media_type(fmt: Column, source_type: Column) -> Column:
    return F.when(fmt == "raw", source_type).when(fmt == "markdown", "text/markdown; charset=utf-8").otherwise("application/json")
