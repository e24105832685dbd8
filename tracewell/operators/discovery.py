"""Sources that lead to pages: sitemaps and their indexes, feeds, and the alternates that pages name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import formats, urls
from tracewell.functions.markdown import decoded
from tracewell.operators.shared import cut

#: What of a sitemap, an index, an RSS or an Atom feed names others.
LISTED = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>, channel struct<item:array<struct<link:string>>>, entry array<struct<link:array<struct<_href:string,_rel:string>>>>"


def listed(files: DataFrame) -> DataFrame:
    """(url, leads, target) of XML files (url, body): ``leads`` is sitemap for what an index lists, page for other entries.

    A body that is no XML, or of another root, lists nothing. Of an Atom entry only its alternates count.
    """
    x = F.from_xml("body", LISTED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    rows = files.select("url", x.alias("x"))
    empty = F.array().cast("array<string>")
    links = F.flatten(F.transform("x.entry", lambda e: F.transform(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), lambda k: k["_href"])))
    pages = F.concat(F.coalesce(F.transform("x.url", lambda u: u["loc"]), empty), F.coalesce(F.transform("x.channel.item", lambda i: i["link"]), empty), F.coalesce(links, empty))
    tagged = lambda kind, targets: F.transform(F.coalesce(targets, empty), lambda t: F.struct(F.lit(kind).alias("leads"), t.alias("target")))
    every = F.concat(tagged("sitemap", F.transform("x.sitemap", lambda s: s["loc"])), tagged("page", pages))
    rows = rows.select("url", F.transform(every, lambda e: e["leads"]).alias("leads"), urls.resolve_each(F.transform(every, lambda e: e["target"]), F.col("url")).alias("targets"))
    return rows.select("url", F.explode(F.arrays_zip("leads", "targets")).alias("e")).select("url", "e.leads", F.col("e.targets").alias("target")).where("target is not null").distinct()


def own_origin(a: Column, b: Column) -> Column:
    origin = lambda u: F.regexp_extract(u, "^([a-z]+://[^/?#]+)", 1)
    return origin(a) == origin(b)


def follow(starts: DataFrame, files: DataFrame, max_depth: int) -> DataFrame:
    """(crawl, url, depth, source) of the pages that sitemaps (crawl, url) lead to, through indexes, on their own origin.

    One level at a time: what indexes list joins the files and drops what was read before, so indexes may list each other
    in circles, and a file is read once however often it is listed. ``depth`` is 1 for what a start lists itself; a page
    keeps the least, and of equals the first source. Files that are not there lead nowhere.
    """
    entries = cut(listed(files).where(own_origin(F.col("url"), F.col("target"))))
    level = cut(starts.select("crawl", "url").distinct())
    read, found = level, None
    for depth in range(1, max_depth + 1):
        led = cut(level.join(entries, "url").select("crawl", F.col("url").alias("source"), "leads", "target"))
        pages = led.where("leads = 'page'").select("crawl", F.col("target").alias("url"), F.lit(depth).alias("depth"), "source")
        found = pages if found is None else found.unionByName(pages)
        level = cut(led.where("leads = 'sitemap'").select("crawl", F.col("target").alias("url")).distinct().join(read, ["crawl", "url"], "left_anti"))
        if not level.take(1):
            break
        read = cut(read.unionByName(level))
    return found.groupBy("crawl", "url").agg(F.min(F.struct("depth", "source")).alias("m")).select("crawl", "url", "m.depth", "m.source")


def alternates(source: Column, sources: tuple[str, ...]) -> Column:
    """Raw targets of a page's alternates whose kind is among ``sources``, in order; other alternates count as html."""
    wanted = F.filter(formats.link_tags(source), lambda t: F.array_contains(t["rel"], "alternate") & t["href"].isNotNull() & kind_of(t["type"]).isin(list(sources)))
    return F.transform(wanted, lambda t: decoded(t["href"]))


def kind_of(declared: Column) -> Column:
    kind = formats.candidate_kind(declared)
    return F.when(kind == "alternate", "html").otherwise(kind)
