"""Crawls: scope, level-synchronous traversal, ledgers, budgets and schedules."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.shared import cut

GLOB_MOST = 1024
#: Equal offers that are written out at once.
OFFERS = 10_000


def glob_regex(glob: str) -> str:
    """Regular expression of an anchored path glob: * within a segment, ** across."""
    if not glob.startswith("/") or not 1 <= len(glob) <= GLOB_MOST or re.search(r"[\\?#\[\]{}()|^\x00-\x1f\x7f]|\*{3,}", glob) or {".", ".."} & set(glob.split("/")):
        raise ValueError("a glob must be an anchored, safe path")
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p) or re.sub(r"([.+$])", r"\\\1", p) for p in re.findall(r"\*\*|\*|[^*]+", glob)) + "$"


def scope_reason(path: Column, include: list[str], exclude: list[str], seed: Column | None = None) -> Column:
    """Why a path is out of scope: excluded before not included; the seed needs no inclusion."""
    any_of = lambda globs: path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)
    outside = ~any_of(include)
    return F.when(any_of(exclude), "excluded").when(outside if seed is None else outside & ~seed, "not_included")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of everything that links (src, dst) reach from the seeds (url) within max_depth.

    One level at a time: the frontier joins the edges, and what was seen before drops out by an anti-join. Each level
    is cut, so plans do not grow with depth; only whether a level is empty comes back.
    """
    edges = cut(edges.select("src", "dst").distinct())
    level = cut(seeds.select("url", F.lit(0).alias("depth")).distinct())
    seen = level
    for depth in range(1, max_depth + 1):
        found = level.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        level = cut(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not level.take(1):
            break
        seen = cut(seen.unionByName(level))
    return seen


def discovery_order(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """The first parent of every URL, by depth and name: (url, depth, parent). crawl_on_demand() gives the exact order."""
    child = visited.select(F.col("url").alias("dst"), F.col("depth").alias("child_depth"))
    parent = visited.select(F.col("url").alias("src"), "depth")
    pairs = edges.join(parent, "src").join(child, "dst").where("child_depth = depth + 1")
    return pairs.groupBy(F.col("dst").alias("url"), F.col("child_depth").alias("depth")).agg(F.min("src").alias("parent"))


def ledger(accepted: DataFrame, skipped: DataFrame, blocked: DataFrame, failed: DataFrame, unvisited: DataFrame) -> DataFrame:
    """One ledger of five tagged parts; parts hold (url, depth, reason)."""
    parts = {"accepted": accepted, "skipped": skipped, "blocked": blocked, "failed": failed, "unvisited": unvisited}
    out = None
    for state, part in parts.items():
        rows = part.select(F.lit(state).alias("state"), "url", "depth", "reason")
        out = rows if out is None else out.unionByName(rows)
    return out


def crawl_status(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Status of each crawl from its ledger, the first blocked reason, and the counts."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = rows.groupBy(*by).agg(*[n(s).alias(s) for s in ("accepted", "skipped", "blocked", "failed", "unvisited")], F.min_by(F.when(F.col("state") == "blocked", F.col("reason")), F.when(F.col("state") == "blocked", F.col(order))).alias("blocked_code"))
    status = F.when((F.col("accepted") > 0) & (F.col("blocked") + F.col("failed") + F.col("unvisited") > 0), "partial").when(F.col("accepted") > 0, "ok").when(F.col("blocked") > 0, "blocked").otherwise("exhausted")
    return out.withColumn("status", status)


def byte_total(wire: Column, decoded: Column, artifact: Column, total: Column) -> Column:
    """Bytes of a page: an explicit total wins if positive."""
    return F.when(total > 0, total).otherwise(F.coalesce(wire, F.lit(0)) + F.coalesce(decoded, F.lit(0)) + F.coalesce(artifact, F.lit(0)))


def byte_budget(pages: DataFrame, by: list[str], order: str, n_bytes: str, budget: int) -> DataFrame:
    """States under a running byte budget: the page that crosses it is blocked, what comes after is unvisited."""
    so_far = F.sum(n_bytes).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = pages.withColumn("total", so_far)
    before = F.col("total") - F.col(n_bytes)
    return rows.withColumn("state", F.when(F.col("total") <= budget, "accepted").when(before <= budget, "blocked").otherwise("unvisited"))


def page_limit(pages: DataFrame, by: list[str], order: str, allowed: str, most: int) -> DataFrame:
    """max_pages counts pages that robots allow; denied ones cost nothing."""
    n = F.sum(F.col(allowed).cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pages.withColumn("nth", n).withColumn("state", F.when(~F.col(allowed) & (F.col("nth") <= most), "blocked").when(F.col("nth") <= most, "accepted").otherwise("unvisited"))


def schedule(pages: DataFrame, by: list[str], order: str, delay: str, wall_ms: int) -> DataFrame:
    """Start of each page when all are ready at 0: the delays of the pages before it; at the deadline it is too late."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(delay).over(w), F.lit(0))
    return pages.withColumn("start_ms", start).withColumn("reason", F.when(F.col("start_ms") >= wall_ms, "max_time"))


def exact_schedule(pages: DataFrame, by: list[str], retries: int, wall_ms: int, delay_ms: int, concurrency: int) -> DataFrame:
    """Sequential budgets of one crawl: starts with waits for readiness, and a retry budget that a batch's first page
    may use whole. ``pages``: by, seq, ready_ms, delay_ms, want_retries.

    A start is max(ready, start before + gap before). With the gaps summed up (g) that is g + running max(ready - g), so two
    windows give every start; likewise what the first pages of batches want, summed up, is what is gone of the budget.
    The first page that is late ends its crawl: those after it are late with it.
    """
    order = Window.partitionBy(*by).orderBy("seq")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pages.select(*by, "seq", F.col("ready_ms").cast("long").alias("ready"), F.greatest(F.lit(delay_ms), F.col("delay_ms")).cast("long").alias("gap"), F.col("want_retries").cast("long").alias("want"), (F.row_number().over(order) - 1).alias("k"))
    rows = rows.withColumn("opens", F.col("k") % concurrency == 0).withColumn("gaps", F.coalesce(F.sum("gap").over(before), F.lit(0)))
    rows = rows.withColumn("start", F.col("gaps") + F.max(F.col("ready") - F.col("gaps")).over(so_far))
    rows = rows.withColumn("late", F.col("start") >= wall_ms).withColumn("spent", F.coalesce(F.sum(F.when(F.col("opens"), F.col("want"))).over(before), F.lit(0)))
    # Starts never fall, so what is late stays late; the least late start is the one that ended the crawl.
    ended = F.min(F.when(F.col("late"), F.struct("k", "start"))).over(so_far)
    rows = rows.withColumn("end", ended)
    after = F.col("k") > F.coalesce(F.col("end.k"), F.col("k"))
    offered = F.when(F.col("opens") & ~after, F.greatest(F.lit(0), F.lit(retries) - F.col("spent"))).otherwise(0).cast("long")
    return rows.select(*by, "seq", F.coalesce("end.start", "start").alias("start_ms"), offered.alias("offered"), F.when(F.col("late"), 0).otherwise(F.least(offered, F.col("want"))).cast("long").alias("retries_used"), F.when(F.col("late"), "max_time").alias("reason"))


def simulate(seed: str, pages: dict[str, dict], limits: dict[str, int], scope=None, wanted: list[str] | None = None) -> tuple[list[dict], dict]:  # noqa: ANN001
    """One crawl in exact order over captured pages: its ledger and its summary.

    A page holds ``links``, ``robots`` (allowed), ``kind`` and ``code`` of its outcome, ``bytes``, ``delay_ms``,
    ``retries`` and ``redirects``, and maybe ``sitemaps``, which its robots file names: they are offered once the page is
    allowed, whatever becomes of it. Limits: pages, depth, frontier, bytes, wall_ms, delay_ms, concurrency, retries,
    redirects. ``scope(url, is_seed)`` gives a reason against a URL, or None. Batches are barriers: discoveries of a
    batch are queued in the order of its dispatch. With a list ``wanted``, a URL that ``pages`` does not hold ends the
    replay, and the list gets what the queue lacks; without one it is not found.
    """
    queue: list[tuple[str, int]] = []
    seen: set[str] = set()
    named: set[str] = set()  # sitemaps that were offered
    rows: list[dict] = []
    limit: str | None = None
    retries, redirects, total, dispatched = limits["retries"], limits["redirects"], 0, 0
    clock, gap, started = 0, 0, False

    def note(state: str, url: str, depth: int, reason: str | None) -> None:
        rows.append({"state": state, "url": url, "depth": depth, "reason": reason})

    def offer(url: str, depth: int, is_seed: bool = False, ahead: int = 0) -> None:
        nonlocal limit
        reason = "max_depth" if depth > limits["depth"] else scope(url, is_seed) if scope else None
        reason = reason or ("duplicate" if url in seen else "max_frontier" if len(queue) - ahead >= limits["frontier"] else None)
        if reason is None:
            seen.add(url)
            queue.append((url, depth))
        elif reason in ("max_depth", "max_frontier"):
            note("unvisited", url, depth, reason)
            limit = limit or reason
        else:
            note("skipped", url, depth, reason)

    offer(seed, 0, True)
    stop = None
    while queue and stop is None:
        batch = []
        while queue and len(batch) < limits["concurrency"] and stop is None:
            url, depth = queue[0]
            page = pages.get(url)
            if page is None and wanted is not None:
                wanted += [u for u, _ in queue if u not in pages]
                return rows, {}
            if clock >= limits["wall_ms"]:
                stop = "max_time"
            elif page is not None and not page["robots"]:
                queue.pop(0)
                note("blocked", url, depth, "robots_denied")
                continue
            for sitemap in page.get("sitemaps", ()) if page is not None and stop is None else ():
                if sitemap not in named:
                    named.add(sitemap)
                    offer(sitemap, depth + 1, ahead=1)  # the page itself has left the queue
            if stop:
                pass
            elif dispatched >= limits["pages"]:
                stop = "max_pages"
            elif total >= limits["bytes"]:
                stop = "max_bytes"
            else:
                begin = clock + max(limits["delay_ms"], gap) if started else clock
                if begin >= limits["wall_ms"]:
                    stop = "max_time"
                    continue
                queue.pop(0)
                clock, started, gap = begin, True, page["delay_ms"] if page else 0
                dispatched += 1
                # The first page of a batch is offered all that is left of the shared budgets.
                batch.append((url, depth, page, (retries, redirects) if not batch else (0, 0)))
        for url, depth, page, (may_retry, may_redirect) in batch:
            if page is None:
                note("blocked", url, depth, "not_found")
                continue
            retries -= min(may_retry, page["retries"])
            redirects -= min(may_redirect, page["redirects"])
            total += page["bytes"]
            if total > limits["bytes"]:
                note("blocked", url, depth, "hard_limit")
                stop = stop or "max_bytes"
            elif page["kind"] == "success":
                note("accepted", url, depth, None)
                for link in page["links"]:
                    offer(link, depth + 1)
            else:
                note("blocked" if page["kind"] == "terminal" else "failed", url, depth, page["code"])
    limit = limit or stop
    for url, depth in queue:
        note("unvisited", url, depth, stop)
    n = {s: sum(r["state"] == s for r in rows) for s in ("accepted", "skipped", "blocked", "failed", "unvisited")}
    whole = not (limit or n["blocked"] or n["failed"] or n["unvisited"])
    status = ("ok" if whole else "partial") if n["accepted"] else "blocked" if n["blocked"] else "exhausted"
    return rows, {"status": status, "limit": limit, "bytes": total, "pages": dispatched, "retries_left": retries, "redirects_left": redirects, **n}


def ledger_of(rows: pd.DataFrame, limits: dict[str, int], scope=None, wanted: list[str] | None = None) -> pd.DataFrame:  # noqa: ANN001
    """simulate() on the rows of one crawl, as a frame."""
    columns = [c for c in PAGE_COLUMNS if c in rows]
    site = {u: {**dict(zip(columns, v, strict=True)), "links": list(v[0])} for u, *v in rows[["url", *columns]].itertuples(index=False, name=None)}
    ledger_rows, summary = simulate(rows["seed"].iloc[0], site, limits, scope, wanted)
    return pd.DataFrame(ledger_rows, columns=["state", "url", "depth", "reason"]).assign(seq=range(len(ledger_rows)), status=summary.get("status"))


PAGE_COLUMNS = ["links", "robots", "kind", "code", "bytes", "delay_ms", "retries", "redirects", "sitemaps"]


def crawl_exact(pages: DataFrame, by: list[str], limits: dict[str, int]) -> DataFrame:
    """simulate() for every crawl whose pages are all at hand: ``pages`` holds by, seed, url, links and the page columns.
    Where sites may be larger than the limits, crawl_on_demand() fetches what a crawl asks for."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out = ledger_of(rows, limits)
        for c in by:
            out[c] = rows[c].iloc[0]
        return out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", state string, url {kinds['url']}, depth int, reason string, seq long, status string"
    return pages.groupBy(*by).applyInPandas(fold, schema)


def fetched(wanted: DataFrame, narrow: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``wanted`` (url, ...) with the columns of a page: what the site and ``decide`` say of each URL."""
    decided = decide(wanted.select("url").distinct())
    if "sitemaps" not in decided.columns:
        decided = decided.withColumn("sitemaps", F.lit(None).cast("array<string>"))
    found = wanted.join(narrow, "url", "left").join(decided, "url", "left")
    return found.select(*wanted.columns, F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.coalesce("robots", F.lit(True)).alias("robots"), F.coalesce("kind", F.lit("terminal")).alias("kind"), F.coalesce("code", F.lit("not_found")).alias("code"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("delay_ms", F.lit(0)).cast("long").alias("delay_ms"), F.lit(0).alias("retries"), F.lit(0).alias("redirects"), F.coalesce("sitemaps", F.array().cast("array<string>")).alias("sitemaps"))


def crawl_on_demand(crawls: DataFrame, site: DataFrame, decide: Callable[[DataFrame], DataFrame], limits: dict[str, int], include: list[str] = ("/**",), exclude: list[str] = ()) -> DataFrame:
    """Exact ledgers of ``crawls`` (crawl, seed) over ``site`` (url, links, kind, code, bytes), of any size.

    A crawl replays until its queue comes to a URL that it has not asked for; what its queue lacks is then joined to
    the site, all crawls at once, and the replay starts again. A task thus holds one crawl's own pages, which its limits
    bound, never a whole site; there is about one round for each level of depth. ``decide`` gives (url, robots,
    delay_ms, and maybe sitemaps) for a table of URLs. ``site``, and what ``decide`` reads, should be cut: each round joins them. A URL that the site lacks is ``not_found``. The rows of a crawl are in order of ``seq``.
    """
    include, exclude = list(include), list(exclude)
    takes, drops = ([re.compile(glob_regex(g)) for g in globs] for globs in (include, exclude))
    kind = crawls.schema["crawl"].dataType.simpleString()

    def scope(url: str, is_seed: bool) -> str | None:
        path = re.sub(r"^[a-z]+://[^/?#]*([^?#]*).*$", r"\1", url, flags=re.S) or "/"
        if any(r.match(path) for r in drops):
            return "excluded"
        return None if is_seed or any(r.match(path) for r in takes) else "not_included"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        wanted: list[str] = []
        out = ledger_of(rows[rows["url"].notna()] if rows["url"].notna().any() else rows, limits, scope, wanted)
        if wanted:
            out = pd.DataFrame({"state": "wanted", "url": wanted, "depth": 0, "reason": None, "seq": range(len(wanted)), "status": None})
        return out.assign(crawl=rows["crawl"].iloc[0], seed=rows["seed"].iloc[0])

    schema = f"crawl {kind}, seed string, state string, url string, depth int, reason string, seq long, status string"
    narrow = site.select("url", "links", "kind", "code", "bytes")
    wanted = crawls.select("crawl", "seed", F.col("seed").alias("url"))
    known = None
    while True:
        found = fetched(wanted, narrow, decide)
        known = cut(found if known is None else known.unionByName(found))
        out = cut(known.groupBy("crawl").applyInPandas(fold, schema))
        wanted = out.where("state = 'wanted'").select("crawl", "seed", "url")
        if not wanted.take(1):
            return out


def crawl_whole(crawls: DataFrame, site: DataFrame, decide: Callable[[DataFrame], DataFrame], max_depth: int, include: list[str] = ("/**",), exclude: list[str] = ()) -> DataFrame:
    """Ledgers (crawl, url, depth, state, reason) of ``crawls`` (crawl, seed) that only their depth limits, in no order.

    The arguments are those of crawl_on_demand(), and so are the rows where no other of its limits is met and pages are
    dispatched one by one. Without a queue to be cut, the first of equal offers need not be known: a level is what the one
    before offers and no level before holds, so a crawl of any size is joins by crawl and URL and never in one task.
    """
    narrow = site.select("url", "links", "kind", "code", "bytes")
    path = F.regexp_replace("url", r"(?s)^[a-z]+://[^/?#]*([^?#]*).*$", "$1")
    path = F.when(path == "", "/").otherwise(path)
    outcome = F.when(~F.col("robots"), "blocked").when(F.col("kind") == "success", "accepted").when(F.col("kind") == "terminal", "blocked").otherwise("failed")
    code = F.when(~F.col("robots"), "robots_denied").when(F.col("kind") != "success", F.col("code"))
    offers = crawls.select("crawl", F.col("seed").alias("url"))
    seen, named, out = crawls.select("crawl", F.col("seed").alias("url")).limit(0), None, None
    for depth in range(max_depth + 2):
        why = F.lit("max_depth") if depth > max_depth else scope_reason(path, list(include), list(exclude), F.lit(depth == 0))
        counted = offers.groupBy("crawl", "url").agg(F.count("*").alias("n")).withColumn("why", why)
        counted = counted.join(seen.withColumn("old", F.lit(True)), ["crawl", "url"], "left")
        counted = cut(counted.withColumn("new", F.col("why").isNull() & F.col("old").isNull()))
        # Offers beyond the first of a URL, each a row, with no long array for many of them.
        again = counted.withColumn("n", F.col("n") - F.col("new").cast("int")).where("n > 0")
        again = again.withColumn("left", F.explode(F.expr(f"transform(sequence(0, (n - 1) div {OFFERS}), k -> least({OFFERS}, n - k * {OFFERS}))"))).withColumn("k", F.explode(F.expr("sequence(1, left)")))
        state, reason = F.when(F.col("why") == "max_depth", "unvisited").otherwise("skipped"), F.coalesce("why", F.lit("duplicate"))
        rows = again.select("crawl", "url", F.lit(depth).alias("depth"), state.alias("state"), reason.alias("reason"))
        out = rows if out is None else out.unionByName(rows)
        level = counted.where("new").select("crawl", "url")
        if not level.take(1):
            break
        seen = cut(seen.unionByName(level))
        found = cut(fetched(level, narrow, decide))
        out = out.unionByName(found.select("crawl", "url", F.lit(depth).alias("depth"), outcome.alias("state"), code.alias("reason")))
        names = found.where("robots").select("crawl", F.explode("sitemaps").alias("url")).distinct()
        names = cut(names if named is None else names.join(named, ["crawl", "url"], "left_anti"))
        named = names if named is None else cut(named.unionByName(names))
        offers = names.unionByName(found.where("robots AND kind = 'success'").select("crawl", F.explode("links").alias("url")))
    return out
