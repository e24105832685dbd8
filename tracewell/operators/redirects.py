"""Redirect chains and DNS gates over captured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import ip
from tracewell.functions.formats import utf16_length
from tracewell.functions.values import safe_headers
from tracewell.operators.crawl import cut

REDIRECTS = [301, 302, 303, 307, 308]


def follow(starts: DataFrame, hops: DataFrame, most: int) -> DataFrame:
    """Chains from (start) over (src, dst, status): end, hops and outcome (ok, redirect_limit, redirect_loop, redirect_downgrade).

    One join a hop, at most ``most`` + 1 of them; finished chains leave the loop.
    """
    moves = hops.where(F.col("status").isin(REDIRECTS)).select(F.col("src").alias("at"), "dst")
    live = starts.select("start", F.col("start").alias("at"), F.array("start").alias("seen"))
    done = None
    for hop in range(most + 1):
        step = live.join(moves, "at", "left")
        loop = F.array_contains("seen", F.col("dst"))
        outcome = F.when(F.col("dst").isNull(), "ok").when(F.lit(hop) >= most, "redirect_limit").when(loop, "redirect_loop").when(F.col("at").startswith("https:") & F.col("dst").startswith("http:"), "redirect_downgrade")
        step = cut(step.withColumn("outcome", outcome))
        ended = step.where("outcome is not null").select("start", F.col("at").alias("end"), F.lit(hop).alias("hops"), "outcome")
        done = ended if done is None else done.unionByName(ended)
        live = step.where("outcome is null").select("start", F.col("dst").alias("at"), F.concat("seen", F.array("dst")).alias("seen"))
        if not live.take(1):
            break
    return done


def location(headers: Column) -> Column:
    """The Location of a redirect (headers: map of name to array of values): the only value of the only such header, of 1 to
    8192 UTF-16 units without control characters; else null."""
    named = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == "location"))
    value = F.when((F.size(named) == 1) & (F.size(F.get(named, F.lit(0))) == 1), F.get(F.get(named, F.lit(0)), F.lit(0)))
    return F.when((value != "") & ~value.rlike(r"[\x00-\x1f\x7f]") & (utf16_length(value) <= 8192), value)


def evidence(status: Column, final_url: Column, chain: Column, address: Column, headers: Column, wire: Column, decoded: Column) -> Column:
    """What a response leaves in the record; null where there was none."""
    row = F.struct(status.alias("status_code"), final_url.alias("final_url"), F.coalesce(chain, F.array().cast("array<string>")).alias("redirect_chain"), address.alias("selected_address"), safe_headers(headers).alias("headers"), wire.alias("wire_bytes"), decoded.alias("decoded_bytes"))
    return F.when(status.isNotNull(), row)


def dns_gate(answers: DataFrame) -> DataFrame:
    """Per host of answers (host, address) of both families: whether all are public, the distinct answers, and the selected one.

    Answers are ordered by family and number; the first public one is selected, in its shortest form. An answer that
    is no address denies the host, without a reason of its own.
    """
    rows = answers.withColumns({"v4": ip.ipv4_number(F.col("address")), "v6": ip.ipv6_key(F.col("address"))})
    # One key that sorts by family and number; what is no address has none.
    key = F.when(F.col("v4").isNotNull(), F.concat(F.lit("4"), F.lpad(F.hex("v4"), 8, "0"))).otherwise(F.concat(F.lit("6"), "v6"))
    rows = rows.withColumns({"key": key, "reason": F.coalesce(ip.ipv4_reason(F.col("v4")), ip.ipv6_reason(F.col("v6")))})
    public = F.col("reason").eqNullSafe(ip.PUBLIC)
    out = rows.groupBy("host").agg(F.coalesce(F.bool_and(public), F.lit(False)).alias("public"), F.count_distinct(F.coalesce("key", "address")).alias("answers"), F.min(F.struct("key", "address")).alias("first"), F.min_by("reason", F.when(~public, F.col("key"))).alias("deny_reason"))
    first = F.when(F.col("first.key").startswith("6"), ip.ipv6_text(F.substring("first.key", 2, 32))).otherwise(F.col("first.address"))
    return out.select("host", "public", "answers", F.when(F.col("public"), first).alias("selected"), "deny_reason")
