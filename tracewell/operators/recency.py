"""A cache of bounded size and age over a log of accesses: what each access finds, without walking the log in order.

A least recently used cache holds a key exactly as long as fewer than ``capacity`` other keys have been used since it
was, whatever expires meanwhile: an access renews or fetches, and either makes its key the most recent. So what a cache
holds is the list of the last distinct keys, and such lists merge: the later one, then what it lacks of the earlier, cut
at the capacity. Each log is cut into blocks of ``BLOCK`` accesses; the lists at their starts come from the blocks' own
lists by doubling (most logs need a few rounds, as full lists end it), and every block then says by itself which
accesses still find their key. Age is a chain: an entry lives ``ttl_ms`` from its fetch, the first access after that
fetches again. Each access knows the one that would follow it in such a chain, and doubling these steps marks the fetches.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.shared import cut, numbered

#: Origins that a robots cache holds, and how long, in milliseconds.
ROBOTS_ENTRIES, ROBOTS_TTL_MS = 256, 86_400_000
BLOCK = 4096


def later_first(late: Column, early: Column, capacity: int) -> Column:
    """Two lists of distinct keys, most recent first, as one."""
    return F.slice(F.concat(late, F.array_except(early, late)), 1, capacity)


def lists_at_starts(rows: DataFrame, capacity: int) -> DataFrame:
    """(cache, block, held): the keys that were used last before each block, most recent first."""
    last = rows.groupBy("cache", "block", "key").agg(F.max("pos").alias("last"))
    recent = F.transform(F.sort_array(F.collect_list(F.struct("last", "key")), asc=False), lambda x: x["key"])
    lists = cut(last.groupBy("cache", "block").agg(F.slice(recent, 1, capacity).alias("held")))
    step = 1
    while lists.where((F.col("block") >= step) & (F.size("held") < capacity)).take(1):
        before = lists.select("cache", (F.col("block") + step).alias("block"), F.col("held").alias("early"))
        merged = F.coalesce(later_first(F.col("held"), F.col("early"), capacity), F.col("held"))
        lists = cut(lists.join(before, ["cache", "block"], "left").select("cache", "block", merged.alias("held")))
        step *= 2
    return lists.select("cache", (F.col("block") + 1).alias("block"), "held")


def found_in_time(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` (cache, key, pos, at, block) with ``resident``: whether the cache still holds the key, as far as its size goes."""
    held = lists_at_starts(rows, capacity)
    entries = rows.select("cache", "block", "key", "pos", "at").unionByName(
        held.select("cache", "block", F.posexplode("held").alias("rank", "key")).select("cache", "block", "key", (-1 - F.col("rank")).cast("long").alias("pos"), F.lit(0).cast("long").alias("at"))
    )

    def replay(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        cache: OrderedDict = OrderedDict()
        flags = []
        for key in block["key"]:
            flags.append(key in cache)
            cache[key] = None
            cache.move_to_end(key)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return block[["cache", "key", "pos", "at"]].assign(resident=flags)[block["pos"] >= 0]

    # A list without accesses of its block (after the last one) has nothing to say.
    return entries.groupBy("cache", "block").applyInPandas(replay, "cache string, key string, pos long, at long, resident boolean")


def outcomes(accesses: DataFrame, cache: Column, key: Column, at: Column, order: list[str], capacity: int = ROBOTS_ENTRIES, ttl_ms: int = ROBOTS_TTL_MS) -> DataFrame:
    """Accesses (all columns) with ``pos`` (their place in their cache's log) and ``outcome``: hit, cold, evicted or expired.

    ``at`` is in milliseconds; accesses of one time stand in the order of ``order``, which must tell them apart. Equal keys
    have equal text. A null cache is a cache of its own; accesses without key or time find nothing (``cold``) and leave
    nothing. A time to live of 0 keeps nothing.
    """
    spark_columns = accesses.columns
    rows = accesses.select("*", cache.cast("string").alias("__cache"), key.cast("string").alias("__key"), at.cast("long").alias("__at"))
    usable = F.col("__key").isNotNull() & F.col("__at").isNotNull() & F.lit(ttl_ms > 0)
    log = cut(numbered(rows.where(usable), ["__cache"], ["__at", *order]))
    narrow = log.select(F.coalesce(F.concat(F.lit("="), "__cache"), F.lit("")).alias("cache"), F.col("__key").alias("key"), "pos", F.col("__at").alias("at"), F.expr(f"pos div {BLOCK}").alias("block"))
    seen = found_in_time(narrow, capacity)
    own = Window.partitionBy("cache", "key").orderBy("pos")
    # A stay begins where the cache does not hold the key.
    seen = seen.withColumn("first", F.row_number().over(own) == 1).withColumn("stay", F.sum((~F.col("resident")).cast("int")).over(own))
    # The access that fetches next, if this one does: the first of the stay that is ttl_ms or more later.
    marks = seen.select("cache", "key", "stay", "pos", F.col("at").alias("t"), F.lit(0).alias("asks")).unionByName(seen.select("cache", "key", "stay", "pos", (F.col("at") + ttl_ms).alias("t"), F.lit(1).alias("asks")))
    back = Window.partitionBy("cache", "key", "stay").orderBy(F.desc("t"), "asks", F.desc("pos"))
    following = F.last(F.when(F.col("asks") == 0, F.col("pos")), ignorenulls=True).over(back)
    steps = cut(marks.withColumn("next", following).where("asks = 1 and next is not null").select("cache", "pos", "next"))
    fetched = cut(seen.where("not resident").select("cache", "pos"))
    while True:
        reached = fetched.join(steps, ["cache", "pos"]).select("cache", F.col("next").alias("pos"))
        reached = cut(reached.join(fetched, ["cache", "pos"], "left_anti").distinct())
        if not reached.take(1):
            break
        fetched = cut(fetched.unionByName(reached))
        double = steps.select("cache", F.col("pos").alias("next"), F.col("next").alias("after"))
        steps = cut(steps.join(double, ["cache", "next"]).select("cache", "pos", F.col("after").alias("next")))
    done = seen.join(fetched.withColumn("fetches", F.lit(True)), ["cache", "pos"], "left")
    outcome = F.when(F.col("first"), "cold").when(~F.col("resident"), "evicted").when(F.col("fetches"), "expired").otherwise("hit")
    told = done.select(F.col("cache").alias("__c"), F.col("pos").alias("__pos"), outcome.alias("outcome"))
    met = log.join(told, (F.coalesce(F.concat(F.lit("="), "__cache"), F.lit("")) == F.col("__c")) & (F.col("pos") == F.col("__pos")))
    rest = rows.where(~usable).select(*spark_columns, F.lit(None).cast("long").alias("pos"), F.lit("cold").alias("outcome"))
    return met.select(*spark_columns, "pos", "outcome").unionByName(rest)
