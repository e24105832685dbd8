"""Ranges, Bloom filters and the store against plain versions."""

import ipaddress
import random

from pyspark.sql import functions as F

from tracewell.functions import ip
from tracewell.operators import bloom, cidr, store


def test_first_range_of_a_list(spark, monkeypatch):
    rnd = random.Random(3)
    four = [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(60)]
    six = [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(60)]
    table = [(k, f"{a}/{rnd.randint(0, 12)}", f"o{k}") for k, a in enumerate(four[:20] + six[:20])]
    table += [(100, four[30], "one"), (101, f"{six[30]}/128", "six"), (102, "8.8.8.8/33", "bad"), (103, "x/8", "bad"), (104, None, "bad"), (-1, f"{four[31]}/32", "first"), (105, "::ffff:1.2.3.0/120", "mapped")]
    nets = sorted((k, ipaddress.ip_network(c, strict=False), o) for k, c, o in table if o != "bad")
    rows = [*four, *six, "::FFFF:1.2.3.4", "1.2.3", "fe80::1%eth0", None, four[0]]

    def owner(a):
        try:
            a = ipaddress.ip_address(a) if a and "%" not in a else None
        except ValueError:
            a = None
        return next((o for _, n, o in nets if a is not None and a.version == n.version and a in n), None)

    addresses = spark.createDataFrame([(k, a) for k, a in enumerate(rows)], "k int, address string")
    ranges = cidr.ranges_of(spark.createDataFrame(table, "ord int, cidr string, owner string"))
    for few in (100, 0):
        monkeypatch.setattr(cidr, "BROADCAST_RANGES", few)
        got = {r["k"]: r["owner"] for r in cidr.first_match(addresses, "address", ranges, keep=["owner"]).collect()}
        assert got == {k: owner(a) for k, a in enumerate(rows)}
    assert {r["owner"] for r in cidr.first_match(addresses, "address", ranges.limit(0), keep=["owner"]).collect()} == {None}


def test_ranges_within_earlier_ones_go(spark):
    """an address met every range that held it, some 1400 of a table of 60 000; now one of a length at most."""
    n = 3000
    table = [(k, f"{k * 2246822519 % 2**32 >> 24}.0.0.0/{2 + k % 22}", f"block{k}") for k in range(n)] + [(n, "2001:db8::/32", "six"), (n + 1, "2001:db8::/48", "within"), (n - 1, "2001:db8:0:1::/64", "earlier"), (None, "::/0", "none")]
    ranges = cidr.ranges_of(spark.createDataFrame(table, "ord int, cidr string, owner string"))
    kept = cidr.foremost(ranges, "ord", ["owner"]).collect()
    assert len(kept) == len({(r["prefix"], r["size"]) for r in kept}) < 400 and {r["owner"] for r in kept if r["prefix"].startswith("6")} == {"six", "earlier"}
    rows = spark.createDataFrame([(f"{a}.1.2.3",) for a in range(256)] + [("2001:db8::1",), ("2001:db8:0:1::5",), ("2001:db9::",), ("x",), (None,)], "a string")
    nets = [(k, ipaddress.ip_network(c, strict=False), o) for k, c, o in table if k is not None]
    first = lambda a: next((o for k, net, o in sorted(nets, key=lambda r: r[0]) if ipaddress.ip_address(a) in net), None)
    got = {r["a"]: r["owner"] for r in cidr.first_match(rows, "a", ranges, keep=["owner"]).collect()}
    assert got == {r["a"]: first(r["a"]) if r["a"] and r["a"] != "x" else None for r in rows.collect()}


def test_addresses_as_columns_agree_with_the_parser(spark):
    cases = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::1.2.3.4", "64:ff9b::1.2.3.400", "1:2", ":::", "1::2::3", "g::", "12345::", "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3.4.5", "", None, "fe80::0:0:1", "1:0:0:2:0:0:0:3"]
    rows = spark.createDataFrame([(c,) for c in cases], "a string").select("a", ip.ipv4_number(F.col("a")).alias("n"), ip.ipv6_key(F.col("a")).alias("k"), ip.ipv6_text(ip.ipv6_key(F.col("a"))).alias("t"))
    for r in rows.collect():
        four, six = (None, None) if r["a"] is None else (ip.parse_ipv4(r["a"]), ip.parse_ipv6(r["a"]))
        assert r["n"] == four and r["k"] == (None if six is None else f"{six:032x}"), r["a"]
        assert six is None or r["t"] == ip.format_ipv6(six)


def test_filters_merge_and_miss_nothing(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), "id")
    blocks = bloom.blocks_for(20_000)
    held = bloom.merged(bloom.filter_of(rows.where("id < 6000"), "hash", blocks), bloom.filter_of(rows.where("id between 5000 and 9999"), "hash", blocks))
    got = bloom.asked(rows, "hash", held, blocks).groupBy((F.col("id") < 10_000).alias("stored"), "maybe").count().collect()
    counts = {(r["stored"], r["maybe"]): r["count"] for r in got}
    assert counts[True, True] == 10_000 and (True, False) not in counts and counts.get((False, True), 0) < 500
    assert not bloom.asked(spark.createDataFrame([(None,)], "hash string"), "hash", held, blocks).first()["maybe"]


def test_a_put_does_not_shuffle_the_store(spark, tmp_path, capsys):
    kept = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(5).cast("long").alias("bytes"))
    kept.write.parquet(f"{tmp_path}/store")
    kept = spark.read.parquet(f"{tmp_path}/store")
    new = spark.range(2990, 3100).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.when(F.col("id") == 2995, 6).otherwise(5).cast("long").alias("bytes"))
    fresh, corrupt = store.put(new.unionByName(new), kept, bloom.filter_of(kept, "hash", 1), 1)
    assert fresh.count() == 100 and [r["bytes"] for r in corrupt.collect()] == [6]
    corrupt.explain("formatted")
    plan = capsys.readouterr().out
    tree = plan[: plan.index("\n\n\n")] if "\n\n\n" in plan else plan
    scan = next(i for i, line in enumerate(tree.splitlines()) if "Scan parquet" in line)
    above = tree.splitlines()[:scan]
    # Between the scan of the store and its join with the possible hits stands no exchange of the store.
    joined = max(i for i, line in enumerate(above) if "BroadcastHashJoin" in line)
    assert not any("Exchange" in line for line in above[joined + 1 :] if "Broadcast" not in line)
