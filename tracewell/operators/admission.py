"""Checks at the edges: network intents, peers, parse-result bounds, fingerprint inputs, stored paths and run ids."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import ip
from tracewell.functions.urls import SECRET_NAME
from tracewell.functions.values import SECRET_KEY

METHODS = ["GET", "HEAD"]
#: Bounds of a document parser's result.
BOUNDS = {"links": 4096, "metadata": 128, "alternates": 128, "jsonld": 128}
MAX_TITLE = 16 * 1024


def intent_fault(method: Column, wire_bytes: Column, wall_ms: Column, redirects: Column) -> Column:
    """Why a request must not be made; null if it may."""
    return F.when(~F.upper(method).isin(METHODS), "method").when(~(wire_bytes > 0), "bytes").when(~(wall_ms > 0), "time").when(~redirects.between(0, 20), "redirects")


def comparable(address: str | None) -> str | None:
    """An address in one form; IPv4 mapped into IPv6 is IPv4."""
    if address is None:
        return None
    text = address.strip("[]").lower()
    v4, v6 = ip.parse_ipv4(text), ip.parse_ipv6(text)
    if v6 is not None:
        return str(ipaddress.IPv4Address(v6 & 0xFFFFFFFF)) if v6 >> 32 == 0xFFFF else ip.format_ipv6(v6)
    return text if v4 is not None else None


@F.pandas_udf(T.StringType())
def comparable_address(address: pd.Series) -> pd.Series:
    return address.map(comparable)


def peer_matches(selected: Column, peer: Column) -> Column:
    """Whether the connected peer is the selected address."""
    return F.coalesce(comparable_address(selected) == comparable_address(peer), F.lit(False))


def parse_fault(dom: Column) -> Column:
    """The first bound that a parse result breaks; null if it keeps all."""
    out = F.when(F.octet_length(dom["title"]) > MAX_TITLE, "title")
    for name, most in BOUNDS.items():
        out = out.when(F.size(dom[name]) > most, name)
    return out


def fingerprint_fault(url: Column, headers: Column) -> Column:
    """Secrets that a request fingerprint must not hold: a secret query name or header."""
    names = F.transform(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1))
    return F.when(F.exists(names, lambda n: n.rlike(f"(?i){SECRET_NAME}")), "secret_query").when(F.exists(F.map_keys(headers), lambda k: k.rlike(SECRET_KEY)), "unsafe_header")


def valid_relative_path(path: Column) -> Column:
    """A stored path: relative, of plain segments, without dots that climb."""
    return path.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]*(?:/[A-Za-z0-9_-][A-Za-z0-9._-]*)*$") & ~path.rlike(r"(?:^|/)\.\.?(?:/|$)") & (F.length(path) <= 4096)


def valid_run_id(run_id: Column) -> Column:
    return run_id.rlike(r"^\d{8}T\d{9}Z-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def run_ids(jobs: DataFrame, started_ms: str, seed: str) -> DataFrame:
    """Jobs with a run id: compact start time and an id drawn from the job's own key, so reruns agree."""
    from tracewell.functions.values import compact_run_time

    h = F.sha2(F.col(seed).cast("string"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return jobs.withColumn("run_id", F.concat_ws("-", compact_run_time(F.col(started_ms)), *parts))
