"""The evidence store as tables: content-addressed objects, lineage, caches, journals and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.values import digest, object_path
from tracewell.operators import bloom, variants
from tracewell.operators.shared import cut

HASH = "^sha256:[0-9a-f]{64}$"
MAX_OBJECT, MAX_JOURNAL = 50 << 20, 16 << 20
STATUSES = ["ok", "partial", "exhausted", "blocked", "internal_error", "output_failure", "interrupted"]


def objects(rows: DataFrame, body: str, order: str, keep: list[str] | None = None) -> DataFrame:
    """One object for each distinct content: hash, path, bytes, copies and the first of ``order``.

    Bodies never move: they are hashed where they are read, and only narrow rows are grouped. ``outcome`` is ``ok``, or
    ``object_too_large`` for contents that the store does not take.
    """
    narrow = rows.select(digest(F.col(body)).alias("hash"), F.octet_length(body).cast("long").alias("bytes"), F.col(order), *(keep or []))
    out = narrow.groupBy("hash").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"), F.min(order).alias(f"first_{order}"))
    return out.withColumns({"path": object_path(F.col("hash")), "outcome": F.when(F.col("bytes") > MAX_OBJECT, "object_too_large").otherwise("ok")})


#: Objects that may be held already, up to which they are broadcast to the store (some 100 bytes each).
BROADCAST_OBJECTS = 200_000


def put(new: DataFrame, existing: DataFrame, held: DataFrame | None = None, blocks: int = 1) -> tuple[DataFrame, DataFrame]:
    """Objects to append, and those whose stored size differs from what has the same hash (corrupt).

    ``held`` is the Bloom filter (see bloom) of the store's hashes, in ``blocks``. Objects that it rules out are new; only
    the others meet the store, and where they are few enough to be broadcast, the store is read but not shuffled.
    """
    new = new.where("outcome = 'ok'") if "outcome" in new.columns else new
    new = new.dropDuplicates(["hash"])
    if held is None:
        sure, maybe = None, new
    else:
        told = cut(bloom.asked(new, "hash", held, blocks))
        sure, maybe = told.where("not maybe").drop("maybe"), told.where("maybe").drop("maybe")
    few = maybe.limit(BROADCAST_OBJECTS + 1).count() <= BROADCAST_OBJECTS
    keys = maybe.select("hash")
    met = existing.join(F.broadcast(keys) if few else keys, "hash", "left_semi").select("hash", F.col("bytes").alias("stored"))
    met = met.groupBy("hash").agg(F.min("stored").alias("stored"))
    rows = maybe.join(met, "hash", "left")
    fresh = rows.where("stored is null").select(*new.columns)
    return fresh if sure is None else sure.unionByName(fresh), rows.where("bytes <> stored")


def orphans(artifacts: DataFrame) -> DataFrame:
    """Artifacts (run_id, hash, derived_from) whose origin is not in the same manifest."""
    own = artifacts.select("run_id", F.col("hash").alias("derived_from"))
    return artifacts.where("derived_from is not null").join(own, ["run_id", "derived_from"], "left_anti")


def manifest_faults(manifests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, fault): unknown statuses, ok runs without source and selected artifact, orphans, malformed hashes."""
    bad_status = manifests.where(~F.col("status").isin(STATUSES)).select("run_id", F.lit("status").alias("fault"))
    held = artifacts.groupBy("run_id").agg(F.max((F.col("role") == "source").cast("int")).alias("source"), F.max((F.col("role") != "source").cast("int")).alias("selected"))
    bare = manifests.where("status = 'ok'").join(held.where("source = 1 and selected = 1"), "run_id", "left_anti").select("run_id", F.lit("incomplete").alias("fault"))
    bad_hash = artifacts.where(~F.col("hash").rlike("^sha256:[0-9a-f]{64}$")).select("run_id", F.lit("hash").alias("fault"))
    return bad_status.unionByName(bare).unionByName(bad_hash).unionByName(orphans(artifacts).select("run_id", F.lit("lineage").alias("fault"))).distinct()


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert: the last row of each key (ranked within partitions first, so a hot key stays small)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Each request's cache status by mode: off, miss, hit, and for stale records a conditional request."""
    joined = requests.join(cache, "fingerprint", "left")
    known = F.col("expires_at").isNotNull()
    fresh = known & (F.col("expires_at") > now)
    status = F.when(F.col("mode") == "off", "off").when((F.col("mode") == "use") & fresh, "hit").when(known, "conditional").otherwise("miss")
    return joined.withColumn("cache_status", status)


def revalidated(lookups: DataFrame, responses: DataFrame) -> DataFrame:
    """After the fetch: a 304 revalidates a record that was asked for conditionally; without one it is an error."""
    rows = lookups.join(responses.select("request_id", "status_code"), "request_id", "left")
    not_modified = F.col("status_code") == 304
    out = F.when(F.col("cache_status").isin("off", "hit"), F.col("cache_status")).when(not_modified & (F.col("cache_status") == "conditional"), "revalidated").when(not_modified, "unexpected_not_modified").otherwise("miss")
    return rows.withColumn("cache_status", out)


def valid_cache(cache: DataFrame, manifests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Cache records whose manifest, source and artifact are all there; an artifact of the selected role is preferred."""
    bound = cache.join(manifests.where("status = 'ok'").select("run_id"), "run_id", "left_semi")
    source = artifacts.where("role = 'source'").select("run_id", F.col("hash").alias("source_hash"))
    bound = bound.join(source, ["run_id", "source_hash"], "left_semi")
    chosen = latest(artifacts.select("run_id", F.col("hash").alias("artifact_hash"), "role").withColumn("k", F.concat_ws("/", "run_id", "artifact_hash")), "k", [F.when(F.col("role") == "raw", 0).otherwise(1).asc(), F.col("role").asc()]).drop("k")
    return bound.join(chosen, ["run_id", "artifact_hash"])


def read_cache(requests: DataFrame, cache: DataFrame, manifests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Requests (fingerprint) with ``hit``, and the warning ``cache_record_corrupt`` where a record is there but not whole."""
    whole = valid_cache(cache, manifests, artifacts).select("fingerprint", F.lit(True).alias("whole")).distinct()
    known = cache.select("fingerprint", F.lit(True).alias("known")).distinct()
    rows = requests.join(known, "fingerprint", "left").join(whole, "fingerprint", "left")
    hit = F.coalesce("whole", F.lit(False))
    return rows.withColumns({"hit": hit, "warning": F.when(F.coalesce("known", F.lit(False)) & ~hit, "cache_record_corrupt")}).drop("known", "whole")


def journal(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, raw) with the parsed event; a line that is no JSON object is bad."""
    return lines.withColumn("event", F.try_parse_json("raw")).withColumn("bad", F.col("event").isNull() | ~F.trim("raw").startswith("{")).where(F.trim("raw") != "")


def recovery(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Runs without a manifest: corrupt if any journal line is bad or the journal is too long, else incomplete; with
    the last event's type, in the order of their ids."""
    per_run = journal(lines).groupBy("run_id").agg(F.bool_or("bad").alias("bad"), F.sum(F.octet_length("raw") + 1).alias("bytes"), F.max_by(F.try_variant_get("event", "$.type", "string"), "line_no").alias("last_event"), F.count("*").alias("events"))
    open_runs = runs.where("has_job and not has_manifest").select("run_id")
    out = open_runs.join(per_run, "run_id", "left")
    return out.orderBy("run_id").select("run_id", F.when(F.coalesce("bad", F.lit(False)) | (F.coalesce("bytes", F.lit(0)) > MAX_JOURNAL), "corrupt").otherwise("incomplete").alias("state"), "last_event", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def references(lines: DataFrame) -> DataFrame:
    """(run_id, hash, bytes): what journals refer to, wherever it lies in an event.

    A whole reference is an object with a hash, a path and a whole number of bytes; besides, any member counts whose
    name is hash or ends in _hash. Strings that merely contain a hash do not. ``bytes`` is null where only a hash is
    given; of several whole references to one hash the largest size stands.
    """
    found = variants.members(journal(lines).where("not bad"), ["run_id"], F.col("event"))
    hashed = found.where(F.col("name").rlike(r"(?i)(?:^|_)hash$")).withColumn("hash", variants.text(F.col("value"))).where(F.col("hash").rlike(HASH))
    size = F.try_variant_get("parent", "$.bytes", "bigint")
    exact = F.schema_of_variant(F.try_variant_get("parent", "$.bytes", "variant")) == "BIGINT"
    whole = (F.col("name") == "hash") & exact & variants.text(F.try_variant_get("parent", "$.path", "variant")).isNotNull()
    return hashed.select("run_id", "hash", F.when(whole, size).alias("bytes")).groupBy("run_id", "hash").agg(F.max("bytes").alias("bytes"))


def missing_objects(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """(run_id, hash, fault): objects that journals refer to and the store (hash, bytes) lacks, or holds with another size."""
    met = references(lines).join(stored.select("hash", F.col("bytes").alias("stored")), "hash", "left")
    fault = F.when(F.col("stored").isNull(), "missing").when(F.col("bytes") != F.col("stored"), "size")
    return met.select("run_id", "hash", fault.alias("fault")).where("fault is not null")


def drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files whose hash differs from the recorded one, or that are gone."""
    return expected.join(found.select("name", F.col("sha256").alias("now")), "name", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("name", "sha256", "now")


def commit_manifests(new: DataFrame, existing: DataFrame, faults: DataFrame) -> DataFrame:
    """Manifests to append: written once, and only without faults."""
    return new.dropDuplicates(["run_id"]).join(existing.select("run_id"), "run_id", "left_anti").join(faults.select("run_id"), "run_id", "left_anti")


def cache_records(manifests: DataFrame, ttl_ms: int) -> DataFrame:
    """Cache rows of committed ok manifests (run_id, fingerprint, source_hash, artifact_hash, fetched_at, revalidated_at): a
    revalidated record keeps when it was fetched, and expires from when it was revalidated."""
    base = F.coalesce("revalidated_at", "fetched_at")
    return manifests.where("status = 'ok'").select("fingerprint", "run_id", "source_hash", "artifact_hash", "fetched_at", (base + F.make_dt_interval(secs=F.lit(ttl_ms / 1000))).alias("expires_at"))
