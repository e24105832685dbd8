"""Command line over captured tables: python -m tracewell.plans.cli <command> <target> [options] --data-root DIR."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracewell.functions import formats, urls, values
from tracewell.operators import contracts, cost, crawl, robots, search, search_index, shared
from tracewell.plans import jobs
from tracewell.sources.capture import result_lines, table


#: The user agent whose robots rules hold.
AGENT = "tracewell/1.0"
#: The store's tables that a cached job reads.
CACHE_TABLES = {"cache": "fingerprint string, run_id string, source_hash string, artifact_hash string, fetched_at timestamp, expires_at timestamp", "manifests": "run_id string, status string", "artifacts": "run_id string, role string, hash string, derived_from string"}
#: Top folders of a data root that hold the store's own state.
PROTECTED = {".gitignore", "cache", "objects", "runs", "security", "tmp"}


def optional(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the data root, or an empty one where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return table(spark, root, name) if there else spark.createDataFrame([], schema)


def output_path(root: str, name: str) -> str:
    """Where ``--output`` writes: a relative path below the data root that stays out of the store's own folders."""
    parts = name.split("/")
    if not name or name.startswith("/") or "\\" in name or any(p in ("", ".", "..") for p in parts) or any(ord(c) < 32 or ord(c) == 127 for c in name):
        raise OutputError(f"output path {name!r}")
    if parts[0] in PROTECTED:
        raise OutputError("output path overlaps protected storage state")
    return f"{root.rstrip('/')}/{name}"


class OutputError(ValueError):
    """An output that cannot be written (exit code 74)."""


def execute(spark: SparkSession, spec: jobs.JobSpec) -> tuple[str, DataFrame]:
    """Status and result rows of a job over the tables of its data root."""
    capabilities = cost.registry(spark)
    if spec.kind == "health":
        return "ok", cost.health(capabilities)
    if spec.explain:
        job = spark.createDataFrame([("job", spec.kind, spec.engine, spec.allow_rendered, spec.allow_cloud)], "job_id string, kind string, forced_engine string, allow_rendered boolean, allow_cloud boolean")
        return "ok", cost.route_plan(job, capabilities).orderBy("ord")
    pages = table(spark, spec.data_root, "pages")
    if spec.kind == "search":
        index = search_index.built(pages, formats.html_text(F.col("html")))
        found, _ = search_index.best(spark.createDataFrame([("run", spec.target)], "query string, text string"), index, spec.search_limit)
        results = found.join(pages.select(F.col("page_id").alias("page"), "url"), "page").select(F.col("query").alias("run_id"), F.col("rank").alias("pos"), "url")
        rows = search.candidates(results, ["run_id"], "pos", urls.admit_url("url")["canonical_url"])
        return "partial", search.ranked(rows, ["run_id"], "pos", spec.scrape_results).select("rank", "canonical")
    admitted = urls.admit(spec.target)
    if admitted.reject:
        raise jobs.InputError(admitted.reject)
    kind = formats.detected_kind(F.lit(None).cast("string"), formats.sniffed_kind(F.col("html")))
    if spec.kind == "crawl":
        site = shared.cut(jobs.crawl_site(pages, sources=spec.discover))
        rules = shared.cut(robots.parsed(optional(spark, spec.data_root, "robots", "origin string, status int, body binary"), AGENT))
        crawls = spark.createDataFrame([("crawl", admitted.canonical_url)], "crawl string, seed string")
        rows = crawl.crawl_on_demand(crawls, site, lambda u: robots.gate(u, rules, "sitemap" in spec.discover), jobs.crawl_limits(spec.limits), list(spec.include), list(spec.exclude))
        return rows.select("status").first()["status"], rows.orderBy("seq").select("state", "url", "depth", "reason")
    found = pages.where(F.col("url") == admitted.canonical_url).withColumn("kind", kind)
    if spec.kind == "extract":
        with open(spec.schema, encoding="utf-8") as f:
            rows = jobs.extract_job(found, json.load(f)).select("url", "data", "missing", "status")
    else:
        request = spark.createDataFrame([("r", spec.cache_mode)], "request_id string, mode string").withColumn("fingerprint", values.fingerprint(F.lit(admitted.canonical_url), spec.goal))
        held = {name: optional(spark, spec.data_root, name, schema) for name, schema in CACHE_TABLES.items()}
        hits = jobs.cache_hits(request, held["cache"], held["manifests"], held["artifacts"], F.current_timestamp())
        if hits.take(1):
            return "ok", hits.select(F.lit(admitted.canonical_url).alias("url"), F.lit("hit").alias("cache_status"), "source_hash", "artifact_hash", "expires_at")
        rows = jobs.derive(found, spec.goal).select("url", "kind", "artifact", "artifact_hash")
    return ("ok" if found.take(1) else "exhausted"), rows


def main(argv: list[str]) -> int:
    try:
        spec = jobs.parse_argv(argv)
        if spec.data_root is None and spec.kind != "health" and not spec.explain:
            raise jobs.InputError("--data-root is needed")
    except jobs.InputError as e:
        print(json.dumps({"status": "invalid_input", "message": str(e)}))
        return contracts.EXIT_CODES["invalid_input"]
    spark = SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        status, rows = execute(spark, spec)
    except jobs.InputError as e:
        print(json.dumps({"status": "blocked", "message": str(e)}))
        return contracts.EXIT_CODES["blocked"]
    lines = result_lines(rows, spec.as_json)
    if spec.output is not None:
        try:
            lines.write.text(output_path(spec.data_root or ".", spec.output))  # what is there already stays
        except (OutputError, AnalysisException) as e:
            print(json.dumps({"status": "output_failure", "message": str(e)}))
            return contracts.EXIT_CODES["output_failure"]
        print(json.dumps({"status": status, "output": spec.output}))
        return contracts.EXIT_CODES[status]
    for line in lines.toLocalIterator():
        print(line["line"])
    return contracts.EXIT_CODES[status]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
