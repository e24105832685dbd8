"""Logs that keep a replayed batch once, tables that rewrite only what changed, and adapters under their contract."""

import glob

from pyspark.sql import functions as F

from tracewell.operators import adapters, store
from tracewell.streaming import sinks

SCHEMA = "run_id long, v string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_batches_count_once_and_only_when_committed(spark, tmp_path, monkeypatch):
    log = sinks.BatchLog(spark, f"{tmp_path}/log", SCHEMA)
    assert log.read().count() == 0
    assert log.write(frame(spark, (1, "a"), (2, "b")), 0) and not log.write(frame(spark, (1, "a"), (2, "b")), 0)
    # A try that fails before its commit leaves rows that nobody sees, and that the next try replaces.
    frame(spark, (9, "torn")).write.parquet(f"{tmp_path}/log/rows/batch=1")
    assert {r["run_id"] for r in log.read().collect()} == {1, 2}
    assert log.write(frame(spark, (3, "c"), (1, "a")), 1) and log.committed() == [0, 1]
    assert sorted(r["run_id"] for r in log.read().collect()) == [1, 1, 2, 3]


def test_manifests_are_written_once(spark, tmp_path):
    log = sinks.BatchLog(spark, f"{tmp_path}/log", SCHEMA, once_by=["run_id"])
    log.write(frame(spark, (1, "first"), (1, "first"), (2, "x")), 0)
    log.write(frame(spark, (1, "later"), (3, "y")), 1)
    assert sorted(map(tuple, log.read().collect())) == [(1, "first"), (2, "x"), (3, "y")]


def test_a_stream_that_starts_again_appends_nothing(spark, tmp_path):
    frame(spark, *[(i, "v") for i in range(40)]).repartition(4).write.parquet(f"{tmp_path}/in")
    log = sinks.BatchLog(spark, f"{tmp_path}/log", SCHEMA)
    for state in ("one", "two"):  # the second stream has lost its checkpoint and delivers the same batch anew
        rows = spark.readStream.schema(frame(spark, (1, "a")).schema).parquet(f"{tmp_path}/in")
        rows.writeStream.foreachBatch(log.sink()).option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()
    assert log.read().count() == 40


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = sinks.BucketTable(spark, f"{tmp_path}/t", SCHEMA, "run_id", 8)
    last = lambda rows: store.latest(rows, "run_id", [F.desc("v")])
    assert table.read().count() == 0 and table.merge(spark.createDataFrame([], SCHEMA), last) == set()
    assert len(table.merge(frame(spark, *[(i, "a") for i in range(200)]), last)) == 8
    before = table.current()
    touched = table.merge(frame(spark, (3, "b"), (3, "c"), (500, "n")), last)
    after = table.current()
    assert {b for b in after if after[b] != before[b]} == touched and 1 <= len(touched) <= 2
    assert len(glob.glob(f"{tmp_path}/t/rows/1/bucket=*")) == len(touched)
    got = {r["run_id"]: r["v"] for r in table.read().collect()}
    assert len(got) == 201 and got[3] == "c" and got[500] == "n" and got[4] == "a"
    table.vacuum()
    assert table.versions() == [1] and table.read().count() == 201


def test_adapters_fail_alone(spark):
    def bad(request):
        raise ValueError("x")

    shapes = {"none": lambda r: None, "list": lambda r: ["success", "ok"], "kind": lambda r: {"kind": None, "code": "ok"}, "code": lambda r: {"kind": "success"}, "ok": lambda r: {"kind": "success", "code": "ok", "detail": r["url"]}, "next": lambda r: {"kind": "skip", "code": "x"}, "limited": lambda r: {"kind": "retryable", "code": "rate_limited"}, "bad": bad}
    adapters.register(spark, "tried", shapes)
    rows = [(k, 0, k, "u") for k in shapes if k != "next"] + [("gone", 0, "nobody", "u"), ("chain", 0, "next", "u"), ("chain", 1, "next", "v"), ("chain", 2, "ok", "w"), ("chain", 3, "ok", "z"), ("limited", 1, "ok", "u"), ("bad", 1, "ok", "u"), (None, 0, "ok", "u")]
    got = adapters.attempts(spark.createDataFrame(rows, "job_id string, ord int, adapter string, url string"), "tried").collect()
    by = {(r["job_id"], r["attempt"]): (r["kind"], r["code"]) for r in got}
    protocol = adapters.PROTOCOL
    assert by == {("none", 1): protocol, ("list", 1): protocol, ("kind", 1): protocol, ("code", 1): protocol, ("gone", 1): protocol, ("bad", 1): adapters.CRASH, ("ok", 1): ("success", "ok"), (None, 1): ("success", "ok"),
                  ("limited", 1): ("retryable", "rate_limited"), ("chain", 1): ("skip", "x"), ("chain", 2): ("skip", "x"), ("chain", 3): ("success", "ok")}


def test_empty_table_of_candidates(spark):
    adapters.register(spark, "nothing", {})
    assert adapters.attempts(spark.createDataFrame([], "job_id string, ord int, adapter string, url string"), "nothing").count() == 0
