"""The denylist, progress and the append log as streams over files that come one after another."""

import datetime as dt
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from cindersift.streaming import events as W, webhooks

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def files(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_denylist_with_state_and_timer(spark, tmp_path):
    schema = "event_id long, ts timestamp, key string, kind string"
    batches = [
        [(1, at(0), "a", "view"), (2, at(1), "a", "error"), (3, at(1), "a", "view"), (4, at(30), "b", "view")],
        [(5, at(50), "a", "view"), (6, at(55), "a", "error"), (7, at(62), "a", "view")],
        [(8, at(114), "a", "view"), (9, at(116), "a", "view"), (10, at(300), "b", "error"), (11, at(301), "b", "view")],
        [(12, at(500), "a", "view"), (13, at(501), "a", "error"), (14, at(502), "a", "view")],
    ]
    rows = files(spark, tmp_path / "in", batches, schema)
    found = W.denied(rows, rows.where("kind = 'error'").select("key", F.col("ts").alias("denied_at")), 3600)
    W.run_available(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    flat = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(r.event_id for r in W.denied(flat, flat.where("kind = 'error'").select("key", F.col("ts").alias("denied_at")), 3600).collect())
    assert got == want == [2, 3, 5, 6, 7, 8, 10, 11, 13, 14]


def test_progress_is_the_last_row_and_a_batch_replaces_itself(spark, tmp_path):
    schema = "scan_id long, ts timestamp, status string"
    sink = W.progress_sink(str(tmp_path / "log"))
    one = spark.createDataFrame([(1, at(0), "pending"), (1, at(2), "running"), (2, at(1), "pending")], schema)
    sink(one, 0)
    sink(one, 0)
    sink(spark.createDataFrame([(1, at(9), "completed")], schema), 1)
    assert sorted((r.scan_id, r.status) for r in W.progress(spark, str(tmp_path / "log")).collect()) == [(1, "completed"), (2, "pending")]


def test_append_log(spark, tmp_path):
    rows = files(spark, tmp_path / "in", [[(1, at(0), "a")], [(2, at(1), "b"), (2, at(1), "b")]], "event_id long, ts timestamp, key string")
    W.run_available(W.deduplicated(rows), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2]


def test_webhooks(spark):
    body = json.dumps({"ref": "refs/heads/main", "after": "a" * 50, "repository": {"full_name": "o/é", "default_branch": "main"}}, ensure_ascii=False)
    for key in (b"k", b"x" * 64, b"long" * 40):
        want = hmac.new(key, body.encode(), hashlib.sha256).hexdigest()
        assert spark.createDataFrame([(body,)], "body string").select(webhooks.hmac_sha256(key, F.col("body"))).first()[0] == want
    pull = json.dumps({"action": "reopened", "number": 7, "pull_request": {"head": {"ref": "b", "sha": "s"}}, "repository": {"full_name": "o/x"}})
    rows = spark.createDataFrame([(1, "push", body), (2, "pull_request", pull), (3, "ping", "{}"), (4, "push", "{broken"), (5, "push", None), (6, "fork", "{}"), (7, "push", body.replace("heads/main", "heads/dev"))], "id long, event string, body string")
    got = {r.id: (r.status, r.trigger, r.branch, r.commit) for r in webhooks.triggered(rows).collect()}
    none = (None, None, None)
    assert got == {1: ("scan_triggered", "webhook_push", "main", "a" * 40), 2: ("scan_triggered", "webhook_pr_7", "b", "s"), 3: ("ok", *none), 4: ("invalid", *none), 5: ("invalid", *none), 6: ("ignored", *none), 7: ("skipped", *none)}
