"""Webhook payloads as a stream of scans: restart between batches, a batch that fails half-way, progress by layer."""

import hashlib
import hmac
import json

import pytest

from cindersift.streaming import scans

SECRET = b"key"
FILES = [("o/a", "x.py", "def view(request):\n    helper(request)\n\ndef helper(q):\n    os.system(q)\n"), ("o/a", "Dockerfile", "FROM python:latest\n"), ("o/b", "y.txt", "npm //registry.npmjs.org/:_authToken=abc"), ("o/c", "z.txt", "plain")]


def payload(repo, commit, event="push"):
    body = json.dumps({"ref": "refs/heads/main", "after": commit, "repository": {"full_name": repo, "default_branch": "main"}})
    return event, body, "sha256=" + hmac.new(SECRET, body.encode(), hashlib.sha256).hexdigest()


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, "event string, body string, signature string").coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp, files):
    rows = spark.readStream.schema("event string, body string, signature string").option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    query = scans.scan_stream(rows, files, f"{tmp}/out", f"{tmp}/checkpoint", secret=SECRET)
    try:
        query.awaitTermination()
    finally:
        spark.streams.removeListener(query.listener)


def test_every_payload_is_scanned_once_over_restarts(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame(FILES, "repo string, file string, content string")
    put(spark, f"{tmp_path}/in", "p1", [payload("o/a", "c1"), payload("o/x", "c9"), ("push", "{}", "sha256=forged"), payload("o/a", "c1")])
    run(spark, tmp_path, files)
    first = spark.read.parquet(f"{tmp_path}/out/scans").collect()
    assert [(r.repository, r.commit, r.batch) for r in first if r.repository == "o/a"] == [("o/a", "c1", 0)]

    # The next batch fails after its findings are written; started again, it runs again and replaces them.
    put(spark, f"{tmp_path}/in", "p2", [payload("o/b", "c2"), payload("o/a", "c1")])
    told = scans.Progress.__call__

    def fail(self, phase, counts):
        if phase == "layers":
            raise RuntimeError("lost")
        told(self, phase, counts)

    monkeypatch.setattr(scans.Progress, "__call__", fail)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, files)
    assert spark.read.parquet(f"{tmp_path}/out/findings").where("batch = 1").count() > 0
    assert spark.read.parquet(f"{tmp_path}/out/scans").where("batch = 1").count() == 0
    monkeypatch.setattr(scans.Progress, "__call__", told)
    put(spark, f"{tmp_path}/in", "p3", [payload("o/c", "c3"), payload("o/b", "c4")])
    run(spark, tmp_path, files)
    rows = spark.read.parquet(f"{tmp_path}/out/scans").collect()
    assert sorted((r.repository, r.commit, r.batch) for r in rows if r.repository != "o/x") == [("o/a", "c1", 0), ("o/b", "c2", 1), ("o/b", "c4", 2), ("o/c", "c3", 2)]
    assert {r.repository: r.score for r in rows}["o/c"] == 100.0
    found = spark.read.parquet(f"{tmp_path}/out/findings")
    assert found.select("scan_id", "file", "line", "rule_id").distinct().count() == found.count()
    assert {r.rule_id for r in found.where("batch = 0").collect()} >= {"l5/cross-file-taint-system", "l6/docker-latest-tag"}
    deliveries = spark.read.parquet(f"{tmp_path}/out/deliveries")
    assert deliveries.count() == 7

    # Counts by layer came with the job that wrote the findings; deduplication keeps as many or fewer.
    phases = scans.progress(spark, f"{tmp_path}/out")
    by = {(r.batch, r.phase, r.layer): r.n for r in phases.collect()}
    assert by[0, "layers", 5] == 1 and by[0, "layers", 6] >= 1 and by[1, "layers", 1] >= 1 and by[2, "scored", None] == 2
    kept = {(r.batch, r.layer): r["count"] for r in found.groupBy("batch", "layer").count().collect()}
    assert all(by[b, "layers", layer] >= n for (b, layer), n in kept.items())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert {r.batch for r in scans.progress(spark, f"{tmp_path}/out").where("phase = 'payloads'").collect()} >= {0, 2}


def test_no_progress_yet(spark, tmp_path):
    assert scans.progress(spark, str(tmp_path)).count() == 0
