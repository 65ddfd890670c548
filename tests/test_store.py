"""Stored tables: retried writes, upserts, and reading without an exchange."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cindersift.operators import findings as P, history as H
from cindersift.operators.store import Store

DAY = dt.datetime(2024, 3, 1, 12)


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store", "t" + tmp_path.name.replace("-", "_"), buckets=4)
    yield made
    made.forget()


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans(spark, ids, score=50.0):
    rows = [(i, i % 5, "failed" if i % 7 == 0 else "completed", DAY + dt.timedelta(days=i % 3), score + i, i) for i in ids]
    return spark.createDataFrame(rows, "scan_id long, repo_id long, status string, scan_time timestamp, score double, findings int")


def test_retried_writes_leave_the_same_rows(spark, store):
    store.save_scans(scans(spark, range(40)))
    first = sorted(map(tuple, store.scans().collect()), key=str)
    store.save_scans(scans(spark, range(40)))
    assert sorted(map(tuple, store.scans().collect()), key=str) == first and len(first) == 40
    # Later rows replace those of their key and leave other rows of their day alone.
    store.save_scans(scans(spark, [3, 41], 90.0))
    rows = {r.scan_id: r.score for r in store.scans().collect()}
    assert len(rows) == 41 and rows[3] == 93.0 and rows[6] == 56.0 and rows[41] == 131.0
    store.save_scans(scans(spark, []))
    assert store.scans().count() == 41
    # Another session's store of the same folder finds the table.
    other = Store(spark, store.folder, store.name + "_again", buckets=4)
    assert other.scans().count() == 41
    other.forget()


def test_latest_needs_no_exchange(spark, store):
    rows = scans(spark, range(60))
    store.save_scans(rows)
    for df in (H.latest(store.scans(), "score", "findings"), H.latest(store.scans(), "score", completed=False)):
        shown = plan(df)
        assert "Exchange" not in shown and "SortAggregate" not in shown and "HashAggregate" in shown, shown
    got = {r.repo_id: (r.scan_id, r.score, r.findings) for r in H.latest(store.scans(), "score", "findings").collect()}
    assert got == {k: (v.scan_id, v.score, v.findings) for k, v in ((r.repo_id, r) for r in sorted(rows.where("status = 'completed'").collect(), key=lambda r: r.scan_id))}
    assert {r.repo_id: (r.scan_id, r.status) for r in H.latest(store.scans(), "status", completed=False).collect()} == {i % 5: (i, "failed" if i % 7 == 0 else "completed") for i in range(55, 60)}


def test_findings_are_deduplicated_where_they_lie(spark, store):
    rows = [(s, i, DAY, f"f{i % 4}.py", i % 2, "l1/x", "high", 0.5 + i / 100, 0.5, i) for s in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "scan_id long, seq long, scan_time timestamp, file string, line int, rule_id string, severity string, confidence double, exploitability double, blast_radius int").withColumns({"issue": F.repeat(F.lit("x"), 3000), "position": F.lit(1)})
    store.save_findings(df.drop("position"), k=20)
    store.save_findings(df.drop("position"), k=20)
    kept = store.findings()
    assert kept.count() == 120 and kept.agg(F.max(F.length("issue"))).first()[0] == 1000
    best = P.dedup_best(kept)
    assert "Exchange" not in plan(best) and best.count() == 24


def test_users_and_odd_rows(spark, store):
    users = lambda rows: spark.createDataFrame(rows, "user_id long, login string, email string, scan_time timestamp")
    store.upsert_users(users([(1, "a", "a@x", None), (2, "b", "b@x", DAY)]))
    store.upsert_users(users([(1, "a", "new@x", None), (3, "c", None, None), (3, "c", None, None)]))
    assert {(r.user_id, r.email) for r in store.users().collect()} == {(1, "new@x"), (2, "b@x"), (3, None)} and store.users().count() == 3
    with pytest.raises(ValueError, match="has no other"):
        store.upsert_users(users([]).withColumn("other", F.lit(1)))
