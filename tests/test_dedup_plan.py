"""Deduplication moves only the columns that are asked for, and sorts them once, after its shuffle."""

from cindersift.operators import findings as P
from cindersift.sources.tables import load


def test_only_asked_columns_travel_and_rows_are_sorted_once(spark):
    for f, severe in ((P.dedup_best, ""), (P.dedup_severity, "severity")):
        plan = f(load(spark, "/root/testdata/sf0.001", "findings")).select("scan_id", "seq", "file", "line", "rule_id")._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange ") == 1, plan
        below = plan[plan.index("Exchange ") :]
        assert not [c for c in ("code_snippet", "description", "cve_id", "issue") if f"AS {c}#" in below], below


def test_nulls_and_ties(spark):
    rows = [(1, i, "f", 1, "r", c, 0.5, None) for i, c in ((3, 0.9), (2, 0.9), (1, 0.2))] + [(2, 1, None, None, None, 0.5, 0.5, "p"), (2, 2, None, None, None, None, 0.5, "p"), (2, 3, None, None, None, 0.5, 0.5, "q")]
    df = spark.createDataFrame(rows, "scan_id long, seq long, file string, line int, rule_id string, confidence double, exploitability double, package_name string")
    assert sorted((r.scan_id, r.seq) for r in P.dedup_best(df).collect()) == [(1, 2), (2, 2), (2, 3)]
