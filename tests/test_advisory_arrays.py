"""Packages of a name and version travel as arrays to the last join with advisories, whatever their number, and all rows come out."""

import pytest
from pyspark.sql import functions as F

from cindersift.operators import deps


def tables(spark, copies):
    packages = [(i, "A" if i % 2 else "a", v, "x") for v in ("1.0", "2.1", "0.0.0") for i in range(copies)] + [(900, None, "1"), (901, "a", None), (902, "b", "1")]
    packages = [(*p, "x") if len(p) == 3 else p for p in packages]
    table = [("a", "<", [2], "high", f"CVE-{i}") for i in range(5)] + [("a", "!=", [1, 0], "low", "CVE-9"), ("c", "<", [9], "low", "CVE-c")]
    return spark.createDataFrame(packages, "package_id long, name string, version string, manifest string"), spark.createDataFrame(table, "package string, op string, bound array<int>, severity string, cve_id string")


def last_join(df):
    """Rows that the join nearest to the result gives."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    node = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    while "Join" not in node.nodeName():
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


def test_rows_of_the_last_join_do_not_grow_with_equal_packages(spark):
    few, lots = (deps.vulnerable(*tables(spark, n)) for n in (2, 100))
    assert last_join(few) == last_join(lots) == 12
    assert (few.count(), lots.count()) == (12, 600)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_no_row_is_lost_whatever_the_arrays_hold(spark, monkeypatch, size):
    monkeypatch.setattr(deps, "CHUNK", size)
    got = deps.vulnerable(*tables(spark, 40))
    assert got.columns == ["package_id", "name", "version", "manifest", "severity", "cve_id"]
    want = [(i, "A" if i % 2 else "a", v, "x", s, c) for i in range(40) for v, s, c in [("1.0", "high", f"CVE-{k}") for k in range(5)] + [("2.1", "low", "CVE-9")]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    keyless = deps.vulnerable(tables(spark, 40)[0].select("version", F.col("name")), tables(spark, 1)[1])
    assert keyless.columns == ["version", "name", "severity", "cve_id"] and keyless.count() == len(want)
