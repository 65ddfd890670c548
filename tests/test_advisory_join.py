"""Packages under a growing table of advisories: no join meets the advisories before versions and bounds are few, and all rows come out."""

import random

from pyspark.sql import functions as F

from cindersift.operators import deps

OPS = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}


def tables(spark, n):
    rng = random.Random(4)
    version = lambda: [rng.randrange(3) for _ in range(rng.randrange(1, 4))]
    table = [(rng.choice(["a", "b"]), rng.choice(deps.OPERATORS), version(), "high", f"CVE-{i % (n - 3)}") for i in range(n)] + [(None, "<", [1], "high", "x"), ("a", None, [1], "high", "y"), ("a", "<", None, "high", "z"), ("a", "~", [1], "high", "w")]
    packages = [(i, rng.choice(["A", "b", "c"]), ".".join(map(str, version()))) for i in range(60)] + [(60, "a", "0.0.0"), (61, None, "1"), (62, "a", None)]
    packages += packages[:5]
    return packages, table, spark.createDataFrame(packages, "package_id long, name string, version string"), spark.createDataFrame(table, "package string, op string, bound array<int>, severity string, cve_id string")


def test_all_pairs_come_out(spark):
    packages, table, p, t = tables(spark, 200)
    want = sorted((i, c) for i, n, v in packages if n and v and v != "0.0.0" for k, o, b, _, c in table if k == n.lower() and b is not None and o in OPS and OPS[o]([int(x) for x in v.split(".")], b))
    got = deps.vulnerable(p, t)
    assert got.columns == ["package_id", "name", "version", "severity", "cve_id"]
    assert sorted((r.package_id, r.cve_id) for r in got.collect()) == want


def test_rows_between_do_not_grow_with_the_advisories_of_a_bound(spark):
    _, _, p, t = tables(spark, 200)
    many = t.withColumn("cve_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(50)])))

    def between(table):
        # Rows that the joins below the last one give: each has few distinct bounds on its side, however many advisories there are.
        plan = deps.vulnerable(p, table)
        plan.collect()
        node, rows = plan._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []

        def walk(n):
            if "Join" in n.nodeName():
                rows.append(n.metrics().apply("numOutputRows").value())
            inner = n.plan() if n.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage") else None
            for x in [inner] if inner is not None else [n.children().apply(i) for i in range(n.children().size())]:
                walk(x)

        walk(node)
        return sorted(rows)

    few, lots = between(t), between(many)
    assert lots[-1] == 50 * few[-1] and lots[:-1] == few[:-1], (few, lots)
