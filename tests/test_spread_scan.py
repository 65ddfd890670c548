import pyarrow as pa
from pyspark.sql import functions as F

from cindersift.functions import text
from cindersift.operators import code, deps, rules, symbols
from cindersift.plans import samples

SF = "/root/testdata/sf0.001"


def test_projects_are_dealt_over_many_tasks(spark):
    """A few bytes of a key stand for the texts of a project, so the number of tasks doesn't follow from sizes."""
    many = 4 * spark.sparkContext.defaultParallelism
    for made in (samples.projects(spark, SF), samples.files(spark, SF)):
        assert made.rdd.getNumPartitions() >= many
    keys = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").cast("string").alias("repo"))
    got = samples.projects(spark, SF).select("repo").distinct()
    assert got.exceptAll(keys).isEmpty() and keys.exceptAll(got).isEmpty()


def test_equal_contents_are_parsed_once(monkeypatch):
    """Each file keeps its findings, also where another of its batch has the same content."""
    source = "import os\n\ndef get(request):\n    os.system(request.args)\n"
    rows = [("a", "x.py", source), ("b", "x.py", source), ("b", "y.py", "def f(:"), ("c", "y.py", None), ("d", "y.py", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["repo", "file", "content"])
    one = [batch.slice(i, 1) for i in range(len(rows))]
    seen = []
    semantic, facts = code.semantic, symbols.facts
    monkeypatch.setattr(code, "semantic", lambda s: (seen.append(s), semantic(s))[1])
    monkeypatch.setattr(symbols, "facts", lambda f, s: (seen.append((f, s)), facts(f, s))[1])
    for found in (code._found((False, True)), symbols._parsed):
        apart = [r for b in found(one) for r in b.to_pylist()]
        seen.clear()
        assert [r for b in found([batch]) for r in b.to_pylist()] == apart and {r["repo"] for r in apart} >= {"a", "b"}
        # The legacy scan reads what the semantic one finds, so each content is met once for each of them.
        assert len(seen) == (6 if isinstance(seen[0], str) else 3)


def test_entropy_splits_a_text_once(spark):
    plan = spark.range(1).select(text.entropy(F.col("id").cast("string")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_findings_and_packages_are_never_broadcast(spark):
    """What is as many as findings or packages goes from task to task, even where it is few bytes as a file."""
    hits = spark.createDataFrame([("a", f"f{i}", 3 - i % 2, "r") for i in range(6)], "repo string, file string, line int, rule_id string")
    first = rules.first_matches(hits.unionByName(hits.withColumn("line", F.lit(9))), "repo", "file")
    assert sorted((r.file, r.line) for r in first.collect()) == [(f"f{i}", 3 - i % 2) for i in range(6)]
    assert "BroadcastHashJoin" not in first._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([(f"r{i}", "requirements.txt", "requirements.txt", "reqests==1.0\n") for i in range(4)], "repo string, file string, filename string, content string")
    near = deps.findings(files).where("rule_id = 'l4/typosquat'")
    assert sorted(r.repo for r in near.collect()) == [f"r{i}" for i in range(4)]
    joins = [x for x in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "__slice#" in x and "strategy=merge" in x]
    assert joins, near._jdf.queryExecution().optimizedPlan().toString()
