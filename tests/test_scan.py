"""The full scan: one pass over the texts, the line as snippet, all six layers, calls across files."""

import pytest
from pyspark.sql import functions as F

from cindersift.operators import packtables, policy
from cindersift.plans import scan

FILES = [
    ("app/views.py", "from app.store import put\n\ndef get(request):\n    put(request)\n"),
    ("app/store.py", "import os\n\ndef put(x):\n    os.system(x)\n"),
    ("app/keys.py", "   api_key = 'abcdefghij'   # nosec\n"),
    ("app/run.py", "subprocess.run(x, shell=True)\n"),
    ("web/a.js", "const db = require('./db');\nasync function f(x) { return db.query(x) }"),
    ("requirements.txt", "django==1.2.3\nreqests\n"),
    ("Dockerfile", "FROM python:latest\nUSER root\n"),
    ("a.txt", 'token = "x9K2mPq7RtY4wZ8nB3vC6dF1gH5jL0sQ"\nplain\n'),
]


def found(spark, files=FILES):
    return scan.detected(spark.createDataFrame([("r", f, c) for f, c in files], "repo string, file string, content string"))


def test_all_layers_and_snippets(spark):
    rows = found(spark).collect()
    assert {r.layer for r in rows} == {1, 2, 3, 4, 5, 6}
    by = {(r.file, r.rule_id): r for r in rows}
    across = by["app/store.py", "l5/cross-file-taint-system"]
    assert (across.line, across.severity, across.confidence, across.exploitability, across.blast_radius) == (3, "critical", 0.65, 0.57, 8)
    assert "over 2 calls" in across.description
    secret = by["app/keys.py", "l1/generic-secret"]
    assert (secret.code_snippet, secret.column, secret.line) == ("api_key = 'abcdefghij'   # nosec", 3, 1)
    assert ("web/a.js", "l5/js-require-then-sql") in by and ("a.txt", "l3/high-entropy-secret") in by and ("requirements.txt", "l4/typosquat") in by


def test_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame([("r", f, c) for f, c in FILES], "repo string, file string, content string").write.parquet(f"{tmp_path}/files")
    seen = []
    rows = scan.detected(spark.read.parquet(f"{tmp_path}/files"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    seen.append(plan)
    assert f"{tmp_path}/files" not in plan and "sifted" in plan
    again = scan.sifted(spark.read.parquet(f"{tmp_path}/files"))
    assert again.contents.count() == 7 and again.lines.where("hits is null").count() <= 1


def test_odd_files(spark):
    df = spark.createDataFrame([(None, None, None), ("r", "", "eval(x)"), ("r", "b.py", None), ("r", "c.py", "")], "repo string, file string, content string")
    assert {(r.file, r.rule_id) for r in scan.detected(df).collect()} == {("", "l1/eval-exec")}
    assert scan.scanned(df.where("false")).count() == 0
    assert scan.scanned(df.withColumns({"line": F.lit(1), "hits": F.lit("x")})).count() == 1


def test_rules_of_a_table(spark, tmp_path):
    table = spark.createDataFrame(
        [
            ("own/todo", "low", r"(?i)\btodo\b", None, None, ["#"], None),
            ("l2/own-go", "high", r"panic\(", None, [".go"], ["//"], 0.9),
            ("own/no-licence", "info", r"(?s).", "whole", [".md"], None, None),
            ("own/off", "high", "(", None, None, None, None),
        ],
        "rule_id string, severity string, pattern string, mode string, extensions array<string>, comments array<string>, confidence double",
    ).withColumns({"absent": F.when(F.col("rule_id") == "own/no-licence", "(?i)licen[cs]e"), "enabled": F.col("rule_id") != "own/off", "other": F.lit(1)})
    files = [("x.go", "// panic(1)\npanic(2)\n// TODO"), ("y.py", "# todo\nz = 1  # todo"), ("a.md", "# Title"), ("b.md", "Licence: MIT")]
    df = spark.createDataFrame([("r", f, c) for f, c in files], "repo string, file string, content string")
    rows = {(r.file, r.rule_id): r for r in scan.detected(df, table).collect()}
    assert {k for k in rows if "own" in k[1]} == {("x.go", "l2/own-go"), ("x.go", "own/todo"), ("y.py", "own/todo"), ("a.md", "own/no-licence")}
    go, todo, bare = rows["x.go", "l2/own-go"], rows["y.py", "own/todo"], rows["a.md", "own/no-licence"]
    assert (go.line, go.layer, go.confidence, go.exploitability, go.code_snippet) == (2, 2, 0.9, 0.65, "panic(2)")
    assert (todo.line, todo.layer, todo.column) == (2, 1, 9) and (bare.line, bare.severity, bare.layer) == (0, "info", 1)
    # The flagship scan takes a table that a setting names, without a change of code.
    table.write.parquet(f"{tmp_path}/packs")
    df = df.union(spark.createDataFrame([("r", "c.txt", "eval(x)")], df.schema))
    before = scan.scanned(df).first().total
    spark.conf.set(scan.PACKS_KEY, f"{tmp_path}/packs")
    try:
        assert scan.scanned(df).first().total == before + 4
    finally:
        spark.conf.unset(scan.PACKS_KEY)
    only = scan.detected(df, table, {"whole": scan.whole_rules})
    assert [r.rule_id for r in only.collect()] == ["own/no-licence"]


def test_faults_of_a_table(spark):
    rows = [("a", "high", "("), ("b", "awful", "x"), ("c", "low", None), ("d", "low", "x"), ("d", "low", "y")]
    with pytest.raises(ValueError, match=r"a: pattern: .*; b: severity awful; c: no pattern; d: given twice"):
        packtables.read(spark.createDataFrame(rows, "rule_id string, severity string, pattern string"))
    many = spark.range(packtables.MAX_RULES + 1).select(F.col("id").cast("string").alias("rule_id"), F.lit("low").alias("severity"), F.lit("x").alias("pattern"))
    with pytest.raises(ValueError, match="more than"):
        packtables.read(many)
    templates = spark.createDataFrame([("debug", 2, "b", "c", "why", "low"), ("debug", 1, "a", "b", "why", "low"), ("eval", 0, "eval", "no", "x", "high")], "key string, position int, pattern string, replacement string, explanation string, risk string")
    found = spark.createDataFrame([("my-debug", "", "xab"), ("eval", "", "q"), ("none", "", "a")], "rule_id string, issue string, code_snippet string")
    fixed = policy.fixed(found, packtables.fix_templates(templates))
    assert sorted((r.rule_id, r.fixed_code) for r in fixed.collect()) == [("eval", "// TODO: x\nq"), ("my-debug", "xbb")]
