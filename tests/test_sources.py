"""Readers, reports, exports and syntax trees."""

import json

from pyspark.sql import functions as F

from cindersift.operators import code, export, graph
from cindersift.sources import scanners


def test_files(spark, tmp_path):
    for name, data in {"a/x.py": b"a\nb", "a/.env": b"K=1", "node_modules/y.js": b"z", "big.txt": b"0" * 100, "a/Dockerfile": b"FROM x\xff"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = scanners.files(spark, str(tmp_path), max_bytes=50)
    assert {(r.file, r.ext, r.lines) for r in rows.collect()} == {("a/x.py", ".py", 2), ("a/Dockerfile", "", 1)}
    assert [r.filename for r in scanners.manifests(rows).collect()] == ["Dockerfile"]


def test_reports(spark):
    def one(doc):
        return spark.createDataFrame([("r", json.dumps(doc) if not isinstance(doc, str) else doc)], "repo string, raw string")

    s = scanners.semgrep(one({"results": [{"check_id": "c", "path": "p", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": "CWE-89: x"}}}, {"check_id": "d"}]})).orderBy("rule_id").collect()
    assert [(r.rule_id, r.line, r.severity, r.cwe_id) for r in s] == [("c", 3, "critical", "CWE-89"), ("d", 0, "medium", None)]
    b = scanners.bandit(one({"results": [{"filename": "f", "line_number": 2, "test_id": "B1", "issue_severity": "LOW", "issue_confidence": "HIGH", "issue_cwe": {"id": 78}}]})).first()
    assert (b.file, b.line, b.severity, b.cwe_id, b.confidence) == ("f", 2, "low", "CWE-78", 0.9)
    result = {"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "Severity": "CRITICAL"}], "Secrets": [{"RuleID": "s", "Severity": "HIGH", "StartLine": 4}], "Misconfigurations": None}
    for doc in ({"Results": [result]}, [result]):
        assert {(r.rule_id, r.severity) for r in scanners.trivy(one(doc)).collect()} == {("CVE-1", "critical"), ("s", "high")}
    assert scanners.trivy(one("{broken")).collect() == [] and scanners.semgrep(one({})).collect() == []


def test_exports(spark):
    f = spark.createDataFrame([(1, 1, "a<b>", "high", "f.py", 3, "x & y", 1.0, 1.0, 1)], "scan_id long, seq int, rule_id string, severity string, file string, line int, issue string, confidence double, exploitability double, blast_radius int")
    assert "x &amp; y" in export.html_rows(f).first().html
    assert json.loads(export.json_reports(f).first().report)["findings"][0]["rule_id"] == "a<b>"
    svg = export.badges(spark.createDataFrame([(1, 85.7)], "repo_id long, score double")).first().svg
    assert "85%" in svg and "#22c55e" in svg
    parts = spark.createDataFrame([(1, "p", "1"), (1, "p", "1"), (1, "a", "2")], "scan_id long, package_name string, version string")
    assert [c["name"] for c in json.loads(export.bill_of_materials(parts).first().sbom)["components"]] == ["a", "p"]


SOURCE = """
@app.route("/x")
def view(request):
    q = request.args["q"]
    sql = f"select {q}"
    cursor.execute(sql)
    return helper(1)

async def helper(n):
    other(n)

def other(n):
    subprocess.run(n, shell=True)
    db.connect("long-literal")

def loop(n):
    loop(n)
"""


def test_trees(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def broken(:"), ("c.py", None)], "file string, content string")
    rows = code.parsed(files)
    assert {(r.file, r.kind) for r in rows.where("kind in ('error', 'shell', 'hardcoded')").collect()} == {("a.py", "shell"), ("a.py", "hardcoded"), ("b.py", "error")}
    assert [(r.line, r.rule_id, r.severity) for r in code.tainted_sinks(rows).collect()] == [(6, "l2/taint-sqli", "critical")]
    edges, handlers, sinks = code.call_graph(rows.where(F.col("name") != "cursor.execute"))
    assert {(r.handler, r.node, r.sink, r.depth) for r in graph.taint_walk(edges, handlers, sinks).collect()} == {("view", "other", "subprocess.run", 2)}


def test_views_and_corpus(spark, tmp_path):
    for name, data in {"a.py": b"x", "b.yml": b"y", "requirements.txt": b"z", "docker-compose.yml": b"c", "Dockerfile.dev": b"d", "notes.md": b"m", "bad.txt": b"\xff\xfe", "x.bin": b"0", ".github/ci.yml": b"w", ".tox/t.py": b"t"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = scanners.files(spark, str(tmp_path))
    names = lambda df: sorted(r.filename for r in df.collect())
    assert names(rows) == ["Dockerfile.dev", "a.py", "b.yml", "docker-compose.yml", "requirements.txt"]
    assert names(scanners.code_files(rows)) == ["a.py"] and names(scanners.config_files(rows)) == ["b.yml", "docker-compose.yml"]
    assert names(scanners.by_extension(rows, ".yml", ".py")) == ["a.py", "b.yml", "docker-compose.yml"] and names(scanners.by_filename(rows, "a.py")) == ["a.py"]
    assert names(scanners.manifests(rows)) == ["docker-compose.yml", "requirements.txt"] and names(scanners.dockerfiles(rows)) == ["Dockerfile.dev", "docker-compose.yml"]
    assert sorted(r.file.rpartition("/")[2] for r in scanners.corpus(spark, str(tmp_path)).collect()) == ["a.py", "notes.md", "requirements.txt"]  # hidden folders are hidden to the file index


def test_persisted_comments_and_training_rows(spark, tmp_path):
    f = spark.createDataFrame([(1, i, "r", "high", "f.py", i, "i" * 1200, "s" if i else "", 0.1 * i, 1.0, 1.0, 1) for i in range(8)], "scan_id long, seq int, rule_id string, severity string, file string, line int, issue string, ai_summary string, false_positive_probability double, confidence double, exploitability double, blast_radius int")
    export.persisted(f, str(tmp_path / "kept"), k=3)
    export.persisted(f, str(tmp_path / "kept"), k=2)
    kept = spark.read.parquet(str(tmp_path / "kept")).collect()
    assert sorted(r.seq for r in kept) == [0, 0, 1, 1, 2] and {len(r.issue) for r in kept} == {1000}
    export.training_rows(f, str(tmp_path / "rows"))
    assert sorted(r.seq for r in spark.read.json(str(tmp_path / "rows")).collect()) == [1, 2, 3, 4]
    said = export.comments(spark.createDataFrame([(85.0, 1, 2)], "score double, critical int, high int")).first().comment
    assert said.startswith("✅") and "critical 1, high 2" in said
