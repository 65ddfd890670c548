"""Trees with hidden names and skipped folders; reports whose keys have drifted."""

import json
import os

import pytest

from cindersift.sources import scanners, trees


def put(root, path, text="x = 1\n"):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize("splits", [1, 3, 256])
def test_hidden_names_and_skipped_folders(spark, tmp_path, splits, monkeypatch):
    root = f"{tmp_path}/repo"
    for path in ("a.py", ".env", "src/deep/er/b.JS", ".github/workflows/ci.yml", "src/.hidden/c.py", "_private/d.py", "Dockerfile.dev", "notes.txt", "node_modules/e.py", "src/.git/f.py", "src/venv/g.py"):
        put(root, path)
    put(root, "big.py", "x" * 3000)
    put(root, "bad.py", b"\xff\xfe = 1")
    os.chmod(f"{root}/node_modules", 0)
    spark.dataSource.register(trees.FileTree)
    read = lambda hidden: spark.read.format("filetree").option("hidden", hidden).option("maxBytes", 2000).option("splits", splits).load(root)
    open_ = {"a.py", ".env", "src/deep/er/b.JS", "_private/d.py", "Dockerfile.dev", "bad.py"}
    assert {r.file for r in read("false").collect()} == open_
    rows = {r.file: r for r in read("true").collect()}
    assert set(rows) == open_ | {".github/workflows/ci.yml", "src/.hidden/c.py"}
    assert (rows[".env"].ext, rows["src/deep/er/b.JS"].ext, rows["a.py"].lines, rows["a.py"].repo, rows["bad.py"].content) == (".env", ".js", 2, "repo", "�� = 1")
    listed = []
    own = trees.TreeReader._listed
    monkeypatch.setattr(trees.TreeReader, "_listed", lambda self, system, folder: listed.append(folder) or own(self, system, folder))
    reader = trees.TreeReader({"path": root, "hidden": "true", "splits": str(splits)})
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == len(rows) + 1
    assert not [f for f in listed if "node_modules" in f or "/.git" == f[-5:] or "venv" in f]


def test_scan_of_a_tree(spark, tmp_path):
    from cindersift.plans.scan import detected

    put(f"{tmp_path}/r", ".env", "SECRET_KEY=abcdefgh\n")
    put(f"{tmp_path}/r", ".github/workflows/ci.yml", "runs-on: x\nuses: actions/checkout@v1\n")
    found = {(r.file, r.rule_id) for r in detected(trees.tree(spark, f"file://{tmp_path}/r")).collect()}
    assert {(".env", "l1/env-file-secret"), (".github/workflows/ci.yml", "l6/gha-old-checkout")} <= found
    os.makedirs(f"{tmp_path}/empty")
    assert trees.tree(spark, f"{tmp_path}/empty").count() == 0


def test_reports_with_drift(spark):
    good = {"check_id": "a", "path": "p.py", "start": {"line": 3, "col": 2}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-89: x"]}}, "new": {"x": [1]}}
    retyped = {"check_id": 7, "path": ["p"], "start": {"line": "four"}, "extra": "none"}
    docs = [json.dumps({"results": [good, retyped, {}, "odd", None], "version": 2}), json.dumps({"results": "none"}), json.dumps([1]), "{broken", "", None, "[]"]
    reports = spark.createDataFrame([("r", d) for d in docs], "repo string, raw string")
    rows = sorted((r.rule_id or "", r.line, r.severity, r.cwe_id or "") for r in scanners.semgrep(reports).collect())
    assert ("a", 3, "critical", "CWE-89") in rows and ("7", 0, "medium", "") in rows and rows.count(("", 0, "medium", "")) >= 1
    assert scanners.broken_reports(reports).first().asDict() == {"repo": "r", "reports": 7, "broken": 2}
    b = spark.createDataFrame([("r", json.dumps({"results": [{"filename": "f", "line_number": "9", "issue_severity": "HIGH", "issue_cwe": 5}, {"filename": "g", "issue_cwe": {"id": 78}, "extra": 1}]}))], "repo string, raw string")
    assert sorted((r.file, r.line, r.cwe_id) for r in scanners.bandit(b).collect()) == [("f", 9, None), ("g", 0, "CWE-78")]
    t = spark.createDataFrame([("r", json.dumps({"Results": [{"Target": "t", "Vulnerabilities": "none", "Secrets": [{"RuleID": "s", "StartLine": [1]}], "More": 1}, 5]}))], "repo string, raw string")
    assert [(r.file, r.rule_id, r.line) for r in scanners.trivy(t).collect()] == [("t", "s", 0)]
