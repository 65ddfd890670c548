"""Texts, second opinions and repository profiles."""

import pytest
from pyspark.sql import functions as F

from cindersift.operators import narrate


def test_texts(spark):
    df = spark.createDataFrame([("high", "Token in sqli", "a.py", 3, "A03", 0.85, 0.6), ("low", "Remark", None, None, None, 0.1, 0.0)], "severity string, issue string, file string, line int, owasp string, exploit double, fp double")
    got = df.select(narrate.summary().alias("s"), narrate.business_impact(F.lower("issue"), F.col("severity")).alias("b")).collect()
    assert got[0].s == "[HIGH] Token in sqli in a.py:3 (OWASP A03: Injection) — Trivially exploitable by an attacker [Likely false positive — verify manually]"
    assert got[0].b == f"{narrate.IMPACTS[0][1]}; {narrate.IMPACTS[1][1]}"
    assert (got[1].s, got[1].b) == ("[LOW] Remark", narrate.OTHER_IMPACT)


def test_second_opinion(spark):
    f = spark.createDataFrame([(1, "high", 0.8, 0.6, 0.2, "own"), (2, "info", 0.8, 0.6, 0.2, None), (3, "low", 0.8, 0.6, 0.2, None)], "id int, severity string, confidence double, exploitability double, false_positive_probability double, ai_summary string")
    s = spark.createDataFrame([(1, 0.5, 1.0, ""), (2, 0.5, 1.0, "x")], "id int, fp double, exploit double, summary string")
    got = {r.id: r for r in narrate.second_opinion(f, s, ["id"]).collect()}
    assert (got[1].confidence, got[1].exploitability, got[1].false_positive_probability, got[1].ai_summary) == (pytest.approx(0.6), pytest.approx(0.8), 0.35, "own")
    assert got[2].confidence == 0.8 and got[3].confidence == 0.8 and got[2].ai_summary is None


def test_profiles(spark):
    rows = [("a", "package.json", "package.json", ".json", '{"react": 1}'), ("a", "x/y.py", "y.py", ".py", "é"), ("b", "m.go", "m.go", ".go", ""), ("b", "n.go", "n.go", ".go", None), ("c", "t.txt", "t.txt", ".txt", "z")]
    got = {r.repo: (r.files, r.language, list(r.frameworks)) for r in narrate.profiles(spark.createDataFrame(rows, "repo string, file string, filename string, ext string, content string")).collect()}
    assert got == {"a": (2, "javascript", ["React"]), "b": (2, "go", []), "c": (1, "unknown", [])}


def test_brief(spark):
    df = spark.createDataFrame([(9, 1, 2, 3, 3, "HIGH", 41.6, 2)], "total int, critical int, high int, medium int, low int, risk_level string, attack_surface double, chains int")
    assert narrate.executive_brief(df).first().brief == "Security assessment: 9 findings identified. Severity: 1 Critical, 2 High, 3 Medium, 3 Low. Overall Risk: HIGH. Attack Surface Score: 42/100. ⚠ 2 multi-step attack chain(s) detected."
