"""The findings pipeline: union, deduplication, ranking, caps and scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cindersift.schema import SCORE_WEIGHT, SEVERITIES, looked_up, severity_rank


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """All layers' findings, none dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def layer_counts(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """Findings of each layer."""
    return findings.groupBy(key, "layer").agg(F.count("*").alias("n"))


def _first_of(findings: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in an order of falling values, then by seq: the one that none comes before.

    Nearly every finding has a key of its own, so nothing is combined before the one shuffle; of the columns only those that are
    asked for later travel, and rows are sorted after it alone.
    """
    # A number of the row would be cut before the shuffle too, behind a sort of whole partitions there.
    before = F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*[(-o).asc() for o in order], F.col("seq").asc()))
    return findings.withColumn("__later", before).where("__later is null").drop("__later")


def dedup_best(findings: DataFrame, key: str = "scan_id", *, strict: bool = False) -> DataFrame:
    """Of the findings of a file, line and three-part rule prefix, the one of highest confidence times exploitability, the first on a tie.

    Findings of packages keep one row for each package unless strict.
    """
    keys = [F.col(key), F.col("file"), F.col("line"), F.substring_index("rule_id", "/", 3)]
    if not strict and "package_name" in findings.columns:
        keys.append(F.coalesce("package_name", F.lit("")))
    return _first_of(findings, keys, [F.col("confidence") * F.col("exploitability")])


def dedup_severity(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """Of a file, line and rule the worst severity, the first on a tie."""
    return _first_of(findings, [F.col(key), F.col("file"), F.col("line"), F.col("rule_id")], [severity_rank(F.col("severity"))])


def risk_order() -> list[Column]:
    """P5: severity, then exploitability times blast radius times confidence, then the given order."""
    return [F.desc(severity_rank(F.col("severity"))), F.desc(F.col("exploitability") * F.col("blast_radius") * F.col("confidence")), F.col("seq")]


def top_by_risk(findings: DataFrame, k: int = 500, key: str = "scan_id") -> DataFrame:
    """The first k of each scan in risk order, with their position."""
    w = Window.partitionBy(key).orderBy(*risk_order())
    return findings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def risk_score(findings: DataFrame, key: str = "scan_id", digits: int = 2) -> DataFrame:
    """100 times the product, in risk order, of 1 - 0.30 * exploitability * weight * confidence * (1 - fp); stops under 0.1."""
    sure = F.col("confidence") * (1 - F.coalesce("false_positive_probability", F.lit(0.0)))
    impact = 0.30 * F.col("exploitability") * looked_up(F.col("severity"), SCORE_WEIGHT, 0.05) * sure
    factor = F.greatest(F.lit(0.05), 1 - F.least(F.greatest(impact, F.lit(0.0)), F.lit(1.0)))
    rows = findings.select(key, F.log(factor).alias("f"), severity_rank(F.col("severity")).alias("r"), (F.col("exploitability") * F.col("blast_radius") * F.col("confidence")).alias("p"), "seq")
    # A product that ends at 0.1 or more was never under it: a plain sum of logarithms, combined before its shuffle.
    total = rows.groupBy(key).agg(F.sum("f").alias("f"))
    stop = math.log(0.1 / 100)
    # For the others the first prefix under 0.1 counts, which is the largest one that is: a running sum, never an array.
    low = total.where(F.col("f") < stop).select(key)
    prefix = F.sum("f").over(Window.partitionBy(key).orderBy(F.desc("r"), F.desc("p"), "seq", F.desc("f")).rowsBetween(Window.unboundedPreceding, 0))
    ended = rows.join(low, key).select(key, prefix.alias("f")).where(F.col("f") < stop).groupBy(key).agg(F.max("f").alias("f"))
    every = total.where(F.col("f") >= stop).unionByName(ended)
    return every.select(key, F.round(F.greatest(F.lit(0.0), 100 * F.exp("f")), digits).alias("score"))


def linear_score(counts: DataFrame) -> DataFrame:
    """100 less 15, 7, 3 and 1 for each critical, high, medium and low finding, not under 0."""
    return counts.withColumn("security_score", F.greatest(F.lit(0), 100 - 15 * F.col("critical") - 7 * F.col("high") - 3 * F.col("medium") - F.col("low")).cast("double"))


def snippet_score(counts: DataFrame) -> DataFrame:
    """100 less 20 and 10 for each critical and high finding and 3 for every finding, not under 0."""
    return counts.withColumn("snippet_score", F.greatest(F.lit(0), 100 - 20 * F.col("critical") - 10 * F.col("high") - 3 * F.col("total")).cast("double"))


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """P10: findings of each severity and in total."""
    return findings.groupBy(*keys).agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def executive_summary(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """Severities, files, the ten first CVE ids, the largest blast radius and the five riskiest critical or high findings."""
    worst = F.when(F.col("severity").isin("critical", "high"), F.struct((-F.col("exploitability") * F.col("blast_radius")).alias("p"), "seq", "rule_id"))
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    per = findings.groupBy(key).agg(*counts, F.count("*").alias("total"), F.countDistinct("file").alias("files"), F.max("blast_radius").alias("max_blast"))
    # Ten ids of each scan are gathered, however many there are.
    ids = findings.where("cve_id is not null").select(key, "cve_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("cve_id"))).where("n <= 10")
    per = per.join(ids.groupBy(key).agg(F.array_sort(F.collect_list("cve_id")).alias("cves")), key, "left")
    w = Window.partitionBy(key).orderBy("w")
    top = findings.select(key, worst.alias("w")).where("w is not null").withColumn("n", F.row_number().over(w)).where("n <= 5")
    top = top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("w.rule_id").alias("r")))), lambda x: x["r"]), ",").alias("top_rules"))
    return per.join(top, key, "left").withColumn("cves", F.coalesce(F.array_join("cves", ","), F.lit("")))


#: Fixed values, in order: the first that a rule id or issue contains names the weakness.
RULE_CWE = (
    ("sql-injection", "CWE-89"), ("command-injection", "CWE-78"), ("template-injection", "CWE-94"), ("ldap-injection", "CWE-90"), ("xpath-injection", "CWE-643"),
    ("xss", "CWE-79"), ("dom-xss", "CWE-79"), ("reflected-xss", "CWE-79"),
    ("hardcoded-secret", "CWE-798"), ("hardcoded-credential", "CWE-259"), ("jwt-none-algorithm", "CWE-347"), ("jwt-no-verify", "CWE-347"), ("broken-auth", "CWE-287"),
    ("weak-hash", "CWE-327"), ("insecure-random", "CWE-330"), ("ecb-mode", "CWE-327"), ("timing-oracle", "CWE-208"), ("high-entropy-string", "CWE-798"),
    ("insecure-deserialization", "CWE-502"), ("pickle-rce", "CWE-502"),
    ("path-traversal", "CWE-22"), ("open-redirect", "CWE-601"),
    ("ssrf", "CWE-918"), ("csrf", "CWE-352"),
    ("cors-wildcard", "CWE-942"), ("ssl-disabled", "CWE-295"), ("iac-priv-escalation", "CWE-269"), ("container-escape", "CWE-284"),
    ("typosquat", "CWE-1357"), ("vulnerable-dependency", "CWE-1035"),
    ("taint-source-to-sink", "CWE-20"),
    ("debug-mode", "CWE-489"), ("info-disclosure", "CWE-200"),
)


def first_contained(text: Column, table) -> Column:
    """The value of the first key, in table order, that the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table])


def resolved_cwe(findings: DataFrame) -> DataFrame:
    """A missing weakness id from the rule id or the issue."""
    text = F.concat_ws(" ", F.lower("rule_id"), F.lower("issue"))
    return findings.withColumn("cwe_id", F.coalesce("cwe_id", first_contained(text, RULE_CWE)))


#: What each scanner calls its severities, and what any other name means.
SCANNER_SEVERITIES = {
    "semgrep": ({"ERROR": "critical", "WARNING": "high", "INFO": "medium", "NOTE": "low"}, "medium"),
    "bandit": ({"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}, "low"),
    "trivy": ({"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "LOW": "low", "UNKNOWN": "low"}, "low"),
}
#: The same names; secrets and misconfigurations of another or no name are worse.
SCANNER_SEVERITIES |= {"trivy-secret": (SCANNER_SEVERITIES["trivy"][0], "high"), "trivy-config": (SCANNER_SEVERITIES["trivy"][0], "medium")}


def mapped_severity(name: Column, scanner: str) -> Column:
    """A scanner's severity as one of ours."""
    names, other = SCANNER_SEVERITIES[scanner]
    return looked_up(F.upper(F.coalesce(name, F.lit(""))), names, other)
