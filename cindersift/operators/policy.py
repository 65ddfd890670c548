"""Policy gates and fixes over scan metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Name, condition, action.
POLICIES = (
    ("No Critical Vulnerabilities", "critical_count == 0", "block"),
    ("Minimum Security Score", "scan_score >= 70", "warn"),
    ("High Vulnerability Limit", "high_count <= 5", "warn"),
    ("No Hardcoded Secrets", "secret_count == 0", "block"),
    ("No Known CVEs", "cve_count <= 3", "warn"),
    ("Attack Chain Alert", "attack_chain_count == 0", "warn"),
    ("Compliance Check", "compliance_violations == 0", "notify"),
)
CONDITION = r"^\s*(\w+)\s*(==|!=|<=|>=|<|>)\s*(\d+(?:\.\d+)?)"


def policies(spark, rows=POLICIES) -> DataFrame:
    return spark.createDataFrame([(n, c, a, True) for n, c, a in rows], "name string, condition string, action string, enabled boolean")


def evaluated(metrics: DataFrame, rules: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, name, action, actual, passed) for every scan and policy.

    metrics: key and one numeric column for each variable. A policy set is small by its nature (its rows become a
    literal array, so scans are neither shuffled nor crossed). Unparsable conditions and disabled rules pass; a missing variable is 0.
    """
    table = rules.select("name", "action", "enabled", F.regexp_extract("condition", CONDITION, 1).alias("variable"), F.regexp_extract("condition", CONDITION, 2).alias("op"), F.regexp_extract("condition", CONDITION, 3).try_cast("double").alias("expected"))
    rows = table.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 policies")
    values = {c: F.col(c).cast("double") for c in metrics.columns if c != key}
    out = []
    for r in rows:
        actual = F.coalesce(values.get(r["variable"], F.lit(0.0)), F.lit(0.0))
        e = F.lit(r["expected"])
        passed = {"==": actual == e, "!=": actual != e, "<=": actual <= e, ">=": actual >= e, "<": actual < e, ">": actual > e}.get(r["op"], F.lit(True)) if r["enabled"] else F.lit(True)
        out.append(F.struct(F.lit(r["name"]).alias("name"), F.lit(r["action"]).alias("action"), actual.alias("actual"), passed.alias("passed")))
    return metrics.select(key, F.inline(F.array(*out)))


def gate(results: DataFrame, key: str = "scan_id") -> DataFrame:
    """The worst of block and warn among failed policies, else pass, with counts."""
    failed = lambda action: F.count(F.when(~F.col("passed") & (F.col("action") == action), 1))
    per = results.groupBy(key).agg(failed("block").alias("blocked"), failed("warn").alias("warned"), failed("notify").alias("notified"), F.count(F.when(F.col("passed"), 1)).alias("passed"))
    return per.withColumn("gate", F.when(F.col("blocked") > 0, "block").when(F.col("warned") > 0, "warn").otherwise("pass"))


def scan_metrics(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """The counts that policies name; secrets by their weakness ids, advisories by any advisory id."""
    n = lambda c: F.count(F.when(c, 1))
    return findings.groupBy(key).agg(
        n(F.col("severity") == "critical").alias("critical_count"),
        n(F.col("severity") == "high").alias("high_count"),
        n(F.col("cwe").isin("CWE-798", "CWE-259")).alias("secret_count"),
        n(F.coalesce("cve_id", F.lit("")) != "").alias("cve_count"),
        n(F.col("chain_probability") > 0.5).alias("attack_chain_count"),
        F.sum(F.size("controls")).alias("compliance_violations"),
    )


#: Key in the rule id or issue; patterns and replacements, in order; explanation; risk of breaking something.
FIXES = (
    ("sqli", ((r"execute\s*\(\s*[\"'].*%s.*[\"']", 'execute("...%s...", (param,))'), (r'f".*\{(\w+)\}.*".*execute', "Use parameterized query with %s placeholder"), (r"\.format\(.*\).*execute", "Use parameterized query with %s placeholder")),
     "Replace string-concatenated SQL with parameterized queries to prevent SQL injection.", "low"),
    ("xss", ((r"innerHTML\s*=", "textContent = "), (r"document\.write\s*\(", "Use DOM API: element.textContent = "), (r"dangerouslySetInnerHTML", "Use DOMPurify.sanitize() before rendering")),
     "Sanitize user input before rendering in DOM to prevent Cross-Site Scripting.", "low"),
    ("command-injection", ((r"os\.system\s*\(", "subprocess.run([], shell=False)"), (r"subprocess\.\w+\([^)]*shell\s*=\s*True", "subprocess.run([cmd, arg], shell=False)"), (r"eval\s*\(", "Use ast.literal_eval() for safe evaluation"), (r"exec\s*\(", "Avoid exec(); use structured dispatch instead")),
     "Replace shell execution with safe subprocess calls using argument arrays.", "medium"),
    ("hardcoded-secret", ((r"(password|secret|api_key|token)\s*=\s*[\"'][^\"']{8,}", 'Use os.environ.get("VAR_NAME")'),),
     "Move secrets to environment variables or a secrets manager (e.g., AWS Secrets Manager, HashiCorp Vault).", "medium"),
    ("deserialization", ((r"pickle\.loads?\s*\(", "json.loads() for safe deserialization"), (r"yaml\.load\s*\(", "yaml.safe_load()"), (r"marshal\.load\s*\(", "json.load() for safe deserialization")),
     "Replace unsafe deserializers with safe alternatives to prevent remote code execution.", "medium"),
    ("ssl-verify", ((r"verify\s*=\s*False", "verify=True"), (r"ssl\._create_unverified_context", "ssl.create_default_context()")),
     "Enable SSL certificate verification to prevent person-in-the-middle attacks.", "low"),
    ("debug-mode", ((r"DEBUG\s*=\s*True", 'DEBUG = os.environ.get("DEBUG", "False").lower() == "true"'), (r"debug\s*=\s*True", "debug=False  # Never enable debug in production")),
     "Disable debug mode in production to prevent information disclosure.", "none"),
    ("weak-crypto", ((r"md5\s*\(", "hashlib.sha256("), (r"sha1\s*\(", "hashlib.sha256("), (r"DES\b", "AES"), (r"MODE_ECB", "MODE_GCM")),
     "Replace weak cryptographic algorithms with strong alternatives.", "medium"),
    ("cors-wildcard", ((r"Access-Control-Allow-Origin.*\*", "Access-Control-Allow-Origin: <specific-origin>"), (r"origins\s*=\s*\[?\s*[\"']?\*", 'origins=["https://your-domain.com"]')),
     "Replace wildcard CORS with specific allowed origins to prevent cross-origin attacks.", "medium"),
    ("jwt-insecure", ((r"algorithms?\s*=\s*\[?\s*[\"']none", 'algorithms=["HS256"]'), (r"verify\s*=\s*False.*jwt", "verify=True")),
     "Enforce JWT signature verification and strong algorithms.", "low"),
    ("docker-root", ((r"USER\s+root", "USER nonroot"),),
     "Run containers as non-root to limit blast radius of container escapes.", "medium"),
)


def fixed(findings: DataFrame, templates: tuple = FIXES) -> DataFrame:
    """The template whose key comes first in the rule id or issue, its first pattern that the code has replaced; else a marked explanation of lower confidence.

    Findings without a template have no fix and are left out.
    """
    text = F.concat(F.lower(F.coalesce("rule_id", F.lit(""))), F.lit(" "), F.lower(F.coalesce("issue", F.lit(""))))
    code = F.coalesce("code_snippet", F.lit(""))
    chosen = None
    for key, pairs, explanation, risk in templates:
        hits = [F.when(F.rlike(code, F.lit("(?i)" + p)), F.regexp_replace(code, "(?i)" + p, r.replace("\\", "\\\\").replace("$", "\\$"))) for p, r in pairs]
        done = F.coalesce(*hits)
        one = F.struct(F.coalesce(done, F.concat(F.lit(f"// TODO: {explanation}\n"), code)).alias("fixed_code"), F.when(done.isNotNull(), 0.75).otherwise(0.50).alias("fix_confidence"), F.lit(explanation).alias("explanation"), F.lit(risk).alias("breaking_risk"))
        there = F.contains(text, F.lit(key))
        chosen = F.when(there, one) if chosen is None else chosen.when(there, one)
    return findings.withColumn("__fix", chosen).where("__fix is not null").select(*findings.columns, "__fix.*")


def merged_fixes(given: DataFrame, offline: DataFrame, key: str = "rule_id") -> DataFrame:
    """The given fixes and those offline ones whose rule none of them covers."""
    return given.unionByName(offline.join(given.select(key).distinct(), key, "left_anti").select(given.columns))


#: What a default posture recommends whatever was found.
POSTURE = {
    "architecture_recommendations": ("Separate concerns: keep business logic, data access, and API layers distinct.", "Add an API gateway or middleware layer for rate limiting and input validation.", "Consider adopting a secrets management solution like HashiCorp Vault or AWS Secrets Manager."),
    "security_improvements": ("Rotate any credentials identified in this scan immediately.", "Enable dependency auto-update tools (Dependabot / Renovate).", "Add pre-commit hooks running Semgrep and secret scanners on every commit."),
}


def default_posture(counts: DataFrame) -> DataFrame:
    """Risk, assessment and actions of each row of (language, frameworks, total, critical, high, medium, low)."""
    n = lambda c: F.col(c).cast("string")
    risk = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 2, "HIGH").when(F.col("total") > 5, "MEDIUM").otherwise("LOW")
    used = F.concat(F.lit("The repository scanned uses "), F.coalesce("language", F.lit("unknown")), F.when(F.size("frameworks") > 0, F.concat(F.lit(" with "), F.array_join("frameworks", ", "))).otherwise(""))
    said = F.concat(used, F.lit(". "), n("total"), F.lit(" issues were detected: "), n("critical"), F.lit(" critical, "), n("high"), F.lit(" high, "), n("medium"), F.lit(" medium, "), n("low"), F.lit(" low."))
    actions = F.array(F.concat(F.lit("Address all "), n("critical"), F.lit(" critical findings immediately.")), F.concat(F.lit("Patch "), n("high"), F.lit(" high severity dependency vulnerabilities this sprint.")))
    fixed_ = {k: F.array(*map(F.lit, v)) for k, v in POSTURE.items()}
    return counts.withColumns({"posture_risk": risk, "assessment": said, "priority_actions": actions} | fixed_)
