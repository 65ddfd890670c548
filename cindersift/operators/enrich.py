"""Enrichment of findings by keyword tables and weights (E1-E18), with expressions only: no join, no shuffle per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cindersift.operators.findings import first_contained
from cindersift.schema import RISK_WEIGHT, looked_up

# Fixed values below, in the order in which they are tried. ----------------------------------------------------------
OWASP = {
    "A01": ("Broken Access Control", "auth permission role admin idor privilege csrf access-control rbac authorization missing-auth"),
    "A02": ("Cryptographic Failures", "crypto encrypt hash md5 sha1 des ecb key secret credential password entropy pbkdf2 tls ssl private-key certificate"),
    "A03": ("Injection", "sqli sql-injection command-injection xss template-injection eval exec os.system subprocess shell ldap xpath nosql innerHTML document.write"),
    "A04": ("Insecure Design", "design architecture rate-limit brute-force missing-rate"),
    "A05": ("Security Misconfiguration", "debug config cors wildcard default misconfiguration docker k8s kubernetes terraform iac helm"),
    "A06": ("Vulnerable & Outdated Components", "cve dependency outdated vulnerable upgrade package typosquat supply-chain"),
    "A07": ("Identification & Authentication Failures", "jwt session token login cookie oauth password brute credential-stuffing"),
    "A08": ("Software & Data Integrity Failures", "deserialization pickle yaml.load integrity ci-cd pipeline actions supply-chain slsa"),
    "A09": ("Security Logging & Monitoring Failures", "logging monitor audit log-sensitive print-sensitive"),
    "A10": ("Server-Side Request Forgery (SSRF)", "ssrf request-forgery urlopen requests.get fetch"),
}
CWE = (
    ("sqli", "CWE-89"), ("sql-injection", "CWE-89"), ("xss", "CWE-79"), ("innerHTML", "CWE-79"), ("template-injection", "CWE-94"),
    ("command-injection", "CWE-78"), ("os.system", "CWE-78"), ("subprocess", "CWE-78"), ("path-traversal", "CWE-22"), ("directory-traversal", "CWE-22"),
    ("eval", "CWE-95"), ("exec", "CWE-95"), ("deserialization", "CWE-502"), ("pickle", "CWE-502"), ("marshal", "CWE-502"), ("ssrf", "CWE-918"),
    ("open-redirect", "CWE-601"), ("hardcoded-secret", "CWE-798"), ("hardcoded-password", "CWE-798"), ("private-key", "CWE-321"),
    ("weak-hash", "CWE-328"), ("md5", "CWE-328"), ("sha1", "CWE-328"), ("weak-random", "CWE-330"), ("math.random", "CWE-330"), ("insecure-random", "CWE-330"),
    ("jwt-none", "CWE-347"), ("jwt-verify-false", "CWE-347"), ("debug-mode", "CWE-489"), ("cors-wildcard", "CWE-942"), ("ssl-verify-false", "CWE-295"),
    ("csrf", "CWE-352"), ("prototype-pollution", "CWE-1321"), ("xxe", "CWE-611"), ("mass-assignment", "CWE-915"), ("idor", "CWE-639"),
    ("race-condition", "CWE-362"), ("entropy", "CWE-331"), ("cve", "CWE-1035"),
)
MITRE = (
    ("Credential Access", "T1552", "secret password credential token key api-key"),
    ("Execution", "T1059", "eval exec system subprocess command-injection"),
    ("Initial Access", "T1190", "sqli xss ssrf injection rce deserialization"),
    ("Persistence", "T1098", "auth jwt session cookie mass-assignment"),
    ("Defense Evasion", "T1562", "ssl-verify debug cors misconfiguration"),
    ("Collection", "T1005", "path-traversal file-read directory sensitive-data"),
    ("Impact", "T1499", "dos redos resource memory timeout"),
)
CONTROLS = {
    "SOC2": {
        "CC6.1": "auth access-control rbac permission admin jwt session",
        "CC6.6": "logging monitor audit log-sensitive",
        "CC6.7": "ssl tls encrypt https cleartext",
        "CC6.8": "dependency cve supply-chain integrity",
        "CC7.2": "config debug misconfiguration iac",
        "CC8.1": "ci-cd pipeline actions deploy",
    },
    "PCI_DSS_v4": {
        "6.2": "sqli xss injection eval command",
        "6.3": "cve dependency upgrade patch",
        "6.4": "xss csrf cors injection ssrf",
        "3.4": "encrypt hash secret credential password",
        "8.3": "auth password jwt session mfa",
    },
    "HIPAA": {
        "164.312(a)": "auth access-control rbac admin",
        "164.312(c)": "hash integrity checksum sign",
        "164.312(d)": "jwt session password credential",
        "164.312(e)": "ssl tls encrypt https cleartext",
    },
    "ISO_27001": {
        "A.9.4": "secret credential hardcoded api-key",
        "A.10.1": "crypto encrypt hash key tls",
        "A.14.2": "injection xss sqli eval debug",
        "A.12.6": "cve dependency upgrade patch",
    },
    "OWASP_TOP_10": {k: words for k, (_, words) in OWASP.items()},
}
CONTROL_NAMES = tuple(f"{f}:{c}" for f, of in CONTROLS.items() for c in of)
TEST_PATH = r"(?i)(test[_/]|tests[_/]|spec[_/]|__tests__|fixtures[_/]|mock[_/]|example[_/]|demo[_/]|sample[_/]|docs[_/]|\.test\.|_test\.py|test_|conftest\.py|setup\.py|README|CHANGELOG|\.md$|\.txt$|\.rst$)"
SUPPRESSED = r"(?i)(#\s*(noqa|nosec|type:\s*ignore)|//\s*(eslint-disable|noinspection|NOSONAR)|TODO|FIXME|HACK|XXX|placeholder|example|template|sample|dummy|test|\{\{\s*\w+\s*\}\}|<your[-_]|CHANGE[-_]?ME|REPLACE[-_]?ME)"
CHAIN_WORDS = ("injection", "auth", "crypto", "config", "ssrf", "secret")
CHAINS = (("injection", "auth", 0.85), ("secret", "auth", 0.80), ("injection", "config", 0.75), ("ssrf", "secret", 0.90), ("crypto", "auth", 0.70))
STRIDE = {
    "Spoofing": "auth jwt session forgery spoof",
    "Tampering": "injection xss tampering integrity",
    "Repudiation": "logging audit monitor",
    "Information Disclosure": "secret leak exposure disclosure path-traversal",
    "Denial of Service": "dos redos resource memory timeout",
    "Elevation of Privilege": "admin privilege escalation rbac eval exec rce",
}
# --------------------------------------------------------------------------------------------------------------------


def any_of(text: Column, words: str) -> Column:
    out = F.lit(False)
    for w in words.split():
        out = out | F.contains(text, F.lit(w))
    return out


def combined() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("rule_id", F.lit("")), F.coalesce("issue", F.lit("")), F.coalesce("description", F.lit(""))))


def false_positive(text: Column, file: Column, snippet: Column, confidence: Column) -> Column:
    """Summed signs of a false positive, 0.95 at most."""
    file, snippet = F.lower(F.coalesce(file, F.lit(""))), F.lower(F.coalesce(snippet, F.lit("")))
    comment = F.rlike(F.trim(snippet), F.lit(r"""^(#|//|/\*|\*|<!--|\"\"\"|''')"""))
    signs = [
        (0.35, F.rlike(file, F.lit(TEST_PATH))),
        (0.15, F.rlike(snippet, F.lit(SUPPRESSED))),
        (0.10, F.length(snippet) < 20),
        (0.15, confidence < 0.5),
        (0.10, any_of(text, "config env setting") & ~any_of(file, ".env config setting")),
        (0.15, any_of(text, "cookie-no- http-not-https localstorage")),
        (0.40, comment),
    ]
    total = F.lit(0.0)
    for weight, sign in signs:
        total = total + F.when(sign, weight).otherwise(0.0)
    return F.least(total, F.lit(0.95))


def exploitability(text: Column, file: Column) -> Column:
    """Vector, complexity, interaction and reachability."""
    file = F.lower(F.coalesce(file, F.lit("")))
    score = F.lit(0.5) + F.when(any_of(text, "sql xss ssrf injection rce command"), 0.25).when(any_of(text, "path-traversal file-read lfi"), 0.15).when(any_of(text, "secret credential password key"), 0.10).otherwise(0.0)
    score = score + F.when(any_of(text, "eval( exec( pickle marshal yaml.load"), 0.15).when(any_of(text, "deserialization prototype-pollution"), 0.10).otherwise(0.0)
    score = score - F.when(any_of(text, "xss csrf open-redirect clickjacking"), 0.05).otherwise(0.0)
    score = score + F.when(any_of(file, "route view handler controller api"), 0.10).otherwise(0.0) - F.when(any_of(file, "util helper internal lib"), 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def owasp(text: Column) -> Column:
    """The category with most of its words in the text, the first on a tie, null without any."""
    # Words as literal arrays keep the generated code small; the array around the text evaluates it once.
    table = F.array(*[F.struct(F.lit(-i).alias("o"), F.lit(k).alias("k"), F.array(*map(F.lit, words.split())).alias("words")) for i, (k, (_, words)) in enumerate(OWASP.items())])

    def best(t: Column) -> Column:
        counted = F.transform(table, lambda c: F.struct(F.size(F.filter(c["words"], lambda w: F.contains(t, w))).alias("n"), c["o"].alias("o"), c["k"].alias("k")))
        return F.array_max(F.filter(counted, lambda c: c["n"] > 0))["k"]

    return F.element_at(F.transform(F.array(text), best), 1)


def mitre(text: Column) -> Column:
    """E5: the technique of the first tactic with a word in the text."""
    return F.coalesce(*[F.when(any_of(text, words), F.lit(technique)) for _, technique, words in MITRE])


def controls(text: Column) -> Column:
    """Every control with a word in the text, as framework:control."""
    return _named_by_any(text, [(f"{f}:{c}", words) for f, of in CONTROLS.items() for c, words in of.items()])


def _named_by_any(text: Column, table: list[tuple[str, str]]) -> Column:
    """The names, in table order, any of whose words the text contains. The table is one literal and the text is read once."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, words.split())).alias("words")) for k, words in table])
    hits = lambda t: F.transform(F.filter(rows, lambda r: F.exists(r["words"], lambda w: F.contains(t, w))), lambda r: r["k"])
    return F.element_at(F.transform(F.array(text), hits), 1)


def by_text(findings: DataFrame) -> DataFrame:
    """E3-E6 of every finding, worked out once for each distinct text: findings share the texts of their rules.

    The distinct texts are combined before their shuffle; where they stay few, adaptive execution broadcasts them.
    """
    rows = findings.withColumn("combined", combined())
    text = F.col("combined")
    texts = rows.select("combined").distinct().withColumns({"owasp": owasp(text), "cwe": first_contained(text, CWE), "technique": mitre(text), "controls": controls(text)})
    bits = [F.when(F.array_contains("controls", name), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, name in enumerate(CONTROL_NAMES)]
    texts = texts.withColumn("controls_mask", reduce(lambda a, b: a.bitwiseOR(b), bits))
    return rows.join(texts, "combined")


def enriched(findings: DataFrame) -> DataFrame:
    """False-positive probability, exploitability, categories, controls and risk of every finding."""
    out = by_text(findings)
    text = F.col("combined")
    out = out.withColumns(
        {
            "fp": F.round(false_positive(text, F.col("file"), F.col("code_snippet"), F.col("confidence")), 6),
            "exploit": F.round(exploitability(text, F.col("file")), 6),
        }
    )
    risk = looked_up(F.col("severity"), RISK_WEIGHT, 0.5) * 40 + F.col("exploit") * 30 + (1 - F.col("fp")) * 15 + F.least(F.col("blast_radius") / 10, F.lit(1.0)) * 15
    return out.withColumn("risk", F.round(risk, 4))


def attack_chains(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """The highest probability of a two-part chain that a finding takes part in, both parts being in its scan."""
    text = combined()
    flags = findings.withColumns({f"__{w}": F.contains(text, F.lit(w)) for w in CHAIN_WORDS})
    seen = flags.groupBy(key).agg(*[F.bool_or(f"__{w}").alias(f"s_{w}") for w in CHAIN_WORDS])
    out = flags.join(seen, key)
    p = [F.when(F.col(f"s_{a}") & F.col(f"s_{b}") & (F.col(f"__{a}") | F.col(f"__{b}")), F.lit(x)).otherwise(0.0) for a, b, x in CHAINS]
    return out.withColumn("chain_probability", F.greatest(*p)).drop(*[f"__{w}" for w in CHAIN_WORDS], *[f"s_{w}" for w in CHAIN_WORDS])


def priority_rank(enriched_findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """Positions by falling risk, in the given order on a tie."""
    return enriched_findings.withColumn("priority", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("risk"), "seq")))


def compliance_summary(enriched_findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """For each scan and framework the violated controls, the share of kept ones and the status."""
    # Controls as bits: a scan's are one grouped or, and no list of them is shuffled.
    per = enriched_findings.groupBy(key).agg(F.bit_or("controls_mask").alias("__m"))
    own = {f: sum(1 << i for i, name in enumerate(CONTROL_NAMES) if name.startswith(f + ":")) for f in CONTROLS}
    frameworks = F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(len(of)).alias("controls"), F.lit(own[f]).cast("long").alias("__own")) for f, of in CONTROLS.items()])
    out = per.select(key, "__m", F.inline(frameworks))
    out = out.withColumn("violated", F.bit_count(F.col("__m").bitwiseAND(F.col("__own"))).cast("long")).drop("__m", "__own")
    out = out.withColumn("kept_percent", F.round((F.col("controls") - F.col("violated")) / F.col("controls") * 100, 1))
    return out.withColumn("status", F.when(F.col("kept_percent") >= 100, "PASS").when(F.col("kept_percent") >= 80, "WARN").otherwise("FAIL"))


def owasp_coverage(enriched_findings: DataFrame) -> DataFrame:
    """Findings of each category."""
    return enriched_findings.where("owasp is not null").groupBy("owasp").agg(F.count("*").alias("n"))


def risk_level(chained: DataFrame, key: str = "scan_id") -> DataFrame:
    """The level of a scan from its severities and chains."""
    per = chained.groupBy(key).agg(F.count(F.when(F.col("severity") == "critical", 1)).alias("c"), F.count(F.when(F.col("severity") == "high", 1)).alias("h"), F.max("chain_probability").alias("p"), F.count("*").alias("n"))
    level = F.when((F.col("c") >= 3) | ((F.col("c") >= 1) & (F.col("p") > 0.7)), "CRITICAL").when((F.col("c") >= 1) | (F.col("h") >= 5), "HIGH").when(F.col("h") >= 2, "MEDIUM").when((F.col("h") >= 1) | (F.col("n") > 10), "LOW").otherwise("MINIMAL")
    return per.select(key, level.alias("risk_level"))


def attack_surface(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """Files, entry points, dependencies and findings, 100 at most."""
    text = F.lower(F.concat_ws(" ", "rule_id", "issue"))
    per = findings.groupBy(key).agg(F.countDistinct("file").alias("files"), F.count(F.when(any_of(text, "route handler api endpoint"), 1)).alias("entries"), F.bool_or(any_of(text, "cve dependency package")).alias("deps"), F.count("*").alias("n"))
    total = F.least(F.col("files") * 5, F.lit(40)) + F.least(F.col("entries") * 10, F.lit(30)) + F.when(F.col("deps"), 15).otherwise(0) + F.least(F.col("n") * 2, F.lit(15))
    return per.select(key, F.least(total, F.lit(100)).cast("double").alias("attack_surface"))


def stride(findings: DataFrame) -> DataFrame:
    """Findings of each threat."""
    return findings.select(F.explode(_named_by_any(combined(), list(STRIDE.items()))).alias("threat")).groupBy("threat").agg(F.count("*").alias("n"))


def written_back(enriched_findings: DataFrame) -> DataFrame:
    """Missing ids filled, the larger false-positive probability, the mean of both exploitabilities."""
    return enriched_findings.withColumns(
        {
            "cwe_id": F.coalesce("cwe_id", "cwe"),
            "false_positive_probability": F.greatest(F.coalesce("false_positive_probability", F.lit(0.0)), F.col("fp")),
            "exploitability": F.round((F.col("exploitability") + F.col("exploit")) / 2, 6),
        }
    )
