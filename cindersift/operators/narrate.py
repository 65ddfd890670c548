"""Texts and second opinions of findings (E7, E8, E17, E19) and what a repository is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cindersift.operators.enrich import OWASP, any_of
from cindersift.schema import looked_up

# Words and phrase, in order; then a phrase for each severity.
IMPACTS = (
    ("secret credential password api-key token", "Account compromise and unauthorized access to external services"),
    ("sqli sql-injection database", "Data breach — full database exfiltration possible"),
    ("xss cross-site innerHTML", "User session hijacking and phishing via stored XSS"),
    ("rce eval exec command-injection deserialization", "Full server compromise — remote code execution"),
    ("ssrf request-forgery", "Internal network reconnaissance and cloud metadata theft"),
    ("cve dependency", "Known exploits available — automated attack tools exist"),
    ("docker k8s terraform iac", "Infrastructure compromise — blast radius extends to entire environment"),
)
SEVERITY_IMPACT = {
    "critical": "Severe security vulnerability requiring immediate remediation",
    "high": "Significant security risk that should be addressed this sprint",
    "medium": "Moderate security concern — plan remediation in upcoming sprint",
}
OTHER_IMPACT = "Low-risk finding — address during regular code maintenance"
#: Manifests, then extensions, of each language, in order.
LANGUAGES = (
    ("python", ("requirements.txt", "setup.py", "pyproject.toml", "Pipfile"), (".py",)),
    ("javascript", ("package.json",), (".js", ".jsx", ".ts", ".tsx")),
    ("java", ("pom.xml", "build.gradle"), (".java",)),
    ("go", ("go.mod",), (".go",)),
    ("rust", ("Cargo.toml",), (".rs",)),
    ("ruby", ("Gemfile",), (".rb",)),
)
FRAMEWORKS = (("FastAPI", "fastapi"), ("Django", "django"), ("Flask", "flask"), ("React", "react"), ("Vue", "vue"), ("Next.js", "next"), ("Spring Boot", "spring-boot"), ("Express", "express"))


def business_impact(text: Column, severity: Column) -> Column:
    """Up to two phrases whose words the text has, else one by severity."""
    hits = F.array_compact(F.array(*[F.when(any_of(text, words), F.lit(phrase)) for words, phrase in IMPACTS]))
    return F.when(F.size(hits) > 0, F.array_join(F.slice(hits, 1, 2), "; ")).otherwise(looked_up(severity, SEVERITY_IMPACT, OTHER_IMPACT))


def summary() -> Column:
    """One sentence of an enriched finding; parts that don't apply are left out."""
    place = F.when(F.coalesce("file", F.lit("")) != "", F.concat(F.lit("in "), F.col("file"), F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise("")))
    category = F.when(F.col("owasp").isNotNull(), F.concat(F.lit("(OWASP "), F.col("owasp"), F.lit(": "), looked_up(F.col("owasp"), {k: n for k, (n, _) in OWASP.items()}, ""), F.lit(")")))
    effort = F.when(F.col("exploit") >= 0.8, "— Trivially exploitable by an attacker").when(F.col("exploit") >= 0.6, "— Exploitable with moderate effort").when(F.col("exploit") >= 0.4, "— Requires specific conditions to exploit")
    doubt = F.when(F.col("fp") >= 0.5, "[Likely false positive — verify manually]")
    return F.concat_ws(" ", F.concat(F.lit("["), F.upper("severity"), F.lit("]")), F.substring("issue", 1, 100), place, category, effort, doubt)


def top_categories(coverage: DataFrame, key: str = "scan_id", k: int = 3) -> DataFrame:
    """The k categories of most findings of each scan as one text, from (key, owasp, n); by name on a tie."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "owasp")
    first = coverage.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= k)
    told = F.transform(F.array_sort(F.collect_list(F.struct("__i", "owasp", "n"))), lambda x: F.concat(x["owasp"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return first.groupBy(key).agg(F.array_join(told, ", ").alias("top_owasp"))


def executive_brief(counts: DataFrame) -> DataFrame:
    """A paragraph of each scan from (total, critical, high, medium, low, risk_level, attack_surface, chains), and top_owasp where it is given.

    The sentences are fixed values but for the product's name.
    """
    n = lambda c: F.col(c).cast("string")
    parts = [
        F.concat(F.lit("Security assessment: "), n("total"), F.lit(" findings identified.")),
        F.concat(F.lit("Severity: "), n("critical"), F.lit(" Critical, "), n("high"), F.lit(" High, "), n("medium"), F.lit(" Medium, "), n("low"), F.lit(" Low.")),
        F.concat(F.lit("Overall Risk: "), F.col("risk_level"), F.lit(".")),
        F.concat(F.lit("Attack Surface Score: "), F.format_number("attack_surface", 0), F.lit("/100.")),
        F.when(F.col("chains") > 0, F.concat(F.lit("⚠ "), n("chains"), F.lit(" multi-step attack chain(s) detected."))),
    ]
    if "top_owasp" in counts.columns:
        parts.append(F.when(F.coalesce("top_owasp", F.lit("")) != "", F.concat(F.lit("Top OWASP categories: "), F.col("top_owasp"), F.lit("."))))
    return counts.withColumn("brief", F.concat_ws(" ", *parts))


def summarised(findings: DataFrame, texts: DataFrame | None, on: list[str]) -> DataFrame:
    """Findings whose summary another model's text replaces, where it has one that isn't blank; without a model all stay."""
    if texts is None:
        return findings
    out = findings.join(texts.select(*on, F.trim("summary").alias("__s")), on, "left")
    return out.withColumn("ai_summary", F.coalesce(F.nullif("__s", F.lit("")), "ai_summary")).drop("__s")


def opinion_batches(findings: DataFrame, key: str = "scan_id", size: int = 12) -> DataFrame:
    """The findings that another judge is asked about, all but info ones, with the number of their batch of ``size`` in their scan."""
    w = Window.partitionBy(key).orderBy("seq")
    return findings.where("severity <> 'info'").withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def second_opinion(findings: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    """Findings with another judge's (fp, exploit, summary), where it has one: surer ones lose less confidence, the rest is averaged."""
    out = findings.join(scores.select(*on, F.col("fp").alias("__fp"), F.col("exploit").alias("__e"), F.col("summary").alias("__s")), on, "left")
    judged = (F.col("severity") != "info") & F.col("__fp").isNotNull()
    updates = {
        "confidence": F.col("confidence") * (1 - 0.5 * F.col("__fp")),
        "exploitability": F.least(F.lit(1.0), (F.col("exploitability") + F.coalesce("__e", "exploitability")) / 2),
        "false_positive_probability": F.round((F.col("false_positive_probability") + F.col("__fp")) / 2, 2),
        "ai_summary": F.coalesce(F.nullif("__s", F.lit("")), "ai_summary"),
    }
    return out.withColumns({c: F.when(judged, e).otherwise(F.col(c)) for c, e in updates.items()}).drop("__fp", "__e", "__s")


def profiles(files: DataFrame) -> DataFrame:
    """Files, bytes, language and frameworks of each repository.

    The language is that of the first manifest kind at the root, else of the most common extension. Frameworks are words
    in the first 4,096 characters of root manifests.
    """
    root = ~F.contains("file", F.lit("/"))
    manifests = [m for _, names, _ in LANGUAGES for m in names]
    head = F.when(root & F.col("filename").isin(*manifests), F.lower(F.substring("content", 1, 4096)))
    has = lambda names: F.bool_or(root & F.col("filename").isin(*names))
    words = [F.coalesce(F.bool_or(F.contains(head, F.lit(w))), F.lit(False)).alias(f"f_{i}") for i, (_, w) in enumerate(FRAMEWORKS)]
    per = files.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"), *[has(names).alias(f"m_{lang}") for lang, names, _ in LANGUAGES], *words)
    common = files.where("ext <> ''").groupBy("repo", "ext").agg(F.count("*").alias("n")).groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("n"), "ext")).alias("c")).select("repo", F.col("c.ext").alias("ext"))
    by_manifest = F.coalesce(*[F.when(F.col(f"m_{lang}"), F.lit(lang)) for lang, _, _ in LANGUAGES])
    by_extension = F.coalesce(*[F.when(F.col("ext").isin(*exts), F.lit(lang)) for lang, _, exts in LANGUAGES])
    frameworks = F.array_compact(F.array(*[F.when(F.col(f"f_{i}"), F.lit(name)) for i, (name, _) in enumerate(FRAMEWORKS)]))
    return per.join(common, "repo", "left").select("repo", "files", "bytes", F.coalesce(by_manifest, by_extension, F.lit("unknown")).alias("language"), frameworks.alias("frameworks"))
