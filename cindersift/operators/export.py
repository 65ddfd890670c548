"""Exports: reports, badges, component lists, comments (K1-K5, K7, K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cindersift.operators.findings import top_by_risk
from cindersift.schema import truncated


def persisted(findings: DataFrame, path: str, k: int = 500, key: str = "scan_id") -> None:
    """K1: the k riskiest findings of each scan, texts cut, as Parquet."""
    truncated(top_by_risk(findings, k, key)).write.mode("append").parquet(path)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_reports(findings: DataFrame, key: str = "scan_id", k: int = 500) -> DataFrame:
    """K2: one JSON text of each scan, its k riskiest findings in order."""
    top = top_by_risk(findings, k, key)
    item = F.struct("position", "rule_id", "severity", "file", "line", "issue")
    return top.groupBy(key).agg(F.to_json(F.struct(F.first(key).alias(key), F.array_sort(F.collect_list(item)).alias("findings"))).alias("report"))


def html_rows(findings: DataFrame) -> DataFrame:
    """K3: a table row of each finding, with its texts escaped."""
    colour = F.when(F.col("severity") == "critical", "#dc2626").when(F.col("severity") == "high", "#ea580c").when(F.col("severity") == "medium", "#d97706").otherwise("#65a30d")
    cells = [escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("file", "line", "issue")]
    return findings.withColumn("html", F.concat(F.lit('<tr><td style="color:'), colour, F.lit('">'), escaped(F.upper("severity")), F.lit("</td><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")))


def badges(latest: DataFrame) -> DataFrame:
    """K4: an SVG badge of each repository's latest score."""
    label, value = F.lit("security"), F.concat(F.floor("score").cast("string"), F.lit("%"))
    colour = F.when(F.col("score") >= 80, "#22c55e").when(F.col("score") >= 50, "#f59e0b").otherwise("#ef4444")
    left, right = 6 * F.length(label) + 10, 7 * F.length(value) + 10
    parts = [F.lit('<svg xmlns="http://www.w3.org/2000/svg" height="20" width="'), (left + right).cast("string"), F.lit('"><rect height="20" width="'), left.cast("string"), F.lit('" fill="#555"/><rect height="20" x="'), left.cast("string"), F.lit('" width="'), right.cast("string"), F.lit('" fill="'), colour, F.lit('"/><text x="5" y="14" fill="#fff">'), label, F.lit('</text><text y="14" fill="#fff" x="'), (left + 5).cast("string"), F.lit('">'), value, F.lit("</text></svg>")]
    return latest.select("repo_id", F.concat(*parts).alias("svg"))


def bill_of_materials(components: DataFrame, key: str = "scan_id") -> DataFrame:
    """K5: a CycloneDX text of each scan's distinct components."""
    one = F.struct(F.lit("library").alias("type"), F.col("package_name").alias("name"), F.col("version"))
    per = components.select(key, "package_name", "version").distinct().groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("components"))
    return per.select(key, F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("sbom"))


def spdx(components: DataFrame, key: str = "scan_id") -> DataFrame:
    """K5: an SPDX text of each scan's distinct components."""
    one = F.struct(F.col("package_name").alias("name"), F.col("version").alias("versionInfo"), F.concat(F.lit("SPDXRef-"), F.regexp_replace("package_name", "[^A-Za-z0-9.-]", "-"), F.lit("-"), F.regexp_replace("version", "[^A-Za-z0-9.-]", "-")).alias("SPDXID"), F.lit("NOASSERTION").alias("downloadLocation"))
    per = components.select(key, "package_name", "version").distinct().groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("packages"))
    return per.select(key, F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), "packages")).alias("sbom"))


def comments(counts: DataFrame) -> DataFrame:
    """K7: a line of markdown for a pull request."""
    mark = F.when(F.col("score") >= 80, "✅").when(F.col("score") >= 60, "⚠️").otherwise("❌")
    return counts.withColumn("comment", F.concat(mark, F.lit(" **Score "), F.round("score", 1).cast("string"), F.lit("/100** | critical "), F.col("critical").cast("string"), F.lit(", high "), F.col("high").cast("string")))


def training_rows(findings: DataFrame, path: str) -> None:
    """K8: findings with a summary and a false-positive probability under 0.5, appended as JSON lines."""
    findings.where("ai_summary is not null and ai_summary <> '' and false_positive_probability < 0.5").write.mode("append").json(path)
