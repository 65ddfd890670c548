"""Files and other scanners' JSON reports as findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cindersift.operators.findings import mapped_severity
from cindersift.schema import canonical

#: What a walk leaves out, and the largest file.
SKIPPED = r"node_modules|__pycache__|\.git|venv|\.venv|dist|build|vendor|\.tox|coverage|\.next|target|\.terraform|\.serverless|\.mypy_cache|\.pytest_cache|\.eggs|bower_components"
MAX_BYTES = 2 * 1024 * 1024
CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".php", ".java", ".go", ".rb", ".cs", ".cpp", ".c", ".h", ".swift", ".kt", ".scala", ".rs", ".sh", ".bash", ".ps1")
CONFIG = (".env", ".yml", ".yaml", ".json", ".conf", ".cfg", ".ini", ".toml", ".tf", ".hcl")
MANIFESTS = ("requirements.txt", "Pipfile", "pyproject.toml", "package.json", "package-lock.json", "yarn.lock", "Gemfile", "go.mod", "Cargo.toml", "Dockerfile", "docker-compose.yml", "docker-compose.yaml")


def files(spark: SparkSession, root: str, *, hidden: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(repo, file, ext, filename, content, lines, bytes) of a tree's code, configuration, manifests and container files.

    Length and path filters reach the source. Folders that start with a dot are left out unless ``hidden``.

    Undecodable bytes are replaced. Names that start with a dot or an underscore are hidden to Spark's file index.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    raw = raw.where(~F.rlike("path", F.lit(rf"/(?:{SKIPPED})/")))
    endings = "|".join(e[1:] for e in CODE + CONFIG)
    names = "|".join(re.escape(m) for m in MANIFESTS)
    raw = raw.where(F.rlike("path", F.lit(rf"(?:(?i:\.(?:{endings}))|/(?:{names})|/Dockerfile[^/]*|/docker-compose[^/]*)$")))
    if not hidden:
        raw = raw.where(~F.rlike("path", F.lit(r"/\.[^/]+/")))
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    name = F.substring_index("path", "/", -1)
    content = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        F.lit(base.rpartition("/")[2]).alias("repo"), F.substring(path, len(base) + 2, 1 << 30).alias("file"),
        F.when(F.contains(name, F.lit(".")), F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))).otherwise("").alias("ext"), name.alias("filename"),
        content.alias("content"), (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.col("length").alias("bytes"),
    )


#: The endings of a training corpus.
CORPUS = (".c", ".cpp", ".py", ".md", ".txt", ".s", ".asm")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of a tree's texts for training; files that are not UTF-8, and folders that start with a dot, are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    endings = "|".join(e[1:] for e in CORPUS)
    raw = raw.where(F.rlike("path", F.lit(rf"\.(?:{endings})$")))
    return raw.select(F.regexp_replace("path", r"^[a-z]+:/*", "/").alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where("content is not null")


def code_files(rows: DataFrame) -> DataFrame:
    """S3: code among files."""
    return rows.where(F.col("ext").isin(*CODE))


def config_files(rows: DataFrame) -> DataFrame:
    """S3: configuration among files."""
    return rows.where(F.col("ext").isin(*CONFIG))


def by_extension(rows: DataFrame, *extensions: str) -> DataFrame:
    """S3: files of these endings."""
    return rows.where(F.col("ext").isin(*extensions))


def by_filename(rows: DataFrame, *names: str) -> DataFrame:
    """S3: files of these names."""
    return rows.where(F.col("filename").isin(*names))


def manifests(rows: DataFrame) -> DataFrame:
    """S3: manifests among files, container and compose files of the usual name included."""
    return by_filename(rows, *MANIFESTS)


def dockerfiles(rows: DataFrame) -> DataFrame:
    """S3: container and compose files among files."""
    return rows.where(F.startswith("filename", F.lit("Dockerfile")) | F.startswith("filename", F.lit("docker-compose")))


def _at(document: str | Column, path: str, kind: str = "string") -> Column:
    """What a document holds at a path, as a type; null where the path or a fitting value is missing."""
    return F.try_variant_get(document, f"$.{path}" if path else "$", kind)


def _items(rows: DataFrame, items: Column, *keep: str) -> DataFrame:
    """A row for each item of a list, as ``x``; what is no list has none."""
    return rows.select(*keep, F.explode(items).alias("x"))


def parsed_reports(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """Reports with ``report``, the document, and ``broken``: whether there is a text that is no JSON. Nothing is dropped.

    A key that has another type than expected costs that value, not the finding and not the report.
    """
    report = F.try_parse_json(F.col(raw))
    return reports.withColumn("report", report).withColumn("broken", F.col(raw).isNotNull() & F.col("report").isNull())


def broken_reports(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """(repo, reports, broken): how many reports each repository has, and how many of them are no JSON."""
    rows = parsed_reports(reports, raw)
    return rows.groupBy("repo").agg(F.count("*").alias("reports"), F.count_if("broken").alias("broken"))


def semgrep(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """Findings of Semgrep reports (repo, raw); missing keys and broken JSON give no rows (see :func:`broken_reports`)."""
    rows = _items(parsed_reports(reports, raw), _at("report", "results", "array<variant>"), "repo")
    cwe = F.nullif(F.regexp_extract(_at("x", "extra.metadata.cwe"), r"(CWE-\d+)", 1), F.lit(""))
    return canonical(rows.select(
        "repo", _at("x", "path").alias("file"), _at("x", "start.line", "int").alias("line"), _at("x", "start.col", "int").alias("column"), _at("x", "check_id").alias("rule_id"),
        F.substring(_at("x", "extra.message"), 1, 1000).alias("issue"), _at("x", "extra.lines").alias("code_snippet"), mapped_severity(_at("x", "extra.severity"), "semgrep").alias("severity"), cwe.alias("cwe_id"),
    ))


def bandit(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """Findings of Bandit reports."""
    rows = _items(parsed_reports(reports, raw), _at("report", "results", "array<variant>"), "repo")
    named = F.upper(_at("x", "issue_confidence"))
    sure = F.when(named == "HIGH", 0.9).when(named == "LOW", 0.4).otherwise(0.7)
    return canonical(rows.select(
        "repo", _at("x", "filename").alias("file"), _at("x", "line_number", "int").alias("line"), _at("x", "col_offset", "int").alias("column"), _at("x", "test_id").alias("rule_id"), _at("x", "issue_text").alias("issue"),
        _at("x", "test_name").alias("description"), _at("x", "code").alias("code_snippet"), mapped_severity(_at("x", "issue_severity"), "bandit").alias("severity"), F.concat(F.lit("CWE-"), _at("x", "issue_cwe.id", "int").cast("string")).alias("cwe_id"), sure.alias("confidence"),
    ))


def trivy(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """Vulnerabilities, secrets and misconfigurations of Trivy reports, with an object or a list at the root."""
    parsed = parsed_reports(reports, raw)
    root = F.coalesce(_at("report", "Results", "array<variant>"), _at("report", "", "array<variant>"))
    t = parsed.select("repo", F.explode(root).alias("t")).withColumn("file", _at("t", "Target"))
    of = lambda name: _items(t, _at("t", name, "array<variant>"), "repo", "file")
    severity = lambda scanner: mapped_severity(_at("x", "Severity"), scanner).alias("severity")
    v = of("Vulnerabilities").select(
        "repo", "file", _at("x", "VulnerabilityID").alias("rule_id"), _at("x", "VulnerabilityID").alias("cve_id"), F.coalesce(_at("x", "Title"), _at("x", "VulnerabilityID")).alias("issue"), _at("x", "Description").alias("description"),
        severity("trivy"), _at("x", "PkgName").alias("package_name"), _at("x", "InstalledVersion").alias("package_version"), _at("x", "FixedVersion").alias("fixed_version"),
    )
    s = of("Secrets").select("repo", "file", _at("x", "RuleID").alias("rule_id"), _at("x", "Title").alias("issue"), severity("trivy-secret"), _at("x", "StartLine", "int").alias("line"), _at("x", "Match").alias("code_snippet"))
    m = of("Misconfigurations").select("repo", "file", _at("x", "ID").alias("rule_id"), _at("x", "Title").alias("issue"), _at("x", "Description").alias("description"), severity("trivy-config"), _at("x", "CauseMetadata.StartLine", "int").alias("line"))
    return canonical(v).unionByName(canonical(s)).unionByName(canonical(m))


def repositories(listings: DataFrame, raw: str = "raw") -> DataFrame:
    """Repositories of listings saved as JSON (raw), the lately updated ones first when collected in order of ``position``."""
    schema = "array<struct<id:long,name:string,full_name:string,html_url:string,default_branch:string,language:string,private:boolean,updated_at:timestamp>>"
    rows = listings.select(F.explode(F.from_json(raw, schema)).alias("r")).select("r.*").where("id is not null")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(F.substring_index("full_name", "/", 1)).orderBy(F.desc("updated_at"), "id")))


#: What an address of a repository begins with.
ADDRESS_STARTS = ("https://github.com/", "git@github.com:")


def repository_address(url: Column) -> Column:
    """(owner, name) of a repository's address, by web or by ssh, with or without ``.git``; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+\z", ""), r"/+\z", ""), r"\.git\z", "")
    out = None
    for start in ADDRESS_STARTS:
        parts = F.split(F.replace(bare, F.lit(start), F.lit("")), "/")
        pair = F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name")))
        out = F.when(F.startswith(bare, F.lit(start)), pair) if out is None else out.when(F.startswith(bare, F.lit(start)), pair)
    return out
