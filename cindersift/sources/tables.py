"""The driver's tables in the roles of this library's inputs. Expressions are plain SQL that any engine reads alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rule ids and issues that stand for the findings of a line item, by its supplier.
RULES = (
    ("l1/sqli-format", "SQL injection by format"), ("l1/jwt-none-algo", "JWT token without signature"), ("l3/weak-hash-md5", "Weak hash of a password"), ("l1/os-system", "Command injection"),
    ("l1/cors-wildcard", "CORS wildcard config"), ("l4/cve-match", "Vulnerable dependency package"), ("l1/pickle-load", "Insecure deserialization"), ("l1/ssrf-risk", "SSRF by request forgery"),
    ("l3/private-key", "Private key secret"), ("l1/missing-auth", "Missing auth on route"), ("l1/log-sensitive", "Logging of secrets"), ("l6/docker-root", "Docker misconfiguration"),
    ("l1/xss-html", "XSS by innerHTML"), ("l5/path-traversal", "Path traversal of user input"), ("l1/debug-mode", "Debug config on"), ("l1/note", "Plain remark"),
)


def _case(expr: str, values) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


FINDINGS = [
    "l_orderkey AS scan_id",
    "l_linenumber AS seq",
    "CASE WHEN l_quantity >= 46 THEN 'critical' WHEN l_quantity >= 36 THEN 'high' WHEN l_quantity >= 20 THEN 'medium' WHEN l_quantity >= 8 THEN 'low' ELSE 'info' END AS severity",
    f"{_case(f'l_suppkey % {len(RULES)}', [r for r, _ in RULES])} AS rule_id",
    f"{_case(f'l_suppkey % {len(RULES)}', [i for _, i in RULES])} AS issue",
    "'' AS description",
    f"concat('src/', {_case('l_partkey % 6', ('route', 'util', 'test_a', 'config', 'lib', 'main'))}, '_', CAST(l_partkey % 3 AS VARCHAR(9)), '.py') AS file",
    "CAST(l_partkey % 7 AS INT) AS line",
    f"{_case('l_suppkey % 4', ('# nosec', 'value = call(user_input, other)', 'x = 1', 'token = load(config)  # TODO'))} AS code_snippet",
    "1 - l_discount AS confidence",
    "l_tax * 10 AS exploitability",
    "CAST(floor(l_quantity / 5) AS INT) AS blast_radius",
    "CAST(l_suppkey % 6 + 1 AS INT) AS layer",
    "CASE WHEN l_returnflag = 'R' THEN concat('CVE-', CAST(l_partkey % 50 AS VARCHAR(9))) END AS cve_id",
    "CASE WHEN l_returnflag = 'A' THEN 'CWE-20' END AS cwe_id",
    "CASE WHEN l_linestatus = 'O' THEN concat('pkg', CAST(l_partkey % 40 AS VARCHAR(9))) END AS package_name",
    "CASE WHEN l_partkey % 3 = 0 THEN concat('1.', CAST(l_partkey % 9 AS VARCHAR(9)), '.0') END AS package_version",
    "CASE WHEN l_returnflag = 'N' THEN 0.25 ELSE 0.0 END AS false_positive_probability",
]
SCANS = [
    "o_orderkey AS scan_id",
    "o_custkey AS repo_id",
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status",
    "o_orderdate AS scan_time",
    "CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10 AS score",
    "CAST(o_orderkey % 13 AS INT) AS findings",
]
REPOS = ["c_custkey AS repo_id", "c_nationkey AS owner", "c_name AS name"]
PACKAGES = [
    "p_partkey AS package_id",
    f"CASE WHEN p_partkey % 3 = 0 THEN {_case('p_partkey % 8', ('django', 'flask', 'requests', 'lodash', 'axios', 'express', 'vm2', 'semver'))} WHEN p_partkey % 3 = 1 THEN {_case('p_partkey % 5', ('reqests', 'lodahs', 'expres', 'nunpy', 'pandsa'))} ELSE concat('lib', CAST(p_partkey AS VARCHAR(19))) END AS name",
    "CASE WHEN p_size % 5 = 0 THEN '0.0.0' ELSE concat(CAST(p_size % 7 AS VARCHAR(9)), '.', CAST(p_partkey % 20 AS VARCHAR(9)), '.', CAST(p_size % 4 AS VARCHAR(9))) END AS version",
    f"{_case('p_partkey % 4', ('requirements.txt', 'package.json', 'Pipfile', 'go.mod'))} AS manifest",
    f"{_case('p_size % 5', ('MIT', 'GPL-3.0', 'Apache-2.0', 'lgpl', 'BSD'))} AS licence",
]
FILES = ["source AS repo", "doc_id AS file", "lang AS ext", "text AS content"]

ROLES = {"findings": ("lineitem", FINDINGS), "scans": ("orders", SCANS), "repos": ("customer", REPOS), "packages": ("part", PACKAGES), "files": ("documents", FILES)}


def load(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """A role's columns; only the columns that they need are read."""
    name, columns = ROLES[role]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


def with_sql(*roles: str) -> str:
    """The same roles as common table expressions."""
    return "WITH " + ", ".join(f"{r} AS (SELECT {', '.join(ROLES[r][1])} FROM {ROLES[r][0]})" for r in roles) + " "
