"""Canonical columns, severity ranks and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Fixed values, worst first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SCORE_WEIGHT = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.15, "info": 0.05}
RISK_WEIGHT = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "info": 0.1}
EXPLOITABILITY = {"critical": 0.85, "high": 0.65, "medium": 0.40, "low": 0.15, "info": 0.05}

FINDING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repo", "file")]
    + [T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("rule_id", "issue", "description", "code_snippet", "severity", "cwe_id", "cve_id", "package_name", "package_version", "fixed_version")]
    + [T.StructField(n, T.DoubleType()) for n in ("confidence", "exploitability", "false_positive_probability")]
    + [T.StructField(n, T.IntegerType()) for n in ("blast_radius", "layer")]
)

#: Longest stored text of each column.
TRUNCATED = {"file": 500, "issue": 1000, "description": 2000, "rule_id": 200, "cve_id": 50, "cwe_id": 50, "code_snippet": 2000, "package_name": 200, "package_version": 100, "fixed_version": 100}


def looked_up(key: Column, table: dict, default) -> Column:
    """A small constant table as an expression; no join, and the default for unknown and null keys."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """5 for critical down to 1 for info, 0 for anything else."""
    return looked_up(severity, {s: 5 - i for i, s in enumerate(SEVERITIES)}, 0)


def canonical(findings):
    """All columns of FINDING in order; what a detector doesn't know is null, confidence 0.8, exploitability 0.5, blast 1."""
    defaults = {"confidence": 0.8, "exploitability": 0.5, "false_positive_probability": 0.0, "blast_radius": 1, "line": 0, "column": 0}
    have = set(findings.columns)
    cols = [(F.coalesce(F.col(f"`{f.name}`"), F.lit(defaults.get(f.name))) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in FINDING]
    return findings.select(*cols, *[c for c in findings.columns if c not in {f.name for f in FINDING}])


def truncated(findings):
    """Texts cut to their stored lengths, probabilities rounded to three places."""
    cuts = {c: F.substring(c, 1, n) for c, n in TRUNCATED.items() if c in findings.columns}
    cuts |= {c: F.round(c, 3) for c in ("confidence", "exploitability", "false_positive_probability") if c in findings.columns}
    return findings.withColumns(cuts)
