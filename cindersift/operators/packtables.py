"""Rule packs and fix templates that come from tables: read, checked and compiled into the plan of a scan.

A pack's row is a rule: what it looks at (lines or whole contents), in which files (endings, names; none means all), behind
which comment starts. The rules of one table become the same data as the packs of the library, so they share its one pass
over the lines. A table is bounded (MAX_RULES rows) since it is part of every plan; a larger one is an error, as is a rule that can't
work: all faults are told at once, with the rule they are in.

Columns: rule_id, severity, pattern; and where they are there: issue, cwe, mode (line, whole), absent, extensions, filenames,
comments (arrays of strings), confidence, exploitability, blast_radius, enabled. Null means the default of the library.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cindersift.functions.text import COMMENT_STARTS
from cindersift.operators.rules import Rule
from cindersift.schema import SEVERITIES

MAX_RULES = 2000
MODES = ("line", "whole")
PACK = "rule_id string, severity string, pattern string, issue string, cwe string, mode string, absent string, extensions array<string>, filenames array<string>, comments array<string>, confidence double, exploitability double, blast_radius int, enabled boolean"


@dataclass(frozen=True)
class Route:
    """Rules for one choice of files: endings and names, of which a file needs one; none of either means every file."""

    rules: tuple[Rule, ...]
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    comments: tuple[str, ...] = COMMENT_STARTS

    def which(self) -> Column | None:
        """Over columns ext and filename."""
        choices = ([F.col("ext").isin(*self.extensions)] if self.extensions else []) + ([F.col("filename").isin(*self.filenames)] if self.filenames else [])
        return reduce(lambda a, b: a | b, choices) if choices else None


@dataclass(frozen=True)
class Packs:
    """The routes of a table: those over lines and those over whole contents."""

    lines: tuple[Route, ...] = ()
    whole: tuple[Route, ...] = ()


def _bad_pattern(spark, pattern: str) -> str | None:
    """Why a pattern can't be compiled, null if it can; the engine that matches also judges."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # noqa: BLE001  what the other side throws comes wrapped
        return str(getattr(e, "java_exception", e)).splitlines()[0]
    return None


def read(table: DataFrame) -> Packs:
    """The packs of a table; ValueError names every rule that can't work."""
    names = [c.split()[0] for c in PACK.split(", ")]
    rows = table.select(*[F.col(c) if c in table.columns else F.lit(None).alias(c) for c in names]).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    faults, seen, routes = [], set(), {}
    for r in rows:
        if r.enabled is False:
            continue
        mode = r.mode or "line"
        wrong = [f"no {c}" for c in ("rule_id", "severity", "pattern") if not r[c]]
        wrong += [f"severity {r.severity}"] if r.severity and r.severity not in SEVERITIES else []
        wrong += [f"mode {mode}"] if mode not in MODES else []
        wrong += ["given twice"] if r.rule_id in seen else []
        wrong += [f"{c} out of range" for c in ("confidence", "exploitability") if r[c] is not None and not 0 <= r[c] <= 1]
        wrong += ["absent is for whole contents"] if r.absent and mode == "line" else []
        wrong += [f"pattern: {why}" for p in (r.pattern, r.absent) if p and (why := _bad_pattern(table.sparkSession, p))]
        seen.add(r.rule_id)
        faults += [f"{r.rule_id}: {', '.join(wrong)}"] if wrong else []
        if not wrong:
            rule = Rule(r.rule_id, r.severity, r.pattern, r.issue or r.rule_id, r.cwe, r.absent, r.confidence, r.exploitability, r.blast_radius)
            key = (mode, tuple(x.lower() for x in r.extensions or ()), tuple(r.filenames or ()), COMMENT_STARTS if r.comments is None else tuple(r.comments))
            routes.setdefault(key, []).append(rule)
    if faults:
        raise ValueError("rules that can't work: " + "; ".join(faults))
    made = lambda mode: tuple(Route(tuple(own), e, f, c) for (m, e, f, c), own in routes.items() if m == mode)
    return Packs(made("line"), made("whole"))


def fix_templates(table: DataFrame) -> tuple:
    """Fix templates (key, position, pattern, replacement, explanation, risk) as :func:`cindersift.operators.policy.fixed` takes them, keys in the order of their least position."""
    rows = table.select("key", "position", "pattern", "replacement", "explanation", "risk").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} templates")
    bad = [f"{r.key}: {why}" for r in rows if (why := _bad_pattern(table.sparkSession, r.pattern))]
    if bad:
        raise ValueError("templates that can't work: " + "; ".join(bad))
    out: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: r.position):
        key, pairs, explanation, risk = out.get(r.key, (r.key, (), r.explanation, r.risk))
        out[r.key] = (key, (*pairs, (r.pattern, r.replacement)), explanation, risk)
    return tuple(out.values())
