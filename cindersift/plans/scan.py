"""The full scan: files to ranked, scored findings, as one plan.

Layers are a registry: a scan loops over LAYERS, each a function of what was sifted from the files. Rules of tables
(:mod:`cindersift.operators.packtables`) join the library's packs, in the one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cindersift.functions.text import CANDIDATE, COMMENT_STARTS, SECRET_WORD, entropy_secrets, lines
from cindersift.operators import code, deps, findings as P, packs, packtables, rules, surface, symbols
from cindersift.schema import canonical
from cindersift.storage import written

COLUMNS = ("repo", "file", "line", "rule_id", "severity", "issue", "description", "code_snippet", "column", "exploitability", "blast_radius", "confidence", "cwe_id")
#: Characters of a line that a finding keeps.
SNIPPET = 300
#: The setting that names a table of rules, read by :func:`scanned` where it is set.
PACKS_KEY = "spark.cindersift.packs"
#: The layer of a table's rules whose ids name none.
OWN_LAYER = 1


@dataclass(frozen=True)
class Sifted:
    """What the layers read: lines that something may be found in, whole contents of some files, and the packs that were met."""

    lines: DataFrame
    contents: DataFrame
    packs: list
    own: packtables.Packs


def sifted(files: DataFrame, own: packtables.Packs = packtables.Packs()) -> Sifted:
    """What the layers read of files (repo, file, content), written in the one pass over the texts.

    These are lines that a rule or the entropy scan may find something in, with the numbers of their rules; and, as line 0, the
    whole contents of the files that a layer looks at as such (sources of Python and scripts, manifests, configuration).
    """
    every = [(None, surface.SURFACE, COMMENT_STARTS), *packs.routes(), surface.legacy_route(), *((r.which(), r.rules, r.comments) for r in own.lines)]
    named = files.select("repo", F.col("file").cast("string").alias("file"), "content")
    named = named.withColumn("filename", F.regexp_extract("file", r"([^/]*)$", 1)).withColumn("ext", F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)))
    whole = F.col("ext").isin(".py", *code.SCRIPTS) | F.col("filename").isin(*deps.MANIFESTS) | surface.legacy_file()
    for r in own.whole:
        whole = whole | (F.lit(True) if r.which() is None else r.which())
    rows = rules.marked(lines(packs.probed(named), whole=whole), every, when=F.col("line") > 0)
    quoted = F.rlike("code", F.lit(CANDIDATE)) & F.rlike("code", F.lit(SECRET_WORD))
    rows = written(rows.where((F.col("line") == 0) | F.col("hits").isNotNull() | quoted), "sifted")
    return Sifted(rows.where("line > 0"), rows.where("line = 0").select("repo", "file", "filename", "ext", F.col("code").alias("content")), every, own)


def _layer_of(rule_id):
    """The number in an id such as ``l3/rc4``; legacy rules, and others without one, count as the first layer's."""
    return F.coalesce(F.when(F.rlike(rule_id, F.lit("^l[1-6]/")), F.substring(rule_id, 2, 1).try_cast("int")), F.lit(OWN_LAYER))


def line_rules(s: Sifted) -> DataFrame:
    """All packs over lines, the first match of each rule in a file."""
    hits = packs.slow_enough(rules.told(s.lines.where("hits is not null"), s.packs))
    hits = hits.withColumns({"code_snippet": F.left(F.regexp_replace("code", r"^\s+|\s+$", ""), F.lit(SNIPPET)), "column": F.greatest(F.instr("code", F.col("matched")) - 1, F.lit(0))})
    return rules.first_matches(hits.select(*COLUMNS), "repo", "file").withColumn("layer", _layer_of(F.col("rule_id")))


def entropy(s: Sifted) -> DataFrame:
    found = entropy_secrets(s.lines.select("repo", "file", "line", "code"))
    return found.select("repo", "file", "line", F.lit("l3/high-entropy-secret").alias("rule_id"), F.lit("high").alias("severity"), F.lit("High-entropy string").alias("issue"), F.col("candidate").alias("matched"), F.lit(0.70).alias("exploitability"), F.lit(7).alias("blast_radius"), "confidence", F.lit(3).alias("layer"))


def whole_rules(s: Sifted) -> DataFrame:
    """The legacy rules over configuration, and a table's rules over whole contents."""
    out = [surface.legacy_files(s.contents).withColumns({"confidence": F.lit(0.8), "exploitability": F.lit(0.5), "blast_radius": F.lit(1), "layer": F.lit(6)})]
    for r in s.own.whole:
        of = {x.rule_id: x for x in r.rules}
        chosen = s.contents if r.which() is None else s.contents.where(r.which())
        found = rules.whole_matches(chosen.select("repo", "file", F.col("filename").alias("matched"), "content"), r.rules).withColumn("line", F.lit(0))
        value = lambda f: rules.looked_up(F.col("rule_id"), {k: f(x) for k, x in of.items()}, None)
        out.append(found.withColumns({"issue": value(lambda x: x.issue), "cwe_id": value(lambda x: x.cwe).cast("string"), "confidence": value(lambda x: 0.8 if x.confidence is None else x.confidence), "exploitability": value(rules.exploitable), "blast_radius": value(rules.reach), "layer": _layer_of(F.col("rule_id"))}))
    return P.union_layers(out)


def trees(s: Sifted) -> DataFrame:
    return code.findings(s.contents.where("ext = '.py'"), legacy=None)


def scripts(s: Sifted) -> DataFrame:
    return code.script_findings(s.contents.where(F.col("ext").isin(*code.SCRIPTS)))


def packages(s: Sifted) -> DataFrame:
    return deps.findings(s.contents)


def flows(s: Sifted) -> DataFrame | None:
    sources = s.contents.where("ext = '.py'")
    # The walk's rounds are jobs of their own; without sources there is nothing to walk.
    return None if sources.isEmpty() else symbols.findings(sources).drop("depth", "handler")


#: Name and function of each layer; a function gives findings, or None where it has nothing to look at.
LAYERS: dict[str, Callable[[Sifted], DataFrame | None]] = {"line rules": line_rules, "entropy": entropy, "whole rules": whole_rules, "syntax trees": trees, "scripts": scripts, "packages": packages, "flows": flows}


def detected(files: DataFrame, packs_table: DataFrame | None = None, layers: dict | None = None) -> DataFrame:
    """Findings of all layers, in the canonical columns, with scan_id and seq; a table's rules (``packs_table``) are found like the library's."""
    s = sifted(files, packtables.Packs() if packs_table is None else packtables.read(packs_table))
    found = [df for f in (LAYERS if layers is None else layers).values() if (df := f(s)) is not None]
    found = [df.withColumn("code_snippet", F.left("matched", F.lit(SNIPPET))).drop("matched") if "matched" in df.columns else df for df in found]
    found = canonical(P.resolved_cwe(P.union_layers(found)))
    return found.withColumn("scan_id", F.col("repo")).withColumn("seq", F.xxhash64("file", "line", "rule_id"))


def scanned(files: DataFrame, packs_table: DataFrame | None = None) -> DataFrame:
    """Severity counts, risk score and linear score of each repository; rules also come from the table that PACKS_KEY names."""
    spark = files.sparkSession
    if packs_table is None and (path := spark.conf.get(PACKS_KEY, None)):
        packs_table = spark.read.parquet(path)
    # Counts and scores read the findings several times; they are few beside the files, which are read once.
    found = written(P.dedup_best(detected(files, packs_table)), "findings")
    counts = P.linear_score(P.severity_counts(found, "scan_id"))
    return counts.join(P.risk_score(found), "scan_id").withColumnRenamed("scan_id", "repo")
