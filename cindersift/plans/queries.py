"""The library's registered queries and the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from cindersift.functions import text
from cindersift.operators import deps, enrich, findings as P, graph, history as H, policy, rules, surface
from cindersift.plans import graphs, more, samples
from cindersift.schema import RISK_WEIGHT, SCORE_WEIGHT, SEVERITIES, truncated
from cindersift.sources.tables import load, with_sql
from cindersift.streaming import events as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {5 - i}" for i, s in enumerate(SEVERITIES)) + " ELSE 0 END"
FIND = with_sql("findings")
COMBINED = "lower(concat(rule_id, ' ', issue, ' ', description))"
LINES = with_sql("files") + r", cut AS (SELECT repo, file, regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM files), kept AS (SELECT repo, file, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM cut), lines AS (SELECT repo, file, unnest(a) AS code, unnest(range(1, len(a) + 1)) AS line FROM kept) "
CODE = "ltrim(code, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
NOT_COMMENT = f"NOT (starts_with({CODE}, '#') OR starts_with({CODE}, '//') OR starts_with({CODE}, '/*') OR starts_with({CODE}, '*') OR starts_with({CODE}, '<!--'))"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _any(words: str, column: str = "t") -> str:
    return "(" + " OR ".join(f"contains({column}, '{_q(w)}')" for w in words.split()) + ")"


# Lines and rules -----------------------------------------------------------------------------------------------------
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(load(spark, sf_dir, "files").drop("ext"))


@query(LINES + "SELECT file, count(*) AS n_lines, sum(length(code))::BIGINT AS chars FROM lines GROUP BY file")
def line_explode(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n_lines"), F.sum(F.length("code")).alias("chars"))


@query(LINES + f"SELECT repo, count(*) AS n FROM lines WHERE {NOT_COMMENT} GROUP BY repo")
def comment_filter(spark, sf_dir):
    return _lines(spark, sf_dir).where(~text.is_comment(F.col("code"))).groupBy("repo").agg(F.count("*").alias("n"))


def _re2(pattern: str) -> str:
    """A pattern as the other engine reads it: word edges spelled out, as it knows only those of ASCII words, and no look-ahead."""
    edges = re.sub(r"\\b(?=[\w(])", r"(?:^|[^\\p{L}\\p{N}_])", pattern)
    return edges.replace("\\b", r"(?:[^\p{L}\p{N}_]|$)").replace("(?!Secure|secure)", "")


def _there(r: rules.Rule) -> str:
    if r.rule_id == "l1/http-not-https":  # a look-ahead: of all such links one that isn't local
        return "len([x FOR x IN regexp_extract_all(code, '(?i)[\"'']http://[^\"'']{5,}[\"'']') IF NOT regexp_matches(x, '(?i)^.http://(localhost|127\\.0\\.0\\.1)')]) > 0"
    if r.rule_id == "l1/ruby-system-exec":  # an edge before a backtick is one after a letter
        return r"(regexp_matches(code, '(?i)(?:^|[^\p{L}\p{N}_])(system|exec)\s*[^#]') OR regexp_matches(code, '[\p{L}\p{N}_]`[^`]*`\s*[^#]'))"
    return f"regexp_matches(code, '{_q(_re2(r.pattern))}')"


def _rule(rule_id: str) -> rules.Rule:
    return next(r for r in surface.SURFACE if r.rule_id == rule_id)


@query(LINES + ", hits AS (" + " UNION ALL ".join(f"SELECT repo, file, line, '{r.rule_id}' AS rule_id FROM lines WHERE {NOT_COMMENT} AND {_there(r)}" for r in surface.SURFACE) + ") SELECT repo, file, rule_id, min(line) AS line FROM hits GROUP BY ALL")
def rule_first_match(spark, sf_dir):
    hits = rules.matches(_lines(spark, sf_dir), surface.SURFACE)
    return rules.first_matches(hits, "repo", "file").select("repo", "file", "rule_id", F.col("line").cast("long").alias("line"))


@query(LINES + f"SELECT repo, count(DISTINCT file) AS files, count(*) AS hits FROM lines WHERE {NOT_COMMENT} AND {_there(_rule('l1/des-usage'))} GROUP BY repo")
def des_word_hits(spark, sf_dir):
    return rules.matches(_lines(spark, sf_dir), surface.SURFACE, rule_filter="l1/des-usage").groupBy("repo").agg(F.countDistinct("file").alias("files"), F.count("*").alias("hits"))


@query(LINES + f"SELECT file, line, regexp_extract(code, '{_q(_rule('l1/generic-secret').pattern)}') AS matched FROM lines WHERE {NOT_COMMENT} AND {_there(_rule('l1/generic-secret'))}")
def secret_assignments(spark, sf_dir):
    return rules.matches(_lines(spark, sf_dir), surface.SURFACE, rule_filter="l1/generic-secret").select("file", F.col("line").cast("long").alias("line"), "matched")


_BITS = "CASE WHEN regexp_matches(candidate, '^[0-9a-fA-F]+$') THEN 3.7 ELSE 5.0 END"


@query(
    LINES
    + f", found AS (SELECT repo, file, line, code, unnest(regexp_extract_all(code, '{_q(text.CANDIDATE)}', 1)) AS candidate FROM lines WHERE {NOT_COMMENT} AND regexp_matches(code, '{_q(text.CANDIDATE)}') AND NOT regexp_matches(code, '{text.HARMLESS}')), "
    + f"near AS (SELECT DISTINCT repo, file, line, candidate FROM found WHERE regexp_matches(string_split(code, candidate)[1], '{text.SECRET_WORD}') AND len(candidate) - len(replace(candidate, '/', '')) <= 2 AND lower(candidate) NOT IN ({', '.join(repr(x) for x in text.HARMLESS_TEXTS)})), "
    + "letters AS (SELECT candidate, c, count(*) AS n FROM (SELECT candidate, unnest(string_split(candidate, '')) AS c FROM (SELECT DISTINCT candidate FROM near)) GROUP BY ALL), "
    + f"bits AS (SELECT candidate, -sum(n / length(candidate) * log2(n / length(candidate))) AS bits, {_BITS} AS least FROM letters GROUP BY candidate) "
    + "SELECT repo, file, line, candidate, round(least(0.92, (bits - least) / (6.5 - least) * 0.85 + 0.40), 2)::DOUBLE AS confidence FROM near JOIN bits USING (candidate) WHERE bits >= least"
)
def entropy_secrets(spark, sf_dir):
    return text.entropy_secrets(_lines(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


@query(with_sql("files") + r"SELECT repo, file, 'low' AS severity, 'notice-without-warranty' AS rule_id FROM files WHERE regexp_matches(content, '(?i)\blicen[cs]e') AND NOT regexp_matches(content, '(?i)\bGNU\b')")
def negative_pattern(spark, sf_dir):
    rule = rules.Rule("notice-without-warranty", "low", r"(?i)\blicen[cs]e", absent=r"(?i)\bGNU\b")
    return rules.whole_matches(load(spark, sf_dir, "files").drop("ext"), [rule])


@query()
def document_scan(spark, sf_dir):
    """The flagship path: lines, rules and entropy, first matches, deduplication and a score for each source."""
    from cindersift.plans.scan import scanned

    return scanned(load(spark, sf_dir, "files"))


# Findings ------------------------------------------------------------------------------------------------------------
def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "findings")


@query(FIND + "SELECT layer, count(*) AS n FROM findings GROUP BY layer")
def union_layers(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    return P.union_layers([rows.where(F.col("layer") % 2 == 0), rows.where(F.col("layer") % 2 == 1)]).groupBy("layer").agg(F.count("*").alias("n"))


@query(FIND + "SELECT scan_id, layer, count(*) AS n FROM findings GROUP BY ALL")
def layer_counts(spark, sf_dir):
    return P.layer_counts(_findings(spark, sf_dir))


@query(FIND + "SELECT scan_id, seq, file, line, rule_id FROM findings QUALIFY row_number() OVER (PARTITION BY scan_id, file, line, array_to_string(string_split(rule_id, '/')[1:3], '/'), coalesce(package_name, '') ORDER BY confidence * exploitability DESC, seq) = 1")
def dedup_best(spark, sf_dir):
    return P.dedup_best(_findings(spark, sf_dir)).select("scan_id", "seq", "file", "line", "rule_id")


@query(FIND + f"SELECT scan_id, seq, file, line, rule_id, severity FROM findings QUALIFY row_number() OVER (PARTITION BY scan_id, file, line, rule_id ORDER BY {RANK} DESC, seq) = 1")
def dedup_severity(spark, sf_dir):
    return P.dedup_severity(_findings(spark, sf_dir)).select("scan_id", "seq", "file", "line", "rule_id", "severity")


@query(FIND + f"SELECT scan_id, seq, severity FROM findings ORDER BY {RANK} DESC, exploitability * blast_radius * confidence DESC, seq, scan_id LIMIT 500")
def risk_sort_top500(spark, sf_dir):
    return _findings(spark, sf_dir).orderBy(*P.risk_order(), "scan_id").limit(500).select("scan_id", "seq", "severity")


@query(FIND + f"SELECT scan_id, seq, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK} DESC, exploitability * blast_radius * confidence DESC, seq)::INT AS position FROM findings QUALIFY position <= 3")
def topk_per_scan(spark, sf_dir):
    return P.top_by_risk(_findings(spark, sf_dir), 3).select("scan_id", "seq", "position")


@query(FIND + "SELECT scan_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + ", count(*) AS total FROM findings GROUP BY scan_id")
def severity_pivot(spark, sf_dir):
    return P.severity_counts(_findings(spark, sf_dir), "scan_id")


_W = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in SCORE_WEIGHT.items()) + " END"


@query(FIND + f", x AS (SELECT scan_id, greatest(0.05, 1 - 0.30 * exploitability * {_W} * (confidence * (1 - false_positive_probability))) AS f, {RANK} AS r, exploitability * blast_radius * confidence AS p, seq FROM findings) SELECT scan_id, round(list_reduce(list(f ORDER BY r DESC, p DESC, seq, f), lambda a, x: CASE WHEN a < 0.1 THEN a ELSE a * x END, 100.0::DOUBLE) + 1e-9, 2) AS score FROM x GROUP BY scan_id")
def multiplicative_score(spark, sf_dir):
    # Decimal inputs make exact ties, which either engine's last bit would decide.
    return P.risk_score(_findings(spark, sf_dir), digits=12).withColumn("score", F.round(F.col("score") + 1e-9, 2))


@query(FIND + "SELECT scan_id, greatest(0, 100 - 15 * count(*) FILTER (severity = 'critical') - 7 * count(*) FILTER (severity = 'high') - 3 * count(*) FILTER (severity = 'medium') - count(*) FILTER (severity = 'low'))::DOUBLE AS security_score FROM findings GROUP BY scan_id")
def linear_score(spark, sf_dir):
    return P.linear_score(P.severity_counts(_findings(spark, sf_dir), "scan_id")).select("scan_id", "security_score")


@query(FIND + "SELECT scan_id, greatest(0, 100 - 20 * count(*) FILTER (severity = 'critical') - 10 * count(*) FILTER (severity = 'high') - 3 * count(*))::DOUBLE AS snippet_score FROM findings GROUP BY scan_id")
def snippet_score(spark, sf_dir):
    return P.snippet_score(P.severity_counts(_findings(spark, sf_dir), "scan_id")).select("scan_id", "snippet_score")


@query(
    FIND + ", t AS (SELECT scan_id, string_agg(rule_id, ',' ORDER BY n) AS top_rules FROM (SELECT scan_id, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY -exploitability * blast_radius, seq, rule_id) AS n FROM findings WHERE severity IN ('critical', 'high')) WHERE n <= 5 GROUP BY scan_id), "
    "a AS (SELECT scan_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + ", count(*) AS total, count(DISTINCT file) AS files, max(blast_radius) AS max_blast, coalesce(array_to_string(list_sort(list(DISTINCT cve_id) FILTER (cve_id IS NOT NULL))[1:10], ','), '') AS cves FROM findings GROUP BY scan_id) SELECT a.*, top_rules FROM a LEFT JOIN t USING (scan_id)"
)
def exec_summary(spark, sf_dir):
    return P.executive_summary(_findings(spark, sf_dir))


def _first(table, column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{_q(k)}') THEN '{v}'" for k, v in table) + " END"


@query(FIND + f"SELECT scan_id, seq, coalesce(cwe_id, {_first(P.RULE_CWE, 't')}) AS cwe_id FROM (SELECT *, lower(concat(rule_id, ' ', issue)) AS t FROM findings)")
def cwe_resolution(spark, sf_dir):
    return P.resolved_cwe(_findings(spark, sf_dir)).select("scan_id", "seq", "cwe_id")


@query(FIND + "SELECT scan_id, seq, substring(file, 1, 500) AS file, substring(code_snippet, 1, 2000) AS code_snippet, round(confidence, 3) AS confidence FROM findings")
def persisted_findings(spark, sf_dir):
    return truncated(_findings(spark, sf_dir)).select("scan_id", "seq", "file", "code_snippet", "confidence")


# Enrichment ----------------------------------------------------------------------------------------------------------
TEXT = FIND + f", e AS (SELECT *, {COMBINED} AS t, lower(file) AS f, lower(code_snippet) AS s FROM findings) "


def _sum(signs) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for w, c in signs)


FP = (
    "least(0.95, "
    + _sum(
        [
            (0.35, f"regexp_matches(f, '{_q(enrich.TEST_PATH)}')"),
            (0.15, f"regexp_matches(s, '{_q(enrich.SUPPRESSED)}')"),
            (0.10, "length(s) < 20"),
            (0.15, "confidence < 0.5"),
            (0.10, f"{_any('config env setting')} AND NOT {_any('.env config setting', 'f')}"),
            (0.15, _any("cookie-no- http-not-https localstorage")),
            (0.40, "regexp_matches(trim(s), '^(#|//|/\\*|\\*|<!--|\"\"\"|'''''')')"),
        ]
    )
    + ")"
)
EXPLOIT = (
    f"greatest(0.0, least(1.0, 0.5 + CASE WHEN {_any('sql xss ssrf injection rce command')} THEN 0.25 WHEN {_any('path-traversal file-read lfi')} THEN 0.15 WHEN {_any('secret credential password key')} THEN 0.10 ELSE 0.0 END"
    f" + CASE WHEN {_any('eval( exec( pickle marshal yaml.load')} THEN 0.15 WHEN {_any('deserialization prototype-pollution')} THEN 0.10 ELSE 0.0 END - CASE WHEN {_any('xss csrf open-redirect clickjacking')} THEN 0.05 ELSE 0.0 END"
    f" + CASE WHEN {_any('route view handler controller api', 'f')} THEN 0.10 ELSE 0.0 END - CASE WHEN {_any('util helper internal lib', 'f')} THEN 0.10 ELSE 0.0 END))"
)
_COUNTS = {k: " + ".join(f"contains(t, '{_q(w)}')::INT" for w in words.split()) for k, (_, words) in enrich.OWASP.items()}
BEST = f"greatest({', '.join(_COUNTS.values())})"
OWASP = f"CASE WHEN {BEST} = 0 THEN NULL " + " ".join(f"WHEN ({c}) = {BEST} THEN '{k}'" for k, c in _COUNTS.items()) + " END"
RISK = "round(CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in RISK_WEIGHT.items()) + f" END * 40 + {EXPLOIT} * 30 + (1 - {FP}) * 15 + least(blast_radius / 10, 1.0) * 15, 4)"
HITS = TEXT + ", hits AS (" + " UNION ALL ".join(f"SELECT scan_id, seq, '{f}' AS framework, '{c}' AS control FROM e WHERE {_any(w)}" for f, of in enrich.CONTROLS.items() for c, w in of.items()) + ") "
STATUS = HITS + ", fw AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {len(of)})" for f, of in enrich.CONTROLS.items()) + ") v(framework, controls)), v AS (SELECT scan_id, framework, count(DISTINCT control) AS violated FROM hits GROUP BY ALL), st AS (SELECT scan_id, framework, controls, coalesce(violated, 0) AS violated, round((controls - coalesce(violated, 0)) / controls * 100, 1) AS kept_percent FROM (SELECT DISTINCT scan_id FROM findings) CROSS JOIN fw LEFT JOIN v USING (scan_id, framework)), status AS (SELECT *, CASE WHEN kept_percent >= 100 THEN 'PASS' WHEN kept_percent >= 80 THEN 'WARN' ELSE 'FAIL' END AS status FROM st) "
CHAIN = TEXT + ", g AS (SELECT *, " + ", ".join(f"contains(t, '{w}') AS has_{w}, bool_or(contains(t, '{w}')) OVER (PARTITION BY scan_id) AS any_{w}" for w in enrich.CHAIN_WORDS) + " FROM e), ch AS (SELECT *, greatest(" + ", ".join(f"CASE WHEN any_{a} AND any_{b} AND (has_{a} OR has_{b}) THEN {p} ELSE 0.0 END" for a, b, p in enrich.CHAINS) + ")::DOUBLE AS chain_probability FROM g) "


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enriched(_findings(spark, sf_dir))


@query(TEXT + f"SELECT scan_id, seq, round({FP}, 6)::DOUBLE AS fp FROM e")
def fp_probability(spark, sf_dir):
    return _enriched(spark, sf_dir).select("scan_id", "seq", "fp")


@query(TEXT + f"SELECT scan_id, seq, round({EXPLOIT}, 6)::DOUBLE AS exploit FROM e")
def exploitability(spark, sf_dir):
    return _enriched(spark, sf_dir).select("scan_id", "seq", "exploit")


@query(TEXT + f"SELECT scan_id, seq, {OWASP} AS owasp FROM e")
def owasp_argmax(spark, sf_dir):
    return _enriched(spark, sf_dir).select("scan_id", "seq", "owasp")


@query(TEXT + f"SELECT owasp, count(*) AS n FROM (SELECT {OWASP} AS owasp FROM e) WHERE owasp IS NOT NULL GROUP BY owasp")
def owasp_coverage(spark, sf_dir):
    return enrich.owasp_coverage(_enriched(spark, sf_dir))


@query(TEXT + f"SELECT scan_id, seq, {_first(enrich.CWE, 't')} AS cwe FROM e")
def cwe_first_match(spark, sf_dir):
    return _enriched(spark, sf_dir).select("scan_id", "seq", "cwe")


@query(TEXT + "SELECT scan_id, seq, CASE " + " ".join(f"WHEN {_any(w)} THEN '{t}'" for _, t, w in enrich.MITRE) + " END AS technique FROM e")
def mitre_first_match(spark, sf_dir):
    return _enriched(spark, sf_dir).select("scan_id", "seq", "technique")


@query(HITS + "SELECT framework, control, count(*) AS n FROM hits GROUP BY ALL")
def compliance_matches(spark, sf_dir):
    c = _enriched(spark, sf_dir).select(F.explode("controls").alias("c"))
    return c.groupBy(F.substring_index("c", ":", 1).alias("framework"), F.substring_index("c", ":", -1).alias("control")).agg(F.count("*").alias("n"))


@query(STATUS + "SELECT scan_id, framework, controls, violated, kept_percent, status FROM status")
def compliance_summary(spark, sf_dir):
    return enrich.compliance_summary(_enriched(spark, sf_dir))


@query(STATUS + "SELECT scan_id, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'WARN' END AS status FROM status GROUP BY scan_id")
def compliance_rollup(spark, sf_dir):
    return H.rolled_up(enrich.compliance_summary(_enriched(spark, sf_dir)))


@query(TEXT + f"SELECT scan_id, seq, {RISK}::DOUBLE AS risk FROM e")
def composite_risk(spark, sf_dir):
    return _enriched(spark, sf_dir).select("scan_id", "seq", "risk")


@query(TEXT + f"SELECT scan_id, seq, row_number() OVER (PARTITION BY scan_id ORDER BY {RISK} DESC, seq)::INT AS priority FROM e")
def priority_rank(spark, sf_dir):
    return enrich.priority_rank(_enriched(spark, sf_dir)).select("scan_id", "seq", "priority")


@query(CHAIN + "SELECT scan_id, seq, chain_probability FROM ch")
def attack_chains(spark, sf_dir):
    return enrich.attack_chains(_findings(spark, sf_dir)).select("scan_id", "seq", "chain_probability")


@query(CHAIN + ", r AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, max(chain_probability) AS p, count(*) AS n FROM ch GROUP BY scan_id) SELECT scan_id, CASE WHEN c >= 3 OR (c >= 1 AND p > 0.7) THEN 'CRITICAL' WHEN c >= 1 OR h >= 5 THEN 'HIGH' WHEN h >= 2 THEN 'MEDIUM' WHEN h >= 1 OR n > 10 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level FROM r")
def risk_level(spark, sf_dir):
    return enrich.risk_level(enrich.attack_chains(_findings(spark, sf_dir)))


@query(FIND + f", r AS (SELECT scan_id, count(DISTINCT file) AS files, count(*) FILTER ({_any('route handler api endpoint')}) AS entries, bool_or({_any('cve dependency package')}) AS deps, count(*) AS n FROM (SELECT *, lower(concat(rule_id, ' ', issue)) AS t FROM findings) GROUP BY scan_id) SELECT scan_id, least(least(files * 5, 40) + least(entries * 10, 30) + CASE WHEN deps THEN 15 ELSE 0 END + least(n * 2, 15), 100)::DOUBLE AS attack_surface FROM r")
def attack_surface(spark, sf_dir):
    return enrich.attack_surface(_findings(spark, sf_dir))


@query(TEXT + "SELECT threat, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS threat FROM e WHERE {_any(w)}" for k, w in enrich.STRIDE.items()) + ") GROUP BY threat")
def stride_counts(spark, sf_dir):
    return enrich.stride(_findings(spark, sf_dir))


@query(TEXT + f"SELECT scan_id, seq, coalesce(cwe_id, {_first(enrich.CWE, 't')}) AS cwe_id, greatest(false_positive_probability, round({FP}, 6))::DOUBLE AS fp, round((exploitability + round({EXPLOIT}, 6)) / 2, 4) AS exploit FROM e")
def fusion_writeback(spark, sf_dir):
    out = enrich.written_back(_enriched(spark, sf_dir))
    return out.select("scan_id", "seq", "cwe_id", F.col("false_positive_probability").alias("fp"), F.round("exploitability", 4).alias("exploit"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.attack_chains(_enriched(spark, sf_dir))
    return policy.scan_metrics(rows).join(P.risk_score(_findings(spark, sf_dir)).withColumnRenamed("score", "scan_score"), "scan_id")


METRICS = (
    CHAIN + ", w AS (SELECT scan_id, round(100 * exp(sum(ln(greatest(0.05, 1 - 0.30 * exploitability * " + _W + " * (confidence * (1 - false_positive_probability)))))), 2) AS scan_score FROM findings GROUP BY scan_id), "
    "m AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (" + _first(enrich.CWE, "t") + " IN ('CWE-798', 'CWE-259')) AS secret_count, count(*) FILTER (coalesce(cve_id, '') <> '') AS cve_count, count(*) FILTER (chain_probability > 0.5) AS attack_chain_count, sum("
    + " + ".join(f"{_any(w)}::INT" for of in enrich.CONTROLS.values() for w in of.values())
    + ") AS compliance_violations FROM ch GROUP BY scan_id), r AS (SELECT scan_id, (critical_count > 0)::INT + (secret_count > 0)::INT AS blocked, (scan_score < 70)::INT + (high_count > 5)::INT + (cve_count > 3)::INT + (attack_chain_count > 0)::INT AS warned, (compliance_violations > 0)::INT AS notified FROM m JOIN w USING (scan_id)) "
)


@query(METRICS + "SELECT scan_id, blocked::BIGINT AS blocked, warned::BIGINT AS warned, notified::BIGINT AS notified, (7 - blocked - warned - notified)::BIGINT AS passed, CASE WHEN blocked > 0 THEN 'block' WHEN warned > 0 THEN 'warn' ELSE 'pass' END AS gate FROM r")
def policy_gate(spark, sf_dir):
    return policy.gate(policy.evaluated(_metrics(spark, sf_dir), policy.policies(spark)))


def _fix_sql() -> str:
    """The same templates for the other engine, whose replacement takes backslashes only."""
    whens = []
    for key, pairs, explanation, _ in policy.FIXES:
        tried = " ".join(f"WHEN regexp_matches(s, '(?i){_q(p)}') THEN regexp_replace(s, '(?i){_q(p)}', '{_q(r)}', 'g')" for p, r in pairs)
        done = " OR ".join(f"regexp_matches(s, '(?i){_q(p)}')" for p, _ in pairs)
        whens.append((key, f"CASE {tried} ELSE concat('// TODO: {_q(explanation)}', chr(10), s) END", f"CASE WHEN {done} THEN 0.75 ELSE 0.50 END"))
    chosen = [" ".join(f"WHEN contains(t, '{k}') THEN {w[i]}" for k, *w in whens) for i in (0, 1)]
    return f"SELECT rule_id, CASE {chosen[0]} END AS fixed_code, (CASE {chosen[1]} END)::DOUBLE AS fix_confidence, count(*) AS n FROM (SELECT rule_id, code_snippet AS s, lower(concat(rule_id, ' ', issue)) AS t FROM findings) WHERE {' OR '.join(f'contains(t, {chr(39)}{k}{chr(39)})' for k, *_ in whens)} GROUP BY ALL"


@query(FIND + _fix_sql())
def fix_templates(spark, sf_dir):
    return policy.fixed(_findings(spark, sf_dir)).groupBy("rule_id", "fixed_code", "fix_confidence").agg(F.count("*").alias("n"))


@query(FIND + "SELECT rule_id, count(*) AS n FROM findings WHERE severity = 'critical' OR rule_id NOT IN (SELECT rule_id FROM findings WHERE severity = 'critical') GROUP BY rule_id")
def fix_anti_merge(spark, sf_dir):
    rows = _findings(spark, sf_dir).select("scan_id", "seq", "rule_id", "severity")
    return policy.merged_fixes(rows.where("severity = 'critical'"), rows).groupBy("rule_id").agg(F.count("*").alias("n"))


# Dependencies --------------------------------------------------------------------------------------------------------
PKG = with_sql("packages")
_LOW = "list_transform(list_filter(string_split(regexp_replace({}, '[^0-9.]', '', 'g'), '.')[1:3], lambda p: p <> ''), lambda p: p::INT)"


@query(PKG + f"SELECT package_id, array_to_string({_LOW.format('version')}, '.') AS parts FROM packages")
def version_parse(spark, sf_dir):
    return load(spark, sf_dir, "packages").select("package_id", F.array_join(deps.version_parts(F.col("version")).cast("array<string>"), ".").alias("parts"))


@query(PKG + ", adv AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c.lstrip('<').split('-')[0]}', '{s}', '{cve}')" for p, c, s, cve in deps.ADVISORIES) + f") v(package, bound, severity, cve_id)) SELECT package_id, name, version, adv.severity, adv.cve_id FROM packages JOIN adv ON lower(name) = package WHERE version <> '0.0.0' AND {_LOW.format('version')} < {_LOW.format('bound')}")
def cve_range_join(spark, sf_dir):
    return deps.vulnerable(load(spark, sf_dir, "packages")).select("package_id", "name", "version", "severity", "cve_id")


_POP = ", ".join(f"('{p}')" for p in deps.POPULAR)


@query(PKG + f", pop AS (SELECT * FROM (VALUES {_POP}) v(popular)), n AS (SELECT DISTINCT lower(name) AS name FROM packages), d AS (SELECT name, popular, levenshtein(name, popular)::INT AS distance FROM n, pop WHERE name NOT IN (SELECT popular FROM pop) AND levenshtein(name, popular) <= 2) SELECT name, popular, distance FROM d QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, popular) = 1")
def typosquat_levenshtein(spark, sf_dir):
    return deps.typosquats(load(spark, sf_dir, "packages"))


@query(PKG + "SELECT package_id, manifest FROM packages WHERE version = '0.0.0' AND manifest IN ('requirements.txt', 'package.json', 'Pipfile')")
def unpinned_deps(spark, sf_dir):
    return deps.unpinned(load(spark, sf_dir, "packages")).select("package_id", "manifest")


@query(PKG + f", pop AS (SELECT * FROM (VALUES {_POP}) v(popular)) SELECT package_id, name FROM packages WHERE lower(name) NOT IN (SELECT popular FROM pop)")
def popular_anti_join(spark, sf_dir):
    return deps.unpopular(load(spark, sf_dir, "packages")).select("package_id", "name")


@query(PKG + "SELECT package_id, licence FROM packages WHERE upper(licence) IN (" + ", ".join(f"'{c.upper()}'" for c in deps.COPYLEFT) + ")")
def copyleft_packages(spark, sf_dir):
    return deps.copyleft(load(spark, sf_dir, "packages")).select("package_id", "licence")


# History -------------------------------------------------------------------------------------------------------------
SC = with_sql("scans", "repos")
LATEST = SC + ", latest AS (SELECT repo_id, scan_id, score, findings FROM scans WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY scan_id DESC) = 1), both_ AS (SELECT repo_id, scan_id, score, coalesce(findings, 0) AS findings, CASE WHEN scan_id IS NULL THEN 'never_scanned' ELSE 'completed' END AS state FROM repos LEFT JOIN latest USING (repo_id)) "


def _scans(spark, sf_dir):
    return load(spark, sf_dir, "scans")


def _repos(spark, sf_dir):
    return load(spark, sf_dir, "repos")


@query(LATEST + "SELECT repo_id, scan_id, score, findings FROM latest")
def latest_scan_per_repo(spark, sf_dir):
    return H.latest(_scans(spark, sf_dir), "score", "findings")


@query(SC + "SELECT repo_id, max(scan_id) AS scan_id, arg_max(status, scan_id) AS status FROM scans GROUP BY repo_id")
def latest_any_status(spark, sf_dir):
    return H.latest(_scans(spark, sf_dir), "status", completed=False)


@query(LATEST + "SELECT * FROM both_")
def repo_left_latest(spark, sf_dir):
    return H.with_latest(_repos(spark, sf_dir), _scans(spark, sf_dir))


@query(LATEST + "SELECT state, count(*) AS repos, round(avg(score), 1) AS mean_score, sum(findings)::BIGINT AS findings FROM both_ GROUP BY state")
def dashboard_stats(spark, sf_dir):
    return H.dashboard(_repos(spark, sf_dir), _scans(spark, sf_dir))


@query(SC + "SELECT scan_id, repo_id, status FROM scans JOIN repos USING (repo_id) WHERE owner = 7")
def ownership_join(spark, sf_dir):
    return H.owned(_scans(spark, sf_dir), _repos(spark, sf_dir), 7).select("scan_id", "repo_id", "status")


@query(FIND + f"SELECT scan_id, seq, severity, rule_id FROM findings WHERE severity = 'high' ORDER BY {RANK} DESC, scan_id, seq LIMIT 200")
def report_filter_sort_limit(spark, sf_dir):
    return H.report(_findings(spark, sf_dir), "high").select("scan_id", "seq", "severity", "rule_id")


TREND = SC + ", b AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_id DESC) AS b FROM scans WHERE status = 'completed'), trend AS (SELECT repo_id, scan_id, scan_time, score, row_number() OVER (PARTITION BY repo_id ORDER BY scan_id)::INT AS position FROM b WHERE b <= 20) "


@query(TREND + "SELECT repo_id, scan_id, score, position FROM trend")
def trend_last_n(spark, sf_dir):
    return H.trend(_scans(spark, sf_dir)).drop("scan_time")


@query(TREND + "SELECT repo_id, round(arg_max(score, position) - arg_min(score, position), 4) AS delta FROM trend GROUP BY repo_id")
def trend_delta(spark, sf_dir):
    return H.trend_delta(H.trend(_scans(spark, sf_dir)))


@query(TREND + ", r AS (SELECT *, min(score) OVER (PARTITION BY repo_id) AS lo, max(score) OVER (PARTITION BY repo_id) AS hi FROM trend) SELECT repo_id, position, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END, 6) AS y FROM r")
def sparkline_norm(spark, sf_dir):
    return H.sparkline(H.trend(_scans(spark, sf_dir)))


@query(FIND + ", a AS (SELECT DISTINCT rule_id, file, line FROM findings WHERE scan_id % 2 = 0), b AS (SELECT DISTINCT rule_id, file, line FROM findings WHERE scan_id % 2 = 1) SELECT rule_id, file, line, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT rule_id, file, line, 'fixed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT rule_id, file, line, 'unchanged' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def scan_diff(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    return H.diff(rows.where("scan_id % 2 = 0"), rows.where("scan_id % 2 = 1"), "rule_id", "file", "line")


@query(TREND + ", p AS (SELECT repo_id, scan_id, round(coalesce(score, 0) - coalesce(lag(score) OVER (PARTITION BY repo_id ORDER BY position), 0), 1) AS change FROM trend) SELECT *, CASE WHEN change > 0 THEN 'improved' WHEN change < 0 THEN 'declined' ELSE 'unchanged' END AS label FROM p")
def score_delta(spark, sf_dir):
    from pyspark.sql import Window

    rows = H.trend(_scans(spark, sf_dir))
    change, label = H.score_change(F.lag("score").over(Window.partitionBy("repo_id").orderBy("position")), F.col("score"))
    return rows.select("repo_id", "scan_id", change.alias("change")).withColumn("label", F.when(F.col("change") > 0, "improved").when(F.col("change") < 0, "declined").otherwise("unchanged"))


@query(SC + "SELECT scan_id, repo_id, epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(scan_time) > 900 AS stuck FROM scans WHERE status NOT IN ('completed', 'failed')")
def not_in_running(spark, sf_dir):
    return H.running(_scans(spark, sf_dir), F.lit("1998-08-02 00:00:00").cast("timestamp")).select("scan_id", "repo_id", "stuck")


@query(SC + "SELECT repo_id, name FROM repos WHERE repo_id IN (SELECT repo_id FROM scans)")
def existence_lookup(spark, sf_dir):
    return H.known(_repos(spark, sf_dir), _scans(spark, sf_dir), ["repo_id"]).select("repo_id", "name")


@query(SC + "SELECT scan_id, repo_id FROM scans WHERE repo_id NOT IN (SELECT repo_id FROM repos WHERE owner < 5)")
def cascade_delete(spark, sf_dir):
    return H.without_repo(_scans(spark, sf_dir), _repos(spark, sf_dir).where("owner < 5").select("repo_id")).select("scan_id", "repo_id")


@query(FIND + "SELECT scan_id, package_name, coalesce(package_version, 'unknown') AS version FROM findings WHERE package_name IS NOT NULL")
def sbom_components(spark, sf_dir):
    return H.components(_findings(spark, sf_dir))


@query(LATEST + ", p AS (SELECT owner, round(avg(score), 2) AS mean_score, count(*) FILTER (score >= 80) AS good, count(*) FILTER (score >= 70) AS passing, count(*) FILTER (score < 50) AS failing, arg_min(repo_id, score * 1000000000 + repo_id) AS worst_repo FROM latest JOIN repos USING (repo_id) GROUP BY owner) SELECT *, CASE WHEN mean_score >= 80 THEN 'good' WHEN mean_score >= 50 THEN 'fair' ELSE 'poor' END AS label FROM p")
def posture(spark, sf_dir):
    return H.posture(H.latest(_scans(spark, sf_dir), "score").join(_repos(spark, sf_dir), "repo_id"), "owner")


@query(SC + "SELECT repo_id, name FROM repos WHERE contains(lower(name), '#00000000')")
def name_search(spark, sf_dir):
    return H.search(_repos(spark, sf_dir), "name", "#00000000").select("repo_id", "name")


@query(FIND + "SELECT severity, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM findings GROUP BY severity")
def severity_share(spark, sf_dir):
    return H.severity_share(_findings(spark, sf_dir))


@query("WITH files AS (SELECT source AS repo, lang AS ext FROM documents), c AS (SELECT repo, ext, count(*) AS n FROM files GROUP BY ALL) SELECT repo, ext AS language, n FROM c QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, ext) = 1")
def language_detect(spark, sf_dir):
    per = load(spark, sf_dir, "files").groupBy("repo", "ext").agg(F.count("*").alias("n"))
    return per.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("n"), "ext")).alias("b")).select("repo", F.col("b.ext").alias("language"), (-F.col("b.n")).alias("n"))


@query("SELECT source AS repo, lang AS ext, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL")
def structure_profile(spark, sf_dir):
    return load(spark, sf_dir, "files").groupBy("repo", "ext").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


# Graphs and streams --------------------------------------------------------------------------------------------------
@query(
    "WITH RECURSIVE edges AS (SELECT DISTINCT l_partkey % 499 AS caller, (l_suppkey * 31 + l_linenumber * 7) % 499 AS callee FROM lineitem), hits AS (SELECT caller AS node, min(callee) AS sink FROM edges WHERE callee >= 490 GROUP BY caller), "
    "walk AS (SELECT DISTINCT caller AS handler, caller AS node, 0 AS depth FROM edges WHERE caller < 5 UNION SELECT w.handler, e.callee, w.depth + 1 FROM walk w JOIN edges e ON w.node = e.caller WHERE w.depth < 5 AND w.node NOT IN (SELECT node FROM hits)), "
    "seen AS (SELECT handler, node, min(depth) AS depth FROM walk GROUP BY ALL) SELECT handler, node, sink, depth FROM seen JOIN hits USING (node)"
)
def taint_walk_edges(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = rows.selectExpr("l_partkey % 499 AS caller", "(l_suppkey * 31 + l_linenumber * 7) % 499 AS callee").distinct()
    handlers = edges.where("caller < 5").select(F.col("caller").alias("node"))
    sinks = edges.where("callee >= 490").select(F.col("callee").alias("node"))
    return graph.taint_walk(edges, handlers, sinks).select("handler", "node", "sink", "depth")


@query("SELECT user_id AS key, epoch_us(date_trunc('hour', ts)) // 1000000 AS start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL")
def rate_limit_windows(spark, sf_dir):
    return W.rate_windows(W.events(spark, sf_dir)).withColumn("start", F.unix_timestamp("start"))


@query("WITH g AS (SELECT user_id AS key, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 900000000, true)::INT AS new FROM events), s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT key, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM s GROUP BY key, k")
def session_timeout(spark, sf_dir):
    return W.sessions(W.events(spark, sf_dir)).select("key", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT user_id AS key, count(*) AS total, epoch_us(max(ts)) // 1000000 AS last_ts FROM events GROUP BY user_id")
def running_totals(spark, sf_dir):
    return W.running_totals(W.events(spark, sf_dir)).withColumn("last_ts", F.unix_timestamp("last_ts"))


@query("SELECT event_id, user_id AS key FROM events WHERE event_type IN ('purchase', 'signup')")
def event_triggers(spark, sf_dir):
    return W.triggers(W.events(spark, sf_dir)).select("event_id", "key")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def event_dedup(spark, sf_dir):
    return W.deduplicated(W.events(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT e.event_id, e.user_id AS key FROM events e JOIN events d ON d.event_type = 'error' AND e.user_id = d.user_id AND e.ts >= d.ts AND e.ts < d.ts + INTERVAL 6 HOUR")
def ttl_denylist(spark, sf_dir):
    rows = W.events(spark, sf_dir)
    return W.denied(rows, rows.where("kind = 'error'").select("key", F.col("ts").alias("denied_at")), 6 * 3600).select("event_id", "key")


QUERIES |= more.QUERIES | graphs.QUERIES | samples.QUERIES
ORACLES |= more.ORACLES | graphs.ORACLES | samples.ORACLES
