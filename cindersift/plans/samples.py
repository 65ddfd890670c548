"""A file for every rule of every pack, and what another engine's matcher says of it.

Samples are made from the patterns themselves: for each rule a text that its pattern matches (by its first, and by its last
alternatives) and one with its needed texts broken. What each must give is worked out here with Python's matcher, line by line,
from the plain statement of which pack looks at which file; the query runs the scan, whose matcher is Java's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from cindersift.operators import packs, rules, surface
from cindersift.plans import scan
from cindersift.storage import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SLASHES, HASH, IAC = ("//", "/*", "*"), ("#",), ("#", "//", "/*", "<!--")
#: Pack, the file its samples stand in, and what their first line must be.
PLACES = (
    (surface.SURFACE, "s.txt", ""), (packs.SCRIPT, "a.js", ""), (packs.JAVA, "A.java", ""), (packs.GO, "a.go", ""), (packs.CRYPTO, "a.py", ""), (packs.DOCKERFILE, "Dockerfile", ""), (packs.COMPOSE, "docker-compose.yml", ""),
    (packs.KUBERNETES, "pod.yaml", "kind: Pod\n"), (packs.WORKFLOWS, "ci.yml", "runs-on: x\n"), (packs.TERRAFORM, "main.tf", ""), (surface.LEGACY, "b.py", ""),
)
WHOLE = {"docker-compose": "docker-compose.yml", "docker": "Dockerfile", "k8s": "pod.yaml", "tf": "main.tf"}


def matching(pattern: str, last: bool) -> str:
    """A text that a pattern matches, by its first or its last alternatives; look-arounds are not looked at."""

    def made(parsed) -> str:
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name in ("ANY", "NOT_LITERAL"):
                out += "x" if name == "ANY" or arg != ord("x") else "y"
            elif name == "IN":
                out += chosen(arg)
            elif name == "BRANCH":
                out += made(arg[1][-1 if last else 0])
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                free, kind = arg[0] == 0 < arg[1], str(arg[2][0][0]) if len(arg[2]) == 1 else ""
                # Where anything may stand, a blank keeps words apart.
                out += " " if free and kind == "ANY" else made(arg[2]) * (1 if free and kind == "IN" and last else arg[0])
        return out

    def chosen(items) -> str:
        # Of the characters that a class takes, a letter or digit if there is one.
        one = re.compile("[" + "".join(shown(x) for x in items) + "]")
        return next(c for c in "a1Ax" + "".join(map(chr, range(32, 127))) if one.match(c))

    def shown(item) -> str:
        name, arg = str(item[0]), item[1]
        if name == "NEGATE":
            return "^"
        if name == "RANGE":
            return re.escape(chr(arg[0])) + "-" + re.escape(chr(arg[1]))
        return re.escape(chr(arg)) if name == "LITERAL" else {"CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S", "CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w"}[str(arg)]

    return made(re._parser.parse(pattern))


def _samples() -> list[tuple[str, str]]:
    rows: list[tuple[str, str]] = []
    for last in (False, True):
        for pack, file, first in PLACES:
            for r in pack:
                line = matching(r.pattern, last)
                # A line that would be a comment, or a word that would go on, stands behind something else.
                rows.append((file, first + ("z " if line.startswith(("#", "//", "*")) else "") + line))
        for r in surface.LEGACY_FILES:
            rows.append((next(f for k, f in WHOLE.items() if k in r.rule_id), matching(r.pattern, last)))
    for pack, file, first in PLACES:
        for r in pack:
            rows.append((file, first + matching(r.pattern, False)[::-1]))
    return [(f, c) for f, c in dict.fromkeys(rows) if c]


def expected(file: str, content: str) -> set[str]:
    """The rules that a file gives, by Python's matcher."""
    ext = "." + file.rpartition(".")[2] if "." in file else ""
    yaml = ext in (".yml", ".yaml") and not file.startswith(("Dockerfile", "docker-compose"))
    cluster = any(t in content for t in ("apiVersion:", "kind: Pod", "kind: Deployment", "kind: Service"))
    looked = [
        (surface.SURFACE, True, (*HASH, *SLASHES, "<!--")), (packs.SCRIPT, ext in (".js", ".ts", ".jsx", ".tsx"), SLASHES), (packs.JAVA, ext == ".java", SLASHES), (packs.GO, ext == ".go", ("//",)), (packs.CRYPTO, ext in packs.CODE, (*HASH, *SLASHES)),
        (packs.DOCKERFILE, file.startswith("Dockerfile"), IAC), (packs.COMPOSE, file.startswith("docker-compose."), IAC), (packs.KUBERNETES, yaml and cluster, IAC), (packs.WORKFLOWS, yaml and "runs-on" in content, IAC), (packs.TERRAFORM, ext == ".tf", IAC),
        (surface.LEGACY, ext in surface.LEGACY_CODE, (*HASH, *SLASHES, "<!--")),
    ]
    found = set()
    for pack, here, starts in looked:
        for r in pack if here else ():
            hits = [m for x in content.splitlines() if not x.strip().startswith(starts) and (m := re.search(r.pattern, x))]
            if r.rule_id == "l3/pbkdf2-low-iterations":
                hits = [m for m in hits if int(m[1]) < 100_000]
            found |= {r.rule_id} if hits else set()
    if file in ("Dockerfile", "docker-compose.yml", "docker-compose.yaml") or ext in (".tf", ".yml", ".yaml"):
        found |= {r.rule_id for r in surface.LEGACY_FILES if re.search(r.pattern, content) and not (r.absent and re.search(r.absent, content))}
    return found


SAMPLES = _samples()
_EXPECTED = ", ".join(f"({i}, '{rule}')" for i, (f, c) in enumerate(SAMPLES) for rule in sorted(expected(f, c)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file, content): a sample for every row of ``part``, in a folder of its own."""
    names, contents = (F.array(*map(F.lit, x)) for x in zip(*SAMPLES))
    at = (F.col("p_partkey") % len(SAMPLES) + 1).cast("int")
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    rows = rows.select("p_partkey", F.element_at(names, at).alias("name"), F.element_at(contents, at).alias("content"))
    return rows.select(F.concat(F.lit("r"), (F.col("p_partkey") % 10).cast("string")).alias("repo"), F.concat_ws("/", F.col("p_partkey").cast("string"), "name").alias("file"), "content")


def rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3, R6-R8, R10, R12, R13 through the scan itself: files that each rule of every pack finds."""
    found = scan.detected(files(spark, sf_dir), layers={k: scan.LAYERS[k] for k in ("line rules", "whole rules")})
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_SEVERITY = ", ".join(f"('{r.rule_id}', '{'high' if r.rule_id == 'l3/pbkdf2-low-iterations' else r.severity}')" for r in (*(r for pack, _, _ in PLACES for r in pack), *surface.LEGACY_FILES))
QUERIES["rule_samples"] = rule_samples
ORACLES["rule_samples"] = f"WITH e AS (SELECT * FROM (VALUES {_EXPECTED}) v(sample, rule_id)), s AS (SELECT * FROM (VALUES {_SEVERITY}) v(rule_id, severity)) SELECT rule_id, severity, count(*) AS n FROM part JOIN e ON p_partkey % {len(SAMPLES)} = sample JOIN s USING (rule_id) GROUP BY ALL"


#: Small projects and every finding (file, layer, rule) that a scan of each must give, worked out by hand.
PROJECTS = (
    (
        (("app/views.py", "from app.store import put\n\ndef get(request):\n    put(request)\n"), ("app/store.py", "import os\n\ndef put(x):\n    os.system(x)\n")),
        (("app/store.py", 1, "l1/os-system"), ("app/store.py", 1, "l1/ruby-system-exec"), ("app/store.py", 1, "native/os-system-injection"), ("app/store.py", 5, "l5/cross-file-taint-system")),
    ),
    ((("requirements.txt", "django==3.2.19\nreqests\n"),), (("requirements.txt", 4, "l4/cve-cve202343665"), ("requirements.txt", 4, "l4/typosquat"), ("requirements.txt", 4, "l4/unpinned-dependency"))),
    ((("web/a.js", "const db = require('./db');\nconst f = (x) => db.query(x)\n"),), (("web/a.js", 5, "l5/js-require-then-sql"),)),
    ((("Dockerfile", "FROM python:latest\nUSER root\n"),), (("Dockerfile", 6, "l6/docker-latest-tag"), ("Dockerfile", 6, "l6/docker-root-user"), ("Dockerfile", 6, "native/docker-latest-tag"), ("Dockerfile", 6, "native/docker-run-as-root"))),
    ((("k.txt", 'token = "x9K2mPq7RtY4wZ8nB3vC6dF1gH5jL0sQ"\n'),), (("k.txt", 3, "l3/high-entropy-secret"),)),
    ((("run.py", "import subprocess\nsubprocess.run(x, shell=True)\n"),), (("run.py", 1, "l1/os-system"), ("run.py", 1, "l1/py-subprocess-shell-cmd"), ("run.py", 1, "native/os-system-injection"), ("run.py", 1, "native/subprocess-shell-true"), ("run.py", 2, "l2/subprocess-shell-true"))),
    ((("c.go", "cipher := RC4\n"),), (("c.go", 1, "l1/rc4-usage"), ("c.go", 3, "l3/rc4"))),
    ((("notes.txt", "nothing here\n"), ("ok/a.py", "def get(request):\n    return 1\n")), ()),
)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file, content): a project for every row of ``part``."""
    every = F.array(*[F.array(*[F.struct(F.lit(f).alias("file"), F.lit(c).alias("content")) for f, c in own]) for own, _ in PROJECTS])
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    rows = rows.select(F.col("p_partkey").cast("string").alias("repo"), (F.col("p_partkey") % len(PROJECTS) + 1).cast("int").alias("at"))
    return rows.select("repo", F.inline(F.element_at(every, F.col("at"))))


def layered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of whole projects, findings by layer and rule."""
    return scan.detected(projects(spark, sf_dir)).groupBy("layer", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


_FOUND = ", ".join(f"({i}, '{f}', {layer}, '{rule}')" for i, (_, found) in enumerate(PROJECTS) for f, layer, rule in found)
QUERIES["layered_scan"] = layered_scan
ORACLES["layered_scan"] = f"SELECT layer, rule_id, count(*) AS n, count(DISTINCT p_partkey) AS repos FROM part JOIN (VALUES {_FOUND}) v(project, file, layer, rule_id) ON p_partkey % {len(PROJECTS)} = project GROUP BY ALL"
