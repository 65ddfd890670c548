"""Registered queries over generated modules: the call graph across files, with the recursive SQL that says the same.

The modules are made of the rows of ``part``: FUNCTIONS rows make a repository of MODULES files, a row a function. Functions of
several modules share a name, calls go over absolute, relative and aliased imports, cycles occur, and which functions are
handlers and call something dangerous comes from the rows' sizes. A call deeper in its expression than the dangerous one comes after it,
and a walk doesn't take it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cindersift.operators import symbols

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FUNCTIONS, MODULES = 40, 5
#: What a function calls, by a row's size: the dangerous ones, and harmless names that end alike.
CALLS = ("os.system(x)", "pickle.loads(x)", "cursor.execute(x)", "store.system(x)", "x.get(1)", "plain(x)")
ENDS = ("system", "loads", "execute", None, None, None)
DEEP = 8


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file, content): Python modules made of the rows of ``part``."""
    i, other = "CAST(p_partkey % 40 AS INT)", "CAST((p_partkey % 40 + 7) % 40 AS INT)"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST(p_partkey div 40 AS STRING) AS repo", f"{i} AS i", f"{other} AS j", "p_size")
    said = F.element_at(F.array(*map(F.lit, CALLS)), (F.col("p_size") % len(CALLS) + 1).cast("int"))
    name = lambda c: F.concat(F.lit("run"), F.floor(F.col(c) / MODULES).cast("string"))
    module = lambda c: F.concat(F.lit("m"), (F.col(c) % MODULES).cast("string"))
    argument = F.when(F.col("p_size") % 11 == 0, "request").otherwise("x")
    # One way to import the called function for each remainder.
    way = F.col("i") % 4
    imports = F.when(way == 0, F.concat(F.lit("    from pkg."), module("j"), F.lit(" import "), name("j"), F.lit(" as step\n    step(x)\n")))
    imports = imports.when(way == 1, F.concat(F.lit("    from ."), module("j"), F.lit(" import "), name("j"), F.lit(" as hop\n    y = [hop(n) for n in x]\n")))
    imports = imports.when(way == 2, F.concat(F.lit("    import pkg."), module("j"), F.lit("\n    pkg."), module("j"), F.lit("."), name("j"), F.lit("(x)\n")))
    imports = imports.otherwise(F.concat(F.lit("    from pkg import "), module("j"), F.lit(" as other\n    other."), name("j"), F.lit("(x)\n")))
    text = F.concat(F.lit("def "), name("i"), F.lit("("), argument, F.lit("):\n"), imports, F.lit("    "), said, F.lit("\n\n"))
    files = rows.select("repo", module("i").alias("m"), F.struct("i", text.alias("text")).alias("f")).groupBy("repo", "m").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return files.select("repo", F.concat(F.lit("src/pkg/"), F.col("m"), F.lit(".py")).alias("file"), F.array_join(F.transform("f", lambda x: x["text"]), "").alias("content"))


def _taint_sql(depth: int) -> str:
    kinds = " ".join(f"WHEN {n} THEN '{e}'" for n, e in enumerate(ENDS) if e)
    return f"""
WITH RECURSIVE f AS (SELECT p_partkey // 40 AS repo, p_partkey % 40 AS i, (p_partkey % 40 + 7) % 40 AS j, p_size % 11 = 0 AS handler, CASE p_size % {len(CALLS)} {kinds} END AS sink FROM part),
n AS (SELECT f.*, 1 + coalesce(sum(5) OVER (PARTITION BY repo, i % {MODULES} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM f),
w AS (SELECT repo, i, 0 AS depth FROM n WHERE handler UNION SELECT w.repo, n.j, w.depth + 1 FROM w JOIN n ON n.repo = w.repo AND n.i = w.i WHERE w.depth < {depth} AND NOT (n.i % 4 = 1 AND n.sink IS NOT NULL) AND EXISTS (SELECT 1 FROM f WHERE f.repo = n.repo AND f.i = n.j))
SELECT CAST(n.repo AS VARCHAR) AS repo, 'src/pkg/m' || (n.i % {MODULES}) || '.py' AS file, n.line::INT AS line, 'l5/cross-file-taint-' || n.sink AS rule_id, min(w.depth)::INT AS depth,
  round(greatest(0.40, 0.75 - 0.10 * min(w.depth)), 4)::DOUBLE AS confidence, round(0.65 - 0.08 * min(w.depth), 4)::DOUBLE AS exploitability
FROM w JOIN n ON n.repo = w.repo AND n.i = w.i WHERE n.sink IS NOT NULL GROUP BY n.repo, n.i, n.line, n.sink
"""


def _taint(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    return symbols.findings(modules(spark, sf_dir), depth=depth).select("repo", "file", "line", "rule_id", "depth", "confidence", "exploitability")


@query(_taint_sql(symbols.DEPTH))
def cross_file_taint(spark, sf_dir):
    """T6-T8 on source files: what requests reach over at most five calls."""
    return _taint(spark, sf_dir, symbols.DEPTH)


@query(_taint_sql(DEEP))
def cross_file_taint_deep(spark, sf_dir):
    """The same over at most eight calls, beyond the depth of the scan."""
    return _taint(spark, sf_dir, DEEP)
