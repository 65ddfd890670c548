"""Python sources as syntax trees (T1-T5, T9): calls, taint and missing checks; cross-file rules of scripts.

The call graph over modules (T6-T8) is in :mod:`cindersift.operators.symbols`; the one here goes by bare names.

Trees are what no expression can give, so files go to Python in Arrow batches; a file that doesn't parse gives one row
that says so. Everything after (sinks, severities, graph walk) is expressions and joins.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from functools import cache, partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cindersift.schema import looked_up

#: Where untrusted data comes from (as written in the source) and which calls it must not reach.
SOURCES = ("request.args", "request.form", "request.json", "request.data", "request.get", "request.cookies", "request.headers", "flask.request", "fastapi.Query", "fastapi.Body", "fastapi.Path", "input(", "sys.argv", "os.environ.get")
SINKS = (
    "execute executemany raw raw_query os.system subprocess.run subprocess.call subprocess.Popen subprocess.check_output eval exec compile open os.path.join "
    "render_template_string Template pickle.loads pickle.load requests.get requests.post urllib.request.urlopen"
).split()
#: Words in a sink's name and its class, the first that fits; then the class of all others, and severities.
SINK_CLASSES = (
    ("sqli", "execute query sql db.run"),
    ("command-injection", "system popen exec subprocess"),
    ("path-traversal", "open path.join read"),
    ("template-injection", "template render"),
    ("ssrf", "requests.get requests.post urlopen"),
    ("insecure-deserialization", "pickle"),
)
OTHER_SINK = "taint-source-to-sink"
SINK_SEVERITY = {"sqli": "critical", "command-injection": "critical", "template-injection": "critical", "insecure-deserialization": "critical", "ssrf": "high", "path-traversal": "high", "taint-source-to-sink": "medium"}
#: Fixed values of the semantic rules: severity, confidence, exploitability, blast radius.
SEMANTIC = {
    "subprocess-shell-true": ("high", 0.90, 0.75, 9),
    "weak-hash": ("high", 0.95, 0.55, 4),
    "yaml-load-no-loader": ("critical", 0.98, 0.80, 9),
    "taint": (None, 0.75, 0.70, 7),
    "hardcoded-arg-in-auth-call": ("high", 0.60, 0.65, 7),
    "missing-auth-check": ("high", 0.55, 0.60, 6),
}
#: Calls that start a shell, weak hashes, words of calls that take credentials, and of handlers that write, check or change.
SHELL_CALLS = ("subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output", "subprocess.check_call")
WEAK_HASHES = ("hashlib.md5", "hashlib.sha1", "md5", "sha1")
CREDENTIAL_CALLS = ("connect", "login", "auth", "password", "secret")
WRITES = ("db.add", "db.commit", "save(", "create(", "update(")
CHECKS = ("verify_token", "check_permission", "is_admin", "require_auth")
CHANGES = ("create", "update", "delete", "modify", "post", "put", "patch")
#: Fixed values of the cross-file rules of scripts, the first that fits: id, pattern, severity, confidence, exploitability, blast radius.
CROSS_FILE = (
    ("l5/js-require-then-sql", r"""(?s)require\s*\(["']([^"']+)["']\)\s*[;\n].{0,500}(execute|query|db\.run|pool\.query)""", "high", 0.55, 0.60, 7),
    ("l5/js-route-handler-audit", r"(?m)(app|router)\.(use|get|post|put|delete)\s*\([^)]+\)", "info", 0.40, 0.20, 3),
    ("l5/js-exported-sink", r"(?s)(module\.exports|export\s+default|export\s+const)\s+\w+[^{]*\{[^}]*(execute|query|exec|spawn)", "medium", 0.55, 0.50, 6),
)
SCRIPTS = (".js", ".ts", ".jsx", ".tsx")
#: What makes a function a handler.
HANDLER_DECORATORS = ("route", "get", "post", "put", "delete", "patch")
HANDLER_ARGUMENTS = ("request", "req", "r")
SCHEMA = "file string, kind string, name string, line int, caller string, detail string"


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _is_source(node: ast.AST, tainted: set[str]) -> bool:
    """Whether an expression is, or is built of, a tainted name or a source."""
    for n in ast.walk(node):
        if isinstance(n, ast.Name) and n.id in tainted:
            return True
        if isinstance(n, (ast.Attribute, ast.Call)):
            text = ast.unparse(n)
            if any(source in text for source in SOURCES):
                return True
    return False


def _sink(name: str) -> str | None:
    if name not in SINKS and name.rpartition(".")[2] not in [x for x in SINKS if "." not in x]:
        return None
    return next((kind for kind, words in SINK_CLASSES if any(w in name.lower() for w in words.split())), OTHER_SINK)


def semantic(source: str) -> Iterator[tuple[str, int, str]]:
    """(rule, line, name) of a source, in the order of its tree: T1-T5. Taint goes through assignments, file-wide."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    tainted: set[str] = set()
    waiting: list[ast.AST] = [tree]
    while waiting:
        n = waiting.pop()
        if isinstance(n, ast.Assign) and _is_source(n.value, tainted):
            tainted |= {t.id for t in n.targets if isinstance(t, ast.Name)}
        elif isinstance(n, ast.Call):
            name = _dotted(n.func)
            keywords = {k.arg: k.value for k in n.keywords}
            shell = keywords.get("shell")
            if name in SHELL_CALLS and isinstance(shell, ast.Constant) and shell.value is True:
                yield "subprocess-shell-true", n.lineno, name
            if name in WEAK_HASHES:
                yield "weak-hash", n.lineno, name
            if name == "yaml.load" and "Loader" not in keywords:
                yield "yaml-load-no-loader", n.lineno, name
            if (sink := _sink(name)) and any(_is_source(a, tainted) for a in [*n.args, *keywords.values()]):
                yield f"taint-{sink}", n.lineno, name
            if any(w in name.lower() for w in CREDENTIAL_CALLS) and any(isinstance(a, ast.Constant) and isinstance(a.value, str) and len(a.value) >= 8 for a in n.args):
                yield "hardcoded-arg-in-auth-call", n.lineno, name
        elif isinstance(n, ast.FunctionDef) and any(w in n.name.lower() for w in CHANGES):
            calls = "\n".join(ast.unparse(c) for c in ast.walk(n) if isinstance(c, ast.Call))
            if any(w in calls for w in WRITES) and not any(w in calls for w in CHECKS):
                yield "missing-auth-check", n.lineno, n.name
        waiting += reversed(list(ast.iter_child_nodes(n)))


#: Fixed values of the legacy tree scan (T9): what the semantic rules are called there, and severities.
LEGACY_TREE = {"subprocess-shell-true": ("native/subprocess-shell-true", "high"), "weak-hash": ("native/weak-hash-algorithm", "high"), "yaml-load-no-loader": ("native/yaml-load-unsafe", "critical"), "bare-except-pass": ("native/bare-except-pass", "low")}


def legacy_semantic(source: str) -> Iterator[tuple[str, int, str]]:
    """(rule, line, name) of the legacy tree scan: three of the semantic rules, and handlers that swallow every exception."""
    yield from ((rule, line, name) for rule, line, name in semantic(source) if rule in LEGACY_TREE)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    for n in ast.walk(tree):
        if isinstance(n, ast.ExceptHandler) and n.type is None and len(n.body) == 1 and isinstance(n.body[0], ast.Pass):
            yield "bare-except-pass", n.lineno, "except"


FOUND = "repo string, file string, line int, rule_id string, severity string, issue string, matched string, exploitability double, blast_radius int, confidence double, cwe_id string, layer int"


def _found(kinds: tuple[bool, ...]):
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in FOUND.split(", ")])
        for b in batches:
            rows = []
            # Equal contents of a batch, as empty or copied modules are, are parsed once.
            met = cache(lambda content: [(k, x) for k in kinds for x in (legacy_semantic if k else semantic)(content)])
            for repo, file, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                told = met(content or "")
                lines = (content or "").split("\n") if told else []
                for legacy, (rule, line, name) in told:
                    snippet = lines[line - 1].strip()[:200] if 0 < line <= len(lines) else ""
                    issue = f"{rule.replace('-', ' ')}: {name}"
                    if legacy:  # a detector that knows none of these
                        rows.append((repo, file, line, LEGACY_TREE[rule][0], LEGACY_TREE[rule][1], issue, snippet, 0.5, 1, 0.8, None, 1))
                        continue
                    severity, sure, exploit, blast = SEMANTIC["taint" if rule.startswith("taint-") else rule]
                    rows.append((repo, file, line, f"l2/{rule}", severity or SINK_SEVERITY[rule.removeprefix("taint-")], issue, snippet, exploit, blast, sure, None, 2))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return found


def findings(files: DataFrame, *, legacy: bool | None = False) -> DataFrame:
    """T1-T5, or T9 (legacy), or both (None): findings of Python files (repo, file, content) by their syntax trees; a file that doesn't parse has none."""
    return files.select("repo", "file", "content").mapInArrow(_found((False, True) if legacy is None else (legacy,)), FOUND)


def _matches(pattern: str, line: Column) -> Column:
    return F.rlike(line, F.lit(pattern))


def script_findings(files: DataFrame) -> DataFrame:
    """Of each script the first cross-file rule that its content matches, at the first line that matches alone, else line 1."""
    lines = F.split("content", "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]")
    hit = None
    for rule, pattern, severity, sure, exploit, blast in CROSS_FILE:
        at = F.array_position(F.transform(lines, partial(_matches, pattern)), True)
        one = F.struct(F.greatest(at, F.lit(1)).cast("int").alias("line"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(rule.rpartition("/")[2].replace("-", " ")).alias("issue"), F.lit("").alias("matched"), F.lit(exploit).alias("exploitability"), F.lit(blast).alias("blast_radius"), F.lit(sure).alias("confidence"), F.lit(None).cast("string").alias("cwe_id"), F.lit(5).alias("layer"))
        there = F.rlike("content", F.lit(pattern))
        hit = F.when(there, one) if hit is None else hit.when(there, one)
    return files.select("repo", "file", hit.alias("x")).where("x is not null").select("repo", "file", "x.*")


def facts(source: str) -> Iterator[tuple[str, str, int, str, str]]:
    """(kind, name, line, caller, detail) of a source: functions, calls, and calls that get tainted arguments."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "error", type(e).__name__, getattr(e, "lineno", 0) or 0, "", str(e)[:200]
        return
    for fn in [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]:
        decorators = {_dotted(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2] for d in fn.decorator_list}
        arguments = {a.arg for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]}
        handler = bool(decorators & set(HANDLER_DECORATORS) or arguments & set(HANDLER_ARGUMENTS))
        yield "handler" if handler else "function", fn.name, fn.lineno, "", ""
        tainted = set(arguments & set(HANDLER_ARGUMENTS))
        nodes = sorted((n for n in ast.walk(fn) if hasattr(n, "lineno") and n is not fn), key=lambda n: (n.lineno, n.col_offset))
        for n in nodes:
            if isinstance(n, ast.Assign) and _is_source(n.value, tainted):
                tainted |= {t.id for t in ast.walk(ast.Tuple(n.targets, ast.Store())) if isinstance(t, ast.Name)}
        for n in nodes:
            if isinstance(n, ast.Call):
                name = _dotted(n.func)
                if not name:
                    continue
                yield "call", name, n.lineno, fn.name, ",".join(k.arg or "**" for k in n.keywords)
                if any(_is_source(a, tainted) for a in [*n.args, *[k.value for k in n.keywords]]):
                    yield "tainted", name, n.lineno, fn.name, ""
                if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords):
                    yield "shell", name, n.lineno, fn.name, ""
                if any(w in name.lower() for w in ("connect", "login", "auth", "password", "secret")) and any(isinstance(a, ast.Constant) and isinstance(a.value, str) and len(a.value) >= 8 for a in n.args):
                    yield "hardcoded", name, n.lineno, fn.name, ""


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    for b in batches:
        rows = [(f, *x) for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in facts(s or "")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


def parsed(files: DataFrame) -> DataFrame:
    """Facts of all Python files (file, content)."""
    return files.select(F.col("file").cast("string"), "content").mapInArrow(_parsed, SCHEMA)


def sink_class(name: Column) -> Column:
    """What a called name is a sink for, by its full dotted name or its last part where the sink has one; null if none."""
    kind = None
    for k, words in SINK_CLASSES:
        hit = reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in words.split()])
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
    sink = name.isin(*SINKS) | F.substring_index(name, ".", -1).isin(*[n for n in SINKS if "." not in n])
    return F.when(sink, kind.otherwise(OTHER_SINK))


def tainted_sinks(rows: DataFrame) -> DataFrame:
    """Calls of a sink with tainted arguments."""
    found = rows.where("kind = 'tainted'").withColumn("rule", sink_class(F.col("name"))).where("rule is not null")
    return found.select("file", "line", "caller", F.concat(F.lit("l2/taint-"), F.col("rule")).alias("rule_id"), looked_up(F.col("rule"), SINK_SEVERITY, "medium").alias("severity"))


def call_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (caller, callee), handlers (node) and sinks (node), by bare name as calls across files give it."""
    defined = rows.where("kind in ('function', 'handler')").select(F.col("name").alias("callee")).distinct()
    calls = rows.where("kind = 'call'").select("caller", "name")
    inner = calls.select("caller", F.substring_index("name", ".", -1).alias("callee")).join(defined, "callee", "left_semi").select("caller", "callee")
    outer = calls.where(sink_class(F.col("name")).isNotNull()).select("caller", F.col("name").alias("callee"))
    return inner.unionByName(outer).distinct(), rows.where("kind = 'handler'").select(F.col("name").alias("node")).distinct(), outer.select(F.col("callee").alias("node")).distinct()
