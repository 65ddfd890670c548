"""Cross-file taint of Python sources (T6-T8): a symbol table over modules, imports resolved by joins, a bounded walk.

A file's syntax tree gives facts: its functions by qualified name, with line and whether requests reach them; its imports,
relative ones made absolute; and each function's calls in order. A call of a name of the same file is settled there, by
scope. All others are settled by equi-joins on the symbol table: a dotted target is cut at every dot into module and name,
modules are known by every ending of their path (``src/app/db.py`` is ``src.app.db``, ``app.db`` and ``db``), and names that a
module only passes on (``from .impl import f``, stars too) are followed for HOPS imports. A bare name that neither scope nor
imports explain means the repository's last function of that name.

A walk from handlers then reaches functions over at most DEPTH calls; those before a function's first dangerous call count, as
the walk ends there. Nodes are functions of files, so functions of one name in several modules stay apart.

Defined results: files that don't parse, or have no path or no repository, give nothing; a file given twice counts once; null contents are empty; calls of what no
table knows end there; a class stands for its ``__init__``; a tie between modules goes to the shorter path, then the first by name.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cindersift.operators.graph import confidence, exploitability, reached, shuffled as _shuffled
from cindersift.schema import looked_up
from cindersift.storage import dropped, written

DEPTH, HOPS, BLAST = 5, 3, 8
#: What makes a function a handler (texts in its decorators, names of its arguments).
HANDLER_DECORATORS = ("route", "get", "post", "put", "delete", "patch")
HANDLER_ARGUMENTS = ("request", "req", "r")
#: Dangerous calls, and texts in their names with the severity, the first that fits; medium without any.
SINKS = (
    "execute", "executemany", "raw", "raw_query", "cursor.execute",
    "os.system", "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output",
    "eval", "exec",
    "send_file", "send_from_directory", "shutil.copy", "shutil.move",
    "render_template_string",
    "pickle.loads", "yaml.load",
    "requests.get", "requests.post", "urllib.request.urlopen", "httpx.get",
)
SEVERITIES = (("execute raw_query sql system subprocess exec popen pickle template_string yaml.load", "critical"), ("requests urlopen httpx open send_file", "high"))
FACTS = pa.schema([("repo", pa.string()), ("file", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("at", pa.int32()), ("text", pa.string()), ("target", pa.string()), ("handler", pa.bool_())])
_FACTS = "repo string, file string, kind string, name string, line int, at int, text string, target string, handler boolean"


def severity(sink: str) -> str:
    return next((s for words, s in SEVERITIES if any(w in sink for w in words.split())), "medium")


def module_of(file: str) -> str:
    parts = [p for p in file.removesuffix(".py").split("/") if p not in ("", ".")]
    return ".".join(parts[:-1] if parts and parts[-1] == "__init__" else parts)


def _dotted(node: ast.AST) -> str:
    """A called name; what isn't a plain chain of names begins with a question mark, so that no symbol fits it."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "?")
    return ".".join(reversed(parts))


def _imports(nodes: Iterable[ast.AST], package: list[str]) -> list[tuple[str, str]]:
    """(local name, absolute target) of import statements; a star is its own local name."""
    out = []
    for n in nodes:
        if isinstance(n, ast.Import):
            out += [(a.asname, a.name) if a.asname else (a.name.partition(".")[0], a.name.partition(".")[0]) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            base = package[: len(package) - n.level + 1] if n.level else []
            source = ".".join([*base, *([n.module] if n.module else [])])
            out += [(a.asname or a.name, source if a.name == "*" else f"{source}.{a.name}" if source else a.name) for a in n.names]
    return out


def facts(file: str, source: str) -> Iterator[tuple[str, str, int, int, str | None, str | None, bool]]:
    """(kind, name, line, at, text, target, handler) of a source. Kinds: module, alias (an import), function, class, call.

    Of a call, ``name`` is the calling function, ``at`` its place there, ``text`` the settled function of this file, and
    ``target`` the called name as it stands, or absolute where an import explains its beginning.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    module = module_of(file)
    package = module.split(".") if file.endswith("__init__.py") else module.split(".")[:-1]
    yield "module", module, 0, 0, None, None, False
    functions: list[tuple[str, ast.AST, str | None]] = []
    classes: set[str] = set()
    waiting: list[tuple[ast.AST, tuple[str, ...], str | None]] = [(tree, (), None)]
    while waiting:
        node, scope, owner = waiting.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = ".".join((*scope, child.name))
                functions.append((name, child, owner))
                waiting.append((child, (*scope, child.name), owner))
            elif isinstance(child, ast.ClassDef):
                name = ".".join((*scope, child.name))
                classes.add(name)
                waiting.append((child, (*scope, child.name), name))
            else:
                waiting.append((child, scope, owner))
    known = {name for name, _, _ in functions}
    outer = _imports(ast.walk(tree), package)
    for local, target in dict(outer).items():
        yield "alias", local, 0, 0, None, target, False
    stars = [t for a, t in outer if a == "*"]

    def settled(name: str) -> str | None:
        if name in known:
            return name
        return f"{name}.__init__" if name in classes and f"{name}.__init__" in known else None

    for name in sorted(classes):
        yield "class", name, 0, 0, settled(name), None, False
    for name, fn, owner in functions:
        named = any(any(w in ast.unparse(d) for w in HANDLER_DECORATORS) for d in fn.decorator_list)
        handler = named or any(a.arg in HANDLER_ARGUMENTS for a in fn.args.args)
        yield "function", name, fn.lineno, 0, name, None, handler
        inner = [n for n in ast.walk(fn) if isinstance(n, (ast.Import, ast.ImportFrom))]
        aliases = dict(outer) | dict(_imports(inner, package))
        scopes = [p for i in range(len(name.split(".")), -1, -1) if (p := ".".join(name.split(".")[:i])) not in classes]
        own = {a for a, _ in _imports(inner, package)}
        for at, call in enumerate(n for n in ast.walk(fn) if isinstance(n, ast.Call)):
            called = _dotted(call.func)
            head, _, rest = called.partition(".")
            if head in ("self", "cls") and owner and rest:
                text = settled(f"{owner}.{rest}")
            elif head in own:
                text = None
            else:
                text = next((s for p in scopes if (s := settled(f"{p}.{called}" if p else called))), None)
            target = ".".join(x for x in (aliases.get(head, head), rest) if x) if text is None else called
            if text is None and head not in aliases and "." not in called and len(stars) == 1:
                target = f"{stars[0]}.{called}"
            yield "call", name, call.lineno, at, text, target, False


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # Equal files of a batch, of one path in several repositories, are parsed once.
        met = cache(lambda file, source: list(facts(file, source)))
        rows = [(repo, file, *x) for repo, file, source in zip(*(c.to_pylist() for c in b.columns)) for x in met(file or "", source or "")]
        for lo in range(0, len(rows), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 65536]), FACTS)], schema=FACTS)


def _resolved(targets: DataFrame, modules: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(repo, target, file, callee) of distinct dotted targets (repo, target)."""
    found, left = [], targets.select("repo", "target", F.col("target").alias("now"))
    for hop in range(HOPS + 1):
        parts = F.split("now", r"\.")
        # Every cut between module and name.
        cut = left.select("*", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
        cut = cut.select("repo", "target", "now", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), ".").alias("module"), F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), ".").alias("symbol"))
        met = written(cut.join(_shuffled(modules), ["repo", "module"]).select("repo", "target", "k", "file", "symbol"), "imports")
        hit = met.join(_shuffled(symbols), ["repo", "file", "symbol"]).groupBy("repo", "target").agg(F.max(F.struct("k", "file", "callee")).alias("m")).select("repo", "target", "m.file", "m.callee")
        hit = written(hit, "resolved")
        found.append(hit)
        if hop == HOPS:
            break
        passed = met.join(_shuffled(hit.select("repo", "target")), ["repo", "target"], "left_anti").withColumn("head", F.substring_index("symbol", ".", 1))
        named = passed.join(_shuffled(aliases.where("head <> '*'")), ["repo", "file", "head"])
        rest = F.expr("substring(symbol, length(head) + 2)")
        named = named.select("repo", "target", "k", F.when(rest != "", F.concat_ws(".", "onto", rest)).otherwise(F.col("onto")).alias("now"))
        starred = passed.join(_shuffled(aliases.where("head = '*'").drop("head")), ["repo", "file"]).select("repo", "target", "k", F.concat_ws(".", "onto", "symbol").alias("now"))
        left = written(named.unionByName(starred).groupBy("repo", "target").agg(F.max(F.struct("k", "now")).alias("m")).select("repo", "target", "m.now").where(F.contains("now", F.lit("."))), "passed")
        if left.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["repo", "target"])


def sink_of(called: Column, *, strict: bool = False) -> Column:
    """The dangerous call that a called name is, null if none: its full dotted name, or its last part where the sink has one part.

    Strict: any dotted name that ends with a sink's last part, the first in the order of the table.
    """
    last, dotted = F.substring_index(called, ".", -1), F.contains(called, F.lit("."))
    out = None
    for s in SINKS:
        end = s.rpartition(".")[2]
        if strict:
            hit = (F.lower(called) == s.lower()) & F.endswith(called, F.lit(end)) | (dotted & (last == end))
        else:
            hit = called == s if "." in s else last == s
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out


def call_graph(files: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, repo, file, name, line, handler), edges (caller, callee) and first dangerous calls (node, sink, called) of files (repo, file, content)."""
    said = files.select(F.col("repo").cast("string").alias("repo"), F.col("file").cast("string").alias("file"), F.col("content").cast("string").alias("content"))
    said = said.where("repo is not null and file is not null")
    rows = written(said.mapInArrow(_parsed, _FACTS), "facts")
    node = lambda file, name: F.struct("repo", F.col(file).alias("file"), F.col(name).alias("name"))
    functions = rows.where("kind = 'function'").groupBy("repo", "file", "name").agg(F.max("line").alias("line"), F.max("handler").alias("handler"))
    symbols = rows.where("kind in ('function', 'class') and text is not null").select("repo", "file", F.col("name").alias("symbol"), F.col("text").alias("callee")).distinct()
    parts = F.split("name", r"\.")
    endings = rows.where("kind = 'module'").select("repo", "file", F.size(parts).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("module"))
    modules = written(endings.groupBy("repo", "module").agg(F.min(F.struct("n", "file")).alias("m")).select("repo", "module", "m.file"), "modules")
    aliases = rows.where("kind = 'alias'").select("repo", "file", F.col("name").alias("head"), F.col("target").alias("onto")).distinct()
    calls = rows.where("kind = 'call'").select("repo", "file", "name", "at", "text", F.col("target").alias("called")).distinct()
    sinks = calls.withColumn("sink", sink_of(F.col("called"), strict=strict)).where("sink is not null")
    sinks = written(sinks.groupBy("repo", "file", "name").agg(F.min(F.struct("at", "sink", "called")).alias("m")).select("repo", "file", "name", "m.*"), "sinks")
    before = calls.join(_shuffled(sinks.select("repo", "file", "name", F.col("at").alias("stop"))), ["repo", "file", "name"], "left").where("stop is null or at < stop")
    open_ = before.where("text is null")
    far = _resolved(open_.where(F.contains("called", F.lit("."))).select("repo", F.col("called").alias("target")).distinct(), modules, symbols, aliases).withColumnRenamed("target", "called")
    # The last definition of a bare name, by file and line.
    bare = functions.select("repo", F.substring_index("name", ".", -1).alias("called"), F.struct("file", "line", "name").alias("d")).groupBy("repo", "called").agg(F.max("d").alias("d")).select("repo", "called", F.col("d.file").alias("to_file"), F.col("d.name").alias("to_name"))
    caller = node("file", "name").alias("caller")
    inside = before.where("text is not null").select(caller, node("file", "text").alias("callee"))
    across = open_.join(_shuffled(far.withColumnsRenamed({"file": "to_file"})), ["repo", "called"]).select(caller, node("to_file", "callee").alias("callee"))
    loose = open_.where(~F.contains("called", F.lit("."))).join(_shuffled(bare), ["repo", "called"]).select(caller, node("to_file", "to_name").alias("callee"))
    edges = written(inside.unionByName(across).unionByName(loose).distinct(), "edges")
    dropped(modules)
    return functions.select(node("file", "name").alias("node"), "repo", "file", "name", "line", "handler"), edges, sinks.select(node("file", "name").alias("node"), "sink", "called")


def findings(files: DataFrame, *, depth: int = DEPTH, strict: bool = False, each_handler: bool = False) -> DataFrame:
    """Dangerous calls that requests reach, at the function's line: one for each function, at its least depth, or for each handler too.

    (repo, file, line, rule_id, severity, issue, description, exploitability, blast_radius, confidence, layer, depth, handler)
    """
    nodes, edges, sinks = call_graph(files, strict=strict)
    handlers = nodes.where("handler").select("node", F.struct("file", "name").alias("from"))
    # Without a handler in the key, a walk's rows are as many as functions, not as handlers times functions.
    start = F.col("node") if each_handler else F.col("node.repo")
    seen = reached(handlers.select(start.alias("start"), "node"), edges, depth)
    out = seen.join(_shuffled(sinks), "node").join(_shuffled(nodes.select("node", "line")), "node")
    end = F.substring_index("sink", ".", -1)
    handler = F.concat_ws(":", "start.file", "start.name") if each_handler else F.lit(None).cast("string")
    told = F.concat(F.lit("A request reaches '"), F.col("called"), F.lit("' in "), F.col("node.file"), F.lit(" over "), (F.col("depth") + 1).cast("string"), F.lit(" calls"))
    return out.select(
        "node.repo", "node.file", "line", F.concat(F.lit("l5/cross-file-taint-"), end).alias("rule_id"), looked_up(F.col("sink"), {s: severity(s) for s in SINKS}, "medium").alias("severity"),
        F.concat(F.lit("Cross-file taint: request data reaches '"), F.col("called"), F.lit("'")).alias("issue"), told.alias("description"), exploitability(F.col("depth")).alias("exploitability"),
        F.lit(BLAST).alias("blast_radius"), confidence(F.col("depth")).alias("confidence"), F.lit(5).alias("layer"), F.col("depth").cast("int").alias("depth"), handler.alias("handler"),
    )
