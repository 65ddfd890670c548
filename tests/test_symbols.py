"""Cross-file taint: modules, imports, scopes, re-exports, depth and what stops a walk."""

from cindersift.operators import symbols

FILES = {
    "app/views.py": "from .helpers import clean as tidy\nimport app.db as store\nfrom lib import *\n\n@router.get('/x')\ndef view(q):\n    tidy(q)\n    store.save(q)\n    Job(q).start()\n    spread(q)\n\nclass Job:\n    def __init__(self, q):\n        self.load(q)\n    def load(self, q):\n        subprocess.run(q)\n",
    "app/helpers.py": "def clean(q):\n    def inner(z):\n        eval(z)\n    inner(q)\n\ndef save(q):\n    os.system(q)\n",
    "app/db/__init__.py": "from .impl import save\n",
    "app/db/impl.py": "from subprocess import Popen as spawn\n\ndef save(q):\n    spawn(q)\n",
    "lib.py": "def spread(q):\n    cursor.execute(q)\n    deeper(q)\n\ndef deeper(q):\n    pickle.loads(q)\n",
    "other/helpers.py": "def clean(q):\n    pickle.loads(q)\n",
    "broken.py": "def x(:",
}


def rows(spark, files, **more):
    df = spark.createDataFrame([("r", f, c) for f, c in files.items()], "repo string, file string, content string")
    return sorted((r.file, r.line, r.rule_id.rpartition("-")[2], r.depth) for r in symbols.findings(df, **more).collect())


def test_functions_are_told_apart_by_module(spark):
    assert rows(spark, FILES) == [
        ("app/db/impl.py", 3, "Popen", 1),
        ("app/helpers.py", 1, "eval", 1),
        ("app/helpers.py", 2, "eval", 2),
        ("app/views.py", 15, "run", 2),
        ("lib.py", 1, "execute", 1),
    ]


def test_depth_cycles_and_handlers(spark):
    chain = {f"m{i}.py": f"from m{i + 1} import f as nxt\ndef f(x):\n    nxt(x)\n" for i in range(7)} | {"m0.py": "from m1 import f as nxt\ndef f(request):\n    nxt(request)\n    f(request)\n"}
    ends = {f"m{i}.py": c + "    eval(x)\n" if i in (5, 6) else c for i, c in ((int(k[1]), v) for k, v in chain.items())}
    assert rows(spark, ends) == [("m5.py", 2, "eval", 5)]
    assert rows(spark, ends, depth=6) == [("m5.py", 2, "eval", 5), ("m6.py", 2, "eval", 6)]
    two = {"a.py": "def h(req):\n    s(req)\ndef g(r):\n    h(r)\ndef s(x):\n    os.system(x)\n"}
    assert rows(spark, two) == [("a.py", 5, "system", 1)]
    assert rows(spark, two, each_handler=True) == [("a.py", 5, "system", 1), ("a.py", 5, "system", 2)]


def test_severities_and_strict_names(spark):
    source = {"a.py": "def h(request):\n    request.args.get('x')\ndef g(req):\n    req.raw_query('x')\n"}
    assert rows(spark, source) == [("a.py", 3, "raw_query", 0)]
    assert rows(spark, source, strict=True) == [("a.py", 1, "get", 0), ("a.py", 3, "raw_query", 0)]
    assert [symbols.severity(s) for s in ("cursor.execute", "eval", "shutil.copy", "httpx.get", "send_file", "urllib.request.urlopen", "yaml.load")] == ["critical", "medium", "medium", "high", "high", "high", "critical"]


def test_odd_inputs(spark):
    df = spark.createDataFrame([("r", "a.py", None), ("r", "a.py", None), (None, None, "def f(request):\n    eval(request)\n"), ("r", "b.py", ""), ("r", "c.py", "def f(r):\n    eval(r)\n"), ("r", "c.py", "def f(r):\n    eval(r)\n")], "repo string, file string, content string")
    assert [(r.file, r.line) for r in symbols.findings(df).collect()] == [("c.py", 1)]
    assert symbols.findings(df.where("false")).count() == 0
