"""Rule packs on the files they are for."""

from cindersift.functions.text import lines
from cindersift.operators import packs, surface
from cindersift.plans.scan import detected

FILES = [
    ("Dockerfile", "FROM python:latest\nUSER root\nENV PASSWORD=abc\nRUN curl http://x | sh\nHEALTHCHECK NONE", {"l6/docker-latest-tag", "l6/docker-root-user", "l6/docker-secret-in-env", "l6/docker-curl-pipe-shell", "l6/docker-no-healthcheck"}),
    ("docker-compose.yml", "a:\n  privileged: true\n  restart: always\n  TOKEN: abcdef", {"l6/compose-privileged", "l6/compose-restart-always", "l6/compose-hardcoded-secret"}),
    ("pod.yaml", "apiVersion: v1\nhostPID: true\nrunAsUser: 0\nlimits: {}", {"l6/k8s-host-pid-ipc", "l6/k8s-run-as-root", "l6/k8s-no-resource-limits"}),
    ("ci.yml", "on: pull_request_target\nruns-on: x\nuses: actions/checkout@v2\nrun: echo ${{ github.event.issue.title }}", {"l6/gha-pull-request-target", "l6/gha-old-checkout", "l6/gha-pwn-request"}),
    ("x.yaml", "privileged: true", set()),
    ("main.tf", 'cidr_blocks = ["0.0.0.0/0"]\nencrypted = false\n# publicly_accessible = true', {"l6/tf-open-ingress", "l6/tf-storage-not-encrypted"}),
    ("a.js", 'db.query(req.body.q + execute)\n// app.get("/admin")\nconst c = jwt.sign(p, "short")', {"l2/js-taint-sqli", "l2/js-taint-command-injection", "l3/jwt-weak-secret"}),
    ("A.java", "Runtime.getRuntime().exec(a + b)", {"l2/java-runtime-exec-concat"}),
    ("a.go", 'import "crypto/md5"\nexec.Command("x" + y)', {"l2/go-weak-hash", "l2/go-exec-inject"}),
    ("a.py", "pbkdf2_hmac('sha256', p, s, 200000)\ncipher = MODE_ECB\nrandom.seed(1)", {"l3/ecb-mode", "l3/seeded-random-crypto"}),
    ("b.py", "pbkdf2_hmac('sha256', p, s, 1000)", {"l3/pbkdf2-low-iterations"}),
    ("c.txt", "MODE_ECB", set()),
]


def test_packs(spark):
    rows = [("r", n, n, "." + n.rpartition(".")[2] if "." in n else "", c) for n, c, _ in FILES]
    files = packs.probed(spark.createDataFrame(rows, "repo string, file string, filename string, ext string, content string"))
    got = {}
    for r in packs.routed_matches(lines(files)).collect():
        got.setdefault(r.file, {})[r.rule_id] = r
    assert {n: set(got.get(n, {})) for n, _, _ in FILES} == {n: want for n, _, want in FILES}
    assert got["b.py"]["l3/pbkdf2-low-iterations"].severity == "high" and got["b.py"]["l3/pbkdf2-low-iterations"].confidence == 0.70
    assert got["a.go"]["l2/go-exec-inject"].line == 2


def test_scan_runs_all_packs(spark):
    files = [
        ("src/a.py", "requests.get(request.args['u'])\nsubprocess.run(x, shell=True)\ncipher = MODE_ECB\n# marshal.load(x)", {"l1/ssrf-risk", "l1/py-subprocess-shell-cmd", "l1/os-system", "l3/ecb-mode", "native/ssrf-risk", "native/os-system-injection", "l2/subprocess-shell-true", "l2/taint-ssrf", "native/subprocess-shell-true"}),
        ("Dockerfile", "FROM python:latest\nEXPOSE 22", {"l6/docker-latest-tag", "l6/docker-dangerous-port", "native/docker-run-as-root", "native/docker-latest-tag", "native/docker-expose-all"}),
        ("ok/Dockerfile", "FROM python:3.12\nUSER app", set()),
        ("k8s/pod.yaml", "kind: Pod\nhostNetwork: true", {"l6/k8s-host-network"}),
        ("x/pod.yaml", "hostNetwork: true", {"native/k8s-host-network"}),
        ("notes.txt", "npm //registry.npmjs.org/:_authToken=abc", {"l1/npm-token"}),
    ]
    got = {}
    for r in detected(spark.createDataFrame([("r", f, c) for f, c, _ in files], "repo string, file string, content string")).collect():
        got.setdefault(r.file, set()).add(r.rule_id)
    assert {f: got.get(f, set()) for f, _, _ in files} == {f: want for f, _, want in files}
    assert (len(surface.SURFACE), len(surface.LEGACY), len(surface.LEGACY_FILES)) == (91, 60, 10)
