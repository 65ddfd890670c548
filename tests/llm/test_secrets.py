"""Secrets: base spans against a plain search, the automata on held-out tokens, long and odd texts."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cindersift.llm import secret_forms, secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(*m.span(), 0, "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(*m.span(), 1, "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(*m.span(), 2, "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(s, e, k) for s, e, _, k in sorted(out, key=lambda x: (x[0], x[2]))]


def made(n=1500, seed=4):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "token", "ſecret", "API_KEY", "apiKey", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "日", "\n", "xyzzy1", "a.b", "\x00", "ghp_", "Q", "==", "/", "-", "token=", "token=short", "token: abcdef"]
    return ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return secrets.trained(secrets.labelled(spark))


def test_base_spans(spark, model):
    texts = [*made(), None, "", "AKIA" * 5, "a" * 24, "token=" * 9 + "abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = secrets.digests(df, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x[2] for x in want) for k in secrets.KINDS]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert {(int(s), int(e), k) for k, s, e in spans} >= set(want)
        added = [(int(s), int(e)) for k, s, e in spans if k == "credential"]
        assert not any(s < y and x < e for s, e in added for x, y, _ in want)
        assert [(int(s), secrets.ALL_KINDS.index(k)) for k, s, e in spans] == sorted((int(s), secrets.ALL_KINDS.index(k)) for k, s, e in spans)


def test_held_out_formats(model):
    found = {0: [], 1: []}
    for i in range(500_000, 504_000):
        token, y, _ = secret_forms.form(i)
        found[y].append(model.margin(token) >= model.threshold)
    recall, wrong = sum(found[1]) / len(found[1]), sum(found[0]) / len(found[0])
    print("recall of unseen credentials", recall, "ordinary tokens taken", wrong)
    assert recall > 0.95 and wrong < 0.01
    # Formats that the table doesn't hold, by their random parts.
    rng = random.Random(2)
    unseen = ["lin_api_" + secret_forms._from(rng, secret_forms.ALNUM, 40) for _ in range(200)] + ["key-" + secret_forms._from(rng, secret_forms.ALNUM, 32) for _ in range(200)]
    share = sum(model.margin(t) >= model.threshold for t in unseen) / len(unseen)
    print("recall of unseen formats", share)
    assert share > 0.8


def test_states_are_merged(spark):
    # (ab)*c: an automaton of two states, however long the tokens were.
    rng = random.Random(1)
    rows = [("-." * min(rng.randrange(20), int(rng.expovariate(0.4))) + "+",) for _ in range(3000)]
    a = secrets.inferred(spark.createDataFrame(rows, "token string"), frequent=2)
    assert len(a.next) <= 6 and a.literals == set()
    assert a.score("-.-.-.+") > a.score("--..-.+") and a.score("-.+") > a.score("-.")


def test_added_spans_in_whole_texts(spark, model):
    token = secret_forms.SECRET[0](random.Random(9))
    long = "plain words of prose, été. " * 80_000
    rows = [(1, f"see {token}, then"), (2, long + token + "."), (3, "visit www.example.com/articles/2024/05/17/some-long-title now"), (None, f"é{token}"), (5, f"token = {token}"), (5, f"token = {token}")]
    out = {}
    for r in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("x"), "kind": F.lit("k"), "base": F.array(F.lit(1))}), model).collect():
        out.setdefault(r.doc_id, []).append([(x.start, x.end, x.kind) for x in r.spans])
        assert r.kind == "k" and r.base == [1]
    n = len(token)
    assert out[1] == [[(4, 4 + n, "credential")]] and out[2] == [[(len(long), len(long) + n, "credential")]] and out[3] == [[]] and out[None] == [[(1, 1 + n, "credential")]]
    assert out[5] == [[(0, 8 + n, "assign")]] * 2
    assert secrets.digests(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_runs_by_doubling_and_rows_of_a_batch():
    rng = random.Random(3)
    for least in (1, 2, 3, 16, 24):
        bits = "".join(rng.choice("0" + "1" * rng.choice([1, 9])) for _ in range(3000))
        assert secrets._runs(np.array([c == "1" for c in bits]), least) == [m.span() for m in re.finditer("1+", bits) if m.end() - m.start() >= least]
    assert secrets._runs(np.zeros(0, bool), 5) == []
    texts = pa.array(["abcdef0123", "4567890123456789abcdefab", None, "0" * 30, "f" * 20, "é" + "f" * 24])
    spans = secrets._found(texts[1:], _never()).to_pylist()
    assert [[(s["start"], s["end"]) for s in x] for x in spans] == [[(0, 24)], [], [(0, 30)], [], [(1, 25)]]


def _never():
    class Never:
        threshold = float("inf")

        def margin(self, token):
            return 0.0

    return Never()
