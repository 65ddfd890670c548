"""Overlaps of spans and redaction against brute force; the order of work for very many spans."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cindersift.llm import private

KIND = "array<struct<start:int,ord:int,kind:string,end:int,base:boolean,score:double>>"


def brute(base, more):
    over = lambda x, y: x[0] < y[3] and y[0] < x[3]
    rank = lambda x: (-x[5], x[0], -x[3], x[1])
    clear = [x for x in more if not any(over(x, b) for b in base)]
    return sorted(base + [x for x in clear if not any(over(x, y) and rank(y) < rank(x) for y in clear)])


def some(rng, n, base):
    out = set()
    for _ in range(n):
        o = rng.randrange(5 if not base else 4)
        start = rng.randrange(0, 60)
        out.add((start, o, private.ALL_KINDS[o], start + rng.randrange(1, 12), base, 1.0 if base else rng.choice([0.6, 0.7, 0.8])))
    return sorted(out)


def test_resolved(spark):
    rng = random.Random(4)
    rows = [(i, some(rng, rng.randrange(0, 6), True), some(rng, rng.randrange(0, 9), False)) for i in range(400)] + [(-1, [], []), (-2, some(rng, 3, True), [])]
    df = spark.createDataFrame(rows, f"id long, base {KIND}, more {KIND}")
    got = {r.id: [tuple(x) for x in r.spans] for r in private.resolved(df, "base", "more", "spans").collect()}
    assert got == {i: brute(b, m) for i, b, m in rows}


def test_many_spans_in_near_linear_time(spark):
    took = []
    for n in (4000, 16000):
        text = F.lit(" ".join(f"+1 ({200 + i % 700}) 555-{1000 + i % 9000} or" for i in range(n)))
        df = spark.range(1).select("id", text.alias("text"))
        none = ([], 1e9)
        began = time.perf_counter()
        row = private.spans(df, none).select(F.size("spans").alias("n")).first()
        took.append(time.perf_counter() - began)
        assert row.n == n
    assert took[1] < 12 * took[0] + 5


@pytest.fixture(scope="module")
def model(spark):
    return private.trained(private.labelled(spark))


def test_secrets_and_redaction(spark, model):
    hex_ = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    cases = [(1, f'x token = "{hex_}" y', f'x token = "[secret]" y'), (2, f"see commit {hex_} and", None), (3, "an-ordinary-long-compound-word here", None), (4, "😀 mail a.b@c.de, +1 (212) 555-0199 ü", "😀 mail [email], [phone] ü"), (5, None, None), (6, "", None)]
    df = spark.createDataFrame([(i, t, "own") for i, t, _ in cases], "doc_id long, text string, spans string").withColumnRenamed("spans", "kept")
    got = {r.doc_id: r for r in private.redacted(df, model).collect()}
    for i, text, want in cases:
        assert got[i].text == (want if want is not None else text) and got[i].kept == "own"


def test_held_out_words_and_forms(spark, model):
    """Spans whose surroundings and forms the labelled table doesn't hold."""
    yes = ['export API_TOKEN="9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"', "Please call our office: 212-555-0147 today", "write jane.roe [at] lindenhof [dot] at soon"]
    no = ["the build sha256:9f8e7d6c5b4a39281706f5e4d3c2b1a098765432 passed", "chapters 12-14 and 15", "between 1998-2004 it grew", "look at this dot on the map", "a-very-long-hyphenated-file-name-without-numbers"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if not s.base] for r in private.spans(df, model).collect()}
    assert [bool(got[i]) for i in range(len(yes + no))] == [True] * len(yes) + [False] * len(no)
