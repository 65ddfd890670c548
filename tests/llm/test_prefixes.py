"""The conversation trie against a brute-force trie, with colliding fingerprints and odd rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cindersift.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    ends = {p: ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed=3, convs=70, most=9, texts=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), f"said {rng.randrange(texts)}") for c in range(convs) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("mask", [-1, 3, 0])
def test_same_as_a_brute_force_trie_also_when_fingerprints_collide(spark, mask):
    rows, rounds = made(), []
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefixes.trie(df, mask=mask, split_rounds=rounds)) == brute(rows)
    assert bool(rounds) == (mask != -1)


def test_long_conversations_span_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    rows = [(c, t, "user", f"t{t}" if t < 4000 or c % 2 else f"t{t}.{c}") for c in (0, 20, 40, 41, 60) for t in range(4200)] + [(7, 0, "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(prefixes.trie(df)) == brute(rows)


def test_nulls_ties_repeats_long_texts_and_names(spark):
    rows = made(5, 30) + [(3, None, None, None), (3, None, "user", None), (3, 0, None, "x\x0by  z"), (3, 0, None, "x\x0by  z"), (None, 1, "user", "gone"), (199, 0, "user", "w " * 200_000), (-5, 0, "user", "below"), (61, 0, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({n: F.lit("clash") for n in ("depth", "f", "s", "n", "h", "words", "total", "pos")})
    assert got(prefixes.trie(df)) == brute(rows)


def test_identical_conversations_and_no_rows(spark):
    rows = [(20 * c, t, "user", f"t {t}") for c in range(300) for t in range(4)]
    assert got(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turnless_conversations_belong_to_the_root(spark):
    lonely = next(c for c in range(100, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lonely, 0, "user", "a")]
    assert got(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(lonely, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]
