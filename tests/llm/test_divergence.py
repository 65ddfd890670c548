"""The source audit against brute force in whole numbers, and radix selection against sorting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cindersift.llm import divergence, radix

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, k=10):
    groups, docs = {}, Counter()
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
        docs.update((lang or "", w) for w in set(words))
    out = []
    for lang in {g for g, _ in groups}:
        own = {s: c for (g, s), c in groups.items() if g == lang}
        kept = [w for g, w in docs if g == lang and docs[g, w] >= min_docs]
        whole = Counter()
        for c in own.values():
            whole.update({w: c[w] for w in kept})

        def shares(c):
            n = sum(c[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // n for w in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            for part, found in (("pair", [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in own if o != s]), ("term", [(f(p[s][w], q[w]), w) for w in kept if own[s][w] and p[s][w] > q[w]])):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[: k if part == "term" else None], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def made(n=240, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "Mo", "é", "ß", "zu", "日") for b in ("x", "Y", "ü", "nn", "本")]
    return [(i, " ".join(rng.choice(words) + rng.choice([" ", ", ", "-", "_", "0"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "ä"])) for i in range(n)]


@pytest.mark.parametrize("tie_rows", [4096, 1])
def test_audit_is_exact(spark, tie_rows):
    rows = made() + [(900, None, "xx", "only"), (901, "", "yy", "a"), (902, "!!", "yy", "b"), (903, "w" * 2_100_000 + " ka", "en", "a")]
    rows += [(1000 + i, f"tie{chr(97 + i % 25)}{chr(98 + i // 25)} " * 2, "tt", "a") for i in range(40) for _ in range(10)] + [(1, "rest tieab", "tt", "b")] * 10
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("term", "n", "docs", "total", "value", "item", "rank", "p", "q")})
    assert got(divergence.audit(df, tie_rows=tie_rows)) == brute(rows)


def test_flushed_sums_and_texts_in_pieces_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 20)
    monkeypatch.setattr(divergence, "PIECE", 16)
    batches = lambda df: df.select("lang", "source", "text").na.fill("").toArrow().to_batches()
    rows = made(60)
    n, docs = Counter(), Counter()
    for b in divergence._counted(iter(batches(spark.createDataFrame(rows, SCHEMA)))):
        for lang, source, term, a, d in zip(*(c.to_pylist() for c in b.columns)):
            if term is not None:
                n[lang, source, term] += a
                docs[lang, source, term] += d
    want, had = Counter(), Counter()
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        want.update((lang or "", source or "", w) for w in words)
        had.update((lang or "", source or "", w) for w in set(words))
    assert n == want and docs == had


def test_shares_of_very_large_counts_stay_exact(spark):
    counts = [(10**15 + 7, 3 * 10**15 + 1), (0, 9 * 10**15), (9 * 10**15 - 2, 9 * 10**15)]
    df = spark.createDataFrame(counts, "n long, total long").select("n", "total", divergence.share(F.col("n"), F.col("total")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 2) // r.total for r in df.collect())


def test_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("tie_rows", [4096, 2, 1])
def test_radix_selection_is_a_sort(spark, tie_rows):
    rng = random.Random(7)
    rows = [(rng.choice(["g", "h", None]), rng.choice([0, 1, 1, 5, 1 << 40, (1 << 61) + 3]), rng.choice(["", "a", "ab", "abc", "abd", "b", "é", "日本", "日"]) + str(rng.randrange(30))) for _ in range(700)]
    rows += [("same", 4, "x")] * 30 + [("few", 2, "y"), (None, None, "z"), ("n", 1, None)]
    df = spark.createDataFrame(rows, "g string, v long, t string")
    want = []
    for g in {r[0] for r in rows}:
        own = sorted(((v, t) for h, v, t in rows if h == g and v is not None and t is not None), key=lambda x: (-x[0], x[1].encode()))
        want += [(str(g), t, v, i) for i, (v, t) in enumerate(own[:12], 1)]
    found = [(str(r.g), r.item, r.value, r["rank"]) for r in radix.best(df, ["g"], "v", "t", 12, tie_rows=tie_rows).collect()]
    assert sorted(found) == sorted(want)
