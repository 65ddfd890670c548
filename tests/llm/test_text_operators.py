"""The text operators against brute force, with nulls, empty and odd texts, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

from cindersift.llm import bpe, decontaminate, lines, near, private, quality

random.seed(7)
WORDS = ["w%d" % i for i in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edited(text, k):
    words = text.split(" ")
    for i in random.sample(range(len(words)), k):
        words[i] = "x%d" % random.randrange(10**6)
    return " ".join(words)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(sets, percent):
    ids, up = list(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def corpus():
    base = [prose(random.randrange(30, 200)) for _ in range(25)]
    texts = base + [edited(random.choice(base), random.randrange(1, 4)) for _ in range(60)] + [base[0], base[0].upper(), base[1] + "\n"]
    texts += ["", None, " \t\n", "one", "one two", "One  two", "é é é é é é", "a b c d e", "b c d e f", "tail " * 3000]
    shared = prose(40)
    return texts + [shared + " " + prose(random.randrange(5, 60)) for _ in range(40)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    texts = corpus()
    df = spark.createDataFrame([(i * 3, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    want = groups({i * 3: shingles(t) for i, t in enumerate(texts)}, percent)
    got = {r.doc_id: r for r in near.near_duplicates(df, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(texts[i // 3])) and r.kept == (r.component_id == i) for i, r in got.items())
    kept = near.deduplicated(df, percent)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near.near_duplicates(odd).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_lines(spark):
    long = [prose(30) for _ in range(20)]
    near_line = long[0][:-1] + "z"
    docs = [(1, f"{long[0]}\n\n{long[1]}"), (2, f"{near_line}\nshort\n{long[2]}"), (3, f"short\n{long[1]}\n   \n{long[3]}"), (4, None), (5, ""), (6, "\n".join(long[4:]) + "\nçé 漢字🙂"), (7, "çé 漢字🙂"), (None, long[1])]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, id long")
    gone = {(r.id, r.line): (r.first_id, r.first_line) for r in lines.duplicate_lines(df.drop("id")).collect()}
    assert gone == {(2, 0): (1, 0), (3, 0): (2, 1), (3, 1): (1, 2), (7, 0): (6, 16)}
    out = lines.deduplicated(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: docs[0][1], 2: f"short\n{long[2]}", 3: f"   \n{long[3]}", 4: None, 5: "", 6: docs[5][1], 7: "", None: long[1]}
    assert lines.duplicate_lines(df.where("false").drop("id")).collect() == []


def test_lines_against_all_pairs(spark):
    base = [prose(random.randrange(3, 40)) for _ in range(20)]
    rows = [edited(random.choice(base), 1) if random.random() < 0.6 else random.choice(base) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = {}
    for i, t in enumerate(rows):
        sets[i] = frozenset(t[j : j + 10] for j in range(len(t) - 9)) or frozenset([t + "$"])
    want = groups(sets, 80)
    got = {r.id: r.first_id for r in lines.duplicate_lines(df).collect()}
    assert got == {i: c for i, c in want.items() if i != c}


def test_lines_of_ordinary_length(spark):
    base = [prose(random.randrange(12, 25)) for _ in range(30)]
    rows = base + [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in base] + [prose(random.randrange(1, 12)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = groups({i: frozenset(t[j : j + 5] for j in range(len(t) - 4)) or frozenset([t + "$"]) for i, t in enumerate(rows)}, 80)
    got = {r.id: r.first_id for r in lines.duplicate_lines(df, lines.FIVE).collect()}
    assert got == {i: c for i, c in want.items() if i != c} and all(got.get(i + 30) == i for i in range(30))


def test_decontamination(spark):
    items = [(i, prose(random.randrange(12, 50))) for i in range(30)] + [(90, None), (91, "too short"), (92, "")]
    docs = [(i, prose(random.randrange(0, 300))) for i in range(40)] + [(500, None), (501, "")]
    docs += [(100 + i, prose(50) + "\n" + t + " " + prose(100)) for i, t in items[:30]] + [(200 + i, prose(20) + " " + edited(t, 1) + " " + prose(30)) for i, t in items[:10] if len(t.split()) > 24]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    whole = {(i, i - 100) for i, _ in docs if 100 <= i < 200}
    assert whole <= got and all(i >= 100 for i, _ in got)
    assert {i for i, _ in docs if 200 <= i < 300} <= {i for i, _ in got}
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.leaks(d, b.where("false")).collect() == []


def test_decontamination_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 60)  # words: three items or so
    items = [(i, prose(20)) for i in range(10)]
    d = spark.createDataFrame([(i, prose(10) + " " + t) for i, t in items], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "Hello world", "aaaaaaa" * 300, "<|endoftext|>", "漢字🙂 naïve", "\n\n  x\t", "it's 1234567"] + ["".join(random.choice("abc é漢1 \n'.") for _ in range(50)) for _ in range(100)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, c0 array<int>")
    ids = bpe.encoded(df, PATH, public_tokenizers.PATTERN)
    assert ids.columns == ["doc_id", "text", "c0", "ids"]
    got = {r.doc_id: r for r in bpe.decoded(ids, PATH, public_tokenizers.PATTERN).collect()}
    told = {r.doc_id: r for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = plain.encode_ordinary(t or "")
        assert got[i].ids == want and bytes(got[i].decoded) == (t or "").encode()
        assert (told[i].n_tokens, told[i].ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert told[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(df.where("false"), PATH, public_tokenizers.PATTERN).collect() == []


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.trained(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").where(quality.fold("doc_id") == 0).select("score", "quality").collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.97
    assert sum(r.score >= quality.THRESHOLD for r in rows if r.quality) / sum(r.quality for r in rows) > 0.98


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "x y", 3.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.scored(docs, quality.trained(docs, none), score_col="s").collect()
    assert [r.s for r in got] == [0.5] * 3 and got[0].score == 1.0
    one = spark.createDataFrame([(1, 1), (2, None), (9, 1)], "doc_id long, quality int")
    assert all(r.s > 0.99 for r in quality.scored(docs, quality.trained(docs, one), score_col="s").collect())
    assert quality.kept(docs, quality.trained(docs, one)).count() == 3


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for o, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), o, kind, m.end()))
    return sorted(out)


def test_private_data(spark):
    texts = [None, "", "a@b.c_d@e.f a@b.com.@x.y", "1.2.3.4.5.6.7.8 001.002.3.255 256.1.1.1", "4111 1111 1111 1111 x 4111-1111-1111-1112", "é🙂a@b.co +1 (168) 555-5254", "1." * 2000, "a@b" + ".c" * 3000, "1 " * 3000]
    texts += ["".join(random.choice("ab@.. 012345+-()é") for _ in range(random.randrange(0, 100))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans2 string")
    model = private.trained(private.labelled(spark))
    got = {r.doc_id: r for r in private.spans(df, model).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.ord, s.kind, s.end) for s in got[i].spans if s.base] == base_spans(t or "")
        added = [s for s in got[i].spans if not s.base]
        assert not any(s.start < b.end and b.start < s.end for s in added for b in got[i].spans if b is not s)
    plain = spark.createDataFrame([(1, "call (555) 123-4567 or write to jonas [at] acme [dot] org, order no. 555-234-5678 on 2024-01-15"), (2, "mail x@y.org now")], "doc_id long, text string")
    assert [r.text for r in private.redacted(plain, model).orderBy("doc_id").collect()] == ["call [phone] or write to [email], order no. 555-234-5678 on 2024-01-15", "mail [email] now"]


def test_private_model_on_held_out_spans(spark):
    from pyspark.sql import functions as F

    rows = private.labelled(spark)
    trees, threshold = private.trained(rows)
    x = F.struct("m", "before", "after")
    features = F.when(F.col("kind") == "phone", private._features("phone", x)).otherwise(private._features("email", x))
    held = rows.where("fold = 0").select((private.margin(trees, features) >= threshold).alias("yes"), "label").collect()
    assert sum(r.label for r in held if r.yes) / sum(r.yes for r in held) >= 0.98
    assert sum(r.yes for r in held if r.label) / sum(r.label for r in held) > 0.6
