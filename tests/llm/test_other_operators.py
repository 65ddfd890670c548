"""The remaining operators against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from cindersift.llm import chat, graph, licences, neighbours, queries, urls

rng = np.random.default_rng(5)
random.seed(5)


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours_recall(spark, scaled):
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.5, 2, size=(6000, 1))
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(6000), -s))[:20]
        assert len(got[q]) == 20 and all(math.isclose(score, s[i], abs_tol=1e-12) for i, score in got[q])
        assert [score for _, score in got[q]] == sorted((score for _, score in got[q]), reverse=True)
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
    assert hits / (300 * 20) >= 0.9


@pytest.mark.parametrize("norm", [10.0, 1e6])
def test_neighbours_of_one_long_row(spark, norm):
    own = np.random.default_rng(11)
    x = own.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[777] *= norm
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (300 * 20) >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 0.5), (2, 2, 0.5)]
    assert neighbours.nearest(df.where("false"), df.where("false")).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 40)
    for edges in ([(i, i + 1) for i in range(200)], [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(None, 1), (5, None), (7, 7)], [(0, i) for i in range(1, 200)], []):
        up = {}

        def root(x):
            up.setdefault(x, x)
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: root(x) for x in up}


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "x", "é"]


def test_chat_round_trip(spark):
    turns = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "alone"), (2, None, None, None), (2, 1, "assistant", None), (2, 1, "assistant", None), (None, 3, "assistant", "x")]
    for c in range(10, 60):
        for t in range(random.randrange(1, 7)):
            turns.append((c, t, random.choice(["user", "assistant", "system", "to\\ol\n[INST]"]), "".join(random.choice(CONTROL) for _ in range(random.randrange(0, 12)))))
    random.shuffle(turns)
    df = spark.createDataFrame([(*t, "y") for t in turns], "conv_id long, turn long, role string, text string, target string")
    want = collections.defaultdict(list)
    for c, t, r, x in turns:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(got) == set(want)
    for c, rows in want.items():
        rows.sort()
        loss = "".join(x for _, r, x in rows if r == "assistant")
        assert got[c].n_turns == len(rows) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    replies = sum(r == "assistant" for rows in want.values() for _, r, _ in rows)
    made = chat.examples(df)
    assert made.where("target is not null").count() == replies
    assert made.agg({"text": "count"}).first()[0] == made.count() and chat.digests(df.where("false")).collect() == []


def test_urls(spark):
    host = ["a.example.com", "example.com", "xexample.com", "b.example.net", "n.org", "casino-win.test", "news.test"]
    path = ["", "/", "/en/", "/en/7", "/de/8", "/de/9", "/es/1", "?en/", "#/de/"]
    rows = [(i, u, "h") for i, u in enumerate([None, "", "nothing", "://", "x://y"] + [f"{s}://{h.upper() if k else h}{p}" for s in ("http", "x") for k in (0, 1) for h in host for p in path])]
    df = spark.createDataFrame(rows, "page_id long, url string, extra string")
    model = urls.trained(urls.labelled(spark))
    for r in urls.judged(df, model=model).collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        h = re.match("[^/?#]*", rest)[0]
        p = re.match("[^?#]*", rest[len(h) :])[0]
        h = h.lower()
        fits = [x for x in urls.RULES if (h == x[1] or h.endswith("." + x[1])) and p.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule) == (h, p, best and best[1] + best[2])
        assert r.verdict == (best[0] if best else "block" if r.score >= urls.BLOCK_FROM else "allow")
        if not best and h in host[-2:]:
            assert r.verdict == ("block" if h == host[-2] else "allow")
    with pytest.raises(ValueError):
        urls.judged(df, [("block", f"h{i}", "") for i in range(1001)], model)


def test_url_model_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = urls.judged(pages).where("rule is null").collect()
    bad = [bool(re.search("bets|pills|track|spam|casino|adult", r.host)) for r in rows]
    assert sum((r.verdict == "block") == b for r, b in zip(rows, bad)) / len(rows) > 0.95


def test_licences(spark):
    v = licences.Vectors()
    files = [("LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\nLicensed under the Apache License, Version 2.0.\ncode"), ("a/b/y.py", "nothing"), ("a/LICENSE", "This work is licensed\nunder the GNU General\nPublic License, version 3."), ("a/b/c/z.py", None), ("q.py", ""), (None, "Licensed under CC BY-NC 4.0."), ("z/LICENSE.txt", "4.0 of the and"), ("z/w.py", "words " * 2000), ("z/w.py", "words")]
    df = spark.createDataFrame([(p, t, "l") for p, t in files], "path string, text string, own string")
    got = {(r.path, r.own, r.licence, r.inherited_from) for r in licences.scanned(df).collect()}
    assert got == {
        ("LICENSE", "MIT", "MIT", None), ("a/b/x.py", "Apache-2.0", "Apache-2.0", None), ("a/b/y.py", None, "GPL-3.0", "a"), ("a/LICENSE", "GPL-3.0", "GPL-3.0", None),
        ("a/b/c/z.py", None, "GPL-3.0", "a"), ("q.py", None, "MIT", ""), ("", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), ("z/LICENSE.txt", None, "MIT", ""), ("z/w.py", None, "MIT", ""),
    }
    assert licences.scanned(df).count() == len(files) and licences.scanned(df.where("false")).collect() == []
    pool = sorted(v.idf) + ["alpha", "beta", "gamma", "the"]
    texts = ["\n".join(" ".join(random.choice(pool) for _ in range(random.randrange(0, 12))) for _ in range(random.randrange(1, 4))) for _ in range(150)] + [t.upper() + " tail" for _, t in licences.TEMPLATES]
    got = {r.path: r for r in licences.matched(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")).collect()}
    for i, t in enumerate(texts):
        best = None
        for unit in set(t.split("\n")) | set(re.split(r"\n[ \t\r]*\n", t)):
            bag = collections.Counter(re.findall("[0-9a-z]+", unit.lower()))
            w = {k: n * v.idf.get(k, v.unseen) for k, n in bag.items()}
            size = math.sqrt(sum(x * x for x in w.values())) or 1
            for name, u in zip(v.names, v.unit):
                c = round(sum(w.get(k, 0) * x for k, x in u.items()) / size, 9)
                if c >= v.threshold and (best is None or (-c, name) < best):
                    best = (-c, name)
        assert (best is None) == (str(i) not in got)
        if best:
            assert got[str(i)].own == best[1] and math.isclose(got[str(i)].cosine, -best[0], abs_tol=1e-6)


def test_licences_of_documents_that_share_a_path(spark):
    texts = {0: "Released under the MIT License.", 1: "nothing", 2: "Licensed under the Apache License, Version 2.0.", 21: "nothing", None: "Licensed under CC BY-NC 4.0."}
    docs = spark.createDataFrame([(i, "one", t) for i, t in texts.items()] + [(None, "one", "nothing")], "doc_id long, source string, text string")
    out = licences.scanned(queries.document_files(docs), key_col="doc_id")
    got = sorted(((r.doc_id, r.path, r.own, r.licence, r.inherited_from) for r in out.collect()), key=str)
    assert got == sorted([
        (0, "one/0/LICENSE", "MIT", "MIT", None), (1, "one/0/LICENSE", None, "Apache-2.0", "one/0"), (2, "one/0/LICENSE", "Apache-2.0", "Apache-2.0", None),
        (21, "one/0/0/21.txt", None, "Apache-2.0", "one/0"), (None, "", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (None, "", None, None, None),
    ], key=str)


def test_licence_files_and_spdx_lines(spark):
    clauses = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice.", "2. Redistributions in binary form must reproduce the above copyright notice."]
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and "sublicense" in t)
    want = {
        "// SPDX-License-Identifier: MIT\ncode": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: Zlib": None,
        "Copyright (c) 2020 A\n\n" + mit: "MIT", "\n\n".join(clauses): "BSD-2-Clause", "\n\n".join([*clauses, third]): "BSD-3-Clause",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble": "GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nPreamble": "GPL-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
    }
    got = {int(r.path): r.own for r in licences.matched(spark.createDataFrame([(str(i), t) for i, t in enumerate(want)], "path string, text string")).collect()}
    assert [got.get(i) for i in range(len(want))] == list(want.values())
