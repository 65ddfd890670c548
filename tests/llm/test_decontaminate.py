"""Retrieval and verification against exhaustive BM25 in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from cindersift.llm import decontaminate

rng = random.Random(5)
COMMON, RARE = ["c%d" % i for i in range(12)], ["r%d" % i for i in range(600)]


def prose(n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else rng.choice(RARE) for _ in range(n))


def split(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(words, k):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def exhaustive(docs, items):
    """{(doc, item): (score, question share, answer share)} by scoring every window against every unit."""
    units = []
    for item, q, a in items:
        q, a = split(q), split(a)
        whole = q + a
        for i in [*range(0, max(len(whole) - 128, 0), 128), max(len(whole) - 128, 0)] if whole else []:
            part = whole[i : i + 128]
            n = min(max(len(q) - i, 0), len(part))
            units.append((item, part, part[:n], part[n:]))
    df = Counter(w for u in units for w in set(u[1]))
    mean, size = sum(len(u[1]) for u in units) / len(units), max(len(u[1]) for u in units)
    found = {}
    for doc, text in docs:
        w = split(text)
        for lo in range(0, max(1, -(-(len(w) - size) // size)) * size if w else 0, size):
            window = w[lo : lo + 2 * size]
            for item, part, q, a in units:
                impact = {x: math.log1p((len(units) - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(part) / mean)) for x, c in Counter(part).items()}
                score = round(sum(v for x, v in impact.items() if x in set(window)) / sum(impact.values()), 9)
                if score < decontaminate.THRESHOLD:
                    continue
                shares = [len(grams(p, k) & grams_of(window, min(k, len(p)))) / len(grams(p, k)) if p else 2.0 for p, k in ((q, 5), (a, 3))]
                if shares[0] >= 0.5 and shares[1] >= 0.3:
                    found[doc, item] = max(found.get((doc, item), (0.0,)), (score, *shares))
    return found


def grams_of(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def corpus():
    items = [(i, prose(rng.randrange(1, 60)), prose(rng.randrange(0, 9))) for i in range(60)] + [(70, prose(300), None), (71, None, prose(12)), (72, "", ""), (73, "Éa-b", None), (None, prose(9), None)]
    items += [items[5], (74, items[6][1], items[6][2])]
    docs = [(i, prose(rng.randrange(0, 500))) for i in range(30)] + [(100, None), (101, ""), (102, " .\n"), (None, (items[8][1] + " ") * 3)]
    for i, (_, q, a) in enumerate(items[:64]):
        w = split((q or "") + " " + (a or ""))
        docs.append((200 + i, prose(rng.randrange(150)) + " " + " ".join(w).upper() + ", " + prose(rng.randrange(150))))
        docs.append((300 + i, prose(40) + " " + " ".join(w[: 2 * len(w) // 3]) + " " + prose(40)))
        for j in rng.sample(range(len(w)), min(len(w), 3)):
            w[j] = "x"
        docs.append((400 + i, " ".join(w)))
    return docs + [docs[-1]], items


@pytest.mark.parametrize("slice_", [1_000_000, 700])
def test_equals_exhaustive_bm25(spark, monkeypatch, slice_):
    monkeypatch.setattr(decontaminate, "SLICE", slice_)
    docs, items = corpus()
    want = exhaustive(docs, [x for x in dict.fromkeys(items) if x[0] is not None])
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    b = spark.createDataFrame(items, "item_id long, question string, answer string")
    rows = decontaminate.leaks(d, b, question_col="question", answer_col="answer").collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert set(got) == set(want) and len(want) > 100
    for key, (score, q, a) in want.items():
        r = got[key]
        assert math.isclose(r.score, score, abs_tol=1e-9) and (r.question_overlap if r.question_overlap is not None else 2.0) == pytest.approx(q) and (r.answer_overlap if r.answer_overlap is not None else 2.0) == pytest.approx(a)
    assert len(rows) == len(want) + sum(k[0] == docs[-1][0] for k in want)  # the repeated row repeats its result
    kept = decontaminate.decontaminated(d, b, question_col="question", answer_col="answer")
    assert kept.columns == d.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in {k[0] for k in want})


def test_two_thirds_of_an_item_without_an_answer(spark):
    text = prose(60)
    d = spark.createDataFrame([(1, prose(80) + " " + " ".join(text.split()[:40]) + " " + prose(80)), (2, prose(200))], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(d, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()] == [1]
    assert decontaminate.leaks(d.where("false"), spark.createDataFrame([(7, text)], "item_id long, text string")).collect() == []


def test_index_of_many_items_is_small():
    import pickle

    import numpy as np

    r = np.random.default_rng(1)
    units = [(i, r.integers(0, 1 << 62, 40, dtype=np.uint64), 40, 0) for i in range(4096)]
    index = decontaminate.Index(units, Counter(x for u in units for x in set(u[1].tolist())), 4096, 40.0, 40)
    assert len(pickle.dumps(index)) < 40 << 20
