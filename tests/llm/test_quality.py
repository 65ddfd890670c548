"""The hinge-loss solver against a reference, the score against its definition, and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cindersift.llm import quality
from cindersift.llm.hashing import utf8


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient steps on the whole dual, a plain and slow solver."""
    r = np.random.default_rng(3)
    n, d = 60, 8
    x = r.normal(size=(n, d))
    y = np.where(x @ r.normal(size=d) + r.normal(size=n) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 0.4)
    rows = [(np.arange(d), v) for v in x]
    epochs, quality.EPOCHS = quality.EPOCHS, 3000
    try:
        w, bias = quality._svm(rows, y, cost, d)
    finally:
        quality.EPOCHS = epochs
    z = np.column_stack([x, np.ones(n)]) * y[:, None]
    q = z @ z.T
    alpha, step = np.zeros(n), 1 / np.linalg.norm(q, 2)
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    best = z.T @ alpha
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - z @ v)).sum()
    assert value(np.append(w, bias)) == pytest.approx(value(best), rel=1e-3)
    assert np.append(w, bias) == pytest.approx(best, abs=2e-2)


def test_score_is_the_scaled_unit_length_margin():
    random.seed(1)
    good, bad = "calm river stone light garden".split(), "click buy now cheap win".split()
    texts = [" ".join(random.choice(g) for _ in range(random.randrange(3, 30))) for g in [good, bad] * 40]
    x, at = quality.features(*utf8(pa.array(texts)))
    rows = [x[lo:hi].astype(np.int64) for lo, hi in zip(at, at[1:])]
    model = quality.fitted(rows, np.array([1, 0] * 40))
    got = model.score(x, at)
    for row, s in zip(rows, got):
        margin = model.weights[row].sum() / np.sqrt(model.squares[row].sum()) + model.bias
        assert s == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-9)
    assert (got[::2] > 0.5).all() and (got[1::2] < 0.5).all()


def test_odd_inputs(spark):
    random.seed(2)
    good, bad = "calm river stone light garden".split(), "click buy now cheap win".split()
    texts = [(i, " ".join(random.choice(bad if i % 2 else good) for _ in range(20))) for i in range(200)]
    odd = [(1000, None), (1001, ""), (None, texts[0][1]), (1002, "stone " * 60_000), (3, texts[3][1]), (3, texts[3][1])]
    docs = spark.createDataFrame([(i, t, 0.25) for i, t in texts + odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in texts] + [(None, 1), (5, None), (9999, 0), (7, 0)], "doc_id long, quality int")
    model = quality.trained(docs, labels)
    out = quality.scored(docs, model, score_col="own")
    assert out.columns == ["doc_id", "text", "score", "own"] and out.count() == len(texts) + len(odd)
    rows = out.collect()
    assert all(0 <= r.own <= 1 for r in rows) and len({r.own for r in rows if r.doc_id in (1000, 1001)}) == 1
    assert len({r.own for r in rows if r.doc_id == 3}) == 1
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and all((r.own > 0.5) == (r.doc_id % 2 == 0) for r in held)
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.own >= quality.THRESHOLD for r in rows)
    none = quality.trained(docs, labels.where("false"))
    assert {r.own for r in quality.scored(docs, none, score_col="own").collect()} == {0.5}
    assert quality.scored(docs.where("false"), model, score_col="own").collect() == []
