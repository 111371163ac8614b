import math
import zlib

import numpy as np
import pytest

from quadrill.llm import quality

GOOD, BAD = "A calm sentence about rivers and hills, with several plain words. ", "BUY%%% now*** CHEAP!! pills$$$ "


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_features_of_odd_texts():
    x, first = quality.features([None, "", "one", "é" * 3000, " "])
    assert first.tolist() == [0, 1, 2, 3, 13] and len(x) == 14 and np.isfinite(x).all()
    alone, _ = quality.features(["é" * 3000])
    assert np.allclose(alone, x[3:13])
    assert (quality.features([""])[0] == x[0]).all() and (quality.features([" ", "!"])[0][0] == x[13]).all()


def test_gradients():
    rng = np.random.default_rng(1)
    x, first, y = rng.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([1, 0, 1])
    model = quality.Model.start(x.astype(np.float32))
    for k in model.LEARNED:
        setattr(model, k, getattr(model, k).astype(np.float64))
    weight = np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.forward(x, first)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    found = model.gradients(model.forward(x, first), y, weight, 0.0)
    for k in model.LEARNED:
        w = getattr(model, k)
        for at in list(np.ndindex(w.shape))[:6]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert found[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def scalar_score(model, x):
    """One document by plain loops: passages encoded, gated attention, score of the weighted sum."""
    m = {f: getattr(model, f).astype(float).tolist() for f in ("mean", "scale", "encode", "encode_b", "tanh", "gate", "attend", "out", "out_b")}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    dot = lambda v, w, j: sum(a * row[j] for a, row in zip(v, w, strict=True))
    hidden, scores = [], []
    for passage in x.astype(float).tolist():
        z = [(a - b) / c for a, b, c in zip(passage, m["mean"], m["scale"], strict=True)]
        h = [max(0.0, dot(z, m["encode"], j) + b) for j, b in enumerate(m["encode_b"])]
        hidden.append(h)
        scores.append(sum(a * math.tanh(dot(h, m["tanh"], j)) * sigmoid(dot(h, m["gate"], j)) for j, a in enumerate(m["attend"])))
    weights = [math.exp(s - max(scores)) for s in scores]
    pooled = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(hidden[0]))]
    return sigmoid(sum(a * b for a, b in zip(pooled, m["out"], strict=True)) + m["out_b"][0])


def test_scores_against_plain_loops(spark):
    rows = [(k, (GOOD, BAD, GOOD + BAD)[k % 3] * (1 + k % 12)) for k in range(90)] + [(200, ""), (201, "é" * 2000)]
    known = [(k, int(k % 3 != 1), 0) for k in range(90)]
    table, truth = docs(spark, rows), labels(spark, known)
    model = quality.learn(table, truth)
    got = {r.doc_id: r for r in quality.classify(table, truth).collect()}
    for one, text in rows:
        want = scalar_score(model, quality.features([text])[0])
        assert got[one].score == pytest.approx(want, abs=2e-6) and got[one].predicted == int(got[one].score >= 0.5)


def test_learning_against_a_plain_descent(spark):
    """The fit ends no worse than a plain gradient descent of many small steps."""
    rng = np.random.default_rng(2)
    x, first = rng.normal(size=(60, 6)).astype(np.float32), np.arange(0, 60, 3)
    y = (x.reshape(20, 3, 6).max(axis=1)[:, 0] > 0.8).astype(int)
    weight = np.ones(20)

    def loss(m):
        p = np.clip(m.forward(x, first)["p"], 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    plain = quality.Model.start(x)
    for _ in range(400):
        for k, g in plain.gradients(plain.forward(x, first), y, weight, 0.0).items():
            setattr(plain, k, getattr(plain, k) - 0.1 * g)
    assert loss(quality.Model.start(x).wide().fit(x, first, y, weight)) <= loss(plain) + 0.05


def test_ties_and_bounds_of_the_sample(spark):
    """Equal texts have equal scores in any batch; rows of one id are documents each, within the bounds."""
    rows = [(k, (GOOD, BAD)[k % 2] * 3) for k in range(60)] + [(0, GOOD), (0, GOOD * 2), (0, GOOD), (2, BAD)] * 5
    known = [(k, 1 - k % 2, 0) for k in range(60)]
    table, truth = docs(spark, rows), labels(spark, known)
    for options in ({}, {"sample": 6}):
        got = quality.classify(table.repartition(7), truth, **options).collect()
        scores = {}
        for r in got:
            scores.setdefault(dict(rows[:60]).get(r.doc_id) if r.doc_id >= 3 else None, set()).add(r.score)
        assert all(len(s) == 1 for t, s in scores.items() if t)
    model = quality.learn(table, truth, sample_mb=1e-6)
    assert model is not None


def test_odd_rows(spark):
    rows = [(k, (GOOD, BAD)[k % 4 == 0] * (1 + k % 5)) for k in range(120)]
    known = [(k, int(k % 4 != 0), 0) for k in range(120)] + [(3, 1, 1), (None, 1, 0), (900, None, None), (5000, 0, 0)]
    odd = [(900, None), (901, ""), (902, GOOD * 3000), (3, GOOD), (None, BAD)]
    got = quality.classify(docs(spark, rows + odd), labels(spark, known)).collect()
    assert len(got) == 125 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 120)
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1 and by[None].predicted == 0 and by[900].score == by[901].score


def test_nothing_to_learn_from(spark):
    assert [r.score for r in quality.classify(docs(spark, [(1, GOOD)]), labels(spark, [(1, 1, 0)])).collect()] == [0.5]
    assert quality.classify(docs(spark, []), labels(spark, [])).collect() == []


def test_query_accuracy(spark):
    from quadrill.llm.queries import op3_quality_classifier

    sf_dir = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op3_quality_classifier(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert held and sum(r.predicted == known[r.doc_id] for r in held) >= 0.97 * len(held)
