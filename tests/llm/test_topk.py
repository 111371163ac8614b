import numpy as np
import pytest

from quadrill.llm import topk


def brute(rows, every=100, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for row, (one, q) in enumerate(good):
        if one % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), i) for at, (i, w) in enumerate(good) if at != row and len(w) == len(q))
            out += [(one, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, norm int")
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_random(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "ROUND_MB", 0.001)
    monkeypatch.setattr(topk, "FIRST", 40)
    monkeypatch.setattr(topk, "PILOT", 9)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 6)) * np.exp(rng.normal(size=(600, 1)))
    v[300:340] = v[0] * rng.uniform(0.9, 1, size=(40, 1))  # near one direction: coordinates prune
    rows = [(k, (x * scale).tolist()) for k, x in enumerate(v)]
    assert run(spark, rows, every=20) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, float("nan")]), (200, None), (300, [0.0, 0.0]), (1, [1.0, None]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, float("inf")]), (5, [1.0]), (400, [2.0]), (None, [1.0, 1.0]), (6, []), (500, []), (7, [-3.0, 1.0]), (0, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0])]) == []


def test_repeated_ids_are_queries_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (200, [1.0, 1.0]), (200, [1.0, 1.0])]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 4 * 5 and (100, 1, 1, 2 << 20) in got and (200, 1, 2, 3 << 20) in got


def test_query(spark):
    from quadrill.llm.queries import op2_exact_top_k

    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in op2_exact_top_k(spark, "/root/testdata/sf0.001").collect()) == brute(rows)


def test_products_beyond_doubles_and_longs(spark):
    assert run(spark, [(0, [1e9]), (1, [-2e9]), (2, [3e9])]) == [(0, 1, 2, 2**63 - 1), (0, 2, 1, -(2**63))]
    a, b = np.array([[3_000_000_001, 1]]), np.array([2_000_000_001, 5])
    assert topk.products(a, b, 2.0**62).tolist() == [3_000_000_001 * 2_000_000_001 + 5]
