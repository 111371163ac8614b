"""Every registered query of the core against its SQL in another engine."""

import math
import os
import sys

import duckdb
import numpy as np
import pytest

from quadrill import index_queries  # noqa: F401  (registers its queries)
from quadrill import queries as core

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    found = duck.execute(core.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    right = plain([tuple(dict(zip(columns, r, strict=True))[c] for c in order) for r in found.fetchall()])
    assert plain([tuple(r[c] for c in order) for r in df.collect()]) == right


@pytest.mark.parametrize("name", ["index_sink_counts", "grid_seeds_with_overflow"])
def test_same_rows_beyond_the_compact_threshold(spark, duck, name):
    """Queries on an overflow find one however many rows are in it."""
    key = "spark.quadrill.spatial_overflow_compact_threshold"
    spark.conf.set(key, "50")
    try:
        test_same_rows(spark, duck, name)
    finally:
        spark.conf.unset(key)


def written(spark, monkeypatch, tmp_path, rows):
    """An engine over a table of these embeddings, on which ``test_same_rows`` runs as well."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(sys.modules[__name__], "SF", str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return con


def test_recall_of_a_query_without_a_hit(spark, monkeypatch, tmp_path):
    """What is near to 1 comes after the first 300 candidates; 4 and 5 are not there."""
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=4) + (10 if k == 1 or k > 600 else 0)).tolist(), 0) for k in range(900) if k not in (4, 5)]
    test_same_rows(spark, written(spark, monkeypatch, tmp_path, rows), "recall_over_queries")
    assert {r.q for r in core.QUERIES["recall_over_queries"](spark, SF).collect()} == {2, 3}


def test_every_point_of_a_graph_is_reached(spark, monkeypatch, tmp_path):
    """Groups of equal and of nearly equal vectors, in which pruning leaves points without a link."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 64))
    rows = [(k, (centres[k % 20] + rng.normal(size=64) * 0.02 * (k % 20 < 10)).tolist(), 0) for k in range(1200)]
    test_same_rows(spark, written(spark, monkeypatch, tmp_path, rows), "graph_reachability")


def test_rescored_beyond_the_nearest_codes(spark, monkeypatch, tmp_path):
    """More rows share the query's code than are rescored at first, and nearer ones have other codes."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=2).tolist(), 0) for k in range(8000)]
    test_same_rows(spark, written(spark, monkeypatch, tmp_path, rows), "sbq_rescore_topk")


@pytest.mark.parametrize(("name", "truth", "least"), [("ann_graph_topk", "topk_cosine", 18), ("ann_graph_label_topk", "topk_label", 16), ("hybrid_seeded_topk", "topk_bbox_cosine", 16), ("sbq_hamming_topk", "topk_cosine", 5), ("index_graph_topk", "topk_cosine", 18), ("index_hybrid_topk", "topk_bbox_cosine", 18)])
def test_recall(spark, name, truth, least):
    right = {r.id for r in core.QUERIES[truth](spark, SF).collect()}
    found = {r.id for r in core.QUERIES[name](spark, SF).collect()}
    assert len(found) == len(right) and len(found & right) >= least


def test_every_query_is_checked():
    assert set(core.QUERIES) - set(core.SQL) == {"ann_graph_topk", "ann_graph_label_topk", "hybrid_seeded_topk", "sbq_hamming_topk", "index_graph_topk", "index_hybrid_topk"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(core.QUERIES) <= set(e.queries())
