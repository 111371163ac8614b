import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrill.functions import boxes as b
from quadrill.functions import labels as ls
from quadrill.functions import metrics as m
from quadrill.operators import grid as g
from quadrill.operators import hybrid as h
from quadrill.operators import search as s
from quadrill.operators.evaluate import effective_qps, timed
from quadrill.plans.cost import Path, return_selectivity, route, scan_work, startup_share
from quadrill.plans.options import IndexOptions, Settings
from quadrill.sources.loader import load_vectors, points


def value(spark, *columns, sql="SELECT 1 AS one"):
    return tuple(spark.sql(sql).select(*columns).first())


V = "SELECT array(1F, 2F, 2F) AS a, array(2F, 0F, 1F) AS b, array(0F, 0F, 0F) AS z, CAST(NULL AS ARRAY<FLOAT>) AS n, array(1F) AS short"


def test_metrics(spark):
    for other in ("b", [2.0, 0.0, 1.0]):
        found = value(spark, m.l2_squared("a", other), m.l2("a", other), m.dot("a", other), m.negative_inner_product("a", other), m.cosine("a", other), sql=V)
        assert found == pytest.approx((6, math.sqrt(6), 4, -4, 1 - 4 / math.sqrt(45)))
    assert value(spark, m.cosine("a", "a"), m.cosine("z", "a"), m.cosine("z", [1, 2, 2]), m.cosine("a", [0, 0, 0]), sql=V) == pytest.approx((0, 1, 1, 1), abs=1e-12)
    assert value(spark, m.l2("n", "a"), m.l2("a", "n"), m.cosine("n", [1, 2, 3]), m.dot("n", [1, 2, 3]), m.cosine("a", "n"), sql=V) == (None,) * 5
    unit, zero = value(spark, m.normalise("a"), m.normalise("z"), sql=V)
    assert unit == pytest.approx([1 / 3, 2 / 3, 2 / 3]) and zero == [0, 0, 0]
    assert value(spark, m.prefix("a", 2), m.zeros(2), sql=V) == ([1, 2], [0, 0])
    assert value(spark, m.hamming(F.array(F.lit(7), F.lit(-1)), F.array(F.lit(4), F.lit(0))), m.hamming(F.array(F.lit(7), F.lit(-1)), [4, 0])) == (66, 66)


@pytest.mark.parametrize("other", ["short", [1.0], [1.0, 2.0, 3.0, 4.0]])
@pytest.mark.parametrize("f", [m.l2, m.dot, m.cosine])
def test_sizes_must_agree(spark, f, other):
    with pytest.raises(Exception, match="components|index|INVALID_ARRAY"):
        value(spark, f("a", other), sql=V)


def test_long_queries_are_not_unrolled(spark):
    q = [float(k % 7) for k in range(m.UNROLL + 40)]
    sql = f"SELECT transform(sequence(1, {len(q)}), x -> CAST(x % 5 AS FLOAT)) AS a"
    a = [float((k + 1) % 5) for k in range(len(q))]
    assert value(spark, m.l2_squared("a", q), m.dot("a", q), sql=sql) == pytest.approx((sum((x - y) ** 2 for x, y in zip(a, q, strict=True)), sum(x * y for x, y in zip(a, q, strict=True))))


def test_metric_names():
    assert m.Metric.of("<=>") is m.Metric.of("cosine") is m.Metric.of(0) and m.Metric.of(2) is m.Metric.IP
    with pytest.raises(ValueError, match="unknown"):
        m.Metric.of("l1")


@pytest.mark.parametrize(
    ("a", "c", "met"),
    [([1, 2], [2, 3], True), ([1, 2], [3], False), ([], [1], False), ([None], [1], False), ([1, None], [1], True), ([1, None], [2], False), ([1, None], [None], False), ([32767, -32768], [-32768], True), (None, [1], False)],
)
def test_label_overlap(spark, a, c, met):
    df = spark.createDataFrame([(a, c)], "a array<smallint>, c array<smallint>")
    assert df.select(ls.overlap("a", "c"), ls.overlap("c", "a")).first() == (met, met)


def test_label_sets(spark):
    df = spark.createDataFrame([([3, 1, None, 3],), (None,), ([],), ([None],)], "l array<smallint>")
    assert [r[0] for r in df.select(ls.normalise("l")).collect()] == [[1, 3], [], [], []]
    df = spark.createDataFrame([([1, 2], [2, 3], [2, 4])], "h array<smallint>, a array<smallint>, b array<smallint>")
    assert df.select(ls.contains_intersection("h", "a", "b"), ls.contains_intersection("a", "h", F.array(F.lit(1)).cast(ls.TYPE))).first() == (True, False)


def test_boxes(spark):
    one = b.Box(0, 0, 1, 1)
    assert one.area == 1 and b.EMPTY.empty and b.EMPTY.area == 0 and b.EMPTY.including(2, 3) == b.Box(2, 3, 2, 3) and one.grown(1) == b.Box(-1, -1, 2, 2)
    df = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0), (1.1, 0.0, 2.0, 1.0), (0.2, 0.2, 0.3, 0.3), (1.0, 1.0, 0.0, 0.0)], "xmin double, ymin double, xmax double, ymax double")
    at = b.Columns.named()
    assert [tuple(r) for r in df.select(at.overlaps(one), one.columns().contains(at), at.empty(), at.area()).collect()] == [(True, False, False, 1.0), (False, False, False, pytest.approx(0.9)), (True, True, False, pytest.approx(0.01)), (False, True, True, 0.0)]
    assert value(spark, *b.Box(0, 0, 10, 0).columns().grown_by_share(0.1).select()) == pytest.approx((-1, -1e-6, 11, 1e-6))


def wkb(kind, body, order="<", z=False):
    return struct.pack(order + "BI", order == "<", kind + 1000 * z) + body


def test_wkb(spark):
    point = wkb(1, struct.pack("<2d", 3, 4))
    line = wkb(2, struct.pack("<I4d", 2, 0, 5, 1, -5))
    polygon = wkb(3, struct.pack("<II8d", 1, 4, 0, 0, 2, 0, 2, 2, 0, 0))
    cases = {
        point: (3, 4, 3, 4), line: (0, -5, 1, 5), polygon: (0, 0, 2, 2), wkb(1, struct.pack(">2d", 3, 4), ">"): (3, 4, 3, 4), wkb(1, struct.pack("<3d", 3, 4, 9), z=True): (3, 4, 3, 4),
        struct.pack("<BII2d", 1, 0x20000001, 4326, 5, 6): (5, 6, 5, 6), struct.pack("<BI3d", 1, 0x80000001, 5, 6, 7): (5, 6, 5, 6), wkb(7, struct.pack("<I", 2) + point + polygon): (0, 0, 3, 4),
        wkb(6, struct.pack("<I", 1) + polygon): (0, 0, 2, 2), wkb(1, struct.pack("<2d", math.nan, math.nan)): None, wkb(2, struct.pack("<I", 0)): None, b"": None, b"\x01\x02": None, None: None,
    }
    for data, want in cases.items():
        assert b.wkb_box(data) == want
    df = spark.createDataFrame([(k, d) for k, d in enumerate(cases)], "k int, g binary").select("k", *b.from_wkb("g").select()).orderBy("k")
    assert [tuple(r)[1:] for r in df.collect()] == [w or (None,) * 4 for w in cases.values()]


@pytest.mark.parametrize(("box", "n", "size"), [(b.Box(0, 0, 1, 1), 1000, (4, 4)), (b.Box(0, 0, 2, 1), 1000, (5, 3)), (b.Box(0, 0, 0, 0), 1000, (1, 1)), (b.Box(0, 0, 0, 1), 1000, (1, 10)), (b.Box(0, 0, 1, 0), 950, (10, 1)), (b.Box(0, 0, 1, 1), 5, (1, 1))])
def test_grid_sizes(box, n, size):
    grid = g.Grid.sized(box, n)
    assert (grid.cols, grid.rows) == size


def test_grid_cells(spark):
    grid = g.Grid(0, 0, 10, 10, 5, 5)
    assert grid.span(b.Box(1.9, 2, 4, 100)) == (0, 2, 1, 4) and grid.span(b.Box(-9, -9, -8, -8)) == (0, 0, 0, 0)
    df = points(spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 2.0, 2.0), (4, 99.0, -3.0)], "id long, x double, y double"), F.col("x"), F.col("y"), F.when(F.col("id") == 3, 0.5).otherwise(0.0))
    cells = {}
    for r in grid.postings(df, "id").collect():
        cells.setdefault(r.id, set()).add(r.cell)
    assert cells == {1: {0}, 2: {24}, 3: {0, 1, 5, 6}, 4: {4}}
    at = grid.postings(df, "id")
    assert sorted(r.id for r in g.ids_in_box(at, grid, b.Box(0, 0, 2, 2)).collect()) == [1, 3]
    assert g.candidate_count(at, grid, b.Box(0, 0, 2, 2)).first()[0] == 5 and g.candidate_count(at, grid, b.EMPTY).first()[0] == 0


@settings(max_examples=15, deadline=None)
@given(n=st.integers(1, 40), a_cell=st.integers(1, 12))
def test_seeds_are_at_even_steps(spark, n, a_cell):
    grid = g.Grid(0, 0, 1, 1, 1, 1)
    at = spark.range(n).select(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("col"), F.lit(0).alias("row"), "id")
    want = list(range(n)) if n <= a_cell else sorted({k * n // a_cell for k in range(a_cell)})
    assert sorted(r.id for r in g.seeds(at, grid, b.Box(0, 0, 1, 1), a_cell).collect()) == want


def test_partitions(spark):
    parts = g.Partitioner.over(b.Box(0, 0, 1, 1), 16)
    assert parts.grid.cols == parts.grid.rows == 4 and parts.grid.xmin == pytest.approx(-0.01)
    assert parts.overlapping(b.Box(0.1, 0.1, 0.3, 0.1)) == [0, 1] and parts.overlapping(b.Box(5, 5, 6, 6)) == []
    union = b.EMPTY
    for k in range(16):
        union = union.union(parts.box(k))
    assert union.area == pytest.approx(1.02**2)


def hybrid_rows(spark):
    return spark.createDataFrame([(1, 0.0, 0.0, [1.0, 0.0]), (2, 0.01, 0.0, [0.0, 1.0]), (3, 5.0, 5.0, [1.0, 0.1])], "pid long, x double, y double, e array<float>").transform(lambda d: points(d, F.col("x"), F.col("y")))


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_hybrid_functions(spark, metric):
    df, own = hybrid_rows(spark), {"metric": metric, "id": "pid", "embedding": "e"}
    assert [r.row_id for r in h.hybrid_dwithin(df, 0, 0, 0.02, [1.0, 0.0], **own).collect()] == ["1", "2"]
    assert [r.row_id for r in h.hybrid_bbox(df, b.Box(-1, -1, 9, 9), [1.0, 0.0], 2, **own).collect()] == ["1", "3"]
    assert [r.row_id for r in h.hybrid_bbox(df, b.Box(-1, -1, 9, 9), [1.0, 0.0], 9, 2, **own).collect()] == ["1", "2"]
    for bad in ({"k": 0}, {"candidate_limit": 0}):
        with pytest.raises(ValueError, match="positive"):
            h.hybrid_bbox(df, b.Box(0, 0, 1, 1), [1.0, 0.0], **bad, **own)
    with pytest.raises(ValueError, match="negative"):
        h.hybrid_dwithin(df, 0, 0, -1, [1.0, 0.0], **own)


def test_search_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id long, embedding array<double>")
    assert [r.id for r in s.search(df, [1.0, 0.0], None).collect()] == [1, 4, 3]
    assert sorted(r.id for r in s.search(df, None, None).collect()) == [1, 3, 4] and s.search(df.limit(0), [1.0, 0.0]).collect() == []
    with pytest.raises(ValueError, match="positive"):
        s.search(df, [1.0, 0.0], 0)


def test_index_options():
    assert IndexOptions().resolved(64).num_bits_per_dimension == 2 and IndexOptions().resolved(900).num_bits_per_dimension == 1
    assert IndexOptions(storage_layout="bq_compression").storage_layout == "memory_optimized" and IndexOptions().resolved(64).num_neighbors == 50
    assert IndexOptions(num_dimensions=10).resolved(64).num_dimensions == 10
    bad = [({"num_neighbors": 9}, None), ({"search_list_size": 1001}, None), ({"max_alpha": 0.9}, None), ({"num_dimensions": 5001}, None), ({"num_bits_per_dimension": 33}, None), ({"storage_layout": "x"}, None)]
    bad += [({"metric": "ip", "storage_layout": "plain"}, 8), ({"storage_layout": "plain"}, 2001), ({}, 16001), ({}, 0), ({"num_bits_per_dimension": 2}, 931), ({"num_bits_per_dimension": 2, "storage_layout": "plain"}, 8), ({"num_dimensions": 9}, 8)]
    for options, dims in bad:
        with pytest.raises(ValueError, match=r"."):
            IndexOptions(**options).resolved(8 if dims is None else dims)
    with pytest.raises(ValueError, match="labels"):
        IndexOptions(storage_layout="plain").resolved(8, labels=True)
    with pytest.raises(ValueError, match="query_rescore"):
        Settings(query_rescore=1001)


def test_costs():
    assert route(None, 5) is Path.GRAPH and route(5, 5) is Path.BRUTE and route(6, 5) is Path.HYBRID
    small, large = scan_work(10_000, k=20), scan_work(300_000, k=20)
    assert small.path is large.path is Path.GRAPH and 100 < small.tuples < large.tuples < 3000
    tiny, narrow, wide = (scan_work(318_375, x, 20) for x in (2000 / 318_375, 0.06, 0.57))
    assert tiny.path is Path.BRUTE and tiny.tuples == pytest.approx(2000) and narrow.path is wide.path is Path.HYBRID
    assert tiny.tuples > narrow.tuples < wide.tuples > scan_work(318_375, k=20).tuples
    assert return_selectivity(100_000, 20) == 2e-4 and return_selectivity(100, 20, 5) == 0.05 and return_selectivity(10, None) == 0.1
    assert startup_share(1, 1e9) == pytest.approx(math.sqrt(0.05)) and startup_share(5, 5) == 1


def test_install(spark):
    assert h.install(spark) is True
    assert spark.sql("SELECT quadrill_l2_distance(array(0D, 3D), array(4D, 0D)) AS d, quadrill_cosine_distance(array(0D), array(1D)) AS c").first() == (5.0, 1.0)
    with pytest.raises(Exception, match="size"):
        spark.sql("SELECT quadrill_l2_distance(array(0D), array(4D, 0D))").collect()


def test_loader(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0], bytearray(wkb(1, struct.pack("<2d", 3, 4))), [2, 1, 2]), (None, None, None)], "embedding array<double>, geometry binary, labels array<smallint>")
    df.coalesce(1).write.parquet(f"{tmp_path}/v")
    got = load_vectors(spark, f"{tmp_path}/v", labels="labels", dims=2).orderBy("id").collect()
    assert (got[0].xmin, got[0].ymax, got[0].labels, got[1].xmin, got[1].labels) == (3, 4, [1, 2], None, [])
    with pytest.raises(Exception, match="components"):
        load_vectors(spark, f"{tmp_path}/v", dims=3).collect()


def test_evaluation(spark):
    assert effective_qps(20, 20, 43.3) == pytest.approx(23.09, abs=0.01) and effective_qps(13, 20, 40.3) == pytest.approx(16.1, abs=0.05)
    assert len(timed(lambda: spark.range(3), 2)) == 2
