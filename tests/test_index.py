import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrill.functions.boxes import Box, Columns
from quadrill.operators import graph as graphs
from quadrill.operators import search as s
from quadrill.operators.index import SpatialIndex
from quadrill.plans.cost import Path
from quadrill.plans.options import IndexOptions, Settings
from quadrill.sources.manifest import Conflict, Manifests, upgraded
from quadrill.streaming.ingest import arrivals, ingest

BOX = Box(0.2, 0.2, 0.6, 0.6)
EXACT = Settings(query_rescore=0)


def rows(spark, n=300, start=0, dims=8, seed=1, null_every=0):
    rng = np.random.default_rng(seed)
    data = []
    for k in range(start, start + n):
        x, y, v = *rng.uniform(0, 1, 2).tolist(), rng.normal(size=dims).tolist()
        half = 0.01 * (k % 3)
        box = (1.0, 1.0, -1.0, -1.0) if k % 50 == 49 else (x - half, y - half, x + half, y + half)
        data.append((k, None if null_every and k % null_every == 0 else v, *box, None if k % 11 == 0 else [k % 5, 7], f"row {k}"))
    return spark.createDataFrame(data, "id long, embedding array<float>, xmin double, ymin double, xmax double, ymax double, labels array<smallint>, name string")


def truth(df, query, k, metric, box=None, labels=None):
    out = []
    for r in df.collect():
        if r.embedding is None or box and not (r.xmin <= r.xmax and r.xmin <= box.xmax and r.xmax >= box.xmin and r.ymin <= box.ymax and r.ymax >= box.ymin):
            continue
        if labels is not None and not set(labels) & set(r.labels or ()):
            continue
        a, b = np.array(r.embedding, float), np.array(query)
        d = {"l2": np.linalg.norm(a - b), "ip": -a @ b, "cosine": 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)}[metric]
        out.append((round(d, 9), r.id))
    return [i for _, i in sorted(out)[:k]]


def ids(df):
    return [r.id for r in df.collect()]


Q = np.random.default_rng(9).normal(size=8).tolist()


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_build_and_search(spark, tmp_path, metric):
    df = rows(spark, null_every=7)
    index = SpatialIndex.build(df, f"file://{tmp_path}/i", IndexOptions(metric=metric), labels="labels")
    for options in ({}, {"box": BOX}, {"labels": [1, 2]}, {"box": BOX, "labels": [7]}, {"labels": []}, {"box": Box(3, 3, 4, 4)}):
        assert ids(index.search(Q, 10, settings=EXACT, **options)) == truth(df, Q, 10, metric, **options)
    found = index.search(Q, 10, settings=Settings(query_rescore=200, query_search_list_size=100))
    assert len(set(ids(found)) & set(truth(df, Q, 10, metric))) >= 9 and found.columns == df.columns + ["distance"]
    assert len(ids(index.search(None, None))) == df.where("embedding is not null").count()


def test_search_is_exact_by_default(spark, tmp_path):
    df = rows(spark, 3000).localCheckpoint()
    index = SpatialIndex.build(df, f"file://{tmp_path}/i", IndexOptions(), labels="labels")
    small = Settings(spatial_brute_force_threshold=1)
    assert index.path_of(BOX, small) is Path.HYBRID
    for k in (20, 150):
        assert ids(index.search(Q, k)) == truth(df, Q, k, "cosine")
        assert ids(index.search(Q, k, box=BOX, settings=small)) == truth(df, Q, k, "cosine", BOX)


def test_routes(spark, tmp_path):
    index = SpatialIndex.build(rows(spark), f"file://{tmp_path}/i", IndexOptions(storage_layout="plain"))
    n = index.candidates(BOX)
    assert n >= rows(spark).where(Columns.named().overlaps(BOX)).count() > 0 and index.candidates(Box(1, 1, 0, 0)) == 0
    assert index.path_of(None) is Path.GRAPH
    assert index.path_of(BOX, Settings(spatial_brute_force_threshold=n)) is Path.BRUTE
    assert index.path_of(BOX, Settings(spatial_brute_force_threshold=n - 1)) is Path.HYBRID
    spark.conf.set("spark.quadrill.spatial_brute_force_threshold", "1")
    assert index.path_of(BOX) is Path.HYBRID
    spark.conf.unset("spark.quadrill.spatial_brute_force_threshold")
    with pytest.raises(ValueError, match="no labels"):
        index.search(Q, labels=[1])


def test_changes(spark, tmp_path):
    df, path = rows(spark), f"file://{tmp_path}/i"
    index = SpatialIndex.build(df, path, labels="labels")
    more = rows(spark, 60, 1000, seed=2, null_every=10)
    far = more.where("id = 1001").withColumns({c: F.col(c) + 50 for c in ("xmin", "xmax", "ymin", "ymax")})
    index.insert(more.where("id <> 1001").unionByName(far))
    assert index.manifest["overflow_rows"] > 0
    live = df.unionByName(more.where("id <> 1001 and embedding is not null")).unionByName(far)
    assert ids(index.search(Q, 15, settings=EXACT)) == truth(live, Q, 15, "cosine")
    assert ids(index.search(Q, 15, box=BOX, settings=EXACT)) == truth(live, Q, 15, "cosine", BOX)
    assert ids(index.search(Q, 5, box=Box(40, 40, 60, 60), settings=EXACT)) == [1001]
    dead = live.where("id % 4 = 0").select("id")
    before = index.candidates(BOX)
    index.delete(dead)
    assert index.candidates(BOX) == before  # the dead are counted until a compaction
    live = live.where("id % 4 <> 0")
    assert ids(index.search(Q, 15, settings=EXACT)) == truth(live, Q, 15, "cosine")
    new = rows(spark, 40, 100, seed=3).withColumn("embedding", F.when(F.col("id") % 8 != 1, F.col("embedding")))
    index.update(new)
    live = live.join(new.select("id"), "id", "left_anti").unionByName(new)
    assert sorted(ids(index.rows())) == sorted(ids(live.where("embedding is not null")))
    assert ids(index.search(Q, 15, settings=EXACT)) == truth(live, Q, 15, "cosine")
    index.vacuum()
    assert index.manifest["overflow_rows"] == 0 and index.candidates(BOX) < before and index.grid.xmax > 50
    version = index.manifest["version"]
    assert index.vacuum().manifest["version"] == version
    index.reindex()
    assert index.manifest["tombstones"] == [] and len(index.manifest["base"]) == 1
    assert ids(index.search(Q, 15, box=BOX, labels=[1, 7], settings=EXACT)) == truth(live, Q, 15, "cosine", BOX, [1, 7])
    old = SpatialIndex(spark, path, 1)
    assert sorted(ids(old.rows())) == sorted(ids(df))
    with pytest.raises(Conflict):
        old.delete(dead)


def test_compacts_at_the_threshold(spark, tmp_path):
    index = SpatialIndex.build(rows(spark, 50), f"file://{tmp_path}/i")
    index.insert(rows(spark, 30, 100), Settings(spatial_overflow_compact_threshold=1000))
    assert index.manifest["overflow_rows"] > 0
    index.insert(rows(spark, 30, 200), Settings(spatial_overflow_compact_threshold=20))
    assert index.manifest["overflow_rows"] == 0 and len(ids(index.rows())) == 110


def test_empty_then_filled(spark, tmp_path):
    index = SpatialIndex.build(rows(spark, 5).limit(0), f"file://{tmp_path}/i", IndexOptions(storage_layout="plain"))
    assert ids(index.search(Q, 3)) == []
    with pytest.raises(Exception, match="components"):
        index.insert(rows(spark, 5, dims=9))


def test_other_sizes_are_refused(spark, tmp_path):
    index = SpatialIndex.build(rows(spark, 20), f"file://{tmp_path}/i")
    with pytest.raises(Exception, match="components"):
        index.insert(rows(spark, 5, 50, dims=9))
    with pytest.raises(Exception, match="components|INVALID_ARRAY"):
        index.search([1.0] * 9, 3, settings=EXACT).collect()


def test_box_filter_reaches_the_scan(spark, tmp_path, capsys):
    index = SpatialIndex.build(rows(spark), f"file://{tmp_path}/i")
    index.search(Q, 5, box=BOX, settings=EXACT).select("id", "distance").explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(xmin,0.6)" in plan and "GreaterThanOrEqual(ymax,0.2)" in plan and "TakeOrderedAndProject" in plan
    assert "name" not in plan.split("ReadSchema")[1].split("\n")[0]
    # The ids that the postings name are sent to the table, which is not shuffled.
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "postings" in plan and plan.count("BroadcastExchange") >= 1


def test_update_is_one_version(spark, tmp_path):
    index = SpatialIndex.build(rows(spark, 40), f"file://{tmp_path}/i")
    before = index.manifest["version"]
    index.update(rows(spark, 10, 35, seed=4))
    assert index.manifest["version"] == before + 1 and sorted(r.id for r in index.rows().collect()) == list(range(45))
    assert index.rows().where("id >= 35").count() == 10


def test_compaction_leaves_one_folder(spark, tmp_path):
    index, df = SpatialIndex.build(rows(spark, 60), f"file://{tmp_path}/i"), rows(spark, 20, 60, seed=3)
    index.insert(df).delete(df.where("id % 2 = 0").select("id")).insert(df.where("id % 4 = 0").withColumn("extra", F.lit(1)))
    assert len(index.manifest["base"]) == 3
    want = sorted(r.id for r in index.rows().collect())
    assert want == [*range(60), *(k for k in range(60, 80) if k % 4 == 0 or k % 2)]
    index.compact()
    assert (len(index.manifest["base"]), index.manifest["tombstones"], index.manifest["overflow_rows"]) == (1, [], 0)
    assert sorted(r.id for r in index.rows().collect()) == want and index.rows().where("extra = 1").count() == 5
    assert ids(index.search(Q, 10)) == truth(index.rows(), Q, 10, "cosine")
    assert sorted(r.id for r in index.fetch(spark.createDataFrame([(1,), (61,), (62,), (999,)], "id long")).collect()) == [1, 61]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """12,000 rows around some centres, as embeddings are, two graph shards."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 24))
    data = []
    for k in range(12000):
        x, y = rng.uniform(0, 1, 2).tolist()
        v = centres[rng.integers(60)] + 0.6 * rng.normal(size=24)
        data.append((k, v.tolist(), x - 0.005, y - 0.005, x + 0.005, y + 0.005, [k % 5, k * 3 % 7 + 5], ""))
    df = spark.createDataFrame(data, "id long, embedding array<float>, xmin double, ymin double, xmax double, ymax double, labels array<smallint>, name string").repartition(8)
    path = f"file://{tmp_path_factory.mktemp('large')}/i"
    index = SpatialIndex.build(df, path, IndexOptions(num_neighbors=24, search_list_size=64), labels="labels", graph=True, shard_rows=6000)
    return index, [(r[0], np.array(r[1]), r[2:6], set(r[6])) for r in data], rng


def _hits(index, data, query, settings, box=None, labels=None):
    unit = query / np.linalg.norm(query)
    near = sorted((-(v @ unit) / np.linalg.norm(v), i) for i, v, b, own in data if (box is None or b[0] <= box.xmax and b[2] >= box.xmin and b[1] <= box.ymax and b[3] >= box.ymin) and (labels is None or own & set(labels)))
    found = index.search(query.tolist(), 20, box=box, labels=labels, settings=settings).collect()
    return len({i for _, i in near[:20]} & {r.id for r in found})


@pytest.mark.parametrize(("options", "least"), [({}, 18), ({"box": Box(0.2, 0.1, 0.7, 0.7)}, 18), ({"labels": [2]}, 18), ({"box": Box(0.2, 0.1, 0.7, 0.7), "labels": [2, 7]}, 16)])
def test_recall_of_stored_graphs(large, options, least):
    """Lists of 100 among 12,000 rows, over 20 queries."""
    index, data, rng = large
    settings = Settings(query_search_list_size=100, spatial_brute_force_threshold=100)
    assert index.path_of(options.get("box"), settings) is (Path.HYBRID if "box" in options else Path.GRAPH)
    hits = [_hits(index, data, data[int(k)][1] + 0.1, settings, **options) for k in rng.integers(0, 12000, 20)]
    assert np.mean(hits) >= least and min(hits) >= least - 4


def test_graph_search_shuffles_no_graph(large):
    index, data, _ = large
    plan = index._walked(Path.GRAPH, data[0][1].tolist(), 20, None, None, Settings())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInPandas" in plan


def test_changes_beside_graphs(spark, tmp_path):
    df = rows(spark, 400)
    index = SpatialIndex.build(df, f"file://{tmp_path}/i", IndexOptions(num_neighbors=16), labels="labels", graph=True, shard_rows=200)
    more = rows(spark, 50, 400, seed=6)
    index.insert(more).delete(df.where("id % 3 = 0").select("id"))
    live = df.where("id % 3 <> 0").unionByName(more)
    got = ids(index.search(Q, 20, settings=Settings(query_search_list_size=200)))
    assert len(set(got) & set(truth(live, Q, 20, "cosine"))) >= 19 and not any(k < 400 and k % 3 == 0 for k in got)
    assert index.explain(BOX).first()["graphs"] and index.explain().first()["path"] == "graph"
    assert ids(index.reindex().search(Q, 5, settings=Settings(query_search_list_size=300))) == truth(live, Q, 5, "cosine")


def test_manifests(spark, tmp_path):
    m = Manifests(spark, f"file://{tmp_path}/m")
    with pytest.raises(FileNotFoundError):
        m.read()
    first = m.commit({"a": 1})
    with pytest.raises(Conflict):
        m.commit({"a": 2})
    assert m.commit(first | {"a": 3})["version"] == 2 and m.read()["a"] == 3 and m.read(1)["a"] == 1
    assert upgraded({"format_version": 1})["options"]["storage_layout"] == "plain"
    with pytest.raises(ValueError, match="format"):
        upgraded({"format_version": 99})


def test_stream_into_an_index(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    df = rows(spark, 40)
    SpatialIndex.build(df.where("id < 10"), path)
    df.where("id >= 5").withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest(stream, path, f"{tmp_path}/cp").awaitTermination()
    assert sorted(ids(SpatialIndex(spark, path).rows())) == list(range(40))
    arrivals(stream).writeStream.format("memory").queryName("quadrill_arrivals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("quadrill_arrivals").agg(F.sum("n")).first()[0] == 35


def cloud(n, dims=6, seed=4):
    return np.random.default_rng(seed).normal(size=(n, dims))


def test_graph_links_are_bounded_and_connected():
    from quadrill.functions.metrics import Metric

    g = graphs.ShardGraph(cloud(400), None, Metric.L2, 12, 40, 1.2).build()
    assert max(map(len, g.links)) <= 12 and all(p not in x and len(set(x)) == len(x) for p, x in enumerate(g.links))
    assert g.reachable() >= 396 and g.dot().startswith("digraph")
    hits = 0
    for q in cloud(30, seed=5):
        right = set(np.argsort(((g.points - q) ** 2).sum(1))[:10].tolist())
        hits += len(right & {p for _, p in g.walk(q, 40)[:10]})
    assert hits >= 285


def test_graph_of_labels_and_small_ones():
    from quadrill.functions.metrics import Metric

    points = cloud(300)
    sets = [frozenset({k % 5, 7}) if k % 11 else frozenset() for k in range(300)]
    g = graphs.ShardGraph(points, sets, Metric.COSINE, 12, 40, 1.2).build()
    found = g.walk(points[3], 60, frozenset({2}))
    assert found and all(2 in sets[p] for _, p in found)
    assert g.walk(points[0], 10, frozenset()) == [] and g.walk(points[0], 10, frozenset({99})) == []
    same = graphs.ShardGraph(np.ones((30, 4)), None, Metric.IP, 10, 10, 1.2).build()
    assert len(same.walk(np.ones(4), 30)) >= 10
    assert graphs.ShardGraph(np.empty((0, 4)), None, Metric.L2, 10, 10, 1.2).build().walk(np.ones(4), 3) == []


def test_rescoring(spark):
    df = rows(spark, 200, null_every=9)
    for bits, dims in ((1, 0), (2, 0), (3, 5)):
        coded, coder = s.coded(df, bits=bits, dims=dims)
        code = coded.where("id = 1").first().code
        assert len(code) == coder.words == 1
        v = np.array(df.where("id = 1").first().embedding, float)[: dims or None]
        v /= np.linalg.norm(v)
        bitstring = [int(code[0]) >> k & 1 for k in range(bits * len(v))]
        for k, x in enumerate(v):
            ones = int(x > coder.means[k]) if bits == 1 else min(bits, max(0, int(np.floor(((x - coder.means[k]) / coder.deviations[k] + 2) / (4 / (bits + 1))))))
            assert bitstring[k * bits : (k + 1) * bits] == [1] * ones + [0] * (bits - ones)
        assert ids(s.rescored(coded, "code", coder, Q, 10, rescore=200, dims=dims)) == truth(df, Q, 10, "cosine")


@pytest.mark.parametrize(("metric", "bits", "dims"), [("cosine", 1, 0), ("cosine", 2, 0), ("cosine", 2, 4), ("l2", 1, 0), ("l2", 3, 0), ("l2", 2, 4), ("ip", 2, 0)])
def test_exact_rescoring_reads_what_codes_allow(spark, metric, bits, dims):
    """Ten rows rescored at first, among them none of the nearest with small vectors."""
    df = rows(spark, 400, null_every=9)
    tiny = df.where("id < 20").select(*(F.transform("embedding", lambda x: x * 1e-5).cast("array<float>").alias(c) if c == "embedding" else (F.col("id") + 1000).alias("id") if c == "id" else F.col(c) for c in df.columns))
    df = df.unionAll(tiny)
    coded, coder = s.coded(df, bits=bits, metric=metric, dims=dims)
    for query in (Q, [x * 1e-5 for x in Q], [0.0] * 8):
        right = [r.id for r in s.search(df, query, 10, metric=metric).collect()]
        assert ids(s.rescored(coded, "code", coder, query, 10, rescore=10, metric=metric, dims=dims, exact=True)) == right
