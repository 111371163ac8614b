"""A stored index: base rows, grid postings, overflow and tombstones.

Everything is Parquet below one folder, and nothing is ever changed in place: a
manifest names the files of a version. Base rows are clustered by grid cell
with flat box columns, so that a box query skips most row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrill.functions import labels as label_sets
from quadrill.functions.boxes import Box, Columns
from quadrill.operators import graph as graphs
from quadrill.operators import grid as grids
from quadrill.operators.codes import Coder
from quadrill.operators.grid import Grid
from quadrill.operators.search import filtered, rescored, search
from quadrill.plans.cost import Path, route, scan_work, startup_share
from quadrill.plans.options import IndexOptions, Settings
from quadrill.sources.manifest import Manifests

#: Columns that the index adds to base rows.
OWN = ("__code", "__seq", "__cell")


class SpatialIndex:
    """An index over (id, embedding, four box columns, labels) and any other columns."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.manifests = Manifests(spark, path)
        self.manifest = self.manifests.read(version)
        self.options = IndexOptions(**self.manifest["options"])
        self.grid = Grid(**self.manifest["grid"])
        coder = self.manifest.get("coder")
        self.coder = coder and Coder(tuple(coder["means"]), tuple(coder["deviations"]), coder["bits"])
        self.labels = self.manifest.get("labels")

    # Writing

    @classmethod
    def build(cls, df: DataFrame, path: str, options: IndexOptions | None = None, *, labels: str | None = None, graph: bool = False, shard_rows: int = graphs.SHARD_ROWS) -> SpatialIndex:
        """Write an index of the rows of ``df`` that have a vector.

        With ``graph`` (ids must be whole numbers) searches without a box, or
        with one of many candidates, walk through stored graphs of
        ``shard_rows`` points and are approximate.
        """
        spark, rows = df.sparkSession, df.where(F.col("embedding").isNotNull())
        first = rows.select(F.size("embedding").alias("n")).take(1)
        dims = first[0]["n"] if first else 1
        o = (options or IndexOptions()).resolved(dims, labels is not None)
        grid, coder = Grid.of(rows), None
        if o.storage_layout != "plain" and first:
            coder = Coder.trained(rows, "embedding", o.metric, o.num_dimensions, o.num_bits_per_dimension)
        manifest = {
            "options": o.asdict(), "dims": dims, "grid": grid.asdict(), "labels": labels, "seq": 0, "base": [], "postings": [], "overflow": [], "overflow_rows": 0, "tombstones": [], "graph": [], "graph_seq": 0, "schemas": {},
            "coder": coder and {"means": coder.means, "deviations": coder.deviations, "bits": coder.bits},
        }
        manifests = Manifests(spark, path)
        prepared = cls._prepared(rows, manifest, grid, coder)
        base = cls._write(prepared, path, "base", "__cell")
        stored = spark.read.schema(prepared.schema).parquet(base)
        listed = grid.postings(stored, "id")
        manifest |= {"base": [base], "postings": [cls._write(listed, path, "postings", "cell")], "schemas": {"base": prepared.schema.json(), "postings": listed.schema.json()}}
        if graph and first:
            to = f"{path}/graph/{uuid.uuid4().hex}"
            graphs.shards(stored, labels=labels, options=o, dims=dims, shard_rows=shard_rows).write.parquet(to)
            manifest["graph"] = [to]
        manifests.commit(manifest)
        return cls(spark, path)

    @staticmethod
    def _prepared(rows: DataFrame, manifest: dict, grid: Grid, coder: Coder | None) -> DataFrame:
        o, at = IndexOptions(**manifest["options"]), Columns.named()
        out = rows
        if manifest["labels"]:
            out = out.withColumn(manifest["labels"], label_sets.normalise(manifest["labels"]))
        dims = manifest["dims"]
        right = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector does not have {dims} components")).cast("array<float>"))
        out = out.withColumn("embedding", right)
        code = coder.code("embedding", o.metric, o.num_dimensions) if coder else F.lit(None).cast("array<bigint>")
        cell = F.when(~at.empty(), grid.point_cell((at.xmin + at.xmax) / 2, (at.ymin + at.ymax) / 2))
        return out.withColumns({"__code": code, "__seq": F.lit(manifest["seq"]).cast("long"), "__cell": cell})

    @staticmethod
    def _write(df: DataFrame, path: str, kind: str, by: str) -> str:
        to = f"{path}/{kind}/{uuid.uuid4().hex}"
        df.repartitionByRange(F.col(by).asc_nulls_last(), F.xxhash64("id")).sortWithinPartitions(F.col(by).asc_nulls_last()).write.parquet(to)
        return to

    def _commit(self, **changes) -> SpatialIndex:
        self.manifests.commit(self.manifest | changes)
        self.__init__(self.spark, self.path)
        return self

    def _inserted(self, df: DataFrame) -> dict:
        """Write rows and their postings; what a manifest says of them."""
        rows, seq = df.where(F.col("embedding").isNotNull()), self.manifest["seq"] + 1
        prepared = self._prepared(rows, self.manifest | {"seq": seq}, self.grid, self.coder)
        base = self._write(prepared, self.path, "base", "__cell")
        over = self._write(self.grid.postings(self.spark.read.schema(prepared.schema).parquet(base), "id"), self.path, "overflow", "cell")
        n = self.manifest["overflow_rows"] + self.spark.read.parquet(over).count()
        schemas = dict(self.manifest.get("schemas") or {})
        if "base" in schemas:
            known = T.StructType.fromJson(json.loads(schemas["base"]))
            new = [f for f in prepared.schema.fields if f.name not in known.names]
            schemas["base"] = T.StructType([*known.fields, *new]).json()
        return {"seq": seq, "base": [*self.manifest["base"], base], "overflow": [*self.manifest["overflow"], over], "overflow_rows": n, "schemas": schemas}

    def _buried(self, ids: DataFrame) -> dict:
        to = f"{self.path}/tombstones/{uuid.uuid4().hex}"
        ids.select(F.col("id"), F.lit(self.manifest["seq"]).cast("long").alias("upto")).distinct().write.parquet(to)
        return {"tombstones": [*self.manifest["tombstones"], to]}

    def _settled(self, settings: Settings | None) -> SpatialIndex:
        limit = (settings or Settings.of(self.spark)).spatial_overflow_compact_threshold
        return self.compact() if self.manifest["overflow_rows"] >= limit else self

    def insert(self, df: DataFrame, settings: Settings | None = None, *, compact: bool = True) -> SpatialIndex:
        """Add rows; their postings go to the overflow, by the grid as it is, until a compaction.

        An overflow of ``spatial_overflow_compact_threshold`` rows is compacted
        at once, unless ``compact`` is False: then the grid stays as it was.
        """
        new = self._commit(**self._inserted(df))
        return new._settled(settings) if compact else new

    def delete(self, ids: DataFrame) -> SpatialIndex:
        """Bury the rows of ``ids`` (id) that the index has now; postings keep counting them until a compaction."""
        return self._commit(**self._buried(ids))

    def update(self, df: DataFrame, settings: Settings | None = None) -> SpatialIndex:
        """Replace rows by id, in one version; a row whose new vector is null is only removed."""
        return self._commit(**self._buried(df.select("id")), **self._inserted(df))._settled(settings)

    def compact(self) -> SpatialIndex:
        """New grid, postings and, unless they are one folder of live rows, base rows; nothing is left in the overflow or buried."""
        live, changes = self.rows(), {}
        grid = Grid.of(live)
        if len(self.manifest["base"]) > 1 or self.manifest["tombstones"]:
            at = Columns.named()
            cell = F.when(~at.empty(), grid.point_cell((at.xmin + at.xmax) / 2, (at.ymin + at.ymax) / 2))
            changes = {"base": [self._write(live.withColumn("__cell", cell), self.path, "base", "__cell")], "tombstones": []}
            live = self.spark.read.schema(live.schema).parquet(*changes["base"])
        postings = self._write(grid.postings(live, "id"), self.path, "postings", "cell")
        return self._commit(grid=grid.asdict(), postings=[postings], overflow=[], overflow_rows=0, **changes)

    def vacuum(self) -> SpatialIndex:
        """Compact if anything is in the overflow; files never shrink."""
        return self.compact() if self.manifest["overflow_rows"] else self

    def reindex(self) -> SpatialIndex:
        """Rewrite all: live rows only, a new coder, new graphs, one file set."""
        o, rows = self.options, self.rows().drop(*OWN)
        fresh = SpatialIndex.build(rows, f"{self.path}/rebuilt/{uuid.uuid4().hex}", o, labels=self.labels, graph=bool(self.manifest.get("graph")))
        keep = ("grid", "coder", "base", "postings", "graph", "graph_seq", "schemas")
        return self._commit(**{k: fresh.manifest[k] for k in keep}, seq=0, overflow=[], overflow_rows=0, tombstones=[])

    # Reading

    def _all(self, kind: str) -> DataFrame | None:
        """All files of a kind, by one read whose schema the manifest knows."""
        paths, schema = self.manifest[kind], (self.manifest.get("schemas") or {}).get("postings" if kind == "overflow" else kind)
        if paths and schema:
            return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths)
        parts = [self.spark.read.parquet(p) for p in paths]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def rows(self) -> DataFrame:
        """Live rows, with the index's own columns."""
        base, dead = self._all("base"), self._all("tombstones")
        if dead is None:
            return base
        last = dead.groupBy(F.col("id").alias("__id")).agg(F.max("upto").alias("__upto"))
        return base.join(last, (F.col("id") == F.col("__id")) & (F.col("__seq") <= F.col("__upto")), "left_anti")

    def postings(self) -> DataFrame:
        """Postings of the grid and of the overflow, a row and cell once; dead rows too."""
        over = self._all("overflow")
        base = self._all("postings")
        return base if over is None else base.unionByName(over).distinct()

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Live rows by id, without the index's own columns."""
        return self.rows().join(ids.select("id").distinct(), "id", "left_semi").drop(*OWN)

    def candidates(self, box: Box) -> int:
        return grids.candidate_count(self.postings(), self.grid, box).first()["candidates"]

    def path_of(self, box: Box | None, settings: Settings | None = None) -> Path:
        s = settings or Settings.of(self.spark)
        return route(None if box is None else self.candidates(box), s.spatial_brute_force_threshold)

    def search(self, query: Sequence[float] | None, k: int | None = 20, *, box: Box | None = None, labels: Iterable[int] | None = None, where=None, settings: Settings | None = None, path: Path | None = None) -> DataFrame:
        """The k nearest live rows under all filters, by the path that the candidates ask for.

        Brute force looks at the rows that the postings of the box name, and no
        others. The other paths rank all rows that the filters leave by their
        vectors, exactly, unless the index has graphs or ``query_rescore`` is
        set. With graphs, shards are walked (from seeds of the box's cells if
        there is one) and what the walks find is ranked, together with rows that
        came after the graphs. With ``query_rescore`` above 0 and codes, rows
        are ranked by codes first: the narrow code column is all that most rows
        need to be read for.
        """
        s = settings or Settings.of(self.spark)
        chosen = path or self.path_of(box, s)
        rows = self.rows()
        if labels is not None and not self.labels:
            raise ValueError("the index has no labels")
        if chosen is Path.BRUTE and box is not None and not box.empty and self.path_of(box, s) is Path.BRUTE:
            # As many ids as the threshold allows, and a row once a cell at most.
            named = self.postings().where(self.grid.within(box)).select("id")
            rows = rows.join(F.broadcast(named), "id", "left_semi")
        by_graph = chosen is not Path.BRUTE and self.manifest.get("graph") and query is not None and k is not None
        if by_graph:
            near = self._walked(chosen, query, k, box, labels, s).distinct()
            new = rows.where(F.col("__seq") > self.manifest["graph_seq"])
            rows = rows.join(near, "id", "left_semi").where(F.col("__seq") <= self.manifest["graph_seq"]).unionByName(new)
        exact = by_graph or chosen is Path.BRUTE or not self.coder or query is None or k is None or not s.query_rescore
        o, own = self.options, {"box": box, "labels": labels, "label_column": self.labels or "labels", "where": where}
        if exact:
            found = search(rows, query, k, metric=o.metric, **own)
        else:
            some = filtered(rows, **own)
            dims = 0 if o.num_dimensions == self.manifest["dims"] else o.num_dimensions
            found = rescored(some, "__code", self.coder, query, k, rescore=max(s.query_rescore, s.query_search_list_size), metric=o.metric, dims=dims)
            found = found.drop("code_distance")
        return found.drop(*OWN)



    def _walked(self, path: Path, query: Sequence[float], k: int, box: Box | None, labels: Iterable[int] | None, s: Settings) -> DataFrame:
        o, stored = self.options, self.spark.read.schema(graphs.SHARDS).parquet(*self.manifest["graph"])
        dims = 0 if o.num_dimensions == self.manifest["dims"] else o.num_dimensions
        grid = self.grid if path is Path.HYBRID else None
        return graphs.walked(stored, query, k, metric=o.metric, dims=dims, list_size=s.query_search_list_size, labels=labels, box=box, grid=grid, seeds_a_cell=s.spatial_seeds_per_cell)

    def explain(self, box: Box | None = None, k: int = 20, settings: Settings | None = None) -> DataFrame:
        """One row on how a search would go: path, rows, candidates, the work expected, files to read."""
        s, n = settings or Settings.of(self.spark), self.rows().count()
        candidates = None if box is None else self.candidates(box)
        work = scan_work(n, None if candidates is None else candidates / max(n, 1), k, s.query_search_list_size, s.spatial_brute_force_threshold)
        row = (route(candidates, s.spatial_brute_force_threshold).value, n, candidates, float(work.tuples), startup_share(work.tuples, n), len(self.manifest["base"]), len(self.manifest["tombstones"]), self.manifest["overflow_rows"], bool(self.manifest.get("graph")))
        return self.spark.createDataFrame([row], "path string, rows long, candidates long, work double, startup double, folders int, tombstones int, overflow long, graphs boolean")
