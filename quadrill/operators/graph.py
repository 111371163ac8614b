"""Proximity graphs a shard, and search over them.

A graph is built by inserting points one after another, so rows are dealt into
shards of bounded size, each built and searched by itself; the shards' best
rows meet in one exact ranking. Exact search stays the default: a graph answers
in few steps where it lies in memory, which a batch job must first load.
"""

from __future__ import annotations

import bisect
import heapq
import io
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.functions import labels as label_sets
from quadrill.functions.boxes import Box
from quadrill.functions.metrics import Metric
from quadrill.operators.codes import index_view, viewed
from quadrill.operators.grid import FLAT, Grid
from quadrill.operators.search import search
from quadrill.plans.options import IndexOptions

SHARD_ROWS = 10_000
#: Lists may grow by this factor while the graph is built.
SLACK = 1.3
GRAPH = "shard int, id long, view array<double>, labels array<int>, neighbors array<long>, start boolean"


class ShardGraph:
    """Points, their labels and their links; label None: unlabelled."""

    def __init__(self, points: np.ndarray, labels: list[frozenset[int]] | None, metric: Metric, degree: int, list_size: int, alpha: float):
        self.points, self.labels, self.metric = points, labels, metric
        self.degree, self.list_size, self.alpha = degree, list_size, alpha
        self.links: list[list[int]] = [[] for _ in points]
        self.start: int | None = None
        self.starts: dict[int, int] = {}

    def to_query(self, q: np.ndarray, rows: Sequence[int]) -> np.ndarray:
        x = self.points[rows]
        if self.metric is Metric.L2:
            return ((x - q) ** 2).sum(axis=1)
        d = -(x @ q)
        return np.maximum(0.0, 1 + d) if self.metric is Metric.COSINE else d

    def _between(self, a: int, rows: np.ndarray) -> np.ndarray:
        """Distances for pruning: never negative, so ratios mean something for inner products too."""
        return ((self.points[rows] - self.points[a]) ** 2).sum(axis=1)

    def entries(self, wanted: frozenset[int] | None) -> list[int]:
        if wanted is None:
            return [] if self.start is None else [self.start]
        return sorted({self.starts[x] for x in wanted if x in self.starts})

    def walk(self, q: np.ndarray, list_size: int, wanted: frozenset[int] | None = None, seeds: Iterable[int] = (), inside: np.ndarray | None = None) -> list[tuple[float, int]]:
        """Best-first: expands the nearest unexpanded point until ``list_size`` nearer ones are; all expanded points, nearest first.

        Points that are not ``inside`` are steps on the way but never found.
        """
        first = list(seeds) or self.entries(wanted)
        if not first:
            return []
        seen = set(first)
        heap = list(zip(self.to_query(q, first).tolist(), first, strict=True))
        heapq.heapify(heap)
        done: list[tuple[float, int]] = []
        while heap:
            d, p = heapq.heappop(heap)
            if len(done) >= list_size and d >= done[list_size - 1][0]:
                break
            if inside is None or inside[p]:
                bisect.insort(done, (d, p))
            near = [x for x in self.links[p] if x not in seen and (wanted is None or self.labels is None or self.labels[x] & wanted)]
            seen.update(near)
            if near:
                for item in zip(self.to_query(q, near).tolist(), near, strict=True):
                    heapq.heappush(heap, item)
        return done

    def prune(self, p: int, others: Iterable[int]) -> list[int]:
        """At most ``degree`` links: near ones that no chosen link makes needless.

        A chosen i makes j needless if j is ``alpha`` times nearer to i than to p
        and i has all labels that j shares with p. alpha rises from 1 while
        links are free.
        """
        rows = np.array(sorted(set(others) - {p}), dtype=np.int64)
        if not len(rows):
            return []
        to_p = self._between(p, rows)
        order = np.argsort(to_p, kind="stable")
        rows, to_p = rows[order], to_p[order]
        shared = None if self.labels is None else [self.labels[j] & self.labels[p] for j in rows]
        worst, chosen, alpha = np.zeros(len(rows)), [], 1.0
        taken = np.zeros(len(rows), dtype=bool)
        while alpha <= self.alpha + 1e-9 and len(chosen) < self.degree:
            for k in range(len(rows)):
                if taken[k] or worst[k] > alpha * alpha:  # distances are squared
                    continue
                taken[k] = True
                chosen.append(int(rows[k]))
                if len(chosen) == self.degree:
                    break
                to_k = self._between(int(rows[k]), rows)
                # Of points in one place none makes another needless.
                ratio = np.divide(to_p, to_k, out=np.where(to_p > 0, np.inf, 1.0), where=to_k > 0)
                if shared is not None:
                    ratio = np.where([s <= self.labels[rows[k]] for s in shared], ratio, 0.0)
                worst = np.maximum(worst, ratio)
            alpha *= 1.2
        return chosen

    def insert(self, p: int) -> None:
        own = None if self.labels is None else self.labels[p]
        for x in own or ():
            self.starts.setdefault(x, p)
        if self.start is None:
            self.start = p
            return
        # A labelled point links among its labels first, then among all.
        for wanted in ([own] if own else []) + [None]:
            near = [x for _, x in self.walk(self.points[p], self.list_size, wanted)]
            self.links[p] = self.prune(p, [*near, *self.links[p]])
            for x in self.links[p]:
                if p not in self.links[x]:
                    self.links[x].append(p)
                    if len(self.links[x]) > SLACK * self.degree:
                        self.links[x] = self.prune(x, self.links[x])

    def build(self) -> ShardGraph:
        for p in range(len(self.points)):
            self.insert(p)
        for p, links in enumerate(self.links):
            if len(links) > self.degree:
                self.links[p] = self.prune(p, links)
        self.connect()
        return self

    def connect(self) -> None:
        """Let links lead to every point: pruning may have taken a point's last one.

        Such a point gets a link from the nearest point that is reached and has
        room: fewer than ``degree`` of its links are the first to reach a point.
        Only others make way, so that what is reached stays reached.
        """
        n = len(self.points)
        reached, firsts = np.zeros(n, dtype=bool), [set() for _ in range(n)]
        room = np.full(n, self.degree)

        def follow(p: int) -> None:
            reached[p], todo = True, [p]
            while todo:
                a = todo.pop()
                new = [x for x in dict.fromkeys(self.links[a]) if not reached[x]]
                reached[new] = True
                firsts[a].update(new)
                room[a] -= len(new)
                todo += new

        if self.start is not None:
            follow(self.start)
        for p in range(n):
            if not reached[p]:
                near = np.flatnonzero(reached & (room > 0))
                a = int(near[np.argmin(self._between(p, near))])
                if len(self.links[a]) >= self.degree:
                    others = np.array([x for x in self.links[a] if x not in firsts[a]])
                    self.links[a].remove(int(others[np.argmax(self._between(a, others))]))
                self.links[a].append(p)
                firsts[a].add(p)
                room[a] -= 1
                follow(p)

    def reachable(self) -> int:
        """Points that links lead to from the start."""
        if self.start is None:
            return 0
        seen, todo = {self.start}, [self.start]
        while todo:
            new = [x for x in self.links[todo.pop()] if x not in seen]
            seen.update(new)
            todo += new
        return len(seen)

    def dot(self) -> str:
        """The links in Graphviz notation."""
        return "\n".join(["digraph {", *(f"  {a} -> {b};" for a, to in enumerate(self.links) for b in to), "}"])


def build(df: DataFrame, *, id: str = "id", embedding: str = "embedding", labels: str | None = None, options: IndexOptions, dims: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a vector: its shard, what the graph sees of it, and its neighbours."""
    o = options.resolved(dims, labels is not None)
    rows = df.where(F.col(embedding).isNotNull()).select(
        F.col(id).cast("long").alias("id"), index_view(embedding, o.metric, o.num_dimensions).alias("view"), (label_sets.normalise(labels).cast("array<int>") if labels else F.lit(None).cast("array<int>")).alias("labels")
    )
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        sets = None if labels is None else [frozenset(map(int, x)) for x in pdf["labels"]]
        g = ShardGraph(np.stack(pdf["view"].to_list()), sets, o.metric, o.num_neighbors, o.search_list_size, o.max_alpha).build()
        ids = pdf["id"].to_numpy()
        firsts = set(g.starts.values()) | {g.start}
        pdf["neighbors"] = [ids[x].tolist() for x in g.links]
        pdf["start"] = [k in firsts for k in range(len(ids))]
        return pdf[["shard", "id", "view", "labels", "neighbors", "start"]]

    return rows.groupBy("shard").applyInPandas(shard, GRAPH)


def candidates(graph: DataFrame, query: Sequence[float], k: int, *, metric: Metric | str, dims: int = 0, list_size: int = 100, labels: Iterable[int] | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(id): the ``list_size`` nearest that each shard's walk finds, ``k`` at least.

    ``seeds`` (id) are where walks start instead, in shards that have one.
    """
    m, wanted = Metric.of(metric), None if labels is None else frozenset(int(x) for x in labels if x is not None)
    q = np.array(viewed(list(query), m, dims))
    rows = graph.withColumn("seed", F.lit(False)) if seeds is None else graph.join(seeds.select("id", F.lit(True).alias("seed")).distinct(), "id", "left")
    most = max(k, list_size)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids = pdf["id"].to_numpy()
        sets = [frozenset(() if x is None else map(int, x)) for x in pdf["labels"]]
        g = ShardGraph(np.stack(pdf["view"].to_list()), sets, m, 0, most, 1.0)
        g.links = [np.searchsorted(ids, x).tolist() for x in pdf["neighbors"]]
        g.start = int(np.flatnonzero(pdf["start"].to_numpy(bool))[0])
        for p in np.flatnonzero(pdf["start"].to_numpy(bool)).tolist():
            for x in sets[p]:
                g.starts.setdefault(x, p)
        from_seeds = np.flatnonzero(pdf["seed"].fillna(False).to_numpy(bool)).tolist()
        found = g.walk(q, most, wanted, from_seeds)
        return pd.DataFrame({"id": ids[[p for _, p in found]] if found else np.empty(0, np.int64)})

    return rows.groupBy("shard").applyInPandas(walk, "id long")


def search_graph(df: DataFrame, graph: DataFrame, query: Sequence[float], k: int, *, id: str = "id", embedding: str = "embedding", metric: Metric | str, dims: int = 0, list_size: int = 100, labels: Iterable[int] | None = None, seeds: DataFrame | None = None, **filters) -> DataFrame:
    """The k nearest of what the walks find, by exact distance, with every filter applied again."""
    near = candidates(graph, query, k, metric=metric, dims=dims, list_size=list_size, labels=labels, seeds=seeds).withColumnRenamed("id", "__near")
    found = df.join(near.distinct(), F.col(id) == F.col("__near"), "left_semi")
    return search(found, query, k, id=id, embedding=embedding, metric=metric, labels=labels, **filters)


#: A shard a row: its arrays in one value, which no reader splits.
SHARDS = "shard int, points long, arrays binary"
BOXED = ("xmin", "ymin", "xmax", "ymax")


def shards(df: DataFrame, *, id: str = "id", embedding: str = "embedding", labels: str | None = None, options: IndexOptions, dims: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graph of ``df`` to be stored, a shard a row, with the boxes of its points."""
    o = options.resolved(dims, labels is not None)
    rows = df.where(F.col(embedding).isNotNull()).select(
        F.col(id).cast("long").alias("id"), index_view(embedding, o.metric, o.num_dimensions).alias("view"), (label_sets.normalise(labels).cast("array<int>") if labels else F.lit(None).cast("array<int>")).alias("labels"), *BOXED
    )
    n = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        sets = None if labels is None else [frozenset(map(int, x)) for x in pdf["labels"]]
        g = ShardGraph(np.stack(pdf["view"].to_list()), sets, o.metric, o.num_neighbors, o.search_list_size, o.max_alpha).build()
        out = io.BytesIO()
        flat = {"links": g.links, "labels": [sorted(x) for x in sets or [()] * len(pdf)]}
        arrays = {name: np.array([x for own in each for x in own], dtype=np.int64) for name, each in flat.items()}
        ends = {f"{name}_ends": np.cumsum([len(own) for own in each]) for name, each in flat.items()}
        np.savez(out, ids=pdf["id"].to_numpy(), points=g.points, boxes=pdf[list(BOXED)].to_numpy(), start=g.start, starts=np.array(sorted(g.starts.items()), dtype=np.int64).reshape(-1, 2), labelled=sets is not None, **arrays, **ends)
        return pd.DataFrame({"shard": [pdf["shard"][0]], "points": [len(pdf)], "arrays": [out.getvalue()]})

    return rows.groupBy("shard").applyInPandas(shard, SHARDS)


def loaded(data: bytes, metric: Metric) -> tuple[ShardGraph, np.ndarray, np.ndarray]:
    """The graph, the ids and the boxes of a stored shard."""
    a = np.load(io.BytesIO(data))
    split = lambda name: [x.tolist() for x in np.split(a[name], a[f"{name}_ends"][:-1])]
    g = ShardGraph(a["points"], [frozenset(x) for x in split("labels")] if a["labelled"] else None, metric, 0, 0, 1.0)
    g.links, g.start, g.starts = split("links"), int(a["start"]), dict(a["starts"].tolist())
    return g, a["ids"], a["boxes"]


def walked(stored: DataFrame, query: Sequence[float], k: int, *, metric: Metric | str, dims: int = 0, list_size: int = 100, labels: Iterable[int] | None = None, box: Box | None = None, grid: Grid | None = None, seeds_a_cell: int = 2) -> DataFrame:
    """(id): what a walk through each stored shard finds; each task reads its shards, nothing is shuffled.

    With a ``box`` only points that overlap it are found, and with a ``grid``
    walks start from ``seeds_a_cell`` points of every cell that the box reaches.
    """
    m, wanted = Metric.of(metric), None if labels is None else frozenset(int(x) for x in labels if x is not None)
    q, most = np.array(viewed(list(query), m, dims)), max(k, list_size)

    def walk(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for data in batch["arrays"]:
                g, ids, boxes = loaded(data, m)
                inside, seeds = None, ()
                if box is not None:
                    whole = (boxes[:, 0] <= boxes[:, 2]) & (boxes[:, 1] <= boxes[:, 3])
                    inside = whole & (boxes[:, 0] <= box.xmax) & (boxes[:, 2] >= box.xmin) & (boxes[:, 1] <= box.ymax) & (boxes[:, 3] >= box.ymin)
                    if grid is not None:
                        seeds = _seeds(np.flatnonzero(inside), boxes, grid, seeds_a_cell)
                    if not inside.any():
                        continue
                if wanted is not None and g.labels is not None:
                    seeds = [p for p in seeds if g.labels[p] & wanted]
                yield pd.DataFrame({"id": ids[[p for _, p in g.walk(q, most, wanted, seeds, inside)]].astype(np.int64)})

    return stored.select("arrays").mapInPandas(walk, "id long")


def _seeds(rows: np.ndarray, boxes: np.ndarray, grid: Grid, a_cell: int) -> list[int]:
    """Rows that stand for the cells of their centres: ``a_cell`` of each at even steps."""
    if not len(rows):
        return []
    x, y = (boxes[rows, 0] + boxes[rows, 2]) / 2, (boxes[rows, 1] + boxes[rows, 3]) / 2
    at = lambda v, low, high, n: np.clip(np.floor((v - low) / max(high - low, FLAT) * n), 0, n - 1).astype(np.int64)
    cell = at(y, grid.ymin, grid.ymax, grid.rows) * grid.cols + at(x, grid.xmin, grid.xmax, grid.cols)
    order = np.argsort(cell, kind="stable")
    out: list[int] = []
    for own in np.split(rows[order], np.flatnonzero(np.diff(cell[order])) + 1):
        out += own[np.unique(np.arange(a_cell) * len(own) // a_cell)].tolist()
    return out
