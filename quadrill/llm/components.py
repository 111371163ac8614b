"""Connected components of a large graph, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.llm.store import materialise


def _stars(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least node m of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long) to (node, root): root is the component's least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every
    round links nodes to smaller ones only, until the stars stay as they are.
    Each round is written to the shared folder, so lineage stays short. The
    minima are aggregated before they are shuffled and the joins have no need of
    a node's rows in one task, so a node with very many links can be split.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        small = _stars(down)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialise(linked.where("u <> v").distinct(), "edges")
        total = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if total == seen:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = total
    raise RuntimeError("components did not settle")
